"""DataFrame operators, one module per stage of a study."""
