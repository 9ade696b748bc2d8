"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 8

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = (
    "the be to of and that have with is in a for on it as "
    "der die das und in zu den von mit ist ein eine nicht im auf "
    "le la les de des et en un une du que qui est dans pour "
    "el los las y por con se del una es no lo su"
).split()

# metric, its least and its largest value (None: no bound). A document fails outside.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("repeat_ratio", None, 0.3),
    ("mean_word_length", 2, 15),
    ("symbol_ratio", None, 0.1),
    ("stop_words", 2, None),
    ("duplicate_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
    ("letter_word_ratio", 0.7, None),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words inside windows that occur twice or more in the text."""
    n = F.size(words)
    hashes = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))),
            lambda i: F.xxhash64(F.slice(words, i, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<long>"))

    def covered(h: Column) -> Column:
        numbered = F.array_sort(
            F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        )

        def twice(s: Column) -> Column:
            return F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda e, j: (e["x"].eqNullSafe(F.get(s, j - 1)["x"]))
                        | (e["x"].eqNullSafe(F.get(s, j + 1)["x"])),
                    ),
                    lambda e: e["i"],
                )
            )

        def length(places: Column) -> Column:
            steps = F.transform(
                places,
                lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))),
            )
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(numbered, twice), length)
        )

    return let(hashes, covered)


def _counts(text: Column, words: Column, lines: Column) -> Column:
    stop = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
    letters = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated(words).cast("long").alias("n_repeat_words"),
        stop.alias("stop_words"),
        letters.alias("letter_words"),
        F.size(lines).alias("lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).alias("bullets"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).alias("ellipses"),
    )


def _metric(m: Column, name: str) -> Column:
    """The metrics of the rules, from the counts. A ratio of nothing is null and passes."""

    def ratio(a: str, b: str) -> Column:
        return F.when(m[b] > 0, m[a] / m[b])

    return {
        "n_words": lambda: m["n_words"],
        "repeat_ratio": lambda: ratio("n_repeat_words", "n_words"),
        "mean_word_length": lambda: ratio("word_chars", "n_words"),
        "symbol_ratio": lambda: ratio("n_symbols", "n_words"),
        "stop_words": lambda: m["stop_words"],
        "duplicate_line_ratio": lambda: ratio("n_dup_lines", "lines"),
        "bullet_line_ratio": lambda: ratio("bullets", "lines"),
        "ellipsis_line_ratio": lambda: ratio("ellipses", "lines"),
        "letter_word_ratio": lambda: ratio("letter_words", "n_words"),
    }[name]()


def quality(text: Column, rules=RULES) -> Column:
    """A struct: the counts, base_failed, kept, and the names of the rules that failed."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NO_SPACE))

    def judged(m: Column) -> Column:
        failed = F.filter(
            F.array(*[
                F.when(
                    reduce(
                        lambda a, b: a | b,
                        ([_metric(m, name) < low] if low is not None else [])
                        + ([_metric(m, name) > high] if high is not None else []),
                    ),
                    name,
                )
                for name, low, high in rules
            ]),
            lambda x: x.isNotNull(),
        )
        base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        return F.struct(
            *[m[c].alias(c) for c in
              ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            base.alias("base_failed"),
            (~base & (F.size(failed) == 0)).alias("kept"),
            F.array_join(failed, ",").alias("failed"),
        )

    counts = let(
        F.struct(text.alias("t"), words_of(text).alias("w"), lines.alias("l")),
        lambda s: _counts(s["t"], s["w"], s["l"]),
    )
    return let(counts, judged)


def quality_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES
) -> DataFrame:
    """One row per row of `docs`: id, counts, base_failed, kept, failed (names of the rules, joined
    by commas). Null or empty text: no words, base_failed. Whole texts; a long text is one row.
    Other columns are not read; empty table: no rows."""
    judged = docs.select(F.col(id_col), quality(F.col(text_col), rules).alias("q"))
    return judged.select(id_col, "q.*")


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass all rules, columns unchanged."""
    return docs.where(quality(F.col(text_col), rules)["kept"])
