"""Scans: named tables, text and Arrow files, and dimensions kept in file names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

MISSING = "NA"

# File names are `<species>_<decade>_<scenario>.<extension>`.
FILE_PATTERNS = {
    "species": r"(\w*)_[0-9]{4}-[0-9]{4}_",
    "decade": r"_([0-9]{4}-[0-9]{4})_",
    "scenario": r"_[0-9]{4}-[0-9]{4}_([-\w]*)[.]",
}
FILE_SUFFIX = "_all_grids_v8"


def union_tables(
    spark: SparkSession, tables: Mapping[str, DataFrame] | None = None, pattern: str = "simulation"
) -> DataFrame:
    """All tables whose name contains the pattern, stacked, with the name in `source_table`.
    Without `tables` the session catalog is searched. Missing columns become null."""
    if tables is None:
        tables = {
            t.name: spark.table(t.name) for t in spark.catalog.listTables() if pattern in t.name
        }
    named = [
        df.withColumn("source_table", F.lit(n)) for n, df in sorted(tables.items()) if pattern in n
    ]
    if not named:
        raise ValueError(f"no table name contains {pattern!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_table(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A catalog table or a parquet path, columns and types as in the schema."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df if schema is None else typed(df, schema)


def scan_by_id_list(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the id table; chunks of the scan are Spark partitions."""
    return df.join(ids.select(key).distinct(), [key], "left_semi").select(*df.columns)


def read_csv_table(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """CSV with a header and quotes written twice inside a field; `NA` and empty fields are null. A
    field that does not fit its type, or a row of another width, is an error. Line breaks inside
    fields need `multi_line`, which reads each file in one task."""
    return spark.read.schema(schema).csv(
        path, header=True, escape='"', nullValue=MISSING, multiLine=multi_line, mode="FAILFAST"
    )


def read_delim_per_key(
    spark: SparkSession, glob: str, key_regex: str, schema: T.StructType, key: str = "species"
) -> DataFrame:
    """Files with a header and fields parted by runs of blanks, one per key; the key is cut from
    the file path. Fields may be quoted; `NA` is null. A row with one field more than the schema
    starts with its row name, which is left out; a row of any other width is an error."""
    # one column: the CSV reader is there to leave out the header of each file
    lines = spark.read.schema("line string").csv(glob, sep="\u0001", quote="", header=True)
    n = len(schema.fields)
    tokens = F.regexp_extract_all("line", F.lit(r"""("[^"]*"|'[^']*'|\S+)"""), F.lit(1))
    width = F.size("tokens")
    surplus = F.raise_error(F.concat(F.lit(f"not {n} fields: "), F.col("line")))
    rows = (
        lines.select(
            "line", tokens.alias("tokens"),
            F.regexp_extract("_metadata.file_path", key_regex, 1).alias("key"),
        )
        .where(width > 0)
        .withColumn("first", F.when(width == n, 0).when(width == n + 1, 1).otherwise(surplus))
    )

    def field(i: int) -> Column:
        token = F.regexp_replace(F.get("tokens", F.col("first") + i), r"""^["']|["']$""", "")
        return F.when(token != MISSING, token)

    return rows.select(
        *[field(i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)],
        F.col("key").alias(key),
    )


def ingest_arrow_files(
    spark: SparkSession, glob: str, schema: T.StructType, batches_per_task: int = 16
) -> DataFrame:
    """Feather (Arrow IPC) files as one table. Footers are read first and the list of record batches
    is written to the shared folder; it is then dealt to tasks of about `batches_per_task`, so a
    large file is read by many."""
    names = [f.name for f in schema.fields]

    def footers(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, local = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
                with system.open_input_file(local) as f:
                    n = pa.ipc.open_file(f).num_record_batches
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32())],
                    names=["path", "batch"],
                )

    def bodies(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for path, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, local = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
                with system.open_input_file(local) as f:
                    body = pa.ipc.open_file(f).get_batch(i).select(names)
                yield from pa.Table.from_batches([body]).cast(target).to_batches()

    # only the path is selected, so file contents are not loaded here
    paths = spark.read.format("binaryFile").load(glob).select("path")
    parts = materialise(paths.mapInArrow(footers, "path string, batch int"), "batches")
    # a given number of partitions is not coalesced
    tasks = -(-parts.count() // batches_per_task)
    return parts.repartition(max(tasks, 1), "path", "batch").mapInArrow(bodies, schema)


def read_parquet_set(spark: SparkSession, glob: str) -> DataFrame:
    """A glob of parquet files as one dataset, without rows that hold a null."""
    return spark.read.parquet(glob).dropna()


def scenario_of(name: Column, suffix: str = FILE_SUFFIX) -> Column:
    scenario = F.regexp_extract(name, FILE_PATTERNS["scenario"], 1)
    return F.regexp_replace(scenario, f"{suffix}$", "")


def parse_file_dimensions(
    df: DataFrame, path_col: str = "path", suffix: str = FILE_SUFFIX
) -> DataFrame:
    """Species, decade, scenario and kind (`prep`, `pred` or `raw`) from a file path; paths that
    do not match are dropped."""
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    species = F.regexp_extract(name, FILE_PATTERNS["species"], 1)
    return (
        df.where(name.rlike(r"\w*_[0-9]{4}-[0-9]{4}_[-\w]*[.]"))
        .withColumn("species", F.regexp_replace(species, "^(prep|pred)_", ""))
        .withColumn("decade", F.regexp_extract(name, FILE_PATTERNS["decade"], 1))
        .withColumn("scenario", scenario_of(name, suffix))
        .withColumn(
            "kind",
            F.when(name.startswith("prep_"), "prep")
            .when(name.startswith("pred_"), "pred")
            .otherwise("raw"),
        )
    )


def read_dimension_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """First word of each line of a list file; blank lines and `#` comments are skipped."""
    word = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0))
    return (
        spark.read.text(path)
        .select(word.alias(name))
        .where((F.col(name) != "") & ~F.col(name).startswith("#"))
    )


def dimension_grid(
    spark: SparkSession, dims: Mapping[str, Sequence[str]], inputs: DataFrame | None = None
) -> DataFrame:
    """All combinations of the listed dimension values, or the inputs that lie in that grid. The
    inputs are filtered per dimension, so the product is never built for them."""
    if inputs is not None:
        for name, values in dims.items():
            inputs = inputs.where(F.col(name).isin(*values))
        return inputs
    grid = spark.range(1).select()
    for name, values in dims.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid
