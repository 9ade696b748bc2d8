"""Sinks. Each returns what a reader of the written data sees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_location

PREDICTION_KEYS = ("species", "decade", "scenario", "init_state")


def write_table_overwrite(df: DataFrame, name: str) -> DataFrame:
    """Replace a parquet path or a catalog table."""
    spark = df.sparkSession
    if "/" in name:
        df.write.mode("overwrite").parquet(name)
        return spark.read.schema(df.schema).parquet(name)
    df.write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def write_csv_result(df: DataFrame, path: str) -> DataFrame:
    """CSV with a header; quotes inside a field are written twice, and an empty text reads back as
    null. Each task writes a file of its own, so reading back file by file (fields may hold line
    breaks) stays parallel."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')
    return df.sparkSession.read.schema(df.schema).csv(
        path, header=True, escape='"', multiLine=True, mode="FAILFAST"
    )


def write_partitioned_dataset(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """One folder per key combination; only folders that get new rows are replaced. Rows are
    rebalanced by key: small combinations share a task, adaptive execution splits a large one."""
    (
        df.hint("rebalance", *[F.col(k) for k in keys])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_predictions(
    df: DataFrame, path: str, keys: Sequence[str] = PREDICTION_KEYS
) -> DataFrame:
    """Predictions by input and initial state; the dimensions become partition columns."""
    return write_partitioned_dataset(df, path, keys)


def write_arrow_files(df: DataFrame, path: str) -> DataFrame:
    """One Arrow IPC file per partition, written by the tasks as batches arrive; returns file names
    and row counts. A task that is run again replaces its own file."""
    location = arrow_location(df.sparkSession, path)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(location)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.arrow"
        writer, rows = None, 0
        with system.open_output_stream(name) as out:
            for batch in batches:
                writer = writer or pa.ipc.new_file(out, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
            (writer or pa.ipc.new_file(out, pa.schema([]))).close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], ["file", "rows"])

    return df.mapInArrow(write, "file string, rows bigint")
