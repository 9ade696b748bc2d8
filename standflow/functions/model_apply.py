"""Batch models over array columns, in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A loader runs once per task and returns the model: arrays in, arrays out, one row each.
Model = Callable[[dict[str, np.ndarray]], Mapping[str, np.ndarray]]
ModelLoader = Callable[[], Model]


def dense(column: pa.Array, dtype: str) -> np.ndarray:
    """Rows of equal-length (nested) lists as one array; scalars as a vector. Nulls and rows of
    different length are errors: values would move from row to row."""
    shape = [len(column)]
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        lengths = pc.unique(pc.list_value_length(column))
        if len(lengths) > 1 or lengths.null_count:
            raise ValueError(f"arrays of one length expected, not of {lengths.to_pylist()}")
        inner = column.flatten()
        shape.append(len(inner) // max(len(column), 1))
        column = inner
    if column.null_count:
        raise ValueError("null among the model's inputs")
    return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(shape)


def apply_model(
    df: DataFrame,
    load_model: ModelLoader,
    inputs: Sequence[str],
    outputs: Mapping[str, int],
    drop: Sequence[str] = (),
    dtype: str = "float32",
    best: int | None = None,
) -> DataFrame:
    """Append one array column per model output (`outputs` maps name to length). Input columns
    listed in `drop` do not travel back. With `best`, an output is an array of that many structs
    (i, p): index and value of the largest values, the lower index on ties, NaN last."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    item = (
        T.DoubleType()
        if best is None
        else T.StructType([T.StructField("i", T.IntegerType()), T.StructField("p", T.DoubleType())])
    )
    schema = T.StructType(kept + [T.StructField(n, T.ArrayType(item, False)) for n in outputs])
    names = [f.name for f in kept]

    def run(batches):
        model = load_model()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            result = model({n: dense(columns[n], dtype) for n in inputs})
            arrays = [columns[n] for n in names]
            for name, size in outputs.items():
                values = np.asarray(result[name], dtype="float64").reshape(batch.num_rows, size)
                if best is None:
                    flat, width = pa.array(values.ravel()), size
                else:
                    order = np.argsort(-values, axis=1, kind="stable")[:, :best]
                    flat, width = pa.StructArray.from_arrays(
                        [pa.array(order.ravel().astype("int32")),
                         pa.array(np.take_along_axis(values, order, axis=1).ravel())],
                        names=["i", "p"],
                    ), order.shape[1]
                offsets = np.arange(0, len(flat) + 1, width, dtype="int32")
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *outputs])

    return df.mapInArrow(run, schema)
