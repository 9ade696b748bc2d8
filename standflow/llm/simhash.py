"""SimHash near-duplicates: pigeonhole blocks, then Hamming distances.

64-bit fingerprints that differ in at most `distance` bits agree on at least `blocks - distance` of
`blocks` blocks. Every choice of that many blocks is one join key: with 6 blocks and distance 3,
20 keys of about 32 bits, so that keys met by chance stay few up to some 10^9 different
fingerprints; take more blocks beyond. Within a key all fingerprints are compared, in tiles of
bounded size when a key holds many; what leaves a tile is a spanning forest of its links, so the
number of rows grows with the fingerprints and not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standflow.session import materialise

from .components import connected_components

SEED = 42
TILE = 1024


def fingerprint(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text (shingle hashes up to each end), the bits set in over half of its hashes."""
    out = np.zeros(len(ends), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    begin = 0
    for i, end in enumerate(ends.tolist()):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(begin, end, 1 << 16):
            part = hashes[at : min(at + (1 << 16), end)].astype("<u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * ones > end - begin].sum() if end > begin else 0
        begin = end
    return out


def shingle_hashes(text: str | None, size: int) -> list[int]:
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    data = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(data, SEED)] if words else []
    begins, at = [], 0
    for w in words:
        begins.append(at)
        at += len(w) + 1
    ends = [b - 1 for b in begins[size:]] + [len(data)]
    digest = xxhash.xxh64_intdigest
    return [digest(data[i:j], SEED) for i, j in zip(begins, ends)]


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """(id, fp long) per row. No words: fingerprint zero."""
    return _prints(docs, F.col(id_col).cast("long"), text_col, shingle)


def _prints(docs: DataFrame, id: Column, text_col: str, shingle: int) -> DataFrame:
    """(id, fp), where id is any column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                each = [shingle_hashes(t, shingle) for t in part.column(1).to_pylist()]
                ends = np.cumsum([len(x) for x in each])
                hashes = np.concatenate([np.array(x, dtype=np.uint64) for x in each])
                fps = fingerprint(hashes, ends).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["id", "fp"])

    picked = docs.select(id.alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([picked.schema["id"], T.StructField("fp", T.LongType())])
    return picked.mapInArrow(run, schema)


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks (as signed longs) of every choice of blocks on which close fingerprints agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable index per index."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (rows sorted by key): each fingerprint with the first of
    its group."""
    n = len(fp)
    change = np.flatnonzero(key[1:] != key[:-1]) + 1
    stops = np.append(change, n)
    stop = np.repeat(stops, np.diff(np.concatenate(([0], stops))))
    at, a, b = np.arange(n), [], []
    for step in range(1, n):
        at = at[at + step < stop[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        a.append(near)
        b.append(near + step)
    if not a:
        return fp[:0], fp[:0]
    root = _roots(n, np.concatenate(a), np.concatenate(b))
    moved = root != np.arange(n)
    return fp[moved], fp[root[moved]]


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for last in (False, True):
            for batch in batches if not last else (None,):
                if batch is not None:
                    rest_key = np.append(rest_key, batch.column(0).to_numpy())
                    rest_fp = np.append(rest_fp, batch.column(1).to_numpy().view(np.uint64))
                # the last run may go on in the next batch
                stop = len(rest_key) if last else int(np.searchsorted(rest_key, rest_key[-1:])[0])
                u, v = _forest(rest_key[:stop], rest_fp[:stop], distance)
                rest_key, rest_fp = rest_key[stop:], rest_fp[stop:]
                u, v = u.view(np.int64), v.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def links(
    fps: DataFrame, distance: int = 3, blocks: int = 6, tile: int = TILE
) -> DataFrame:
    """(u, v): links that join all different fingerprints (column fp) within `distance` bits, a
    spanning forest per key and tile."""
    masks = block_masks(blocks, distance)
    keys = fps.select(
        "fp",
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
                for i, m in enumerate(masks)
            ])
        ).alias("key"),
    ).select("fp", "key.*")
    on = ["mask", "part"]
    sizes = keys.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles)
    dealt = (
        keys.join(sizes, on)
        .select("fp", *on, own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("to"))
        .select(
            # a run is one pair of tiles of one key; a clash of hashes only adds comparisons
            F.xxhash64(*on, F.least("own", "to"), F.greatest("own", "to")).alias("run"),
            "fp",
        )
    )
    return (
        dealt.repartition("run")
        .sortWithinPartitions("run")
        .mapInArrow(_links(distance), "u long, v long")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 3,
    blocks: int = 6,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id (the smallest id
    reachable over links of at most `distance` differing bits).

    Texts are lower-cased (A-Z), cut into words at the six ASCII space characters and shingled;
    fewer words than a shingle are one shingle; no words (null, empty): fingerprint zero, linked
    like any other. A null id is no candidate for component_id, which is null where a component has
    no other; rows of one id are rows of their own. Empty table: no rows. Other columns are not
    read. Runs jobs for the stages it writes to the shared folder."""
    grouped = _components(docs, id_col, text_col, shingle, distance, blocks, tile)
    return grouped.select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def _components(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int, blocks: int, tile: int
) -> DataFrame:
    """(id, fp, component_id, root) per row; root is the component's smallest fingerprint."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(classes.select("fp"), distance, blocks, tile))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = materialise(
        rooted.join(groups, "root").select("fp", "component_id", "root"), "components"
    )
    return prints.join(of_fp, "fp").select("id", "fp", "component_id", "root")


def keep_one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 3,
    blocks: int = 6,
    tile: int = TILE,
) -> DataFrame:
    """One row of each component of `docs`, columns unchanged: that of the smallest id.

    Where several rows of a component have that id, the smallest row (by its columns) stays. Rows
    of one id in different components are told apart by their fingerprints. A row without an id
    stays only if no row of its component has one."""
    return keep_firsts(
        docs,
        _components(docs, id_col, text_col, shingle, distance, blocks, tile),
        lambda rows, id: _prints(rows, id, text_col, shingle),
        id_col,
    )


def keep_firsts(
    docs: DataFrame,
    grouped: DataFrame,
    prints: Callable[[DataFrame, Column], DataFrame],
    id_col: str,
) -> DataFrame:
    """The rows to keep by `grouped` (id, fp, component_id, root); `prints` gives (id, fp) of rows,
    where id is any column."""
    first = F.col("id").eqNullSafe(F.col("component_id"))
    ids = (
        grouped.groupBy(F.col("id").alias("of_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(first).alias("is_first"))
        .where("is_first")
    )
    # a row as one column: no name of its own can meet a name of this function
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    rows = rows.join(ids, F.col("doc")[id_col].cast("long").eqNullSafe(F.col("of_id")))
    single = rows.where("n = 1").select("doc.*")
    # of an id that several rows have, the fingerprint tells which row is which
    shared = prints(rows.where("n > 1").select("doc.*"), F.struct(*docs.columns)).select(
        F.col("id").alias("doc"), "fp", F.col("id")[id_col].cast("long").alias("doc_id")
    )
    firsts = grouped.where(first).join(
        ids.where("n > 1"), F.col("id").eqNullSafe(F.col("of_id"))
    ).select("of_id", F.col("fp").alias("of_fp"), "root").distinct()
    several = (
        shared.join(
            firsts,
            (F.col("fp") == F.col("of_fp")) & F.col("doc_id").eqNullSafe(F.col("of_id")),
        )
        .groupBy("of_id", "root")
        .agg(F.min("doc").alias("doc"))
        .select("doc.*")
    )
    return single.unionByName(several)
