"""Ranked lexical search: exact inner products, found through ball trees.

A document is a sparse vector of saturated term frequencies, an item one of term weights, both whole
numbers. Documents are dealt into blocks of about `BLOCK_POSTINGS` terms, whatever their ids, so no
key is hot and a block fits a task. A block meets the items in one group, keeps the terms that some
item uses, builds a ball tree over its documents and searches it for every item (`ball_tree.py`). A
sixteenth of the blocks go first: the last of the best scores found there is a floor under which
no document of the other blocks can be among an item's best, so most of their subtrees are never
opened. The floors only save work: every block is searched for every item.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from standflow.session import materialise

from .ball_tree import BallTree, Rows

BEST = 50
BLOCK_POSTINGS = 1_000_000
CHUNK_ITEMS = 10_000  # items that meet a block at once
FIRST = 16  # one of so many blocks goes first

# ASCII letters and digits, and everything beyond ASCII, as UTF-8 bytes after lower-casing A-Z
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

_FOUND = "item_no long, item_id long, row long, id long, score long"


def term_counts(text: str | None) -> Counter:
    """Terms of a text and how often each occurs; null has none. `bytes.lower` changes A-Z only."""
    return Counter(_TERM.findall(text.encode().lower())) if text else Counter()


def with_terms(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per row of `df`: `row` (a number of its own), `id`, `n` (terms with repeats),
    `terms` and `counts` (aligned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [term_counts(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([sum(c.values()) for c in found], pa.int64()),
                        pa.array([[t.decode() for t in c] for c in found], pa.list_(pa.string())),
                        pa.array([list(c.values()) for c in found], pa.list_(pa.int32())),
                    ],
                    names=["row", "id", "n", "terms", "counts"],
                )

    picked = df.select(
        F.monotonically_increasing_id().alias("row"), "id", F.col(text_col).alias("text")
    )
    return picked.mapInArrow(
        run, "row long, id long, n long, terms array<string>, counts array<int>"
    )


def _item_vectors(docs: DataFrame, items: DataFrame, n_docs: int) -> DataFrame:
    """(item_no, item_id, terms, weights) over the terms that some document has."""
    terms = items.select("row", "id", F.explode("terms").alias("term"))
    wanted = terms.select("term").distinct()
    frequency = (
        docs.select(F.explode("terms").alias("term"))
        .join(wanted, ["term"], "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    ratio = F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)
    weight = F.floor(1000 * F.log(ratio)).cast("long")
    return (
        terms.join(frequency.select("term", weight.alias("w")), ["term"])
        .groupBy(F.col("row").alias("item_no"), F.col("id").alias("item_id"))
        .agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("v"))
        .select("item_no", "item_id", F.col("v.term").alias("terms"), F.col("v.w").alias("weights"))
    )


def _vectors(docs: pa.Table, vocabulary: pa.Array, n_docs: int, n_terms: int) -> Rows:
    """The documents of a block over the given terms; those with none of them are left out. Ids
    are places in the block."""
    docs = docs.combine_chunks()
    terms = docs.column("terms").chunk(0)
    size = np.diff(terms.offsets.to_numpy())
    at = pc.index_in(terms.flatten(), value_set=vocabulary)
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    row_of = np.repeat(np.arange(len(docs)), size)[known]
    columns = at.drop_null().to_numpy().astype(np.int64)
    tf = docs.column("counts").chunk(0).flatten().to_numpy()[known].astype(np.int64)
    n = docs.column("n").to_numpy()
    m = 50 + 50 * n * n_docs // n_terms
    values = 1_000_000_000 * tf // (1000 * tf + 20 * m[row_of])
    places, starts = np.unique(row_of, return_index=True)
    return Rows(places, np.append(starts, len(row_of)), columns, values)


def _search_blocks(docs: DataFrame, items: DataFrame, n_docs: int, n_terms: int, best: int):
    """For each item its best documents of each block, not below `floor`. The tree's ids are the
    places of a block's documents in the order of their ids."""
    schema = pa.schema([(c, pa.int64()) for c in ("item_no", "item_id", "row", "id", "score")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls last
            right = right.combine_chunks()
            terms = right.column("terms").chunk(0)
            coded = terms.flatten().dictionary_encode()
            block = _vectors(left, coded.dictionary, n_docs, n_terms)
            tree = BallTree(block, len(coded.dictionary))
            columns, begins = coded.indices.to_numpy(), terms.offsets.to_numpy()
            weights = right.column("weights").chunk(0).flatten().to_numpy()
            floors = right.column("floor").to_pylist()
            names = left.select(["row", "id"])
            for i, (no, item) in enumerate(
                zip(right.column("item_no").to_pylist(), right.column("item_id").to_pylist())
            ):
                span = slice(begins[i] - begins[0], begins[i + 1] - begins[0])
                places, scores = tree.search(columns[span], weights[span], best, floors[i])
                if len(places):
                    part = names.take(pa.array(places))
                    part = part.append_column("score", pa.array(scores, pa.int64()))
                    part = part.append_column("item_no", pa.array([no] * len(places), pa.int64()))
                    found.append(
                        part.append_column("item_id", pa.array([item] * len(places), pa.int64()))
                    )
        if not found:
            return schema.empty_table()
        return pa.concat_tables(found).select(schema.names)

    by = ["block", "chunk"]
    return docs.groupBy(*by).cogroup(items.groupBy(*by)).applyInArrow(run, _FOUND)


def search(
    documents: DataFrame,
    items: DataFrame,
    best: int = BEST,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """The `best` documents of each item: item_id, rank, doc_id, score; equal scores by ascending
    doc_id, documents without an id last.

    Every row of `documents` is a document, whatever its id; every row of `items` is an item, so
    a repeated item_id has a ranking per row. Rows without a term (null, empty) neither count nor are
    found; an item that no document shares a term with has no rows. Other columns are ignored, texts
    are read whole. Two tables are written to the shared folder: the documents' terms and the best
    of the first blocks."""
    docs = materialise(
        with_terms(documents.select(F.col(doc_id).cast("long").alias("id"), text), text)
        .where(F.col("n") > 0),
        "terms",
    )
    wanted = materialise(
        with_terms(items.select(F.col(item_id).cast("long").alias("id"), text), text)
        .where(F.col("n") > 0),
        "items",
    )
    total = docs.agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"),
        F.sum(F.size("terms")).alias("postings"),
    ).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    blocks = max(1, -(-(total["postings"] or 0) // block_postings))
    vectors = materialise(_item_vectors(docs, wanted, n_docs), "item_vectors")
    chunks = max(1, -(-vectors.count() // CHUNK_ITEMS))

    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = docs.withColumn("block", deal("row", blocks)).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )

    asked = vectors.withColumn("chunk", deal("item_no", chunks))

    def at_blocks(first: bool, asked: DataFrame) -> DataFrame:
        here = lambda df: df.where((F.col("block") % FIRST == 0) == first)
        # the stated items against all documents, block by block
        spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return _search_blocks(here(dealt), here(spread), n_docs, n_terms, best)

    found = at_blocks(True, asked.withColumn("floor", F.lit(1).cast("long")))
    if blocks > 1:
        found = materialise(found, "first_blocks")
        by_score = Window.partitionBy("item_no").orderBy(F.desc("score"))
        floors = (
            found.withColumn("place", F.row_number().over(by_score))
            .where(F.col("place") == best)
            .select("item_no", F.col("score").alias("floor"))
        )
        rest = asked.join(floors, ["item_no"], "left").fillna(1, ["floor"])
        found = found.unionByName(at_blocks(False, rest))
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= best)
        .select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
    )
