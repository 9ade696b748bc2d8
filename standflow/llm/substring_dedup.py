"""Substring dedup: words covered by a window that also starts in an earlier document.

Super-k-mer partitioning: consecutive windows that share a minimiser travel as one packed string to
the minimiser's bucket (see `passages`), where the windows are unpacked and sorted, and runs of equal
windows counted exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .passages import HOT, Entries, Plan, Text, repeated_passages


def _read(text: str | None) -> Text:
    # bytes.split() cuts at the six ASCII space characters and at nothing else
    words = (text or "").encode().split()
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(length) + np.arange(len(words))
    symbols = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return Text(symbols, b" ".join(words), ends - length, ends)


def smaller_documents(e: Entries, window: int) -> np.ndarray:
    """Bits of the windows that also start in a document of smaller id."""
    bits = np.zeros(len(e.strings), dtype=np.uint64)
    everything = e.all_windows()
    firsts: dict[bytes, int] = {}
    alike: list[tuple[int, int]] = []  # repeats of a string in its first document
    for i in np.lexsort((e.place, e.doc)).tolist():
        first = firsts.setdefault(e.strings[i], i)
        if e.doc[first] != e.doc[i]:
            bits[i] = everything[i]
        elif first != i:
            alike.append((i, first))
    windows: list[tuple[bytes, int, int, int]] = []
    for s, i in firsts.items():
        o, n, doc = int(e.offset[i]), int(e.count[i]), int(e.doc[i])
        cut = [0, *[j + 1 for j, c in enumerate(s) if c == 32], len(s) + 1] if n > 1 else None
        for j in range(n):
            w = s if cut is None else s[cut[j] : cut[j + window] - 1]
            windows.append((w, doc, i, o - j))
    windows.sort()
    last, smallest = None, None
    for w, doc, i, bit in windows:
        if w != last:
            last, smallest = w, doc
        elif doc != smallest:
            bits[i] |= np.uint64(1 << bit)
    for i, first in alike:
        bits[i] = bits[first]
    return bits


def _report(text: Text, removed: np.ndarray) -> tuple:
    words = text.data.split()
    kept = b" ".join([w for w, r in zip(words, removed.tolist()) if not r])
    return len(words), int(removed.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()


def remove_repeated_windows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    hot: int = HOT,
) -> DataFrame:
    """Remove each word covered by `window` consecutive words that also start in a document with a
    smaller id. Windows are judged on the input.

    Words are runs of anything but the six ASCII space characters. Returns id, n_words, n_removed,
    kept_sha256 and the kept words joined by one space. Null text: no words. Null id: larger than
    any other. Rows of one id never remove each other's words. Empty table: no rows. Other columns
    are not read."""
    plan = Plan(
        window=window, k=max(window - 31, window // 4, 1), read=_read,
        resolve=lambda e: smaller_documents(e, window), report=_report, within_document=False,
        hot=hot, schema="n_words long, n_removed long, kept_sha256 string, kept string",
    )
    return repeated_passages(docs, id_col, text_col, plan)
