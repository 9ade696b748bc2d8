"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

The merges of a rank file are compiled, on demand, into a deterministic machine over bytes. The
encoding of a prefix ends in one token only: the longest that is compatible with the token before
it (two tokens are compatible if their joined bytes encode to just these two). A state of the
machine holds, for each place in the text from which some token can still grow, how far it has
grown and the tokens up to there; tokens that all of these agree on are certain and are emitted, so
the lookahead never exceeds the longest token. States and moves are made when first met and
forgotten when there are too many; every text goes through them. The token that all paths begin
with is left out of a state once no path ends in it, as nothing is joined to it any more.

A text of any length is encoded piece by piece between spaces; what is kept between texts (machine,
known pre-tokens, known pairs) is bounded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_STATES = 200_000  # some 100 MB with their moves
MAX_KNOWN = 200_000  # pre-tokens of up to MAX_KEPT characters, twice some 40 MB
MAX_PIECES = 300_000  # between spaces, likewise
MAX_KEPT = 256
MAX_PAIRS = 200_000
START = ROOT = 0


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """token: rank, from a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class Transducer:
    """Bytes in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        # all beginnings of tokens: node << 8 | byte -> node
        self.child: dict[int, int] = {}
        self.token: list[int | None] = [None]  # that ends at a node
        self.grows = bytearray(1)  # whether a longer token goes on from a node
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                self.grows[node] = 1
                key = node << 8 | byte
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.token)
                    self.token.append(None)
                    self.grows.append(0)
            self.token[node] = rank
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.halves = lru_cache(maxsize=None)(self._halves)  # one entry per token at most
        self._reset()

    def _reset(self) -> None:
        start = ((ROOT, (None,)),)
        self.numbers = {start: START}
        self.states = [start]
        # state << 8 | byte -> state after it, ids that have become certain
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merge(self, data: bytes, parts_left: int = 1) -> list[bytes]:
        """Merge the pair of lowest rank until none, or this number of parts, is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > parts_left:
            pairs = [self.ranks.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:])]
            least = min(pairs)
            if least == 1 << 62:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for a single byte or a token that merging
        does not reach."""
        parts = self.merge(self.tokens[token], 2)
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def compatible(self, before: int | None, token: int) -> bool:
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[before, token] = self._compatible(before, token)
        return known

    def _compatible(self, before: int | None, token: int) -> bool:
        """Whether no merge ever joins the two. Undo their merges from the last to the first, along
        the seam; the tokens at the seam join if their merge comes before the next one undone."""
        if before is None:
            return len(self.merge(self.tokens[token])) == 1
        left, right, until = before, token, 1 << 62
        tokens, ranks = self.tokens, self.ranks
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < until:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            # on equal ranks the left one is merged first, so the right one is undone first
            if b is None or (a is not None and left > right):
                until, left = left, a[1]
            else:
                until, right = right + 1, b[0]

    def _make_move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        child, ends, grows = self.child, self.token, self.grows
        last, kept = None, []
        for node, path in self.states[state]:  # from the longest
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if last is None:
                token = ends[node]
                if token is not None and self.compatible(path[-1], token):
                    last = path + (token,)
            if grows[node]:
                kept.append((node, path))
        assert last is not None, "no token for this byte"
        certain = self._agreed(last, kept)
        kept.append((ROOT, last))
        if certain:
            kept = [(node, path[certain:]) for node, path in kept]
        if kept[-1][1][0] is not None and all(len(path) > 1 for _, path in kept):
            # nothing will be joined to the first token of all any more
            kept = [(node, (None, *path[1:])) for node, path in kept]
        new = tuple(kept)
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
        move = self.moves[state << 8 | byte] = (number, last[1 : certain + 1])
        return move

    @staticmethod
    def _agreed(last: tuple, kept: list) -> int:
        """How many tokens after the first all paths have in common."""
        certain = 0
        for token in last[1:]:
            for _, path in kept:
                if len(path) <= certain + 1 or path[certain + 1] != token:
                    return certain
            certain += 1
        return certain

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > MAX_STATES:
            self._reset()
        known, state, out = self.moves.get, START, []
        for byte in data:
            move = known(state << 8 | byte)
            if move is None:
                move = self._make_move(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        out += self.states[state][-1][1][1:]  # the tokens up to the end
        return out


_SPACE_AFTER_SPACE = (  # the characters of \s, for Arrow's pattern matcher
    "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] "
)
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def split_at_spaces(text: str) -> tuple[str, list[str]]:
    """The text before the first cut, and the pieces after: cuts lie before single spaces that
    follow something else, where no pre-token of the pattern can reach across. Pieces are given
    without their leading space."""
    first, *rest = _BEFORE_SPACE.split(text)
    return first, [p[1:] for p in rest]


def _strings(values: pa.Array) -> list[str]:
    """As `to_pylist`, by one split instead of a call per value."""
    lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    out = pc.binary_join(lists, "\0")[0].as_py().split("\0")
    # a value may hold the separator; no values are joined to one empty text
    return out if len(values) and len(out) == len(values) else values.to_pylist()


class PieceEncoder:
    """Texts to arrays of ids, each different piece and pre-token once.

    `learn(pre_tokens)` gives the ids of each, as bytes of `dtype`. Of two generations of known
    pre-tokens the older one is forgotten when the younger is full; what is met again is young.
    So it is with known pieces, which are looked up first and are cut into pre-tokens only if new."""

    def __init__(self, pattern: str, dtype: str):
        self.find, self.dtype = regex.compile(pattern).findall, np.dtype(dtype)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # without the space before them
        self.known_pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def learn(self, pre_tokens: list[str]) -> Iterable[bytes]:
        raise NotImplementedError

    def _ids(self, parts: list[list[str] | tuple[str, ...]]) -> list[bytes]:
        wanted = set(chain.from_iterable(parts))
        new = wanted.difference(self.known)
        if new and len(self.known) + len(new) > MAX_KNOWN:
            self.known, self.older, new = {}, self.known, wanted
        known, older = self.known, self.older
        again = new.intersection(older)
        known.update((p, older[p]) for p in again)
        new = sorted(new - again)  # equal beginnings share their moves
        known.update(zip(new, self.learn(new)))
        ids = [known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p]) for p in parts]
        for p in new:
            if len(p) > MAX_KEPT:
                del known[p]
        return ids

    def _after_space(self, pieces: list[str]) -> list[bytes]:
        """Ids of the pieces, all different, each with the space before it."""
        ids = [*map(self.known_pieces.get, pieces)]
        lacking = [at for at, x in enumerate(ids) if x is None]
        older = self.older_pieces
        for at in lacking:
            ids[at] = older.get(pieces[at])
        new = [at for at in lacking if ids[at] is None]
        for at, x in zip(new, self._new_pieces([pieces[at] for at in new])):
            ids[at] = x
        if len(self.known_pieces) + len(lacking) > MAX_PIECES:
            self.known_pieces, self.older_pieces = {}, self.known_pieces
            lacking = range(len(pieces))
        self.known_pieces.update(
            (pieces[at], ids[at]) for at in lacking if len(pieces[at]) <= MAX_KEPT
        )
        return ids

    def _new_pieces(self, pieces: list[str]) -> list[bytes]:
        parts, find = [], self.find
        for p in pieces:
            if p.isalpha():  # the two common cases need no pattern
                parts.append((" " + p,))
            elif p[-1:] in (",", ".") and p[:-1].isalpha():
                parts.append((" " + p[:-1], p[-1]))
            else:
                parts.append(find(" " + p))
        return self._ids(parts)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """One array per text; null is the empty text."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _SPACE_AFTER_SPACE).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, " ")
        begins, pieces = split.offsets.to_numpy(), split.flatten()
        coded = pieces.dictionary_encode()
        ids = self._after_space(_strings(coded.dictionary))
        size = np.array([*map(len, ids)], dtype=np.int32) // self.dtype.itemsize
        at = np.cumsum(size, dtype=np.int32) - size
        flat = np.frombuffer(b"".join(ids), dtype=self.dtype)
        which = coded.indices.to_numpy()
        lengths = size[which]
        lengths[begins[:-1]] = 0  # no space before the first piece of a text
        ends = np.zeros(len(lengths) + 1, dtype=np.int32)  # a batch has less than 2^31 ids
        np.cumsum(lengths, out=ends[1:])
        place = np.repeat(at[which] - ends[:-1], lengths)
        place += np.arange(ends[-1], dtype=np.int32)
        flat = flat[place]
        stops = ends[begins].tolist()
        firsts = self._ids([*map(self.find, pieces.take(pa.array(begins[:-1])).to_pylist())])
        for i, first in enumerate(firsts):
            if odd[i]:
                yield self._one(texts[i].as_py())
            else:
                rest = flat[stops[i] : stops[i + 1]]
                yield np.concatenate((np.frombuffer(first, self.dtype), rest))

    def _one(self, text: str) -> np.ndarray:
        first, rest = split_at_spaces(text)
        distinct = list(dict.fromkeys(rest))
        ids = dict(zip(distinct, self._after_space(distinct)))
        data = [*self._ids([self.find(first)]), *map(ids.__getitem__, rest)]
        return np.frombuffer(b"".join(data), dtype=self.dtype)


class Encoder(PieceEncoder):
    """Text to token ids: every match of the pattern on its own, through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(pattern, "<i4")
        self.transducer = Transducer(ranks)

    def learn(self, pre_tokens: list[str]) -> Iterator[bytes]:
        encode, dtype = self.transducer.encode, self.dtype
        return (np.array(encode(p.encode()), dtype).tobytes() for p in pre_tokens)


class Utf8Stream:
    """Bytes in pieces, text out: holds back the bytes of a character that is not complete.

    The state is the number of bytes still missing; only the last three bytes of a piece can
    start such a character, so only these go through the machine."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end belong to an incomplete character."""
        missing = seen = 0
        for byte in data[-3:]:
            if byte < 0x80:
                missing = seen = 0
            elif byte < 0xC0:
                missing, seen = (missing - 1, seen + 1) if missing else (0, 0)
            else:
                missing, seen = (1 if byte < 0xE0 else 2 if byte < 0xF0 else 3), 1
            if not missing:
                seen = 0
        return seen

    def push(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._open(data)
        self.held = data[cut:]
        return data[:cut].decode()

    def close(self) -> None:
        if self.held:
            raise ValueError("the ids end inside a character")


class Decoder:
    def __init__(self, ranks: dict[bytes, int], chunk: int = 1 << 14):
        self.tokens = {r: t for t, r in ranks.items()}
        self.chunk = chunk

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        stream, token = Utf8Stream(), self.tokens.__getitem__
        for at in range(0, len(ids), self.chunk):
            yield stream.push(b"".join(map(token, ids[at : at + self.chunk].tolist())))
        stream.close()

    def decode(self, ids: list[int]) -> str:
        return "".join(self.stream(np.array(ids, np.int64)))


def small_batches(
    batches: Iterable[pa.RecordBatch], size: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes, or one row."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids"
) -> DataFrame:
    """All columns, and the token ids (array<int>) of the whole text; null text: no ids. An
    existing column of the name `ids_col` is replaced. `ranks_path` is a file every executor has."""
    docs = docs.drop(ids_col)
    return _with_column(
        docs, text_col, ids_col, "array<int>",
        lambda: Encoder(load_ranks(ranks_path), pattern).encode,
    )


def decode_documents(
    docs: DataFrame, ranks_path: str, ids_col: str = "ids", text_col: str = "decoded"
) -> DataFrame:
    """All columns, and the text of the ids; null or no ids: the empty text."""
    docs = docs.drop(text_col)
    return _with_column(
        docs, ids_col, text_col, "string",
        lambda: partial(_decode_all, Decoder(load_ranks(ranks_path))),
    )


def _decode_all(decoder: Decoder, ids: pa.Array) -> Iterator[str]:
    return (decoder.decode(i or []) for i in ids.to_pylist())


def _with_column(docs, source: str, name: str, kind: str, load) -> DataFrame:
    spark = docs.sparkSession
    added = spark.createDataFrame([], f"`{name}` {kind}").schema.fields[0]
    schema = T.StructType([*docs.schema.fields, added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        make = load()
        for part in small_batches(batches):
            values = make(part.column(part.schema.get_field_index(source)))
            made = pa.array(list(values), type=to_arrow_type(added.dataType))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, made], names=[*part.schema.names, name]
            )

    return docs.mapInArrow(run, schema)


def _round_trips(
    encoder: Encoder, decoder: Decoder, texts: pa.Array
) -> Iterator[tuple[np.ndarray, str]]:
    """Ids of each text, and the SHA-256 of what they decode to."""
    for ids in encoder.encode(texts):
        decoded = hashlib.sha256()
        for s in decoder.stream(ids):
            decoded.update(s.encode())
        yield ids, decoded.hexdigest()


def encode_checked(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text"
) -> DataFrame:
    """All columns but the text, `ids` (array<int>) of the whole text, and `decoded_sha256` of what
    they decode to, in one pass of one Python worker. Columns of these names are replaced; null
    text: no ids; rows of equal or null id are rows of their own."""
    docs = docs.drop("ids", "decoded_sha256")
    rest = [c for c in docs.columns if c != text_col]
    kept = docs.select(*rest, text_col)
    added = "ids array<int>, decoded_sha256 string"
    schema = T.StructType([
        *kept.schema.fields[:-1], *docs.sparkSession.createDataFrame([], added).schema.fields
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        encoder, decoder = Encoder(ranks, pattern), Decoder(ranks)
        for part in small_batches(batches, 2 << 20):
            ids, digests = [], []
            for i, d in _round_trips(encoder, decoder, part.column(len(rest))):
                ids.append(i)
                digests.append(d)
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:-1],
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
                    pa.array(digests, pa.string()),
                ],
                names=[*rest, "ids", "decoded_sha256"],
            )

    return kept.mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode each whole text, decode the ids again, and return id, n_tokens, the SHA-256 of the
    decimal ids joined by one space and that of the decoded bytes, in one pass. Null text: empty.
    Rows of equal or null id are rows of their own; empty table: no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        encoder, decoder = Encoder(ranks, pattern), Decoder(ranks)
        decimal = {i: str(i) for i in ranks.values()}.__getitem__
        for batch in small_batches(batches):
            rows = []
            for ids, decoded in _round_trips(encoder, decoder, batch.column(1)):
                written = hashlib.sha256(" ".join(map(decimal, ids.tolist())).encode())
                rows.append((len(ids), written.hexdigest(), decoded))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()),
                 pa.array(b, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(
        run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
