"""Secret scans with a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: every match contains one of some
strings, and so all trigrams of it. The index lists, for the trigrams of these queries, the
documents they occur in; its postings are combined per document, and a rule's pattern runs over its
candidates only. A rule without mandatory trigrams runs over every document.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

MAX_STRINGS = 24
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """`pattern` is read alike by Python and Java. Matches are leftmost and do not overlap; a match
    counts if the group has `least` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: kinds and patterns; the first three are the base
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

Query = list[frozenset[str]]  # all of: one of these strings


def _strings(items) -> tuple[set[str] | None, Query]:
    """What a sequence of parsed items matches: all strings, if few, and a query."""
    exact: set[str] | None = {""}
    query: Query = []

    def close():
        nonlocal exact
        if exact and all(len(s) >= 3 for s in exact):
            query.append(frozenset(s.lower() for s in exact))
        exact = {""}

    complete = True
    for op, arg in items:
        name = str(op)
        more: set[str] | None = None
        inner: Query = []
        if name == "LITERAL":
            more = {chr(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            more = {chr(a) for _, a in arg}
        elif name == "SUBPATTERN":
            more, inner = _strings(arg[3])
        elif name == "BRANCH":
            parts = [_strings(p) for p in arg[1]]
            if all(p[0] is not None for p in parts):
                more = set().union(*[p[0] for p in parts])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = arg
            once, inner = _strings(body)
            if once is not None and int(most) == 1:
                more = once | {""}
            elif once is not None and least == most and least <= 8:
                more = {"".join([s] * least) for s in once} if len(once) == 1 else None
            if least == 0:
                inner = []
        if more is not None and exact is not None and len(exact) * len(more) <= MAX_STRINGS:
            exact = {a + b for a in exact for b in more}
            continue
        complete = False
        query += inner
        close()
        if more is not None and len(more) <= MAX_STRINGS:
            exact = more
    whole = exact if complete else None
    if not complete:
        close()
    return whole, query


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of: any of: sets of trigrams that must all occur, in lower case. Empty: no condition."""
    whole, query = _strings(sre.parse(pattern))
    if whole is not None and all(len(s) >= 3 for s in whole):
        query = [*query, frozenset(s.lower() for s in whole)]
    return [
        sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in one}, key=sorted)
        for one in query
    ]


def trigram_index(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """Postings (trigram, id) of the given trigrams in lower-cased texts."""
    grams = F.array(*[F.lit(t) for t in trigrams])
    # the text is lower-cased once, not once per trigram
    found = let(F.lower(text_col), lambda low: F.filter(grams, lambda t: F.contains(low, t)))
    return docs.select("id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """(id, kinds): the rules whose query the postings of a document fulfil."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for one in q for s in one for t in s})
    # at most all trigrams of the rules per document
    postings = trigram_index(docs, trigrams, text_col).groupBy("id").agg(
        F.collect_set("trigram").alias("trigrams")
    )

    def holds(query) -> Column:
        def every(s: frozenset[str]) -> Column:
            need = F.array(*[F.lit(t) for t in sorted(s)])
            return F.size(F.array_intersect("trigrams", need)) == len(s)

        anys = [reduce(lambda a, b: a | b, [every(s) for s in one]) for one in query]
        return reduce(lambda a, b: a & b, anys)

    kinds = F.array_compact(
        F.array(*[F.when(holds(q), k) for k, q in queries.items() if q])
    )
    return postings.select("id", kinds.alias("kinds")).where(F.size("kinds") > 0)


_SPAN = "struct<start:int,rule:int,end:int,first:int,stop:int>"  # code points, then bytes
_PIECE = 256


def _running(values: Column, start: Column, join) -> Column:
    """What comes before each value: `join` of `start` and all earlier ones. Arrays are built per
    piece and then per array of pieces, as appending to one array copies what it holds."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(_PIECE)),
        lambda at: F.slice(values, at + 1, _PIECE),
    )

    def scan(items: Column, of) -> Column:
        empty = F.slice(F.array(start), 1, 0)
        return F.aggregate(
            items,
            F.struct(start.alias("last"), empty.alias("before")),
            lambda acc, x: F.struct(
                join(acc["last"], of(x)).alias("last"),
                F.concat(acc["before"], F.array(acc["last"])).alias("before"),
            ),
        )

    def whole(inner: Column) -> Column:
        outer = scan(inner, lambda x: x["last"])["before"]
        return F.flatten(
            F.zip_with(inner, outer, lambda x, o: F.transform(x["before"], lambda v: join(o, v)))
        )

    return let(F.transform(pieces, lambda piece: scan(piece, lambda x: x)), whole)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, rule, end) of a rule's matches, in code points, end exclusive, and the same
    in bytes. Every text piece is touched a fixed number of times, however many matches there are."""
    pattern = F.lit(rule.pattern)

    def sizes(x: Column) -> Column:
        return F.struct(
            (F.length(x["before"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("n"),
            (F.octet_length(x["before"]) + F.coalesce(F.octet_length(x["m"]), F.lit(0))).alias("b"),
        )

    def add(x: Column, y: Column) -> Column:
        return F.struct((x["n"] + y["n"]).alias("n"), (x["b"] + y["b"]).alias("b"))

    def span(x: Column, at: Column) -> Column:
        start, first = at["n"] + F.length(x["before"]), at["b"] + F.octet_length(x["before"])
        return F.struct(
            start.alias("start"),
            F.lit(number).alias("rule"),
            (start + F.length(x["m"])).alias("end"),
            first.alias("first"),
            (first + F.octet_length(x["m"])).alias("stop"),
        )

    def placed(matches: Column) -> Column:
        nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"))
        before = let(F.transform(matches, sizes), lambda v: _running(v, nothing, add))
        pairs = F.arrays_zip(matches.alias("x"), before.alias("at"))
        counted = F.filter(pairs, lambda p: F.length(p["x"]["g"]) >= rule.least)
        return F.transform(counted, lambda p: span(p["x"], p["at"])).cast(f"array<{_SPAN}>")

    matches = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g"),
        # one piece more than there are matches
        F.split(text, rule.pattern, -1).alias("before"),
    )
    return F.when(text.rlike(rule.pattern), let(matches, placed)).otherwise(_none())


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _quick(rule: Rule) -> Rule:
    """Short matches of a single repeated class never count, so the pattern can ask for the length:
    a run that is long enough is the same match, a shorter one is none."""
    m = re_class(rule.pattern)
    if m and rule.group == 0:
        return Rule(rule.kind, f"{m}{{{rule.least},}}", 0, rule.least)
    return rule


def re_class(pattern: str) -> str | None:
    items = list(sre.parse(pattern))
    if len(items) == 1 and str(items[0][0]) == "MAX_REPEAT" and pattern.endswith("]+"):
        body = list(items[0][1][2])
        if len(body) == 1 and str(body[0][0]) == "IN" and pattern.startswith("["):
            return pattern[:-1]
    return None


def _with_spans(
    docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...], name: str
) -> DataFrame:
    """All rows and columns, and the spans of all rules, sorted, under a name of its own."""
    low = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # rows travel as one struct, so that no name of theirs meets a name of the index
    found = candidates(low, rules)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(found, F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")), "left")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    arrays = []
    for number, rule in enumerate(rules):
        spans = _spans(text, _quick(rule), number)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(_none())
        arrays.append(spans)
    return joined.select("row", F.array_sort(F.concat(*arrays)).alias(name))


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """All rows of `docs` with all columns, and `spans`: array of (start, rule, end), sorted, where
    rule is the rule's number. Null text: no spans. Rows of one id share their index entry, which
    only widens the candidates; null ids are one id. A column named `spans` is replaced. The work
    grows with the length of a text and its matches, not with their product."""
    found = _with_spans(docs, id_col, text_col, rules, "spans")
    public = F.transform("spans", lambda s: F.struct(s["start"], s["rule"], s["end"]))
    others = [c for c in docs.columns if c != "spans"]
    return found.select(*[F.col(f"row.`{c}`") for c in others], public.alias("spans"))


def _written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def _number_of(rule: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rule"] == rule))


def secret_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    base: int = len(BASE_RULES),
) -> DataFrame:
    """id, n_<kind> of the base rules, base_sha256 and spans (kind:start:end by start, then kind)."""
    found = find_secrets(docs.select(id_col, text_col), id_col, text_col, rules)
    own = F.filter("spans", lambda s: s["rule"] < base)
    return found.select(
        id_col,
        *[
            _number_of(i).cast("long").alias(f"n_{r.kind}")
            for i, r in enumerate(rules[:base])
        ],
        F.sha2(_written(own, rules), 256).alias("base_sha256"),
        _written(F.col("spans"), rules).alias("spans"),
    )


def mask_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    mask: str = MASK,
) -> DataFrame:
    """All rows and columns, with `mask` in place of each secret (overlapping ones: one mask).
    Columns of any name are kept as they are. The pieces between secrets are cut by bytes, which
    takes no search from the text's beginning."""
    text = F.col(f"row.`{text_col}`")

    def masked(spans: Column, whole: Column) -> Column:
        stops = F.transform(spans, lambda s: s["stop"])
        done = let(stops, lambda v: _running(v, F.lit(0), F.greatest))
        both = F.arrays_zip(spans.alias("s"), done.alias("done"))
        apart = F.filter(both, lambda x: x["s"]["first"] >= x["done"])
        pieces = F.transform(
            apart,
            lambda x: F.substring(whole, x["done"] + 1, x["s"]["first"] - x["done"]).cast("string"),
        )
        last = F.array_max(stops)
        rest = F.substring(whole, last + 1, F.octet_length(whole) - last).cast("string")
        return F.array_join(F.concat(pieces, F.array(rest)), mask)

    found = _with_spans(docs, id_col, text_col, rules, "spans")
    # a cast to bytes copies the text, so it is made once
    with_bytes = let(text.cast("binary"), lambda whole: masked(F.col("spans"), whole))
    new = F.when(F.size("spans") > 0, with_bytes).otherwise(text)
    return found.select(
        *[
            (new if c == text_col else F.col(f"row.`{c}`")).alias(c)
            for c in docs.columns
        ]
    )
