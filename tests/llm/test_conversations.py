import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from standflow.llm import conversations as conv
from standflow.llm.turn_repair import Machine, Repair

SCHEMA = "conv_id long, turn long, role string, text string, edit string, content int, position int"
MAY = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(turns):
    """(cost, audit) from the end of the conversation; turns are (initial, fault)."""

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        offers = []
        if i == len(turns):
            if last in ("", "a"):
                offers.append((0, ""))
        else:
            initial, fault = turns[i]
            offers.append(add(2, "D", best(i + 1, last, 0)))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if initial and initial in MAY[last]:
                    offers.append(add(extra, "K", best(i + 1, initial, 0)))
                for r in "ua":
                    if r in MAY[last]:
                        offers.append(add(1 + extra, "R", best(i + 1, r, 0)))
        if inserted < 3:
            for r in "ua":
                if r in MAY[last]:
                    offers.append(add(5, "I", best(i, r, inserted + 1)))
        return min(offers, default=(10**9, ""))

    def add(cost, letter, rest):
        return rest[0] + cost, letter + rest[1]

    for i in range(len(turns), 0, -1):  # not too deep a recursion
        for last in MAY:
            best(i, last, 0)
    return best(0, "", 0)


def brute_force(rows):
    """rows: (turn, role, text) after damage -> the report without the id."""
    rows = sorted(
        ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
    )
    seen, faults = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        if not marks:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif marks[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest(tuple((r[:1], f) for (_, r, _), f in zip(rows, faults)))
    out, last, at = [], "", 0
    for letter in audit:
        if letter == "I":
            last = [r for r in "ua" if r in MAY[last]][0]
            out.append((None, {"u": "user", "a": "assistant"}[last], "", "I"))
            continue
        turn, role, text = rows[at]
        at += 1
        if letter == "K":
            last = role[:1]
            out.append((turn, role, text, "K"))
        elif letter == "R":
            last = [r for r in "ua" if r in MAY[last]][0]
            out.append((turn, {"u": "user", "a": "assistant"}[last], text, "R"))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[1][:1] for r in out))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x, _ in out).encode()).hexdigest()
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, digest), out


@pytest.fixture(scope="module")
def table():
    r = random.Random(11)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "", None, "u", "Assistant"]
    texts = ["Yes.", "No!", "What?", "and then", "", " \n", None, "a ", "ok. \t", "…", "é?"]
    rows = []
    for c in range(400):
        turns = list(range(r.randint(1, 9)))
        if c % 3 == 0:
            turns = r.choices([0, 1, 2, 3, 7, None], k=len(turns))
        for t in turns:
            text = r.choice(texts) if r.random() < 0.4 else f"Text {r.randint(0, 30)}."
            role = ["user", "assistant"][(t or 0) % 2] if r.random() < 0.7 else r.choice(roles)
            rows.append((c if c != 17 else None, t, role, text))
    rows += [(5000, 2**60, "user", "far."), (5000, 2**60 + 3, "assistant", "farther.")]
    rows += [(5001, i, "user", f"all users {i % 300}.") for i in range(700)]  # ways stay apart
    rows += [(5002, i, ("user", "assistant")[i % 2], f"sound {i}.") for i in range(900)]
    rows += [(5003, 0, "user", "one."), (5003, 0, "user", "one."), (5003, 0, "assistant", "two.")]
    rows += [(5004, 0, "system", "only."), (5005, 0, "user", "x" * 3_000_000 + ".")]
    return rows


@pytest.fixture(scope="module")
def expected(table):
    by_id = {}
    for c, *rest in table:
        by_id.setdefault(c, []).append(tuple(rest))
    return {c: brute_force(rows) for c, rows in by_id.items()}


@pytest.mark.parametrize("chunk", [conv.CHUNK_BYTES, 500])
def test_report(spark, table, expected, chunk):
    df = spark.createDataFrame([(*x, "e", 1, 2) for x in table], SCHEMA).repartition(3)
    got = {r["conv_id"]: r for r in conv.repair_report(df, chunk).collect()}
    assert got.keys() == expected.keys()
    for c, (want, _) in expected.items():
        assert tuple(got[c][2:]) == want, c


@pytest.mark.parametrize("chunk", [conv.CHUNK_BYTES, 500])
def test_turns(spark, table, expected, chunk):
    df = spark.createDataFrame([(*x, "e", 1, 2) for x in table], SCHEMA)
    got = {}
    for r in conv.repaired_turns(df, chunk).collect():
        got.setdefault(r["conv_id"], {})[r["position"]] = tuple(r[2:])
    assert got == {c: dict(enumerate(out)) for c, (_, out) in expected.items() if out}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conv.repair_report(df).collect() == [] == conv.repaired_turns(df).collect()
    assert conv.report_all(df, conv.damage(df)).collect() == []


def test_damaged_table(spark, table):
    rows = [x for x in table if (x[0] or 0) < 5000] + [(9000 + i, 0, "user", "Gone?") for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r[1:]) for r in conv.report_all(df, conv.damage(df)).collect()}
    by_id = {}
    for c, t, role, text in rows:
        kept = by_id.setdefault(c, [])
        which = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if which == 0:
            continue
        text = "" if which == 1 else re.sub("[.!?]", "", text) if which == 2 else text
        kept += [(t, "user" if which == 4 else role, text)] * (2 if which == 3 else 1)
    assert any(not kept for kept in by_id.values())
    assert got == {c: brute_force(kept)[0] for c, kept in by_id.items()}


def test_waiting_chunks_are_put_away():
    """Where ways stay apart, all chunks but two are spilled, and the result is the same."""
    spilled = []

    def spill(entries, turns):
        spilled.append(len(turns))
        return lambda: (entries, turns)

    repair = Repair(Machine(), spill, 100)
    for i in range(10_000):
        if repair.turn("u", 0, i):
            list(repair.decided())
    inserts, rest = repair.finish()
    got = [(e, t) for edits, turns in rest for e, t in zip(edits, turns)]
    assert [t for _, t in got] == list(range(10_000)) and sum(spilled) >= 9_000
    assert "".join(e for e, _ in got) + inserts == cheapest_users(10_000)
    sound, held = Repair(Machine(), spill, 100), 0
    spilled.clear()
    for i in range(10_000):
        if sound.turn("ua"[i % 2], 0, i):
            held += sum(len(t) for _, t in sound.decided())
    assert held >= 9_800 and not spilled


def cheapest_users(n):
    small = cheapest((("u", ""),) * 10)[1]
    assert small == "KR" * 5
    return "KR" * (n // 2)
