"""Conversation repair against a plain search over all cheapest audits."""

import hashlib
import heapq
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cohortlab.llm import conversations, queries
from conftest import TESTDATA

SPACES = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """(cost, audit, repaired) of rows (role, text, fault): least cost, then least audit, by best-first search."""
    todo, done = [(0, "", 0, 0, ())], set()
    while todo:
        cost, audit, at, said, out = heapq.heappop(todo)
        if (at, said) in done:
            continue
        done.add((at, said))
        if at == len(rows) and said in (0, 3):
            return cost, audit, list(out)
        spoken = {0: 2, 1: 2, 2: 3, 3: 2}[said]
        name = {2: "user", 3: "assistant"}[spoken]
        heapq.heappush(todo, (cost + 2, audit + "I", at, spoken, (*out, (name, ""))))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(todo, (cost + 3, audit + "D", at + 1, said, out))
        if fault in ("blank", "duplicate"):
            continue
        more = int(fault == "truncated")
        kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], said))
        if kept is not None:
            heapq.heappush(todo, (cost + more, audit + "K", at + 1, kept, (*out, (role, text))))
        heapq.heappush(todo, (cost + 2 + more, audit + "R", at + 1, spoken, (*out, (name, text))))


def plain_report(rows):
    """The whole row of one conversation of (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.rstrip(SPACES)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = Counter(f for _, _, f in faults)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
    cost, audit, repaired = plain_repair(faults)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest), repaired


def plain_damage(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        mine = out.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if fate == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if fate == 3 else 1)
    return out


def some_rows(seed, conversations_, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations_):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "Ça va ?\n", "", " \t", None, f"turn {rng.randint(0, 9)}.", "x" * 200 + rng.choice("ab.")])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, text, "more"))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def test_audits_equal_a_plain_search(spark):
    rows = [*some_rows(1, 250, 9), *((None, t, r, x, "m") for t, r, x in [(0, "user", "a."), (None, "assistant", "b."), (2, "user", "c.")])]
    by_id = {}
    for conv, turn, role, text, _ in rows:
        by_id.setdefault(conv, []).append((turn, role, text))
    df = spark.createDataFrame(rows, SCHEMA)
    expected = {conv: plain_report(mine) for conv, mine in by_id.items()}
    got = {r.conv_id: tuple(r)[1:] for r in conversations.digests(df).collect()}
    assert got == {conv: report for conv, (report, _) in expected.items()}
    assert {r.conv_id: tuple(r)[1:] for r in conversations.audits(df).collect()} == {c: v[:-1] for c, v in got.items()}
    turns = {}
    for r in sorted(conversations.repair(df).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
        assert len(turns[r.conv_id]) == r.place + 1
    assert turns == {c: repaired for c, (_, repaired) in expected.items() if repaired}


def test_blocks_change_nothing():
    rng = np.random.default_rng(3)
    many = [bytes(rng.choice([0, 1, 2, 2, 2, 3, 3, 3, 4, 6, 7, 10, 11], size).astype(np.uint8)) for size in [0, 1, 2, 5, 63, 64, 65, 200, 777]]
    plain = []
    for codes in many:
        rows = [("xsua"[c & 3] if c & 3 else "x", "", "blank" if c & 4 else "truncated" if c & 8 else "") for c in codes]
        plain.append(plain_repair(rows)[:2])
    for block in (1, 2, 7, 64, 4096):
        assert conversations.solve(many, block) == plain


def test_ranks_order_the_audits():
    rng = np.random.default_rng(4)
    codes, sizes = rng.choice([0, 1, 2, 3, 4, 10], 40).astype(np.int64), np.array([17, 0, 23])
    tails = np.broadcast_to(conversations._END, (3, 4))
    letter, target = conversations._arcs(codes, sizes, tails, conversations.costs_of(codes, sizes, tails))
    pointers, length, rank = conversations.ranked(letter, target)
    audits = []
    for node in range(len(letter)):
        text, at = b"", node
        while letter[at]:
            text, at = text + bytes([conversations.LETTERS[letter[at]]]), target[at]
        audits.append(text)
    assert [len(a) for a in audits] == length.tolist()
    order = sorted(set(audits))
    assert [order.index(a) for a in audits] == rank.tolist()
    assert len(pointers) <= 2 + max(map(len, audits)).bit_length()


def test_one_conversation_of_a_third_of_all_rows(spark, monkeypatch):
    hot = spark.range(6000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id") % 4000, F.lit(".")).alias("text"))
    rest = spark.createDataFrame([r[:4] for r in some_rows(2, 400, 6)], SCHEMA.rsplit(",", 1)[0]).where("conv_id <> 7")
    df = hot.union(rest)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.digests(df).collect()}
    mine = [tuple(r) for r in hot.select("turn", "role", "text").collect()]
    assert got[7] == plain_report(mine)[0]


def test_damage_and_odd_tables(spark):
    rows = [r[:4] for r in some_rows(5, 300, 6)] + [(10_000 + k, 0, "user", "gone?") for k in range(60)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = {conv: plain_report(mine)[0] for conv, mine in plain_damage(rows).items()}
    assert any(not v[6] and v[5] == 0 for v in expected.values())
    got = {r.conv_id: tuple(r)[1:] for r in conversations.digests(conversations.damage(df)).collect()}
    assert got == expected
    empty = df.limit(0)
    assert conversations.digests(conversations.damage(empty)).collect() == []
    assert conversations.repair(empty).collect() == []
    names = spark.createDataFrame([("a", 0, "user", "x" * 3_000_000 + ".", 1), ("a", 1, "assistant", "y.", 1)], "conv_id string, turn int, role string, text string, conv int")
    assert [r.audit for r in conversations.audits(names).collect()] == ["KK"]


def test_query_on_the_given_table(spark):
    table = spark.read.parquet(f"{TESTDATA}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    expected = {conv: plain_report(mine)[0] for conv, mine in plain_damage(rows).items()}
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversations(spark, TESTDATA).collect()}
    assert got == expected
