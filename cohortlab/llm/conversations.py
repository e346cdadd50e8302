"""Operator 13: repair of the structure of conversations.

A conversation should be ``(system? (user assistant)+)?``. Its rows are kept (0), given
the role user or assistant (2) or deleted (3), and empty user or assistant rows are
inserted (2); rows that are blank or repeat an earlier one have to go, and a row kept or
reroled that is cut off adds 1. The *audit* is the initials of the edits in order: of the
cheapest repairs the one with the least audit, in ASCII order.

1. Rows are reduced to one code each (role, fault) and sorted by conversation. What
   repeats an earlier row is found by a map-side minimum of the turn over equal rows.
2. Nodes are (rows done, what was last said). A cost DP runs backward over all
   conversations of a batch at once. Long conversations are cut into blocks of ``BLOCK``
   rows: of each the cost matrix between its borders is found first, and the matrices give
   the cost at every border.
3. Prefix doubling over the arcs that are optimal: nodes are ranked by their least letter,
   then by pairs of ranks, that is by audits of 2, 4, 8, ... letters, while the pointer to
   the end of each least path doubles. A letter has one arc at most out of a node, so the
   rank by one letter selects the arc; the audit is read off by the pointers of the powers
   of two, all places of all audits at once.
4. Audits and rows meet in one sorted stream per conversation, which yields the repaired
   rows, or the digest of their texts, holding one batch.

A task holds the codes and the audit of one conversation (bytes a row, as the audit in the
result does), never its texts. All rows of one conversation pass through one task of
step 4, because its digest can't be put together from parts.

Cases: null conversation ids are one conversation; rows of a null turn come first; rows
with equal turns are ordered by role, the first ``HEAD`` code points of the text and its
MD5; null roles and texts are one blank; a role counts by its first character; a
conversation without rows has an empty audit; very long texts are only trimmed and
hashed; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import SPACES, slices

#: Rows of a block of a long conversation, and of a batch of conversations.
BLOCK, BATCH = 4096, 1 << 17
HEAD = 64
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Letters in ASCII order; 0 is the end of an audit.
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
FAR = 1 << 40

# what was last said: nothing yet, system, user, assistant; roles: other, s, u, a
_INITIALS = {"s": 1, "u": 2, "a": 3}
#: The state after an inserted or reroled row.
_SAID = np.array([2, 2, 3, 2])
#: The state after a row kept, by state and role; -1 where it can't follow.
_KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
_LEGAL = {(1, 2), (2, 3), (3, 2)}
_MUST_GO, _CUT_OFF = 4, 8
#: Costs of the end: a conversation is empty or ends with the assistant.
_END = np.array([0, FAR, FAR, 0])


def conversation_key(conv_id: Column) -> Column:
    """The id as text that no null shares."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("-"))


def _lean(rows: DataFrame) -> DataFrame:
    """Rows with their key, order columns and faults; texts come along."""
    rows = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    return rows.select(
        conversation_key(F.col("conv_id")).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "present",
        F.substring("text", 1, HEAD).alias("head"),
        F.unhex(F.md5("text")).alias("digest"),
        code.cast("int").alias("initial"),
        (F.length(stripped) == 0).alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut_off"),
    )


ORDER = ["role", "head", "digest"]


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Conversations dealt to tasks, each with its rows in order."""
    return rows.repartition("conv").sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), *ORDER)


def costs_of(codes: np.ndarray, sizes: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Least cost from every node to the end.

    ``codes`` are the rows of all blocks end to end, ``sizes`` their numbers of rows and
    ``tails`` (block, state) what it costs to go on behind each block. The nodes of a block
    are (rows done, state), so it has four times one more than its rows.
    """
    first_row = np.cumsum(sizes) - sizes
    first_level = first_row + np.arange(len(sizes))
    out = np.empty((int(sizes.sum()) + len(sizes), 4), np.int64)
    longest_first = np.argsort(-sizes, kind="stable")
    ordered = sizes[longest_first]
    for back in range(int(ordered[0]) + 1 if len(ordered) else 0):
        active = longest_first[: np.searchsorted(-ordered, -back, side="right")]
        level = first_level[active] + sizes[active] - back
        if back == 0:
            here = tails[active].astype(np.int64)
        else:
            code, after = codes[first_row[active] + sizes[active] - back], out[level + 1]
            here = DELETE + after
            extra = np.where(code & _CUT_OFF, CUT, 0)[:, None]
            stays = (code & _MUST_GO == 0)[:, None]
            kept = _KEPT[:, code & 3].T
            keep = np.where(stays & (kept >= 0), KEEP + extra + np.take_along_axis(after, np.maximum(kept, 0), 1), FAR)
            turn = np.where(stays, REROLE + extra + after[:, _SAID], FAR)
            here = np.minimum(np.minimum(here, keep), turn)
        # one or two rows put in
        one = INSERT + here[:, _SAID]
        out[level] = np.minimum(np.minimum(here, one), 2 * INSERT + here[:, _SAID[_SAID]])
    return out


def _arcs(codes: np.ndarray, sizes: np.ndarray, tails: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letter, target) of the optimal arc with the least letter out of every node; 0 and itself at the end."""
    levels = len(cost)
    last_level = np.cumsum(sizes + 1) - 1
    inside = np.ones(levels, bool)
    inside[last_level] = False
    code = np.zeros(levels, np.int64)
    code[inside] = codes
    node = np.arange(levels * 4).reshape(levels, 4)
    state, after = np.broadcast_to(np.arange(4), (levels, 4)), np.full((levels, 4), FAR)
    after[:-1][inside[:-1]] = cost[1:][inside[:-1]]
    extra = np.where(code & _CUT_OFF, CUT, 0)[:, None]
    stays = (inside & (code & _MUST_GO == 0))[:, None]
    kept = _KEPT[:, code & 3].T
    ends = np.zeros((levels, 4), bool)
    ends[last_level] = tails == cost[last_level]
    found = [
        (ends, node),
        (inside[:, None] & (cost == DELETE + after), node + 4),
        (cost == INSERT + cost[:, _SAID], node - state + _SAID[state]),
        (stays & (kept >= 0) & (cost == KEEP + extra + np.take_along_axis(after, np.maximum(kept, 0), 1)), node - state + 4 + kept),
        (stays & (cost == REROLE + extra + after[:, _SAID]), node - state + 4 + _SAID[state]),
    ]
    letter, target = np.zeros((levels, 4), np.int64), node.copy()
    for number in (4, 3, 2, 1, 0):  # the least letter is written last
        has, where = found[number]
        letter[has], target[has] = number, where[has]
    return letter.ravel(), target.ravel()


def ranked(letter: np.ndarray, target: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(pointers, length, rank): where the least paths of 1, 2, 4, ... letters lead, and all nodes' audits in order."""
    pointers, rank = [target], letter
    length = (letter > 0).astype(np.int64)
    while (letter[pointers[-1]] > 0).any():
        to = pointers[-1]
        pairs = rank * (len(rank) + 1) + rank[to]
        rank = np.unique(pairs, return_inverse=True)[1]
        length = length + length[to]
        pointers.append(to[to])
    return pointers, length, rank


def least_paths(codes: np.ndarray, sizes: np.ndarray, tails: np.ndarray, entry: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(audit, state behind it) of each block entered in state ``entry``."""
    cost = costs_of(codes, sizes, tails)
    letter, target = _arcs(codes, sizes, tails, cost)
    pointers, length, _ = ranked(letter, target)
    start = 4 * (np.cumsum(sizes + 1) - sizes - 1) + entry
    many = length[start]
    node = np.repeat(start, many)
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    for power, to in enumerate(pointers):
        jumps = (place >> power) & 1 == 1
        node[jumps] = to[node[jumps]]
    text = LETTERS[letter[node]].tobytes()
    ends = np.cumsum(many).tolist()
    last = start
    for to in pointers:  # the last pointer leads to the end from everywhere
        last = to[start]
    return [text[a:b] for a, b in zip([0, *ends], ends)], last % 4


def solve(conversations: list[bytes], block: int = BLOCK) -> list[tuple[int, str]]:
    """(cost, audit) of each conversation given as the codes of its rows."""
    short = [k for k, c in enumerate(conversations) if len(c) <= block]
    out: list[tuple[int, str]] = [(0, "")] * len(conversations)
    if short:
        codes = np.frombuffer(b"".join(conversations[k] for k in short), np.uint8).astype(np.int64)
        sizes = np.array([len(conversations[k]) for k in short])
        tails = np.broadcast_to(_END, (len(short), 4))
        cost = costs_of(codes, sizes, tails)[np.cumsum(sizes + 1) - sizes - 1, 0]
        audits, _ = least_paths(codes, sizes, tails, np.zeros(len(short), np.int64))
        for k, c, audit in zip(short, cost.tolist(), audits):
            out[k] = (c, audit.decode())
    for k, conversation in enumerate(conversations):
        if len(conversation) > block:
            out[k] = _solve_long(np.frombuffer(conversation, np.uint8), block)
    return out


def _solve_long(conversation: np.ndarray, block: int) -> tuple[int, str]:
    parts = [conversation[at : at + block].astype(np.int64) for at in range(0, len(conversation), block)]
    group = max(1, BATCH // block)
    matrices = []
    for at in range(0, len(parts), group):
        some = parts[at : at + group]
        # every block with every one of the four states as its only exit
        sizes = np.repeat([len(p) for p in some], 4)
        tails = np.tile(np.where(np.eye(4) > 0, 0, FAR), (len(some), 1))
        cost = costs_of(np.concatenate([p for p in some for _ in range(4)]), sizes, tails)
        entry = cost[np.cumsum(sizes + 1) - sizes - 1].reshape(len(some), 4, 4)
        matrices += list(entry.transpose(0, 2, 1))  # (state before, state behind)
    border = costs_of(np.zeros(0, np.int64), np.array([0]), _END[None])[0]
    borders = [border]
    for m in reversed(matrices):
        borders.append(np.minimum(FAR, (m + borders[-1]).min(axis=1)))
    borders.reverse()
    audit, state = [], 0
    for k, part in enumerate(parts):
        # rows put in at a border belong to the block behind it, at the end to the last block
        tail = _END if k + 1 == len(parts) else borders[k + 1]
        some, end = least_paths(part, np.array([len(part)]), tail[None], np.array([state]))
        audit.append(some[0])
        state = int(end[0])
    return int(borders[0][0]), b"".join(audit).decode()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What the sorted rows of one conversation add up to."""

    def __init__(self, key, conv_id):
        self.key, self.conv_id = key, conv_id
        self.codes = bytearray()
        self.low = self.high = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, row, initial, blank, later, cut_off):
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        repeated = later or self.before is not None and row == self.before[0]
        if self.before is not None and (self.before[1], initial) not in _LEGAL:
            self.illegal += 1
        self.before = (row, initial)
        code = initial
        if blank:
            self.blank += 1
            code |= _MUST_GO
        elif repeated:
            self.duplicate += 1
            code |= _MUST_GO
        elif cut_off:
            self.truncated += 1
            code |= _CUT_OFF
        self.codes.append(code)

    def counts(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _audited(schema: pa.Schema):
    def run(batches):
        open_: _Conversation | None = None
        done: list[_Conversation] = []
        size = 0

        def solved() -> pa.RecordBatch:
            rows = [(c.key, c.conv_id, *c.counts(), *s) for c, s in zip(done, solve([bytes(c.codes) for c in done]))]
            return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "conv_id", "present", "turn", "role", "digest", "initial", "blank", "later", "cut_off")]
            for key, conv_id, present, turn, role, digest, initial, blank, later, cut_off in zip(*columns):
                if open_ is None or key != open_.key:
                    if open_ is not None:
                        done.append(open_)
                        size += len(open_.codes)
                        if size >= BATCH or len(done) >= BATCH:
                            yield solved()
                            done, size = [], 0
                    open_ = _Conversation(key, conv_id)
                if present:
                    open_.add(turn, (turn, role, digest), initial, blank, later, cut_off)
        if open_ is not None:
            done.append(open_)
        if done:
            yield solved()

    return run


def _spark_and_arrow(conv_type: T.DataType, more: str, *, key: bool) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [T.StructField("conv", T.StringType())] if key else []
    schema = T.StructType([*fields, T.StructField("conv_id", conv_type), *T._parse_datatype_string(more).fields])
    return schema, to_arrow_schema(schema)


def _prepared(rows: DataFrame) -> DataFrame:
    if "present" not in rows.columns:
        rows = rows.withColumn("present", F.lit(True))
    return _lean(rows.select("conv_id", "turn", "role", "text", "present"))


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, its faults, the least cost and the audit.

    ``rows`` has conv_id, turn, role and text. With a boolean column ``present``, rows that
    are not present only name their conversation.
    """
    return _audits(_prepared(rows)).drop("conv")


def _audits(lean: DataFrame) -> DataFrame:
    lean = lean.drop("text")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    same = ["conv", "role", "digest"]
    firsts = lean.where("present").groupBy(*same).agg(F.min(at).alias("first"))
    marked = lean.join(firsts, same, "left")
    later = F.col("present") & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    marked = marked.withColumn("later", F.coalesce(later, F.lit(False))).drop("first")
    schema, arrow = _spark_and_arrow(lean.schema["conv_id"].dataType, REPORT, key=True)
    return _in_order(marked).mapInArrow(_audited(arrow), schema)


def _edited(batches) -> Iterator[tuple]:
    """(report, None) for each conversation, then (report, (role, text, letter)) for its repaired rows in order."""
    report = key = None
    audit, at, said = "", 0, 0

    def put_in(said):
        said = int(_SAID[said])
        return said, ("user" if said == 2 else "assistant", "", "I")

    def rest():
        nonlocal said, at
        while at < len(audit) and audit[at] == "I":
            said, row = put_in(said)
            at += 1
            yield report, row

    for batch in slices(batches):
        columns = [batch.column(c).to_pylist() for c in ("conv", "report", "role", "text", "initial")]
        for conv, has, role, text, initial in zip(*columns):
            if conv != key:
                yield from rest()
                key, report, audit, at, said = conv, has, has["audit"], 0, 0
                yield report, None
                continue
            yield from rest()
            letter, at = audit[at], at + 1
            if letter == "K":
                said = int(_KEPT[said, initial])
                yield report, (role, text, letter)
            elif letter == "R":
                said = int(_SAID[said])
                yield report, ("user" if said == 2 else "assistant", text, letter)
    yield from rest()


def _stream(rows: DataFrame) -> DataFrame:
    """Each conversation's report and then its rows, in order."""
    lean = _prepared(rows)
    reports = _audits(lean)
    report = F.struct(*[c for c in reports.columns if c != "conv"])
    heads = reports.select("conv", F.lit(0).alias("place"), report.alias("report"))
    texts = lean.where("present").select("conv", F.lit(1).alias("place"), "turn", *ORDER, "text", "initial")
    return _in_order(heads.unionByName(texts, allowMissingColumns=True), "place")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired rows of every conversation, places from 0."""
    stream = _stream(rows)
    schema, arrow = _spark_and_arrow(rows.schema["conv_id"].dataType, "place long, role string, text string, edit string", key=False)

    def run(batches):
        out, size, place = [], 0, 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out), arrow)], schema=arrow)

        for report, row in _edited(batches):
            if row is None:
                place = 0
                continue
            out.append((report["conv_id"], place, *row))
            size, place = size + len(row[1]), place + 1
            if len(out) >= 4096 or size >= 1 << 20:
                yield full()
                out, size = [], 0
        if out:
            yield full()

    return stream.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """:func:`audits` with ``repaired_sha256``, of ``role:text`` of the repaired rows, newline-joined."""
    stream = _stream(rows)
    schema, arrow = _spark_and_arrow(rows.schema["conv_id"].dataType, REPORT + ", repaired_sha256 string", key=False)

    def run(batches):
        out, open_, digest, any_row = [], None, None, False

        def closed():
            return (*open_.values(), digest.hexdigest())

        def full():
            return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out), arrow)], schema=arrow)

        for report, row in _edited(batches):
            if row is None:
                if open_ is not None:
                    out.append(closed())
                open_, digest, any_row = report, hashlib.sha256(), False
                if len(out) >= 4096:
                    yield full()
                    out = []
                continue
            digest.update(f"{chr(10) if any_row else ''}{row[0]}:{row[1]}".encode())
            any_row = True
        if open_ is not None:
            out.append(closed())
        if out:
            yield full()

    return stream.mapInArrow(run, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults put in, for :func:`audits` and :func:`repair`.

    By the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row (it is not ``present``
    then), 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats it, 4 makes its role
    user. Nulls are one blank.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), times.alias("copy"))
    return rows.drop("copy")
