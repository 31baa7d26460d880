"""Repair of conversations: the cheapest edits that give them a legal sequence of roles.

A legal conversation is empty, or an optional system row and then user and
assistant in turn, the last an assistant's.  Rows are kept, given another role,
deleted, or put in with an empty text; a blank row and a repeated one have to go.

Every partial repair is one whole number.  Its high digits are the cost; below
them stand ``width`` digits of three bits, the audit letters from left to right
(1 to 4 in ASCII order) with zeros behind the last.  So the least number is the
least cost and, among equals, the least audit, and the repair is a shortest path
over (row, state of the role sequence) found from the end with integer minima
alone.  A letter put in front moves the digits one place down.

Long conversations are taken in blocks of rows from the end.  Rows put in stand
before a row of their block, so every audit of a block ends with its last row's
letter and none is the beginning of another: a block needs only the cost of what
follows, and the numbers stay ``3 * BLOCK`` digits long at any length.  An audit
determines its path (each state allows one new role), hence the repaired rows.

Scale: texts are read for their faults and a digest; narrow rows find the first
of equal rows by an aggregate and a join, are sorted by ranges that cut through
a conversation of any size, and leave a letter a row.  Only these letters, a
byte a row as the audit itself, meet per conversation.  The texts are shuffled
once and pass a task as a stream, each conversation behind its audit; none is
gathered.

Cases: a null role or text counts as one space; a null conv_id is a conversation
of its own; rows without a turn come first; rows of one turn come by role, then
by the digest of their text; equal rows are one another's repeats; a role that
begins with none of s, u, a cannot be kept; an empty table gives no rows; other
columns are not read.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Rows whose audit letters stand in one number.
BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS = "DIKR"
# states of the role sequence: nothing yet, after system, after user, after assistant
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "-": (None,) * 4}
#: The state that a new user or assistant leads to, and the role it takes.
_NEW, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_LEGAL_END = (0, 3)
_LEGAL_PAIRS = ("su", "ua", "au")
#: What is said of a row: the initial of its role and its fault, as one character.
_INITIALS, _FAULTS = "sua-", ("", "blank", "duplicate", "truncated")
CODES = {(r, f): chr(65 + 4 * i + j) for i, r in enumerate(_INITIALS) for j, f in enumerate(_FAULTS)}
_MEANING = {c: k for k, c in CODES.items()}
_DIGIT = {c: i + 1 for i, c in enumerate(LETTERS)}


def _edits(code: str) -> tuple:
    """(state, letter, cost, next state) of what can be done with a row."""
    role, fault = _MEANING[code]
    out = []
    for q in range(4):
        out.append((q, "D", DELETE, q))
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            if _AFTER[role][q] is not None:
                out.append((q, "K", KEEP + more, _AFTER[role][q]))
            out.append((q, "R", REROLE + more, _NEW[q]))
    return tuple(out)


_EDITS = {c: _edits(c) for c in _MEANING}


@lru_cache(maxsize=20_000)
def _block(codes: str, after: tuple, last: bool) -> tuple[tuple[int | None, str], ...]:
    """For each state before the block, the least cost to the end and the block's audit.

    ``after`` has the cost from each state behind the block, None where there is no way.
    """
    width = 3 * len(codes) + 2
    low, top = 3 * width, 3 * (width - 1)
    mask = (1 << low) - 1

    def before(weight: int, letter: str, cost: int) -> int:
        """The weight with a letter put in front of its audit."""
        return ((weight >> low) + cost << low) + (_DIGIT[letter] << top) + ((weight & mask) >> 3)

    def with_new(weights: list[int | None]) -> list[int | None]:
        """Up to two new rows in front; a third would come back to the same state."""
        for _ in range(2):
            weights = [min((w for w in (weights[q], None if weights[_NEW[q]] is None else
                                        before(weights[_NEW[q]], "I", INSERT)) if w is not None), default=None)
                       for q in range(4)]
        return weights

    weights = [None if c is None else c << low for c in after]
    if last:
        weights = with_new(weights)
    for code in reversed(codes):
        found: list[int | None] = [None] * 4
        for q, letter, cost, then in _EDITS[code]:
            if weights[then] is not None:
                w = before(weights[then], letter, cost)
                if found[q] is None or w < found[q]:
                    found[q] = w
        weights = with_new(found)
    out = []
    for w in weights:
        digits = [] if w is None else [(w & mask) >> 3 * (width - 1 - i) & 7 for i in range(width)]
        out.append((None if w is None else w >> low, "".join(LETTERS[d - 1] for d in digits if d)))
    return tuple(out)


def step(q: int, letter: str, role: str) -> int:
    """The state after an edit, for a row whose role has this initial."""
    return _AFTER[role][q] if letter == "K" else q if letter == "D" else _NEW[q]


def solve(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, ties to the least audit."""
    parts = [codes[at:at + block] for at in range(0, len(codes), block)] or [""]
    after: tuple = tuple(0 if q in _LEGAL_END else None for q in range(4))
    chosen = []
    for k in range(len(parts) - 1, -1, -1):
        lead = min((c for c in after if c is not None))  # so that the blocks of like ends are alike
        solved = _block(parts[k], tuple(None if c is None else c - lead for c in after), k == len(parts) - 1)
        after = tuple(None if c is None else c + lead for c, _ in solved)
        chosen.append([audit for _, audit in solved])
    q, audit = 0, []
    for part, audits in zip(parts, reversed(chosen)):
        rows = iter(part)
        audit.append(audits[q])
        for letter in audit[-1]:
            q = step(q, letter, "-" if letter == "I" else _MEANING[next(rows)][0])
    return after[0], "".join(audit)


def initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "-"


def plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), a null role or text as one space."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                whole("role"), whole("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that a checksum of conversation and turn deals out, for trials of the repair."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = plain(conversations).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("again")).drop("again")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, codes): equal rows of a turn once, a code for each of them."""
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(body == "", 1).when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    same = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("h"), fault.alias("fault")).groupBy(
        "conv_id", "turn", "role", "h", "fault").agg(F.count(F.lit(1)).alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = same.groupBy("conv_id", "role", "h").agg(F.min(when).alias("first")).select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("d"), "first")
    met = same.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                    & (F.col("h") == F.col("d")))
    head = F.left("role", F.lit(1))
    role = F.when(head == "s", 0).when(head == "u", 1).when(head == "a", 2).otherwise(3)
    code = lambda fault: F.char(65 + 4 * role + fault)
    own = F.when(F.col("fault") == 1, 1).when(~when.eqNullSafe(F.col("first")), 2).otherwise(F.col("fault"))
    again = F.when(F.col("fault") == 1, 1).otherwise(2)
    return met.select("conv_id", "turn", "role", "h", F.concat(
        code(own), F.repeat(code(again), F.col("n").cast("int") - 1)).alias("codes"))


def _runs(coded: DataFrame) -> DataFrame:
    """(conv_id, part, run, codes, first, last, turns): the codes of a conversation in a task, in order."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "h")]
    names = ["conv_id", "part", "run", "codes", "first", "last", "turns"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        conv, codes, seen, out = None, [], [None, None, 0], []

        def closed():
            nonlocal n
            n += 1
            return conv, part, n, "".join(codes), *seen

        def batch():
            rows, out[:] = [pa.array(c, k) for c, k in zip(zip(*out), kinds)], []
            return pa.RecordBatch.from_arrays(rows, names)

        for b in batches:
            for c, t, k in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "codes"))):
                if codes and c != conv:
                    out.append(closed())
                    codes, seen = [], [None, None, 0]
                conv = c
                codes.append(k)
                if t is not None and t != seen[1]:
                    seen = [t if seen[0] is None else seen[0], t, seen[2] + 1]
                if len(out) == 2000:
                    yield batch()
        if codes:
            out.append(closed())
        if out:
            yield batch()

    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "codes").mapInArrow(
        run, "conv_id long, part int, run int, codes string, first long, last long, turns long")


def _summary(runs: list[dict]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of a conversation's runs in order."""
    codes = "".join(r["codes"] for r in runs)
    with_turn = [r for r in runs if r["turns"]]
    gaps = 0
    if with_turn:
        turns = sum(r["turns"] for r in with_turn) - sum(a["last"] == b["first"] for a, b in zip(with_turn, with_turn[1:]))
        gaps = with_turn[-1]["last"] - with_turn[0]["first"] + 1 - turns
    count = {f: sum(codes.count(CODES[i, f]) for i in _INITIALS) for f in _FAULTS}
    roles = codes.translate({ord(c): r for c, (r, _) in _MEANING.items()})
    cost, audit = solve(codes)
    legal = sum(roles.count(p) for p in _LEGAL_PAIRS)  # none of the pairs overlaps itself
    return (gaps if gaps < 2 ** 63 else None, count["blank"], count["duplicate"], count["truncated"],
            max(0, len(roles) - 1) - legal, cost, audit)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    ``gaps`` beyond 64 bits is null.
    """
    runs = _runs(_coded(plain(conversations)))
    parts = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("part", "run", "codes", "first", "last", "turns"))).alias("runs"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                found = list(zip(*map(_summary, b.column("runs").to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv_id"), *(pa.array(c, pa.int64()) for c in found[:6]), pa.array(found[6], pa.string())],
                    ["conv_id", *_COUNTS, "audit"])

    return parts.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")


def repaired(conversations: DataFrame, reported: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the rows that stay or are put in.

    The rows of a conversation come together and in order.  ``reported`` is the
    stored report of the same rows.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = plain(conversations).select("conv_id", F.lit(1).alias("head"), "turn", "role", _digest(F.col("text")).alias("h"), "text")
    heads = reported.select("conv_id", F.lit(0).alias("head"), none("long").alias("turn"), none("string").alias("role"),
                            none("binary").alias("h"), F.col("audit").alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "head", "turn", "role", "h")]
    met = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order)
    names = ["conv_id", "place", "turn", "role", "text", "edit"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        conv, audit, at, q, place, out, size = None, "", 0, 0, 0, [], 0

        def put(turn, role, text, edit):
            nonlocal place, size
            out.append((conv, place, turn, role, text, edit))
            place, size = place + 1, size + len(text) + 64

        def put_in():
            nonlocal at, q
            while at < len(audit) and audit[at] == "I":
                put(None, _ROLE[q], "", "I")
                q, at = _NEW[q], at + 1

        def batch():
            nonlocal size
            cols, out[:], size = [pa.array(c, k) for c, k in zip(zip(*out), kinds)], [], 0
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            for c, head, turn, role, text in zip(*(b.column(x).to_pylist() for x in (
                    "conv_id", "head", "turn", "role", "text"))):
                if head == 0:
                    put_in()
                    conv, audit, at, q, place = c, text, 0, 0, 0
                else:
                    put_in()
                    letter = audit[at]
                    if letter != "D":
                        put(turn, role if letter == "K" else _ROLE[q], text, letter)
                    q, at = step(q, letter, initial(role)), at + 1
                if size > 1 << 22:
                    yield batch()
        put_in()
        if out:
            yield batch()

    return met.select("conv_id", "head", "turn", "role", "text").mapInArrow(
        run, "conv_id long, place long, turn long, role string, text string, edit string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` of each conversation's rows, newline-joined.

    ``rows`` must come straight from ``repaired``, whose order is that of the digest.
    """
    def run(batches):
        conv, sha, out = None, None, []
        for b in batches:
            for c, place, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if sha:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
                out = []
        if sha:
            out.append((conv, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    names, kinds = ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()]
    return rows.select("conv_id", "place", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def audited(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The report of ``rows`` with the digest of their repair, for every conv_id of ``conversations``.

    A conversation without rows has zeros, an empty audit and the digest of nothing.
    """
    stored = written(report(rows), "dialogue-report")
    sha = digests(repaired(rows, stored))
    ids = conversations.select(F.col("conv_id").cast("long").alias("c")).distinct()
    named = lambda df, as_: df.withColumnRenamed("conv_id", as_)
    met = (ids.join(named(stored, "a"), F.col("c").eqNullSafe(F.col("a")), "left")
           .join(named(sha, "b"), F.col("c").eqNullSafe(F.col("b")), "left"))
    there = F.col("audit").isNotNull()
    return met.select(
        F.col("c").alias("conv_id"), *(F.when(there, F.col(n)).otherwise(0).alias(n) for n in _COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
