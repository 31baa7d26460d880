import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from packledger.llm import dialogues, queries

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, codes string, place int, h binary, audit string"


def faulty(rows):
    """The fault of each (role, text) row of a conversation, '' for none."""
    seen, out = set(), []
    for role, text in rows:
        if not text.strip(WHITE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.strip(WHITE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by a search over tuples, least cost first, then least audit."""
    faults = faulty(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = (i, "" if not roles else "s" if roles == "s" else roles[-1])
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        if (*state, audit) in done or len(audit) > 3 * len(rows) + 2:
            continue
        done.add((*state, audit))
        new = "assistant" if roles.endswith("u") else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, roles + new[0], (*lines, f"{new}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + new[0], (*lines, f"{new}:{text}")))
                grown = roles + role[:1]
                if role and re.match("s?(ua)*u?$", grown) and (grown == "s" or grown.strip("s")):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, grown, (*lines, f"{role}:{text}")))


def coded(rows):
    return "".join(dialogues.CODES[dialogues.initial(r), f] for (r, _), f in zip(rows, faulty(rows)))


def test_least_cost_and_least_audit():
    rng = random.Random(7)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "bot", ""]),
                 rng.choice(["a.", "b!", "c", " ", "d?", "e"])) for _ in range(rng.randint(0, 6))]
        cost, audit, _ = cheapest(rows)
        for block in (1, 2, 3, 256):
            assert dialogues.solve(coded(rows), block) == (cost, audit), rows


def test_blocks_do_not_change_the_repair():
    rng = random.Random(3)
    for _ in range(40):
        codes = "".join(rng.choice(list(dialogues.CODES.values())) for _ in range(rng.randint(30, 120)))
        whole = dialogues.solve(codes, 1000)
        assert all(dialogues.solve(codes, b) == whole for b in (1, 5, 16))


def test_a_long_conversation_takes_time_in_proportion():
    cost, audit = dialogues.solve("".join(dialogues.CODES[r, f] for r, f in [("u", ""), ("u", "truncated"), ("-", "")]) * 30_000)
    assert cost == 30_000 * 5 and len(audit) >= 90_000


def expected(rows):
    """The whole result from (conv_id, turn, role, text) rows, by plain Python."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        groups[conv] += []
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, _, _ in found if t is not None}
        said = [(r, t) for _, r, t in found]
        faults = faulty(said)
        cost, audit, lines = cheapest(said)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
                     faults.count("duplicate"), faults.count("truncated"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"],
                           r["repaired_sha256"]) for r in df.collect()}


def test_query_against_plain_python(prepared, data):
    rows = prepared.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = queries.op11_dialogue_repair(prepared, data)
    assert got.count() == rows.select("conv_id").distinct().count()
    assert result(got) == expected([tuple(r) for r in rows.collect()])


def test_odd_rows(prepared):
    rows = [(None, 0, "user", "Hello."), (None, 1, None, "No role."), (1, None, "user", None), (1, 3, "user", "Yes."),
            (1, 3, "user", "Yes."), (1, 3, "assistant", "No?"), (1, -5, "", "x."), (2, 0, "system", "\t\n"),
            (3, 7, "User", "Upper."), (4, 0, "system", "Go."), (4, 1, "user", "é" * 300_000), (4, 9, "assistant", ""),
            (5, None, "assistant", "later \x85 "), (5, None, "assistant", "first."), (11, 0, "user", "A."), (11, 0, "user", "A."),
            *((6, t, "user", "same.") for t in range(6)), *((t, 0, "user", "x") for t in range(20, 60))]
    df = prepared.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    got = dialogues.audited(df, dialogues.damaged(df))
    assert result(got) == expected(rows)
    assert dialogues.audited(df.limit(0), dialogues.damaged(df.limit(0))).count() == 0


def test_one_conversation_over_many_tasks(prepared):
    rng = random.Random(1)
    rows = [(9, t // 2, rng.choice(["user", "assistant"]), f"t{t % 500}.") for t in range(6000)]
    df = prepared.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA).repartition(6)
    prepared.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(dialogues.audited(df, df))[9]
    finally:
        prepared.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = sorted(((t, r, x) for _, t, r, x in rows), key=lambda r: (r[0], r[1], hashlib.sha256(r[2].encode()).digest()))
    said = [(r, x) for _, r, x in order]
    cost, audit = dialogues.solve(coded(said), 6000)
    assert (got[5], got[6]) == (cost, audit) and got[2] == faulty(said).count("duplicate")
