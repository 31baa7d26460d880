import math

from packledger.llm import mixing


def earliest_deadline_first(q):
    """Slots of one period, block by block, by looking at every source in every slot."""
    names, total = sorted(q), sum(q.values())
    done, ran = dict.fromkeys(names, 0), []
    for t in range(total):
        due = [(math.ceil((done[s] + 1) * total / q[s]), s) for s in names if done[s] * total // q[s] <= t]
        ran.append(min(due)[1])
        done[ran[-1]] += 1
    return ran


def test_schedule_against_a_simulation(make):
    sizes = {"a": 90, "b": 17, "c": 17, "d": 5}
    docs = make(*[(1000 * i + j, "x", None, s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)])
    q = {"a": 50, "b": 30, "c": 13, "d": 7}
    weights = docs.sparkSession.createDataFrame(list(q.items()), "source string, q int")
    rows = mixing.schedule(docs, weights).collect()
    ran = earliest_deadline_first(q)
    slots = {r["slot"]: r for r in rows}
    assert len(rows) == len(slots) == sum(sizes.values())
    nth = {}
    horizon = None
    for t in range(400):
        s = ran[t % 100]
        k = nth[s] = nth.get(s, -1) + 1
        if k >= sizes[s]:
            horizon = t if horizon is None else horizon
            assert t not in slots
            continue
        r = slots[t]
        assert (r["source"], r["block"]) == (s, k) and r["in_mix"] == (horizon is None)
        assert r["release_at"] <= t < r["due_at"]
    done = dict.fromkeys(q, 0)
    for t in range(horizon):  # every prefix is less than one block away from the weights
        done[slots[t]["source"]] += 1
        assert all(abs(done[s] - q[s] * (t + 1) / 100) < 1 for s in q)


def test_odd_rows(odd, empty):
    rows = mixing.schedule(odd).collect()
    assert len(rows) == 14 and len({r["slot"] for r in rows}) == 14
    assert {r["source"] for r in rows} == {None, "a", "b"}
    assert mixing.schedule(empty).count() == 0
    assert mixing.mixed(empty).count() == 0


def test_mixed_keeps_whole_rows_of_the_mix(make):
    docs = make(*[(i, "x", None, "big" if i % 4 else None) for i in range(400)])
    weights = docs.sparkSession.createDataFrame([("big", 1), (None, 1)], "source string, q int")
    kept = mixing.mixed(docs, weights)
    assert kept.schema == docs.schema
    placed = {r["doc_id"] for r in mixing.schedule(docs, weights).where("in_mix").collect()}
    assert {r["doc_id"] for r in kept.collect()} == placed
    n = {s: sum((r["source"] == s) for r in kept.collect()) for s in ("big", None)}
    assert n == {"big": 101, None: 100}  # the slot after the last full pair is big's
