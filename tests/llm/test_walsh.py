import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np

from packledger.llm import queries, walsh

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code int, error string, indexes int, same int, part int"
NONE = (None,) * 6


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """[(vec_id, code, error, label_error)] and the digest, by whole numbers in plain loops."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    step = width // parts
    cut = lambda v, k: v[k * step:(k + 1) * step]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, k) for _, v, _ in seeds] for k in range(parts)]

    def near(p, book):
        return min((sum((a - b) ** 2 for a, b in zip(p, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v, k), books[k])[1]].append(cut(v, k))
            for e, mine in groups.items():
                books[k][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out, by_label = [], defaultdict(int)
    for i, v, lab in kept:
        found = [near(cut(v, k), books[k]) for k in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{n:02x}" for _, n in found), error, lab))
        by_label[lab] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab]) for i, c, e, lab in out), key=str), sha


def result(df):
    rows = df.collect()
    return (sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=str),
            {r["codebooks_sha256"] for r in rows})


def test_transform_keeps_distances_in_sequency_order():
    for n in (1, 2, 8, 16):
        h = walsh.walsh(n)
        assert (h @ h.T == n * np.eye(n, dtype=int)).all()
        assert [(np.diff(h[:, k]) != 0).sum() for k in range(n)] == list(range(n))


def test_nearest_entry_and_ties():
    rng = np.random.default_rng(5)
    for width in (1, 3, 8, 11):
        for reach in (2, 1000):
            parts, entries = rng.integers(-reach, reach, (500, width)), rng.integers(-reach, reach, (16, width))
            entries[9] = entries[4]
            d = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
            for kind in (np.int64, object):
                index, least = walsh.nearest(parts.astype(kind), entries.astype(kind))
                assert (index == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_query_against_plain_loops(prepared, data):
    rows = [tuple(r) for r in prepared.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    expected, sha = brute(rows)
    assert result(queries.op13_vector_codes(prepared, data)) == (expected, {sha})


def test_odd_rows(prepared):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5] * 8, [0.5] * 8, [-0.0001] * 8, [0.1, -0.2], [], [nan] * 8, [inf] * 8, None, [None] * 8,
               [0.3, 0.1, 0.2, 0.9, -1.0, 0.0, 0.25, 1e-300], [1.0] * 8, [2.5, -2.5] * 4]
    rows = [(i if i % 5 else None, v, None if i % 2 else i % 4) for i, v in enumerate(vectors)]
    rows += [(7, [0.7] * 8, 1)] * 30 + [(8, [0.7] * 8, 1), (7, [0.6] * 8, 1)]
    make = lambda rows: prepared.createDataFrame([(*r, *NONE) for r in rows], SCHEMA)
    for some in (rows, rows[:3]):
        expected, sha = brute(some)
        assert result(walsh.compressed(make(some).repartition(3))) == (expected, {sha})
    assert walsh.compressed(make(rows).limit(0)).count() == 0
    assert walsh.compressed(make([(1, None, 1), (2, [nan], 2)])).count() == 0
    assert [r["code"] for r in walsh.compressed(make([(1, [], 1)])).collect()] == ["00" * 8]


def test_extreme_magnitudes_are_exact(prepared):
    vectors = [[1e300] * 8, [-1e300, 3e9] * 4, [1e15 + k for k in range(8)], [k / 7 for k in range(8)], [4e18] * 8, [3e8] * 8]
    rows = [(i, v, 0) for i, v in enumerate(vectors * 4)]
    df = prepared.createDataFrame([(*r, *NONE) for r in rows], SCHEMA)
    expected, sha = brute(rows, entries=3)
    got, shas = result(walsh.compressed(df, entries=3))
    cap = lambda e: e if e < 2 ** 63 else None
    assert shas == {sha} and [(i, c, e) for i, c, e, _ in got] == sorted(((i, c, cap(e)) for i, c, e, _ in expected), key=str)
