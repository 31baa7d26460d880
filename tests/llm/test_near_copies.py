import random

import numpy as np

from packledger.llm import near_copies as N


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if len(words) < width and words else {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def similar(a, b, least=0.8):
    a, b = plain_set(a), plain_set(b)
    return a == b or len(a & b) >= least * len(a | b)


def one_of_each(rows):
    """Rows (as tuples of doc_id, text, ...) kept by links between all pairs."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    sets = [plain_set(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [rows[i] for i in range(len(rows)) if root(i) == i]


def test_counters_at_any_radius():
    rng = random.Random(2)
    base = np.array([rng.getrandbits(64) for _ in range(70)], np.uint64)
    other = np.array([int(b) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 30))) for b in base for _ in range(3)], np.uint64)
    for radius in (0, 1, 5, 20, 31, 63):
        want = np.bitwise_count(base[:, None] ^ other[None, :]) <= radius
        assert (N._hits(base, other, radius) == want).all()


def test_every_text_has_a_leader_within_the_radius():
    rng = random.Random(4)
    keys = np.sort(np.array([rng.choice([1, 2, 3, 4, 4, 4, 4]) for _ in range(1500)]))
    fps = np.array([rng.getrandbits(64) for _ in keys], np.uint64)
    found = N.leaders(keys, fps, 24)
    assert (keys[found] == keys).all() and (found[found] == found).all() and (found <= np.arange(len(keys))).all()
    assert (np.bitwise_count(fps ^ fps[found]) <= 24).all()
    heads = np.unique(found)
    for k in np.unique(keys):
        mine = fps[heads[keys[heads] == k]]
        assert (np.bitwise_count(mine[:, None] ^ mine[None, :]) + 64 * np.eye(len(mine), dtype=int) > 24).all()


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, share):
    """The words with a run of them replaced so that about ``share`` of the shingles stay common."""
    n = max(1, round(len(words) * (1 - share) / (1 + share)) - 4)
    at = rng.randrange(len(words) - n)
    return words[:at] + prose(rng, n) + words[at + n:]


def test_planted_copies_and_clean_documents(make):
    rng = random.Random(9)
    rows, planted = [], []
    passage = prose(rng, 60)
    for i in range(0, 600, 2):
        words = prose(rng, rng.randint(120, 400)) + (passage if i % 3 == 0 else [])
        copy = edited(rng, words, rng.uniform(0.82, 0.97))
        rows += [(i, " ".join(words)), (i + 1, " ".join(copy))]
        planted.append(similar(rows[-2][1], rows[-1][1]))
    kept = {r["doc_id"] for r in N.one_of_each(make(*rows)).collect()}
    assert {i for i in range(0, 600, 2)} <= kept
    gone = sum(is_copy and 2 * k + 1 not in kept for k, is_copy in enumerate(planted))
    assert sum(planted) > 250 and gone >= 0.95 * sum(planted)
    assert all(is_copy or 2 * k + 1 in kept for k, is_copy in enumerate(planted))


def test_links_beside_the_leaders_are_found(make):
    """Edited copies on both sides of the threshold: the groups are those of all pairs."""
    rng = random.Random(12)
    rows, line = [], prose(rng, 30)
    for family in range(60):
        words = prose(rng, 150) + (line if family % 2 else [])
        rows += [(10 * family + k, " ".join(edited(rng, words, rng.uniform(0.8, 0.93)))) for k in range(7)]
    want = {r[0] for r in one_of_each(rows)}
    assert {r["doc_id"] for r in N.one_of_each(make(*rows), bucket=4).collect()} == want


def test_first_shingles_of_links_meet():
    rng = np.random.default_rng(5)
    late = (np.arange(0, 400, 3, dtype=np.uint64), rng.integers(1, 9, 134))
    for n in (1, 2, 3, 4, 5, 9, 10, 11, 60):
        for _ in range(30):
            h = rng.choice(400, n, replace=False).astype(np.uint64)
            swapped = n - int(np.ceil(n * 1.6 / 1.8 - 1e-9))
            other = np.concatenate((h[swapped:], 1000 + np.arange(swapped, dtype=np.uint64)))
            assert len(np.intersect1d(N.prefix(np.sort(h), late), N.prefix(np.sort(other), late)))


def test_signatures_differ_in_no_more_places_than_shingles():
    rng = np.random.default_rng(6)
    for n in (1, 20, 300):
        h = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        for k in range(0, n + 1, max(1, n // 5)):
            a, b = h[:n], h[k:n + k]
            apart = int(np.bitwise_count(N.signature(a) ^ N.signature(np.concatenate((b, b)))).sum())
            assert apart <= 2 * k and (n > 20 or not k or apart >= k)


def test_pairs_of_a_bucket_grow_with_its_rows():
    rng = np.random.default_rng(7)
    size = 400
    root, at, n = np.arange(size), np.zeros(size, np.int64), np.full(size, 60)
    bucket, one = np.zeros(size, np.int64), rng.integers(0, 1 << 63, 1, np.int64)
    alike = [np.repeat(one, size) for _ in range(4)]
    every = sum(len(i) for i, _ in N.across(bucket, root, at, n, alike))
    some = [np.concatenate(x) for x in zip(*N.across(bucket, root, at, n, alike, most=2))]
    assert every == size * (size - 1) // 2
    assert len(some[0]) <= 2 * size and set(np.concatenate(some).tolist()) == set(range(size))
    apart = [rng.integers(-(1 << 63), 1 << 63, size, np.int64) for _ in range(4)]
    assert not sum(len(i) for i, _ in N.across(bucket, root, at, n, apart))


def test_a_crowd_is_one_group_before_all_its_pairs_are_compared(make, monkeypatch):
    rng = random.Random(13)
    words = prose(rng, 120)
    rows = [(i, " ".join(edited(rng, words, 0.87))) for i in range(160)]
    compared, plain = [], N.written

    def written(df, name):
        out = plain(df, name)
        if name == "near-missed":
            compared.append(out.count())
        return out
    monkeypatch.setattr(N, "written", written)
    kept = {r["doc_id"] for r in N.one_of_each(make(*rows)).collect()}
    assert kept == {r[0] for r in one_of_each(rows)}
    assert 0 < sum(compared) < 20 * len(rows)


def test_large_group_is_thinned_in_parts(make):
    rng = random.Random(10)
    words = prose(rng, 200)
    rows = [(i, " ".join(edited(rng, words, 0.95) if i else words)) for i in range(300)] + [(1000, " ".join(prose(rng, 200)))]
    kept = [r["doc_id"] for r in N.one_of_each(make(*rows), bucket=50).collect()]
    assert sorted(kept) == [0, 1000]


def test_odd_rows(odd, empty):
    got = N.one_of_each(odd)
    assert got.schema == odd.schema
    plain = one_of_each([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, plain))
    assert N.one_of_each(empty).count() == 0
