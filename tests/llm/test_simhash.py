import random

import numpy as np
import xxhash

from packledger.llm import components, simhash


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words] if len(words) < width else [words[i:i + width] for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, ids, radius=2):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least[root(i)] = min(least.get(root(i), 1 << 62), ids[i])
    return [least[root(i)] for i in range(len(fps))]


def test_fingerprint_bit_by_bit():
    texts = [None, "", "One", "one two", "a B c", "A b C d a b c", "été Été ÉTÉ x", "w " * 500, "\x85x y z"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_counters_find_all_within_the_radius():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(90)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < .5) for b in base]
    left, right = np.array(base, np.uint64), np.array(near + base, np.uint64)
    for radius in (0, 1, 2):
        got = set(zip(*(x.tolist() for x in simhash._pairs(left, right, radius))))
        assert got == {(i, j) for i, a in enumerate(base) for j, b in enumerate(near + base)
                       if bin(a ^ b).count("1") <= radius}


def _prints(spark, fps):
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    return spark.createDataFrame([(i, 0, f) for i, f in enumerate(signed)], "doc_id long, text_hash long, fp long")


def test_groups_with_large_buckets_split(prepared):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    hot = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)]
    low = [centre >> 20 << 20 | rng.getrandbits(20) for _ in range(150)]  # one bucket, few links
    fps = hot + low + [rng.getrandbits(64) for _ in range(60)]
    expected = plain_groups(fps, range(len(fps)))
    by_fp = {f - (1 << 64) if f >> 63 else f: c for f, c in zip(fps, expected)}
    for bucket in (1 << 15, 64):
        got = simhash.groups(_prints(prepared, fps), bucket=bucket).collect()
        assert {r["fp"]: r["component_id"] for r in got} == by_fp


def test_components_of_chains_and_stars(prepared):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)]
    edges += [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components.components(prepared.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)
    assert set(got) == set(near)


def test_documents_against_brute_force(prepared):
    docs = prepared.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    expected = plain_groups(fps, [r["doc_id"] for r in rows])
    got = simhash.near_duplicates(docs).orderBy("doc_id").collect()
    assert [r["fp"] % (1 << 64) for r in got] == fps
    assert [r["component_id"] for r in got] == expected


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 14
    zero = [r for r in got if r["fp"] == 0]
    assert {r["doc_id"] for r in zero} == {1, 2, 3, None} and {r["component_id"] for r in zero} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] == 5} == {5}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.schema == odd.schema
    rows = kept.collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in rows) == sorted([
        (1, ""), (4, "123 !!"), (5, "other wor"), (5, "plain wor"), (0, "no id at "), (6, "the river"),
        (7, "xxxxxxxxx"), (8, "日本語 の 文"), (9, "tail\x00nul ")])
    assert simhash.one_of_each(empty).count() == 0
