import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from packledger.llm import harmonic, queries
from packledger.llm.tokens import default_path


def test_cuts_cover_a_document_in_class_lengths():
    for size in (1, 8, 1024):
        for n in (1, 2, 7, 8, 9, 1000, 1023, 1024, 1025, 5000):
            found = harmonic.cuts(n, size)
            assert [a for a, _ in found] == [0, *np.cumsum([k for _, k in found])[:-1]] and sum(k for _, k in found) == n
            assert all(k <= size and size % k == 0 for _, k in found)


def test_a_worker_pads_nothing():
    rng = random.Random(2)
    for _ in range(50):
        bins, rows = harmonic.Bins(64, 100), []
        for i in range(rng.randint(0, 60)):
            for at, n in harmonic.cuts(rng.randint(1, 200), 64):
                rows += bins.add((i, at), n)
        rows += bins.close()
        filled = Counter()
        for (i, at), seq, _ in rows:
            filled[seq] += 1
        assert min(filled, default=100) == 100 and bins.close() == []


def check(docs, df, size):
    whole = Tokenizer.from_file(default_path())
    rows = df.collect()
    held = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        held[r["doc_id"]].append(np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4"))
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    assert pieces == Counter((d, a, n, zlib.crc32(ids[a:a + n].tobytes()), len(ids))
                             for d, all_ids in held.items() for ids in all_ids for a, n in harmonic.cuts(len(ids), size))
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size and at & at - 1 == 0  # a power of two: not padded
    short = sum(1 for p in filled.values() if sum(n for _, n in p) < size)
    assert short <= size.bit_length() * max(1, df.rdd.getNumPartitions())


def test_query_against_whole_texts(prepared, data):
    docs = prepared.read.parquet(f"{data}/documents.parquet")
    check(docs, queries.op12_harmonic_packing(prepared, data), 1024)
    check(docs.repartition(5), harmonic.digests(docs.repartition(5), size=64), 64)


def test_odd_rows(odd, empty):
    check(odd, harmonic.digests(odd), 1024)
    assert harmonic.digests(empty).count() == 0
    with pytest.raises(ValueError):
        harmonic.pack(odd, size=1000)


def test_sequences_hold_the_ids(odd):
    for r in harmonic.pack(odd).collect():
        assert len(r["ids"]) == 4 * r["length"]
