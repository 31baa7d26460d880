import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from packledger.llm import packing
from packledger.llm.tokens import Encoder, default_path


def best_fit_decreasing(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(size - n)
    return len(room)


def test_plan_is_best_fit_over_documents():
    rng = random.Random(1)
    for _ in range(120):
        size = rng.choice([8, 16, 64])
        histogram = Counter(rng.randint(1, size) for _ in range(rng.randint(0, 300)))
        plan = packing.plan(histogram, size)
        filled = defaultdict(list)
        for n, count in histogram.items():
            for s, o in zip(*plan.slots(np.full(count, n), np.arange(count))):
                filled[s].append((o, n))
        for parts in filled.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= size
        assert len(filled) == plan.sequences == best_fit_decreasing(histogram.elements(), size)


def test_ids_equal_the_tokenizer_on_whole_texts(prepared):
    docs = [r["text"] for r in prepared.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += ["a  b \n c\n\n d", "  x", "　 y z", "a\x1fb \x1f c", "<|endoftext|> k<|endoftext|>", "", None, "\t \n",
             "ab  c ’s it's  'll I'LL", "x\n", "\n", "a\nb\n\nc", "don't. (yes)!? 1,234.5% naïve­́ \U0001f600 a b",
             "end### two$$$ !!! WORD!! word,### (word) a|b a<b [x]_{y} --- it's! 'tis ''quoted'' 3.14 x2y 2x \nStart\n(Next)\n###\n5th",
             "пример текст слово слово, 日本語 mixed語 éa à̀b ßtraße ÿ ÷ × ªº µ", "a\n\nb\n \n c", "tab\there", "\nx", " \nx",
             "word.\n word,, \"q\" $5 &c; x.y z|", "a" * 3000]
    whole = Tokenizer.from_file(default_path())
    enc = Encoder(default_path())
    for part in (docs[:50], docs[50:], docs):
        got = enc.encode(part)
        for t, ids in zip(part, got):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def check(docs, rows, size):
    whole = Tokenizer.from_file(default_path())
    expected, lengths = Counter(), []
    for r in docs.select("doc_id", "text").collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= size else (len(ids) % size or size)
        cuts = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            lengths.append(b - a)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    assert len(filled) == best_fit_decreasing(lengths, size)


def test_documents_are_packed_whole(prepared):
    docs = prepared.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, packing.digests(docs).collect(), packing.SIZE)
    check(docs, packing.digests(docs, size=100).collect(), 100)


def test_windows_follow_the_order_of_the_table(prepared, tmp_path, odd, empty):
    docs = prepared.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "ordered")
    docs.orderBy("doc_id").coalesce(1).write.parquet(path)
    stored = prepared.read.parquet(path)
    digest = lambda df: df.selectExpr("doc_id", "piece", "start", "length", "crc32(ids) ids_crc32", "sequence_id", "offset")
    check(stored, digest(packing.pack_in_order(stored)).collect(), packing.SIZE)  # one window: as over all
    rows = digest(packing.pack_in_order(stored, size=100, window=60)).collect()
    whole = [(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in digest(packing.pack(stored, size=100)).collect()]
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows) == Counter(whole)
    held, room, last = defaultdict(set), defaultdict(list), {}
    for r in rows:
        held[r["sequence_id"]].add(r["doc_id"])
        room[r["sequence_id"]].append((r["offset"], r["length"]))
        last[r["doc_id"]] = max(last.get(r["doc_id"], 0), r["piece"])
    for parts in room.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]] and sum(n for _, n in parts) <= 100
    order = sorted(last)
    before = dict(zip(order, np.cumsum([0] + [last[d] + 1 for d in order]).tolist()))
    longest = max(last.values()) + 1
    assert all(before[max(ds)] - before[min(ds)] <= 60 + longest for ds in held.values())
    check(odd, digest(packing.pack_in_order(odd.coalesce(1))).collect(), packing.SIZE)
    assert packing.pack_in_order(empty).count() == 0


def test_odd_rows(odd, empty):
    check(odd, packing.digests(odd).collect(), packing.SIZE)
    assert packing.digests(empty).count() == 0


def test_sequences_hold_the_ids(odd):
    placed = packing.pack(odd, size=64)
    rows = placed.collect()
    sequences = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(placed).collect()}
    for r in rows:
        a = 4 * r["offset"]
        assert sequences[r["sequence_id"]][a:a + 4 * r["length"]] == bytes(r["ids"])
    assert sum(map(len, sequences.values())) == 4 * sum(r["length"] for r in rows)
