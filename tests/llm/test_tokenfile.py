import glob
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from packledger.llm import tokenfile
from packledger.llm.tokens import default_path


def expected(docs):
    whole = Tokenizer.from_file(default_path())
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    ids = [(d, whole.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]
    return sorted(((-1 if d is None else d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids)


def check(docs):
    rows = sorted(tokenfile.round_trip(docs).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert order == sorted(order)
    assert sorted((d, r["n_tokens"], r["ids_crc32"]) for d, r in zip(order, rows)) == expected(docs)


def test_round_trip(prepared):
    check(prepared.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5))


def test_odd_rows(odd, empty):
    check(odd)
    assert tokenfile.round_trip(empty).count() == 0


def test_frames_are_read_alone_and_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME", 64)
    path = f"{tmp_path}/x.zst"
    docs = {i: np.arange(i, i + 10 + i % 7, dtype="<u4").tobytes() for i in range(40)}
    with tokenfile.Writer(path) as w:
        for d, ids in docs.items():
            w.add(d, ids)
        w.add(None, b"")
    r = tokenfile.Reader(path)
    assert dict(r.documents()) == docs | {None: b""} and len(r.frames) > 10
    read = []
    monkeypatch.setattr(r, "read_frame", lambda k, f=r.read_frame: read.append(k) or f(k))
    assert dict(r.documents([17, 3, 999])) == {3: docs[3], 17: docs[17]} and len(read) == 2
    data = bytearray(open(path, "rb").read())
    import zstandard
    assert b"".join(docs.values()) == zstandard.ZstdDecompressor().stream_reader(
        bytes(data), read_across_frames=True).read()  # other readers skip the list and the table
    entry = len(data) - 9 - 12 * len(r.frames) + 8
    data[entry] ^= 1  # the first frame's checksum
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        next(tokenfile.Reader(path).documents([0]))


def test_a_file_holds_its_range(prepared, tmp_path):
    docs = prepared.range(2000).selectExpr("id as doc_id", "repeat('w ', 20) as text")
    files = tokenfile.write(docs, str(tmp_path)).orderBy("ordinal").collect()
    assert len(glob.glob(f"{tmp_path}/*.zst")) == len(files)
    seen = []
    for f in files:
        r = tokenfile.Reader(f["file"])
        seen += [d for d, _ in r.documents()]
        assert len(r.doc_ids) == f["docs"] and r.n_ids.sum() == f["ids"]
    assert seen == list(range(2000))
