import hashlib
import re

import pytest

import corpus_pipeline
import test_near_copies as near_copies
from packledger.llm import mixing, secret_scan
from test_mixing import earliest_deadline_first
from test_packing import check

SF = "/root/testdata/sf0.001"


def key(r):
    return str(tuple(r))


def steps(spark, docs):
    """Each stage's input and output, written in between."""
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        yield name, docs, out
        docs = out


def letters(rows):
    return [r for r in rows if re.search(r"[^\W\d_]", r["text"] or "")]


def one_of_each(rows):
    named = [(r["doc_id"], r["text"], *(r[c] for c in r.asDict() if c not in ("doc_id", "text"))) for r in rows]
    kept = set(near_copies.one_of_each(named))
    return [r for r, n in zip(rows, named) if n in kept]


def blanked(rows):
    out = []
    for r in rows:
        text = secret_scan.redact(r["text"])
        same = text == r["text"]
        out.append({**r.asDict(), "text": text, "n_chars": r["n_chars"] if same else len(text)})
    return out


def mix(rows):
    """Slot after slot of the schedule, each filled by the source it belongs to while that has rows."""
    order = {}
    for r in rows:
        spot = hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()
        order.setdefault("null" if r["source"] is None else "=" + r["source"], []).append((spot, r["doc_id"], r))
    mass = {s: len(v) ** mixing.POWER for s, v in order.items()}
    q = {s: max(1, round(m / sum(mass.values()) * mixing.SCALE)) for s, m in mass.items()}
    waiting = {s: sorted(v, key=lambda x: (x[0], x[1])) for s, v in order.items()}
    ran, t, out = earliest_deadline_first(q), 0, []
    while any(waiting.values()):
        s = ran[t % len(ran)]
        t += 1
        if waiting[s]:
            out.append(waiting[s].pop(0)[2])
    return out


def test_mix_orders_uneven_sources(make):
    sizes = {"hot": 60, "b": 25, "c": 9, "one": 1, None: 5}
    names = [s for s, n in sizes.items() for _ in range(n)]
    docs = make(*((i, f"text {i}", "en", s) for i, s in enumerate(names)))
    want = [r["doc_id"] for r in mix(docs.collect())]
    assert [r["doc_id"] for r in mixing.in_order(docs).collect()] == want and len(want) == 100
    assert want != sorted(want) and names[want[-1]] == "hot"


def test_stages_against_brute_force(prepared):
    docs = prepared.read.parquet(f"{SF}/documents.parquet")
    expected = {"language": letters, "near_duplicates": one_of_each, "secrets": blanked, "mix": mix}
    seen = []
    for name, given, out in steps(prepared, docs):
        seen.append(name)
        if name == "pack":
            rows = out.selectExpr("doc_id", "piece", "start", "length", "crc32(ids) ids_crc32", "sequence_id", "offset")
            check(given, rows.collect(), 1024)
        else:
            assert out.schema == docs.schema
            want = [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in expected[name](given.collect())]
            assert sorted(map(key, out.collect())) == sorted(map(str, want)), name
    assert seen == ["language", "near_duplicates", "secrets", "mix", "pack"]


def test_run_is_the_stages(prepared):
    docs = prepared.read.parquet(f"{SF}/documents.parquet")
    *_, (_, _, last) = steps(prepared, docs)
    cols = ["doc_id", "piece", "start", "length", "ids"]
    assert sorted(map(key, corpus_pipeline.run(prepared, SF).select(*cols).collect())) == \
        sorted(map(key, last.select(*cols).collect()))


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_rows(prepared, rows, request):
    docs = request.getfixturevalue(rows)
    for name, given, out in steps(prepared, docs):
        if name != "pack":
            assert out.schema == docs.schema, name
        elif rows == "odd":
            assert out.select("doc_id").distinct().count() > 3
        else:
            assert out.count() == 0
