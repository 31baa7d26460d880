import corpus_pipeline
from packledger.llm import mixing


def check_all_in_order(spark, docs):
    out = corpus_pipeline.mix(spark, docs, None)
    assert out.schema == docs.schema
    rows = out.collect()
    assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))
    slot = {r["doc_id"]: r["slot"] for r in mixing.schedule(docs).collect()}
    assert [slot[r["doc_id"]] for r in rows] == sorted(slot.values())
    return rows


def test_a_source_of_one_row_drops_nothing(prepared, make):
    docs = make(*[(i, f"text {i}", None, "many" if i % 2 else "other") for i in range(3000)], (5000, "one", None, None))
    check_all_in_order(prepared, docs)


def test_a_hot_source_is_kept_whole(prepared, make):
    names = [f"s{i}" for i in range(19) for _ in range(40)] + ["hot"] * 400
    rows = check_all_in_order(prepared, make(*[(i, "x", "en", s) for i, s in enumerate(names)]))
    assert sum(r["source"] == "hot" for r in rows) == 400
    # while all sources run, the hot one has its weight and not its share of the rows
    q = {r["src"]: r["q"] for r in mixing.tempered(mixing.keyed(make(
        *[(i, "x", "en", s) for i, s in enumerate(names)]))).collect()}
    share = q["=hot"] / sum(q.values())
    assert abs(sum(r["source"] == "hot" for r in rows[:500]) - 500 * share) < 1


def test_repeated_and_odd_rows_stay(prepared, odd, empty):
    assert sorted(map(str, corpus_pipeline.mix(prepared, odd, None).collect())) == sorted(map(str, odd.collect()))
    assert corpus_pipeline.mix(prepared, empty, None).count() == 0
