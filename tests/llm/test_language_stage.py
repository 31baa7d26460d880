import corpus_pipeline
from packledger.llm import langid

ENGLISH = "the river rose over its banks and the old bridge fell into the water below"
GERMAN = "der Fluss trat über die Ufer und die alte Brücke stürzte in das Wasser darunter"


def test_null_languages_are_predicted_and_given_ones_stay(prepared, make):
    docs = make(*[(i, f"{ENGLISH} {i}", "en") for i in range(0, 30)], *[(i, f"{GERMAN} {i}", "de") for i in range(30, 60)],
                (100, ENGLISH), (101, GERMAN), (102, ENGLISH, "xx"), (103, "123 !!"))
    out = corpus_pipeline.language(prepared, docs, None)
    assert out.schema == docs.schema
    got = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert len(got) == 63 and 103 not in got
    assert (got[100], got[101], got[102]) == ("en", "de", "xx")


def test_without_labels_no_text_goes(prepared, make):
    docs = make((1, ENGLISH), (2, "日本語"), (3, "12 !"), (4, None), (5, ""))
    assert {(r["doc_id"], r["lang"]) for r in corpus_pipeline.language(prepared, docs, None).collect()} == {
        (1, None), (2, None)}
    assert {r["lang_pred"] for r in langid.predict(docs, langid.build({})).collect()} == {langid.UNKNOWN}
