from packledger.llm import langid


def parse(text, sample):
    """Phrases of a greedy parse against all substrings, by looking them up in the sample."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_match_a_parse_by_substring_search():
    samples = {"aa": ["abab cdcd abcd", "dcba bca"], "bb": ["xyz zyx abc", "qq xyzzy"]}
    model = langid.build(samples)
    texts = ["abcd xyz", "ab, CD; q1q", "zzz abab cdcd", "ÄB ab", "x" * 40]
    got, sizes, seen = langid.phrases(texts, model.tables())
    known = {" ", *model.alphabet}
    for i, text in enumerate(texts):
        plain = langid.squeezed(text + ".")  # a letter no sample has never matches
        plain = "".join(c if c in known else "\x01" for c in plain)
        trailing = sizes[i] - len(plain)
        assert trailing in (0, 1) and seen[i]
        for j, lang in enumerate(model.languages):
            sample = " ".join(langid.squeezed(x) for x in samples[lang])
            assert got[i, j] == parse(plain + " " * trailing, sample), (text, lang)


def test_windows_restart_the_parse(monkeypatch):
    model = langid.build({"aa": ["abcdefgh" * 3]})
    whole, _, _ = langid.phrases(["abcdefgh" * 40], model.tables())
    monkeypatch.setattr(langid, "WINDOW", 16)
    cut, _, _ = langid.phrases(["abcdefgh" * 40], model.tables())
    assert whole[0, 0] == 320 // 24 + 1 and cut[0, 0] == 320 // 16


def test_held_out_accuracy(prepared):
    docs = prepared.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs.where(langid.learnable())))
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(odd, empty):
    model = langid.fit(odd)
    rows = langid.predict(odd, model).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert len(rows) == 14
    assert all(by[i] == [("und", 0.0)] for i in (1, 2, 3, 4))
    assert by[8][0][0] == "ja" and by[6][0][0] == "en" and by[5][0] == by[5][1]
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_identified_keeps_rows_whole(odd):
    kept = langid.identified(odd, langid.fit(odd))
    assert kept.schema == odd.schema
    assert kept.count() == 14 - 5  # 1 to 4, and the row without id and text
