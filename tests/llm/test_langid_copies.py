import random

from pyspark.sql import functions as F

from packledger.llm import langid


def words(rng, letters):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(60))


def copied(spark, texts, copies):
    """Each (lang, text) as many times as said."""
    return spark.createDataFrame(texts, "lang string, text string").crossJoin(spark.range(copies).withColumnRenamed(
        "id", "doc_id"))


def test_languages_of_copies_are_learned(prepared):
    rng = random.Random(1)
    alphabets = {f"l{i}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for i in range(8)}
    texts = [(lang, words(rng, letters)) for lang, letters in alphabets.items()]
    model = langid.fit(copied(prepared, texts, 3000))
    assert model.languages == sorted(alphabets)
    new = [(lang, words(rng, letters)) for lang, letters in alphabets.items()]
    got, _ = langid.classify([t for _, t in new], model, model.tables())
    assert got == [lang for lang, _ in new]


def test_copies_do_not_crowd_out_other_texts(prepared, monkeypatch):
    rng = random.Random(2)
    seen = {}
    monkeypatch.setattr(langid, "build", lambda samples, sample: seen.update(samples))
    hot = copied(prepared, [("aa", "hot " * 500)], 2000)
    others = copied(prepared, [("aa", words(rng, "abcdef") + f" only{i}q") for i in range(40)], 1)
    langid.fit(hot.unionByName(others))
    assert len(seen["aa"]) <= 41 * langid.PIECES
    assert sum("hot" in x for x in seen["aa"]) == langid.PIECES
    for i in range(40):  # tails are read, not heads alone
        assert any(f"only{i}q"[-4:] in x for x in seen["aa"])


def test_the_bound_is_hard(prepared, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "build", lambda samples, sample: seen.update(samples))
    rows = prepared.range(500).select(F.col("id").alias("doc_id"), F.lit("aa").alias("lang"),
                                      F.concat(F.lit("text "), F.col("id")).alias("text"))
    langid.fit(rows, rows=30)
    assert len(seen["aa"]) == 30
