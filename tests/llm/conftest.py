import pytest

from packledger.llm import common

#: Columns beyond those of documents, named like the operators' own.
CLASH = ("score double, k int, row string, r int, src string, spot string, bucket int, lane int, ids binary, "
         "fp long, spans string, slot long, text_hash long, component_id long, held_out string, lang_pred int")
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
NONE = (None,) * len(CLASH.split(", "))


@pytest.fixture(scope="session")
def prepared(spark):
    return common.prepare(spark)


@pytest.fixture(scope="session")
def make(prepared):
    """documents from (doc_id, text[, lang[, source]]) rows, with clashing columns beside them."""
    def build(*rows):
        whole = []
        for doc_id, text, *more in rows:
            lang, source = (*more, None, None)[:2]
            whole.append((doc_id, text, lang, source, None if text is None else len(text), *NONE))
        return prepared.createDataFrame(whole, DOCS)
    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    words = "the river rose over its banks and the old bridge fell " * 6000
    return make(
        (1, None), (2, ""), (3, " \n\t "), (4, "123 !!"), (5, "plain words here", "en", "a"),
        (5, "plain words here", "en", "a"), (5, "other words here now", "en", "b"), (None, "no id at all", "en"),
        (None, "no id at all", "en"), (None, None, None, "a"), (6, words, "en", "a"), (7, "x" * 100_000, "en", "a"),
        (8, "日本語 の 文", "ja", "b"), (9, "tail\x00nul \x85 next  space \x1f z", "en", None))


@pytest.fixture(scope="session")
def empty(make):
    return make()
