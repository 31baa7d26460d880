"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton holds every substring of a bounded sample
of its labelled text.  A text is parsed greedily into the longest phrases that
occur in the sample; the fewer phrases per letter, the closer the language.
The phrases are divided by the text's symbols, so that counts of texts of any
length compare; the language with the fewest wins, ties going to the first
language in alphabetical order.

Text is read as symbols: letters in lower case, every run of other characters as
one gap.  Parsing starts anew every ``WINDOW`` symbols, at any length of text,
so that all windows of a batch step through the automata together as numpy
arrays; nothing is cut off.

Scale: fitting reads a sample whose bound is a parameter; prediction is one pass
over the texts without a shuffle, and what travels to the tasks is bounded by
the sample.

Cases: null text, or text without any letter, is ``und`` with score 0; letters no
language has seen cost each language the same; when there is nothing to learn
from, every text is ``und``; repeated rows give repeated results; an empty table
gives no rows; other columns are not read.
"""
from __future__ import annotations

import unicodedata
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import kept, written

#: Distinct labelled texts asked for per language, and symbols of text kept of each and in all.
SAMPLE_ROWS, SAMPLE_OF_ROW, SAMPLE = 300, 1000, 40_000
#: Pieces that what is kept of a text is read in.
PIECES = 8
WINDOW = 512
#: Characters parsed together, about: whole texts, at least one.
AT_ONCE = 1 << 20
#: Symbol classes: 0 pads, 1 is a gap, 2 is a letter outside the sample.
PAD, GAP, OTHER = 0, 1, 2
UNKNOWN = "und"
_RARE = 0x110000


def _fold(text: str) -> str:
    return text.lower()


def squeezed(text: str) -> str:
    """Lower-case letters, every other run of characters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in _fold(text)).split())


@dataclass
class Automaton:
    """Transitions of a suffix automaton as parallel arrays; state 0 is the root."""
    states: int
    source: np.ndarray
    symbol: np.ndarray
    target: np.ndarray


def automaton(symbols: list[int]) -> Automaton:
    """Suffix automaton of a symbol sequence, built online."""
    step: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    edges = [(s, c, t) for s, out in enumerate(step) for c, t in out.items()]
    arr = np.array(edges, np.int32).reshape(-1, 3)
    return Automaton(len(step), arr[:, 0], arr[:, 1], arr[:, 2])


@dataclass
class Model:
    """What a prediction needs: languages, the alphabet, one automaton each."""
    languages: list[str]
    alphabet: dict[str, int]
    automata: list[Automaton]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dense steps of all languages: entry = (next state's row << 1) | phrase ended."""
        width = len(self.alphabet) + 3
        rows = sum(a.states + 1 for a in self.automata)
        steps = np.empty((rows, width), np.int32)
        roots, base = [], 0
        for a in self.automata:
            # one more state stands after a symbol never seen, which is a phrase by itself
            start = np.full(width, base + a.states, np.int64)
            at_root = a.source == 0
            start[a.symbol[at_root]] = a.target[at_root] + base
            part = steps[base:base + a.states + 1]
            part[:] = ((start * width) << 1) | 1
            part[a.source, a.symbol] = ((a.target.astype(np.int64) + base) * width) << 1
            part[0, start == base + a.states] &= ~1  # the first phrase of a window is counted already
            part[:, PAD] = ((np.arange(a.states + 1) + base) * width) << 1
            roots.append(base * width)
            base += a.states + 1
        kind = np.full(_RARE, GAP, np.int32)
        for c, k in self.alphabet.items():
            kind[ord(c)] = k
        return steps.ravel(), np.array(roots, np.int64), kind


def _letters() -> np.ndarray:
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(_RARE)), bool, _RARE)
    return _IS_LETTER


_IS_LETTER: np.ndarray | None = None


def build(samples: dict[str, list[str]], sample: int = SAMPLE) -> Model:
    """Automata of the sample texts by language; each language takes up to ``sample`` symbols."""
    texts = {}
    for lang in sorted(samples):
        joined = " ".join(x for x in map(squeezed, samples[lang]) if x)[:sample]
        if joined:
            texts[lang] = joined
    letters = sorted({c for t in texts.values() for c in t} - {" "})
    alphabet = {c: OTHER + 1 + i for i, c in enumerate(letters)}
    code = alphabet | {" ": GAP}
    return Model(list(texts), alphabet, [automaton([code[c] for c in t]) for t in texts.values()])


def learnable() -> Column:
    """Rows to learn from in the query: labelled, and outside the held-out third."""
    return F.col("lang").isNotNull() & ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, of_row: int = SAMPLE_OF_ROW, sample: int = SAMPLE) -> Model:
    """Learn from (text, lang) rows.

    Copies count once: of the distinct texts of each language, the first ``rows``
    by hash are taken, all of them if there are fewer.  Of each up to ``of_row``
    characters are read, in ``PIECES`` pieces spread over the text; pieces of all
    texts take turns until there are ``sample`` symbols.
    """
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    first = Window.partitionBy("lang").orderBy("h")
    picked = known.select("lang", "h").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= rows)
    picked = written(picked.drop("nth"), "langid-picked")  # bounded; its stored size decides how it is joined
    size = max(1, of_row // PIECES)
    length = F.length("text")
    last = F.greatest(F.lit(1), F.least(F.lit(PIECES), F.ceil(length / size))) - 1
    spread = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.substring(
        F.col("text"), (F.floor(i * (length - size) / F.greatest(last, F.lit(1))) + 1).cast("int"), F.lit(size)))
    pieces = known.join(picked, ["lang", "h"], "left_semi").select("lang", "h", spread.alias("pieces"))
    by_lang: dict[str, list[tuple]] = {}
    for r in pieces.groupBy("lang", "h").agg(F.min("pieces").alias("pieces")).collect():
        held = [x for x in r["pieces"] if x]
        turn = r["h"] % max(1, len(held))  # not every text begins with its head
        by_lang.setdefault(r["lang"], []).extend((i, r["h"], x) for i, x in enumerate(held[turn:] + held[:turn]))
    return build({lang: [x for _, _, x in sorted(held)] for lang, held in by_lang.items()}, sample)


def _symbols(texts: list[str | None], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, symbols per text, and whether a text has a letter."""
    is_letter = _letters()
    joined = "\x00".join(_fold(t) if t else "" for t in texts) + "\x00"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(code == 0)
    if len(ends) != len(texts):  # a text holds the separator itself
        cleaned = [(_fold(t) if t else "").replace("\x00", " ") for t in texts]
        code = np.frombuffer(("\x00".join(cleaned) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(code == 0)
    letter = is_letter[code]
    symbol = kind[code]
    symbol[letter & (symbol == GAP)] = OTHER
    symbol[~letter] = GAP
    owner = np.zeros(len(code), np.int64)
    owner[ends[:-1] + 1] = 1
    np.cumsum(owner, out=owner)
    gap = ~letter
    keep = np.ones(len(code), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])  # one symbol per run of gaps
    keep[ends] = False
    first = np.concatenate(([0], ends[:-1] + 1))
    keep[first] &= ~gap[first]
    owner, symbol = owner[keep], symbol[keep]
    sizes = np.bincount(owner, minlength=len(texts))
    seen = np.bincount(owner, weights=symbol != GAP, minlength=len(texts)) > 0
    return symbol, sizes, seen


def phrases(texts: list[str | None], dense: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases (texts x languages), symbols per text, whether a text has a letter."""
    steps, roots, kind = dense
    symbol, sizes, seen = _symbols(texts, kind)
    parts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), parts)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(parts)[:-1])), parts)
    at = starts[owner] + nth * WINDOW
    size = np.minimum(sizes[owner] - nth * WINDOW, WINDOW)
    order = np.argsort(-size, kind="stable")  # lanes end one after the other
    owner, at, size = owner[order], at[order], size[order]
    lanes = len(owner)
    state = np.repeat(roots[:, None], lanes, axis=1).astype(np.int64)
    count = np.full((len(roots), lanes), 1, np.int64)
    if lanes:
        live_at = np.searchsorted(-size, -np.arange(1, WINDOW + 1), side="right")
        for i in range(int(size[0])):
            live = int(live_at[i])
            entry = steps[state[:, :live] + symbol[at[:live] + i]]
            count[:, :live] += entry & 1
            state[:, :live] = entry >> 1
    total = np.zeros((len(texts), len(roots)), np.int64)
    for k in range(len(roots)):
        total[:, k] = np.bincount(owner, weights=count[k], minlength=len(texts))
    return total, sizes, seen


def classify(texts: list[str | None], model: Model, dense: tuple) -> tuple[list[str], np.ndarray]:
    """Language and score of each text.

    The score compares the winner's phrases with the runner-up's: 0.5 when both
    need as many, nearing 1 as the runner-up needs more; 1 for a single language.
    """
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    cuts, held = [0], 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > AT_ONCE and i > cuts[-1]:
            cuts.append(i)
            held = len(t or "")
    parts = [phrases(texts[a:b], dense) for a, b in zip(cuts, [*cuts[1:], len(texts)])]
    total, sizes, seen = (np.concatenate(x) for x in zip(*parts))
    rate = total / np.maximum(sizes, 1)[:, None]
    best = np.argmin(rate, axis=1)
    ranked = np.sort(rate, axis=1)
    if rate.shape[1] > 1:
        score = ranked[:, 1] / np.maximum(ranked[:, 0] + ranked[:, 1], 1e-12)
    else:
        score = np.ones(len(texts))
    langs = [model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), seen.tolist())]
    return langs, np.where(seen, score, 0.0)


def _ready(shared) -> tuple[Model, tuple]:
    """The model and its dense tables, made once in a worker process."""
    model = shared.value
    return model, kept("langid", model.key, lambda: model.tables() if model.languages else ())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known, dense = _ready(shared)
        for b in batches:
            langs, score = classify(b.column("text").to_pylist(), known, dense)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, whole, whose text has a letter; a null ``lang`` becomes the predicted one.

    With nothing learned the rows stay as they are, their languages null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known, dense = _ready(shared)
        for b in batches:
            texts = b.column("text").to_pylist()
            if known.languages:
                langs, _ = classify(texts, known, dense)
                lang = pa.array([x if x != UNKNOWN else None for x in langs], pa.string())
                at = b.schema.get_field_index("lang")
                seen = lang.is_valid()
                filled = pc.coalesce(b.column(at), lang.cast(b.schema.field(at).type))
                b = pa.RecordBatch.from_arrays([filled if i == at else c for i, c in enumerate(b.columns)], b.schema.names)
            else:
                seen = pa.array(_symbols(texts, np.full(_RARE, GAP, np.int32))[2], pa.bool_())
            yield b.filter(seen)

    return docs.mapInArrow(run, docs.schema)
