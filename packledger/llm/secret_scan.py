"""Secrets in text: three plain patterns and an assignment-aware lexer.

The patterns (``BASE``) find their matches from left to right without overlap.
The lexer reads assignments as they stand in source and configuration files
(``name = "literal"``, ``"name": "literal"``, ``name := a + "literal"``,
``--name=literal``, ``define("name", "literal")``, ``<name>literal</name>``,
``<add key="name" value="literal"/>``, indented blocks after ``name: |``), keeps the constants it has seen, follows names through
other names to the literals behind them, and scores a literal by the names it
ends up in.  A literal that reaches the threshold is added as kind ``named``
unless a pattern's match covers it; where no piece of a concatenation reaches it
alone, the pieces are scored as one value and added together.  A word is a
reference if the text assigns that name, digits or not.

Every name is walked once and every value put together once, so the time of a
text grows with its length.  Spans are code points, end exclusive.  One pass over
the texts, no shuffle.

Cases: null text is empty text; an empty text has no spans; a text of any length
is read whole; repeated rows give repeated results; an empty table gives no
rows; a column of any other name is passed over.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Kinds in the order they are listed in; the lexer's kind comes last.
KINDS = ("assign", "access", "hex", "named")

# The patterns as stated, with the characters each must have at least.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of hex digits is matched whole or not at all
_ASSIGN_LEAST, _ACCESS_LEAST = 12, 18

#: Words of a target name, and how much each speaks for a secret (below 0: against it).
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.5, "bearer": 0.7, "private": 0.5,
    "key": 0.4, "access": 0.3, "api": 0.3, "signing": 0.4, "encryption": 0.4, "client": 0.1, "salt": 0.4,
    "cookie": 0.3, "session": 0.3, "jwt": 0.8, "webhook": 0.3, "dsn": 0.5,
    "count": -0.8, "length": -0.8, "len": -0.8, "size": -0.8, "max": -0.6, "min": -0.6, "name": -0.6,
    "label": -0.8, "field": -0.6, "prompt": -0.8, "hint": -0.8, "help": -0.8, "type": -0.6, "url": -0.4,
    "path": -0.5, "file": -0.5, "public": -0.7, "enabled": -0.8, "expiry": -0.7, "ttl": -0.8, "regex": -0.8,
}
#: Literals that stand for a secret without being one.
PLACEHOLDER = re.compile(
    r"(?i)change[-_ ]?me|example|placeholder|your[-_ ]|dummy|redacted|\bnone\b|\bnull\b|\btrue\b|\bfalse\b"
    r"|^[x*.\-_#]+$|[<{$%]\w*[>}%]")
#: The same without the pattern of a whole literal, to be looked for where pieces meet.
_WORDS = re.compile(PLACEHOLDER.pattern.replace(r"|^[x*.\-_#]+$", ""))
LEAST_LITERAL, THRESHOLD = 8, 0.5

_QUOTED = r"""(?:[rRbBfFuU]{1,2}+(?=["']))?(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)"""
_TERM = rf"""(?:{_QUOTED}|\$\{{[\w.\-]+\}}|[^\s"'`,;+(){{}}\[\]<>=:|&]++)"""
_PAIR = re.compile(
    r"""(?<![\w.\-])(?P<name>[A-Za-z_][\w.\-]*+)["']?[ \t]*+(?::=|=>|[=:](?![=:]))[ \t]*+"""
    rf"""(?P<value>{_TERM}(?:[ \t]*+\+[ \t]*+{_TERM})*+)""")
_TERMS = re.compile(_TERM)
_REFERENCE = re.compile(r"\$\{([\w.\-]+)\}|([A-Za-z_][\w.]*)")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NAME = re.compile(r"[A-Za-z_][\w.\-]*")
#: f("NAME", "literal", as in define and setenv.
_CALL = re.compile(rf"(?<![\w.])[A-Za-z_][\w.]*+\([ \t]*+(?P<name>{_QUOTED})[ \t]*+,[ \t]*+(?P<value>{_QUOTED})")
_ELEMENT = re.compile(r"<(?P<tag>[A-Za-z][\w:.\-]*+)(?P<inside>[^<>]*+)>(?:(?P<text>[^<]*+)</(?P=tag)[ \t]*+>)?")
_ATTRIBUTE = re.compile(r"""(?<![\w:.\-])([\w:.\-]++)[ \t]*+=[ \t]*+("[^"]*+"|'[^']*+')""")
_BLOCK = re.compile(r"""^(?P<indent>[ \t]*+)(?:-[ \t]++)?["']?(?P<name>[A-Za-z_][\w.\-]*+)["']?:[ \t]*+[|>][-+0-9]*+[ \t]*+\n""", re.M)
_LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|\Z)")
#: Attributes that hold a name beside one called value.
_NAMING = ("key", "name", "id")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns."""
    out = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    """How sensitive a target name is, 0 to 1, from the words it is made of."""
    words = [w.lower() for w in _NAME_PART.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:])}
    total = sum(NAME_WORDS.get(w, 0.0) for w in words) + sum(NAME_WORDS.get(w, 0.0) for w in joined)
    return max(0.0, min(1.0, total))


def _variety(bits: float, kinds: int) -> float:
    return min(1.0, bits / 3.5) * (1.0 if kinds > 1 else 0.6)


def _bits(counts: Counter, n: int) -> float:
    return -sum(k / n * math.log2(k / n) for k in counts.values())


_KINDS = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"), re.compile("[^A-Za-z0-9]"))


def literal_score(literal: str) -> float:
    """How much a literal looks like a secret, 0 to 1: variety of characters, no placeholder."""
    n = len(literal)
    if n < LEAST_LITERAL or PLACEHOLDER.search(literal) or " " in literal.strip():
        return 0.0
    return _variety(_bits(Counter(literal), n), sum(bool(p.search(literal)) for p in _KINDS))


def _inner(m: re.Match, group: str | int = 0) -> tuple[int, int]:
    """The span of a quoted literal without its prefix and quotes."""
    a, b = m.span(group)
    while m.string[a] not in "\"'`":
        a += 1
    return a + 1, b - 1


def pairs(text: str):
    """(name, terms) of each assignment; a term is a literal's (start, end) or the name it refers to."""
    found = list(_PAIR.finditer(text))
    assigned = {m["name"] for m in found}
    for m in found:
        terms: list[tuple[int, int] | str] = []
        for t in _TERMS.finditer(text, m.start("value"), m.end("value")):
            word = t[0]
            r = _REFERENCE.fullmatch(word)
            name = (r[1] or r[2]) if r else word
            if word[-1] in "\"'`":
                terms.append(_inner(t))
            elif name in assigned or r and not any(c.isdigit() for c in word):
                terms.append(name)
            else:
                terms.append(t.span())
        yield m["name"], terms
    yield from _marked_up(text)


def _marked_up(text: str):
    """(name, terms) of calls with two literals, of elements, and of indented blocks."""
    if "(" in text:
        for m in _CALL.finditer(text):
            a, b = _inner(m, "name")
            if _NAME.fullmatch(text, a, b):
                yield text[a:b], [_inner(m, "value")]
    if "<" in text and ">" in text:
        for m in _ELEMENT.finditer(text):
            if m["text"]:
                yield m["tag"], [_stripped(text, *m.span("text"))]
            if m["inside"]:
                held = {a[1].lower(): (a.start(2) + 1, a.end(2) - 1)
                        for a in _ATTRIBUTE.finditer(text, m.start("inside"), m.end("inside"))}
                for n in _NAMING:
                    if n in held and "value" in held:
                        yield text[slice(*held[n])], [held["value"]]
    done = 0
    if "|" in text or ">" in text:
        for m in _BLOCK.finditer(text):
            if m.start() < done:
                continue  # a line of the block before
            terms, done = [], m.end()
            while done < len(text):
                line = _LINE.match(text, done)
                if line[2].strip() and len(line[1]) <= len(m["indent"]):
                    break
                if line[2].strip():
                    terms.append(_stripped(text, *line.span(2)))
                done = line.end()
            yield m["name"], terms


def _stripped(text: str, a: int, b: int) -> tuple[int, int]:
    whole = text[a:b]
    return a + len(whole) - len(whole.lstrip()), max(a + len(whole) - len(whole.lstrip()), a + len(whole.rstrip()))


class _Value:
    """What a concatenation looks like, kept so that another piece is added in the piece's time."""
    __slots__ = ("n", "counts", "kinds", "best", "mark", "plain", "lead", "trail", "inner", "solid", "head", "tail")
    EDGE = 64

    def __init__(self, literal: str = ""):
        self.n, self.counts = len(literal), Counter(literal)
        self.kinds = frozenset(i for i, p in enumerate(_KINDS) if p.search(literal))
        self.best = literal_score(literal)
        self.mark = bool(_WORDS.search(literal))  # holds the word of a placeholder
        self.plain = not literal.strip("x*.-_#")
        body = literal.strip()
        self.solid = bool(body)
        self.lead = " " in literal[:len(literal) - len(literal.lstrip())]
        self.trail = " " in literal[len(literal.rstrip()):]
        self.inner = " " in body
        self.head, self.tail = literal[:self.EDGE], literal[-self.EDGE - 1:]

    def add(self, other: "_Value") -> None:
        if not other.n:
            return
        if self.n:
            edge = self.tail + other.head
            self.mark = self.mark or other.mark or bool(_WORDS.search(edge, len(self.tail) > self.EDGE))
            if self.solid and other.solid:
                self.inner = self.inner or other.inner or self.trail or other.lead
                self.trail = other.trail
            elif self.solid:
                self.trail = self.trail or other.trail
            else:
                self.inner, self.lead, self.trail = other.inner, self.lead or other.lead, other.trail
            self.solid = self.solid or other.solid
            self.plain = self.plain and other.plain
        else:
            self.mark, self.inner, self.lead, self.trail = other.mark, other.inner, other.lead, other.trail
            self.solid, self.plain = other.solid, other.plain
        self.counts.update(other.counts)
        self.n += other.n
        if self.n >> 60:  # doubled again and again: no text could be so long, so shares of characters do
            self.counts = Counter({c: (k >> 30) + 1 for c, k in self.counts.items()})
            self.n = sum(self.counts.values())
        self.kinds |= other.kinds
        self.best = max(self.best, other.best)
        if len(self.head) < self.EDGE:
            self.head = (self.head + other.head)[:self.EDGE]
        self.tail = (self.tail + other.tail)[-self.EDGE - 1:]

    def score(self) -> float:
        """As ``literal_score`` of the whole."""
        if self.n < LEAST_LITERAL or self.mark or self.plain or self.inner:
            return 0.0
        return _variety(_bits(self.counts, self.n), len(self.kinds))


def _folded(text: str, held: dict[str, list[list]], wanted: list[list]) -> list[_Value]:
    """The values of assignments whose names stand for their last values, every value put together once.

    A name within its own value stands for nothing there.
    """
    uses = Counter(t for lists in held.values() for t in lists[-1] if isinstance(t, str))
    uses.update(t for terms in wanted for t in terms if isinstance(t, str))
    made: dict[str, _Value] = {}

    def put(terms: list) -> _Value:
        value = _Value()
        for i, t in enumerate(terms):
            if not isinstance(t, str):
                value.add(_Value(text[t[0]:t[1]]))
            elif t in made:
                uses[t] -= 1
                if not i and not uses[t]:
                    value = made.pop(t)  # its last use: go on from it instead of from a copy
                else:
                    value.add(made[t])
        return value

    out = []
    for terms in wanted:
        todo = [(t, False) for t in reversed(terms) if isinstance(t, str)]
        open_: set[str] = set()
        while todo:
            name, ready = todo.pop()
            if ready:
                made[name] = put(held[name][-1])
                open_.discard(name)
            elif name in held and name not in made and name not in open_ and uses[name] > 0:
                open_.add(name)
                todo.append((name, True))
                todo.extend((t, False) for t in reversed(held[name][-1]) if isinstance(t, str))
        out.append(put(terms))
    return out


def named_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that a sensitive name holds, directly, through other names or put together from pieces.

    Names are walked from the most sensitive on, so each is met once, with the
    greatest weight of the names that lead to it.
    """
    if not any(c in text for c in "=:(<"):
        return []
    held: dict[str, list[list]] = {}
    for name, terms in pairs(text):
        held.setdefault(name, []).append(terms)
    weights = {n: w for n in held if (w := name_score(n)) >= THRESHOLD}
    behind: dict[str, float] = {}
    for name in sorted(weights, key=weights.__getitem__, reverse=True):
        todo = [name]
        while todo:  # constants behind the name; a circle of names ends itself
            n = todo.pop()
            if n not in behind:
                behind[n] = weights[name]
                todo.extend(r for terms in held[n] for r in terms if isinstance(r, str) and r in held)
    out, joined = set(), []
    for name, weight in behind.items():
        for terms in held[name]:
            out.update(t for t in terms if not isinstance(t, str) and weight * literal_score(text[t[0]:t[1]]) >= THRESHOLD)
            if len(terms) > 1:
                joined.append((weight, terms))
    marked: set[str] = set()
    for (weight, terms), value in zip(joined, _folded(text, held, [t for _, t in joined])):
        if weight * value.best < THRESHOLD <= weight * value.score():
            todo = list(terms)
            while todo:
                t = todo.pop()
                if not isinstance(t, str):
                    if t[0] < t[1]:
                        out.add(t)
                elif t in held and t not in marked:
                    marked.add(t)
                    todo.extend(held[t][-1])
    return sorted((a, b, "named") for a, b in out)


def _uncovered(added: list, base: list) -> list:
    """The spans that lie in none of the base spans."""
    firsts, reach, ends = [], 0, []
    for a, b, _ in sorted(base):
        reach = max(reach, b)  # the furthest end of the spans that begin here or before
        firsts.append(a)
        ends.append(reach)
    return [s for s in added if not (i := bisect_right(firsts, s[0])) or ends[i - 1] < s[1]]


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    added = named_spans(text)
    if base and added:
        added = _uncovered(added, base)
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans as one."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    merged: list[list] = []
    for a, b, kind in found:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


_SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans is an array of (start, end, kind) by start, then kind."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for b in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(t)]
                     for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, spans {_SPANS}")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with secrets blanked out of ``text``; n_chars follows where there is one."""
    def run(batches):
        for b in batches:
            old = b.column("text").to_pylist()
            new = [redact(t) for t in old]
            cols = {n: b.column(n) for n in b.schema.names}
            cols["text"] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in cols:
                was = cols["n_chars"].to_pylist()
                now = [w if o == n or w is None else len(n) for w, o, n in zip(was, old, new)]
                cols["n_chars"] = pa.array(now, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
