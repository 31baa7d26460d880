"""Token ids of whole texts with a public tokenizer file, many texts at once."""
from __future__ import annotations

import gc
import os
import re
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Words after which a worker process starts a new store; the one before is kept for look-ups.
REMEMBERED = 400_000
#: Runs that are encoded as one text.
TOGETHER = 64
# White space as the tokenizer's own splitting pattern sees it, and
# the letters of Latin script below U+0100.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Runs that the tokenizer keeps apart from what follows; an apostrophe may join, a `<` begins special tokens, so they are not among the marks.
_RUN = re.compile(rf"\n|[{_LATIN}]+|[0-9]+|[!-&(-/:;=-@\[-`{{-~]+")
#: The tokenizer never joins across the borders of these pieces, so they can be encoded apart.
_PIECE = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_INNER_SPACE = re.compile(rf"\n?[^{_SPACE}]*[{_SPACE}]")
#: Stands for the ids of a word with white space beside or inside it.
_WHOLE = b""


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to ids, remembering the ids of the words it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.single = Tokenizer.from_file(path)  # for runs, which need no splitting
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.line_end = self._plain(["\n"])[0]
        self.stop = int(np.frombuffer(self.line_end, "<u4")[0])
        self.forget()

    def forget(self) -> None:
        """Start with empty stores: words as they stand after a space, and runs that follow no space."""
        self.known: dict[str, bytes] = {"": _WHOLE}
        self.before: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {"\n": self.line_end}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, runs: list[str]) -> list[bytes]:
        """Ids of runs, many in one text: no id spans the line ends between them, and nothing else gives theirs."""
        out = []
        for at in range(0, len(runs), 100 * TOGETHER):
            texts = ["\n".join(runs[k:k + TOGETHER]) + "\n" for k in range(at, min(at + 100 * TOGETHER, len(runs)), TOGETHER)]
            got = np.concatenate([np.array(e.ids, "<u4")
                                  for e in self.single.encode_batch_fast(texts, add_special_tokens=False)])
            raw, stops = got.tobytes(), (4 * np.flatnonzero(got == self.stop)).tolist()
            out += [raw[a:b] for a, b in zip([0, *(x + 4 for x in stops)], stops)]
        return out

    def _learn(self, words: list[str]) -> None:
        """Add the ids of words; a word stands for itself after a space, or after its line end."""
        known, bare, composed, others, alone = self.known, self.bare, [], [], set()
        letters = pc.match_substring_regex(pa.array(words, pa.string()), f"^[{_LATIN}]+$").to_numpy(zero_copy_only=False)
        spaced = list(compress(words, letters))
        for w in compress(words, ~letters):
            parts = _RUN.findall(w)
            if sum(map(len, parts)) == len(w) and w != "\n":
                composed.append((w, parts))
                alone.update(parts[1:])
            elif w == "\n" or _INNER_SPACE.match(w[1:] if w[0] == "\n" else w):
                known[w] = _WHOLE  # the whole text goes the plain way
            else:
                others.append(w)
        first = {p[0] for _, p in composed}.difference(spaced)
        spaced += [w for w in first if w not in known and w != "\n"]
        known.update(zip(spaced, self._many([" " + w for w in spaced])))
        new = list(alone.difference(bare))
        bare.update(zip(new, self._many(new)))
        for w, (head, *rest) in composed:
            if rest:
                known[w] = b"".join([self.line_end if head == "\n" else known[head], *[bare[p] for p in rest]])
        if others:
            ids = self._plain([w[1:] if w[0] == "\n" else " " + w for w in others])
            known.update((w, self.line_end + i if w[0] == "\n" else i) for w, i in zip(others, ids))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        held = pc.fill_null(column.cast(pa.large_string()), "").dictionary_encode()  # copies are encoded once
        collects = gc.isenabled()
        gc.disable()  # nothing here refers back to itself, and the stores are long to look through
        try:
            done = self._encode(held.dictionary)
        finally:
            if collects:
                gc.enable()
        return [done[i] for i in held.indices.to_pylist()]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of different words, learned where they are new."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {"": _WHOLE}
        if len(self.bare) > REMEMBERED:
            self.bare = {"\n": self.line_end}
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            names = [words[i] for i in missing]
            again = list(map(self.before.get, names))
            self.known.update((w, ids) for w, ids in zip(names, again) if ids is not None)
            self._learn([w for w, ids in zip(names, again) if ids is None])
            for i, w in zip(missing, names):
                found[i] = self.known[w]
        return found

    def _encode(self, texts: pa.Array) -> list[bytes]:
        none, line_end = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        lines = pc.binary_join_element_wise(line_end, pc.replace_substring(texts, "\n", " \n"), none)
        words = pc.split_pattern(lines, " ")
        coded = words.values.dictionary_encode()
        ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        word = coded.indices.to_numpy()
        n = size[word]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[word] - ends + n, n)
        at += np.arange(len(at))
        raw = flat[at].tobytes()
        of = words.offsets.to_numpy()
        border = 4 * np.concatenate(([0], ends))[of]
        whole = np.diff(np.concatenate(([0], np.cumsum(n == 0)))[of]) > 0
        out = [raw[a:b] for a, b in zip((border[:-1] + len(self.line_end)).tolist(), border[1:].tolist())]
        for i in np.flatnonzero(whole):  # runs of white space: encode between safe borders instead
            out[i] = b"".join(self._plain(_PIECE.findall(texts[i].as_py())))
        return out


def encoder(path: str) -> Encoder:
    """One encoder per file in a worker process."""
    return kept("tokens", path, lambda: Encoder(path))
