"""Token ids of many texts with a word tokenizer, each distinct word encoded once.

The tokenizer file must drop white space and split at it, as the word-level BPE files do: the
ids of a text are then those of its words in turn. Texts are cut at ASCII white space and their
words made distinct in Arrow; words seen before come from a bounded cache. A word of plain
letters with closing punctuation is looked up by its parts; any other goes through the whole
tokenizer, as does every word if the file has other settings than those the shortcut knows.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridloom.llm.hashed import compact

#: Words that one worker remembers; when full, it starts anew.
CACHE_WORDS = 250_000
#: Letters whose lower case and normal form do not hang on their neighbours, then ASCII signs but the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-į]+)([!-&(-/:-@\[-`{-~]*)")
#: Settings under which a plain word's ids are those of its letters, then those of its signs (fixed values).
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOADED: dict[str, WordTokens] = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        cut = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.plain = steps == _NORMALIZERS and cut == _SPLIT and made.get("post_processor") is None
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.filled = 0

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            spelled = part if part.isascii() else part.encode().decode("latin1").translate(self.letters)
            ids = self.parts[part] = [t.id for t in self.whole.model.tokenize(spelled)]
        return ids

    def _encode(self, word: str) -> list[int]:
        if self.plain and (m := _PLAIN.fullmatch(word)):
            return self._part(m[1].lower()) + self._part(m[2]) if m[2] else self._part(m[1].lower())
        return self.whole.encode(word, add_special_tokens=False).ids

    def _index(self, words: list[str]) -> np.ndarray:
        """Place of each distinct word in the cache."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        get = self.known.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            coded = [self._encode(words[i]) for i in new.tolist()]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            first, ends = len(self.known), np.cumsum(sizes) + self.filled
            while len(self.starts) < first + len(new):
                self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
            while len(self.pool) < ends[-1]:
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.filled : ends[-1]] = np.fromiter((i for c in coded for i in c), np.uint32, int(sizes.sum()))
            self.starts[first : first + len(new)], self.lengths[first : first + len(new)] = ends - sizes, sizes
            self.filled = int(ends[-1])
            at[new] = np.arange(first, first + len(new))
            self.known.update(zip((words[i] for i in new.tolist()), range(first, first + len(new)), strict=True))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text among them); null has none."""
        cut = pc.ascii_split_whitespace(pc.fill_null(compact(texts).cast(pa.large_string()), ""))
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        of_word = self._index(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        bounds = bounds - bounds[0]
        sizes = self.lengths[of_word]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        within = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
        return self.pool[np.repeat(self.starts[of_word], sizes) + within], ends[bounds]


def word_tokens(path: str) -> WordTokens:
    """One per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]
