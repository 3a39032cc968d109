"""Token ids by the tokenizers library, at the cost of each distinct word once.

The library spends most of its time on normalising and splitting.  For
tokenizers that drop white space, a text's ids are its words' ids in a row, so a
batch's distinct fragments are encoded by the library and the ids are put
together by numpy.  ``splits_on_space`` says whether a tokenizer file is of that
kind; others are encoded text by text.  Fragments are:

- words between ASCII white space (0x20, 0x09-0x0D), as the pre-tokeniser drops
  all white space and no rule reaches across it;
- cut further between an ASCII letter and ASCII punctuation other than the
  apostrophe: the pre-tokeniser always cuts there, and neither side composes
  with the other when normalised;
- with A-Z lower-cased when the normaliser lower-cases.

A text that holds the string of one of the tokenizer's added tokens (such as
``<|endoftext|>``, which the library maps to the token's own id wherever it
stands) is encoded by the library as a whole.

A process keeps what it has encoded, up to CACHE_IDS ids, then starts anew.
"""

from __future__ import annotations

import json
import os
import re
import threading

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkit import LOWER, Texts, Words, hash_ranges, texts_of, words_of

CACHE_IDS = 6_000_000
BATCH_FRAGMENTS = 256

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[ord("'")] = False

#: One letter run: letters that no normal form changes and every Unicode version has.
_ONE_RUN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

_LOCK = threading.Lock()
_CODECS: dict[str, "WordCodec"] = {}


def codec(path: str) -> "WordCodec":
    """This process's codec of a tokenizer file."""
    with _LOCK:
        if path not in _CODECS:
            _CODECS[path] = WordCodec(path)
        return _CODECS[path]


class IdCache:
    """Ids of fragments by the fragments' hashes, in flat arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: list[np.ndarray]) -> None:
        at = len(self.ids) + np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.ids = np.concatenate([self.ids, *ids])
        keys = np.concatenate([self.keys, keys])
        rank = np.argsort(keys)
        self.keys, self.at, self.size = keys[rank], np.concatenate([self.at, at])[rank], np.concatenate([self.size, counts])[rank]

    def ids_of(self, words: Words, learn) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments in a row, and the number of ids of each text; ``learn`` adds missing ones."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(words.texts), np.int64)
        h = hash_ranges(words.texts.buf, words.start, words.end)
        kinds, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.ids) > CACHE_IDS:
            self.clear()
        slot = np.searchsorted(self.keys, kinds)
        new = np.ones(len(kinds), dtype=bool)
        inside = slot < len(self.keys)
        new[inside] = self.keys[slot[inside]] != kinds[inside]
        if new.any():
            learn(words, pick[new], kinds[new])
            slot = np.searchsorted(self.keys, kinds)
        size = self.size[slot][inverse]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[slot][inverse] - to[:-1], size) + np.arange(int(to[-1]))]
        return ids, np.diff(to[words.first])


class WordCodec:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = splits_on_space(spec)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        ends = spec["model"].get("end_of_word_suffix") or ""
        size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(size, dtype=bool)
        if ends:
            for token, i in spec["model"]["vocab"].items():
                self.closes[i] = token.endswith(ends)
        self.cache = IdCache()

    def _learn(self, words: Words, pick: np.ndarray, keys: np.ndarray) -> None:
        fragments = [words.texts.buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(words.start[pick].tolist(), words.end[pick].tolist(), strict=True)]
        encode = lambda x: self.tokenizer.encode_batch_fast(x, add_special_tokens=False)
        counts = np.empty(len(fragments), dtype=np.int64)
        parts: list[np.ndarray] = []
        # fragments of one pre-token each can share a call, as each ends with a closing token
        plain = np.array([_ONE_RUN.fullmatch(x) is not None for x in fragments], dtype=bool) if self.closes.any() else np.zeros(len(fragments), dtype=bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n_plain = int(plain.sum())
        for lo in range(0, n_plain, BATCH_FRAGMENTS):
            rows = order[lo : min(lo + BATCH_FRAGMENTS, n_plain)]
            ids = np.array(encode([" ".join([fragments[r] for r in rows])])[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(rows) or ends[-1] != len(ids):
                raise RuntimeError("tokenizer does not close its words")
            counts[lo : lo + len(rows)] = np.diff(ends, prepend=0)
            parts.append(ids)
        for lo in range(n_plain, len(order), BATCH_FRAGMENTS):
            rows = order[lo : lo + BATCH_FRAGMENTS]
            found = [x.ids for x in encode([fragments[r] for r in rows])]
            counts[lo : lo + len(rows)] = [len(x) for x in found]
            parts.append(np.array([i for x in found for i in x], dtype=np.uint32))
        self.cache.add(keys[order], counts, parts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        if not self.by_word:
            return self._whole(column)
        special = self._has_added(column)
        if not special.any():
            return self.cache.ids_of(fragments_of(texts_of(column)), self._learn)
        # texts with an added token go to the library, the others by fragments; then both in their order
        plain, plain_size = self.cache.ids_of(fragments_of(texts_of(pc.if_else(pa.array(special), "", column))), self._learn)
        made, made_size = self._whole(column.filter(pa.array(special)))
        size = plain_size.copy()
        size[special] = made_size
        source = np.repeat(special, size)
        ids = np.empty(int(size.sum()), dtype=np.uint32)
        ids[~source], ids[source] = plain, made
        return ids, size

    def _has_added(self, column: pa.Array) -> np.ndarray:
        found = np.zeros(len(column), dtype=bool)
        for x in self.added:
            found |= pc.fill_null(pc.match_substring(column, x), False).to_numpy(zero_copy_only=False)
        return found

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = ["" if x is None else x for x in column.to_pylist()]
        found = [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], dtype=np.int64)


def splits_on_space(spec: dict) -> bool:
    """Whether a tokenizer file drops white space, lower-cases, and cuts letters from marks, as this module assumes."""
    names = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    first = cuts[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    pattern = first.get("pattern", {}).get("Regex", "")
    return "Lowercase" in names and drops and "[\\p{L}]+" in pattern and "[^\\s\\p{L}\\p{N}]+" in pattern


def fragments_of(texts: Texts) -> Words:
    words = words_of(Texts(LOWER[texts.buf], texts.offsets))
    buf = words.texts.buf[: texts.size]
    if not len(buf) or not len(words):
        return words
    letter, mark = _LETTER[buf], _MARK[buf]
    cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
    cut = cut[~np.isin(cut, words.texts.offsets)]
    start = np.sort(np.concatenate([words.start, cut]))
    end = np.sort(np.concatenate([words.end, cut]))
    return Words(words.texts, start, end, np.searchsorted(start, words.texts.offsets))
