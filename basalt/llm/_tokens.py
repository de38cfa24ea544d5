"""Exact tokenisation with a bounded cache of words.

A byte-level BPE with the usual splitting pattern never lets a token cross from a non-space
to a following white space, and a word-end BPE drops white space. So a text whose white space is
single blanks or line feeds between words can be encoded word by word, and each distinct word only
once per worker. The second one's pattern also parts a letter from a stop that ends a word, so the ids of such
a word are put together from those of the word alone and of the stop. All other texts, and tokenizers of other kinds, are encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: New words that are encoded as one text.
RUN_WORDS = 4096
#: Distinct words that a worker remembers unless told otherwise; beyond it the cache starts afresh.
CACHE_WORDS = 1_000_000
_encoders: dict[str, "Encoder"] = {}
_separators = re.compile("[\x00\x1c-\x1f]")
_stop = re.compile("(?<=[A-Za-z])([.,;:!?])(?=\x1f|$)")


def _single(text: str) -> bool:
    """Whether all white space of a text is single blanks or line feeds between words."""
    if text.isascii():
        return not (text[0] in " \n" or text[-1] in " \n" or any(w in text for w in ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")))
    return " ".join(text.split()) == text.replace("\n", " ")


def encoder(path: str, cache_words: int = CACHE_WORDS) -> "Encoder":
    """The worker's encoder of a tokenizer; it keeps at most ``cache_words`` words, some 200 bytes each."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache_words = cache_words
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, bytes] = {}
        self.cache_words = CACHE_WORDS
        self.edges: np.ndarray | None = None
        spec = json.loads(self.tokenizer.to_str())
        norm = spec["normalizer"] or {}
        self.lowers = any(n["type"] == "Lowercase" for n in norm.get("normalizers", [norm] if norm else []))
        self.suffix = spec["model"].get("end_of_word_suffix")
        pre = spec["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers", [])
        spaced = any(c.isspace() for t in spec["added_tokens"] for c in t["content"]) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.joined = not spaced and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        self.dropped = not spaced and len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and r"[^\s" in steps[0]["pattern"].get("Regex", "") and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]

    def _words(self, text: str) -> list[str] | None:
        """Keys of the cache whose ids, joined, are the text's; None if the text must be encoded whole."""
        if not (self.joined or self.dropped) or _separators.search(text):
            return None
        if self.dropped:
            return text.split()
        if not text:
            return []
        if not _single(text):
            return None
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\x00" + keys[0]
        return keys

    def _plain(self, key: str) -> str:
        return key if self.dropped or key[0] == "\n" else key[1:] if key[0] == "\x00" else " " + key

    def _forms(self, keys: list[str]) -> list[str]:
        """Each key as keys whose ids, joined, are its own, between \x1e; all at once, as one text."""
        text = "\x1f".join(keys)
        if self.lowers and text.isascii():
            text = text.lower()
        return _stop.sub("\x1e\\1", text).split("\x1f")

    def learn(self, need: list[str]) -> None:
        """Puts the ids of the words into the cache."""
        if self.joined:
            self._learn(need)
            return
        plain = [k for k in need if k.isascii()]
        other = [k for k in need if not k.isascii()]
        forms = [f for part in (plain, other) if part for f in self._forms(part)]
        self._learn(list({p for f in forms for p in f.split("\x1e")}.difference(self.cache)))
        get = self.cache.__getitem__
        made = [(k, b"".join(map(get, f.split("\x1e"))) if "\x1e" in f else get(f)) for k, f in zip(plain + other, forms) if k != f]
        self.cache.update(made)

    def _learn(self, need: list[str]) -> None:
        """Puts the ids of keys without a stop behind them into the cache.

        Plain words are encoded many at a time: of a byte-level BPE a token begins with the blank byte where a
        word begins, of a word-end BPE one ends with the suffix where a word of letters ends, and nowhere
        else. If the counts differ, each of the words is encoded alone.
        """
        ids = lambda e: array("I", e.ids).tobytes()
        tokens = lambda: (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        if self.joined:
            many = [k for k in need if k[0] not in "\x00\n"]
            if self.edges is None:
                self.edges = np.array([t.startswith("\u0120") for t in tokens()])
        else:
            many = [k for k in need if k.isascii() and k.isalpha()] if self.suffix else []
            if self.edges is None and self.suffix:
                self.edges = np.array([t.endswith(self.suffix) for t in tokens()])
        alone = set(need).difference(many)
        for s in range(0, len(many), RUN_WORDS):
            part = many[s : s + RUN_WORDS]
            row = np.array(self.tokenizer.encode_batch_fast([" " * self.joined + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.edges[row])
            raw = row.tobytes()
            if self.joined and len(at) == len(part) and not at[0]:
                cuts = [*(4 * at).tolist(), 4 * len(row)]
            elif not self.joined and len(at) == len(part) and at[-1] == len(row) - 1:
                cuts = [0, *(4 * at + 4).tolist()]
            else:
                alone.update(part)
                continue
            self.cache.update(zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))
        alone = list(alone)
        self.cache.update(zip(alone, map(ids, self.tokenizer.encode_batch_fast([self._plain(k) for k in alone], add_special_tokens=False))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        # Many small objects that all stay: collections would pass over them again and again for nothing.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = lambda e: array("I", e.ids).tobytes()
        keys = [self._words(t) for t in texts]
        every = set().union(*(k for k in keys if k))
        need = list(every.difference(self.cache))
        if len(self.cache) + len(need) > self.cache_words:
            self.cache.clear()
            need = list(every)
        if need:
            self.learn(need)
        get = self.cache.__getitem__
        return [b"".join(map(get, k)) if k is not None else ids(self.tokenizer.encode(t, add_special_tokens=False)) for k, t in zip(keys, texts)]


def groups(texts: list[str], size: int = 1 << 22):
    """Slices (lo, hi) of about ``size`` characters."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
