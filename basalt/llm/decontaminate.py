"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters (lower case, words joined by one blank) may differ from a passage by
k = floor(rate * n) edits. Cut into k + 1 pieces, at least one piece stays whole, so an Aho-Corasick
automaton over all pieces finds every passage; Myers' bit-parallel algorithm verifies the window
around each hit. The document side is one pass with no shuffle.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_gaps = re.compile(r"[\W_]+")
#: Items and their characters that one pass over the documents takes at most.
ITEMS_A_PASS, CHARS_A_PASS = 20_000, 16_000_000


def normalise(text: str | None) -> str:
    return _gaps.sub(" ", (text or "").lower()).strip()


def myers(pattern: str, masks: dict[str, int], text: str) -> int:
    """Smallest edit distance of ``pattern`` to any substring of ``text``."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        up = (mh << 1 | ~(xv | ph)) & full
        down = ph & xv
    return best


class Matcher:
    """All items of one pass: their pieces' automaton and their Myers masks."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = normalise(text)
            if not t:
                continue
            k = int(len(t) * rate)
            masks: dict[str, int] = {}
            for i, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << i
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((len(self.items), a))
            self.items.append((item_id, t, k, masks))
        self.automaton = ahocorasick.Automaton()
        for p, owners in pieces.items():
            self.automaton.add_word(p, (len(p), owners))
        if pieces:
            self.automaton.make_automaton()

    def leaks(self, text: str | None) -> dict[int, int]:
        """item_id -> smallest distance, for the items of which ``text`` holds a passage within budget."""
        if not self.items:
            return {}
        t = normalise(text)
        found: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        whole: set[int] = set()
        for end, (size, owners) in self.automaton.iter(t):
            for i, at in owners:
                if i in whole:
                    continue
                item_id, item, k, masks = self.items[i]
                start = end - size + 1 - at
                spot = (i, start // (k + 1))
                if spot in seen:
                    continue
                if t.startswith(item, max(start, 0)) and start >= 0:
                    whole.add(i)
                    found[item_id] = 0
                    continue
                seen.add(spot)
                base = spot[1] * (k + 1)
                d = myers(item, masks, t[max(base - k, 0) : base + k + len(item) + k])
                if d <= k:
                    found[item_id] = min(d, found.get(item_id, d))
        return found


def _passes(items: DataFrame, id_col: str, text_col: str):
    """Blocks of the items, each of a bounded size."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // (ITEMS_A_PASS // 2)), -(-chars // (CHARS_A_PASS // 2)))
    for b in range(blocks):
        yield [(r.id, r.text) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()]


def leaks(docs: DataFrame, items: DataFrame, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance) for each document and item it leaks.

    Null, empty and wordless texts and items leak nothing. Repeated rows give repeated results;
    null ids are carried through. An empty table on either side gives no rows. An item is found wherever
    its characters stand, within words too, so one of a few letters leaks from most documents; a benchmark
    with such items needs them filtered first.
    """
    out = None
    for block in _passes(items, item_col, item_text):
        matcher = _Lazy(block, rate)

        def run(batches, matcher=matcher):
            for batch in batches:
                found = [(d, i, k) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, k in matcher.get().leaks(t).items()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))], names=["doc_id", "item_id", "distance"])

        part = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, item_id long, distance long")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.06, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item; one pass, no shuffle."""
    names, at = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # any name may come, dotted ones too
    for block in _passes(items, item_col, item_text):
        matcher = _Lazy(block, rate)

        def run(batches, matcher=matcher):
            for batch in batches:
                yield batch.filter(pa.array([not matcher.get().leaks(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)


#: Matchers of a worker process by the digest of their items; a worker meets those of one call at a time.
_made: dict[str, Matcher] = {}


class _Lazy:
    """Builds the matcher on first use in each worker process: items travel, automata do not."""

    def __init__(self, items, rate):
        self.args = (items, rate)
        self.digest = hashlib.sha256(repr((sorted(items, key=repr), rate)).encode()).hexdigest()

    def get(self) -> Matcher:
        if self.digest not in _made:
            if len(_made) >= 4:
                _made.clear()
            _made[self.digest] = Matcher(*self.args)
        return _made[self.digest]
