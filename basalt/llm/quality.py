"""Text quality by histogram gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import _boost
from basalt.llm._scratch import Scratch
from basalt.llm._words import utf8, word_hashes

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "punctuation", "symbols", "bars", "exclaims", "non_ascii", "blanks",
    "distinct_words", "top_word", "same_as_before", "distinct_pairs", "distinct_lines", "line_bytes", "entropy", "stops", "commas", "top_byte", "marked_words",
)
#: Labelled rows that a model is fitted on at most (those of smallest hash of id).
SAMPLE = 20_000
_kind = {n: np.array([chr(c) in s for c in range(256)]) for n, s in {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "point": "!\"'(),-./:;?", "symbol": "#$%&*+<=>@[\\]^_`{|}~", "blank": " \t\n\r\v\f"}.items()}


def statistics(data: np.ndarray, h: np.ndarray) -> list[float]:
    """The features of one text, from its bytes and its words' hashes."""
    n, w = len(data), len(h)
    if not n:
        return [0.0] * len(FEATURES)
    count = sum(np.bincount(data[s : s + (1 << 22)], minlength=256) for s in range(0, n, 1 << 22)).astype(float)
    k = {name: count[mask].sum() for name, mask in _kind.items()}
    ascii_letters = k["upper"] + k["lower"]
    p = count[count > 0] / n
    _, times = np.unique(h, return_counts=True) if w else (None, np.zeros(1))
    pairs = len(np.unique(h[1:] ^ (h[:-1] << np.uint64(1)))) / (w - 1) if w > 1 else 1.0
    breaks = np.flatnonzero(data == 10)
    whole = len(breaks) + 1
    lines = len(set(data.tobytes().split(b"\n")))
    last = data[:-1][_kind["blank"][data[1:]] & ~_kind["blank"][data[:-1]]] if n > 1 else data
    return [
        np.log1p(n), np.log1p(w), (n - k["blank"]) / max(w, 1), (ascii_letters + count[128:].sum()) / n, k["upper"] / max(ascii_letters, 1), k["digit"] / n, k["point"] / n, k["symbol"] / n,
        count[124] / max(w, 1), count[33] / max(w, 1), count[128:].sum() / n, k["blank"] / n,
        len(times) / max(w, 1), times.max() / max(w, 1), float((h[1:] == h[:-1]).mean()) if w > 1 else 0.0, pairs, lines / whole, np.log1p(n / whole), float(-(p * np.log(p)).sum()),
        (count[46] + count[63]) / max(w, 1), count[44] / max(w, 1), count.max() / n, float((_kind["symbol"][last] | (last == 33)).mean()) if len(last) else 0.0,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of each text; null counts as empty."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                data, at = utf8(part.column(1))
                h, words = word_hashes(data, at)
                x = [v for i in range(part.num_rows) for v in statistics(data[at[i] : at[i + 1]], h[words[i] : words[i + 1]])]
                offsets = np.arange(part.num_rows + 1) * len(FEATURES)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.float64()))], names=["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, x array<double>")


def train(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, **options) -> _boost.Trees:
    """A model from feature rows (id, x) and labels 0 / 1. Null ids and labels teach nothing; of
    contradicting labels of one id the smaller counts; of repeated rows one is taken."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = usable.join(table.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = table.join(chosen, "id").select("id", "y", "x").groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).select("id", "r.y", "r.x").orderBy("id").collect()  # at most ``sample`` rows
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    return _boost.fit(x, np.array([r.y for r in rows], float), **options)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, **options) -> DataFrame:
    """(doc_id, score, predicted) of every row: how likely label 1 is.

    Empty and null texts are scored like others (all statistics 0). Null ids are scored, not learnt
    from. With no usable label every score is 0.5. An empty table gives an empty result.
    """
    work = Scratch(docs.sparkSession, "quality")
    table = work.table(features(docs, id_col, text_col), "features")
    model = train(table, labels, id_col, label_col, sample, **options)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            p = model.score(x)
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return table.mapInArrow(run, "doc_id long, score double, predicted int")
