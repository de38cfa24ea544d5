"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents longer than a sequence are cut into full pieces and a rest. The histogram of piece
lengths (at most ``capacity`` rows, so it may go to the driver) gives the linear program; its rounded
patterns say how many pieces of each length bin a run of sequences takes. Every piece has a rank
among the pieces of its length, and the rank alone says which sequence and slot it goes to.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._lp import patterns
from basalt.llm._scratch import Scratch
from basalt.llm._tokens import CACHE_WORDS, encoder, groups
from basalt.llm._totals import before


class Plan:
    """Where the r-th piece of a length goes. Its size follows from capacity / width, not from the corpus."""

    def __init__(self, counts: dict[int, int], capacity: int, width: int):
        bins = {}
        for length in sorted(counts, reverse=True):
            b = -(-length // width)
            base = bins.setdefault(b, [0, {}])
            base[1][length] = base[0]
            base[0] += counts[length]
        size = np.array(sorted(bins), np.int64)
        demand = np.array([bins[b][0] for b in size.tolist()], np.int64)
        found = patterns(size, demand, capacity // width)
        first = np.cumsum([0, *(t for _, t in found)])
        self.sequences = int(first[-1])
        self.offset = np.zeros(capacity + 1, np.int64)
        self.runs = {}
        for i, b in enumerate(size.tolist()):
            used = [p for p, (c, _) in enumerate(found) if c[i]]
            each = np.array([found[p][0][i] for p in used], np.int64)
            times = np.array([found[p][1] for p in used], np.int64)
            slot = np.array([found[p][0][:i].sum() for p in used], np.int64)
            start = np.cumsum(each * times) - each * times
            for length, base in bins[b][1].items():
                self.offset[length] = base
                self.runs[length] = (start, first[used], each, slot)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, slot) of pieces, given their ranks among the pieces of their length."""
        sequence, slot = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = length == n
            start, first, each, base = self.runs[n]
            r = rank[at] + self.offset[n]
            p = np.searchsorted(start, r, "right") - 1
            j = r - start[p]
            sequence[at] = first[p] + j // each[p]
            slot[at] = base[p] + j % each[p]
        return sequence, slot


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str, text_col: str, cache_words: int) -> DataFrame:
    """Each document's pieces; ``rank`` counts the pieces of equal length in this partition."""

    def run(batches):
        enc, part, seen = encoder(tokenizer_path, cache_words), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                ids, texts = (c.to_pylist() for c in batch.slice(s, 2048).columns)
                texts, rows = [t or "" for t in texts], []
                for lo, hi in groups(texts):
                    for doc_id, raw in zip(ids[lo:hi], enc.encode(texts[lo:hi])):
                        raw += end
                        n = len(raw) // 4
                        for at in range(0, n, capacity):
                            k = min(capacity, n - at)
                            rows.append((part, doc_id, at, k, zlib.crc32(raw[4 * at : 4 * (at + k)]), n, int(seen[k])))
                            seen[k] += 1
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "part long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, width: int = 8, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Null and repeated ids are packed like
    any other row. An empty table gives no piece. Other columns are ignored. ``capacity`` must be a
    multiple of ``width``, the width of the histogram's bins. ``cache_words`` bounds a worker's memory of words
    and changes nothing but the time.
    """
    work = Scratch(docs.sparkSession, "packing")
    cut = work.table(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, cache_words), "pieces")
    counted = work.table(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    plan = Plan({r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, width)
    # A row for each length of each part: it grows with the input, so it is never broadcast.
    ranked = cut.join(before(counted, "part", "n", "base", by=("length",)).drop("n").hint("shuffle_hash"), ["length", "part"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sequence, slot = plan.place(batch.column(2).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    w = Window.partitionBy("sequence_id").orderBy("slot")
    return placed.withColumn("offset", F.sum("length").over(w) - F.col("length")).drop("slot")
