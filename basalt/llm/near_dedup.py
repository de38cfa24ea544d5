"""MinHash-style near-duplicate classes from SetSketch registers.

1. Every text becomes its set of k-word shingles, a digest of that set and m SetSketch
   registers (truncated minima of exponentials, logarithmic in base b; mergeable by max).
2. Texts with the same set collapse into one class by a grouped aggregation.
3. Classes are banded: ``rows`` registers make one band key. Members of a band bucket are first
   compared with its smallest member only; members that stay in different components of one
   bucket are then compared with each other, after exact bounds and the joint likelihood of the
   registers have removed hopeless pairs. No bucket is capped.
4. Every link is confirmed on the full shingle sets: den * |A & B| >= num * |A | B|.

At J = 0.8, 25 bands of 4 registers miss a link with probability 2e-6.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._graph import connected_components
from basalt.llm._scratch import Scratch
from basalt.llm._words import mix, shingle_sets, utf8, word_hashes


@dataclass(frozen=True)
class Sketch:
    """SetSketch parameters: rate a, base b, largest register q + 1, the banding, and the number of
    registers beyond the bands (a multiple of 4), which only make the joint estimate sharper."""

    a: float = 20.0
    b: float = 1.001
    q: int = 65534
    bands: int = 25
    rows: int = 4
    extra: int = 200

    @property
    def m(self) -> int:
        return self.bands * self.rows + self.extra

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(977)
        return rng.integers(0, 1 << 63, (self.m, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, (self.m, 1), dtype=np.uint64)

    def registers(self, elements: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """uint16 registers of a non-empty set of 64-bit hashes."""
        least = np.full(self.m, np.iinfo(np.uint64).max, np.uint64)
        for s in range(0, len(elements), 512):
            np.minimum(least, (elements[None, s : s + 512] * factor + shift).min(axis=1), out=least)
        u = (least.astype(np.float64) + 0.5) / 2.0**64
        x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / self.a
        return np.clip(np.floor(1 - np.log(x) / np.log(self.b)), 0, self.q + 1).astype(np.uint16)

    def likely_jaccard(self, ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Joint maximum-likelihood Jaccard similarity of pairs (rows), on a grid of 0.01."""
        more, less = (ka > kb).sum(1)[:, None], (ka < kb).sum(1)[:, None]
        u = (na / (na + nb))[:, None]
        v = 1 - u
        grid = np.minimum(np.arange(0, 100) / 100.0, np.minimum(u / v, v / u) - 1e-9)
        p = lambda x: np.maximum(-np.log1p(-np.maximum(x, 0) * (self.b - 1) / self.b) / np.log(self.b), 1e-12)
        up, down = p(u - v * grid), p(v - u * grid)
        log = more * np.log(up) + less * np.log(down) + (self.m - more - less) * np.log(np.maximum(1 - up - down, 1e-12))
        return grid[np.arange(len(grid)), log.argmax(1)]


def shingle_table(docs: DataFrame, id_col: str, text_col: str, k: int, sketch: Sketch | None) -> DataFrame:
    """(id, n, d1, d2, keys) for each row, or with no sketch (id, shingles)."""
    schema = "id long, n long, d1 long, d2 long, keys array<bigint>" if sketch else "id long, shingles array<bigint>"

    def run(batches):
        factor, shift = sketch.hashes() if sketch else (None, None)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                sets = shingle_sets(*word_hashes(*utf8(part.column(1))), k)
                if sketch is None:
                    sets = [x.view(np.int64) for x in sets]
                    at = np.cumsum([0, *map(len, sets)])
                    yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets)))], names=["id", "shingles"])
                    continue
                n, d, keys = [], [], []
                for x in sets:
                    n.append(len(x))
                    d.append((int(mix(x).sum(dtype=np.uint64)), int(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))))
                    if len(x):
                        keys.append(sketch.registers(x, factor, shift))
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                at = np.cumsum([0, *(sketch.m // 4 * (c > 0) for c in n)])
                d = np.array(d, np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
                    names=["id", "n", "d1", "d2", "keys"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (src, dst) whose full sets pass den * |A & B| >= num * |A | B|."""

    def run(batches):
        for batch in batches:
            flat = [batch.column(i).values.to_numpy(zero_copy_only=False) for i in (2, 3)]
            at = [batch.column(i).offsets.to_numpy() for i in (2, 3)]
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                x, y = (f[o[r] : o[r + 1]] for f, o in zip(flat, at))
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[r] = den * common >= num * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep))

    left = pairs.join(sets.select(F.col("id").alias("src"), F.col("shingles").alias("s1")), "src")
    both = left.join(sets.select(F.col("id").alias("dst"), F.col("shingles").alias("s2")), "dst")
    return both.select("src", "dst", "s1", "s2").mapInArrow(run, "src long, dst long")


def _hopeful(pairs: DataFrame, sketch: Sketch, floor: float) -> DataFrame:
    """Drops pairs whose registers put the joint estimate far below the threshold."""

    def run(batches):
        for batch in batches:
            k = [batch.column(i).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(batch.num_rows, -1) for i in (2, 3)]
            n = [batch.column(i).to_numpy().astype(float) for i in (4, 5)]
            if batch.num_rows:
                keep = sketch.likely_jaccard(*k, *n) >= floor
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep))

    return pairs.select("src", "dst", "k1", "k2", "n1", "n2").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, sketch: Sketch = Sketch()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Null and empty texts have an empty set and are linked with nothing. Rows that repeat an id
    each give a row and share its component. A null id is linked with nothing: its component is
    null and it is kept. An empty table gives an empty result. Other columns are ignored.
    """
    work = Scratch(docs.sparkSession, "near-dedup")
    rows = work.table(shingle_table(docs, id_col, text_col, k, sketch), "rows")
    same = ["n", "d1", "d2"]
    classes = work.table(rows.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys"), F.count("*").alias("copies")), "classes")

    # Buckets with more than one class; from here on only classes that share a bucket matter.
    banded = classes.select(F.col("rep").alias("id"), "n", F.posexplode(F.slice("keys", 1, sketch.bands)).alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = work.table(banded.join(buckets, ["band", "key"]).select("band", "key", "id", "n", "hub", "size"), "members")
    wanted = members.select("id").distinct()
    # Hashed on the side of the ids, at every size: no text is sorted, and the plan does not change as the input grows.
    texts = docs.join(wanted.withColumnRenamed("id", id_col).hint("shuffle_hash"), id_col, "left_semi")
    sets = work.table(shingle_table(texts, id_col, text_col, k, None).dropDuplicates(["id"]), "sets")

    # Smallest hub of each member; then, in another component, each bucket's member that meets most
    # others: the text that a group's copies stem from is closer to them than they are to each other.
    tried = work.table(members.where("id <> hub").groupBy("id").agg(F.min("hub").alias("dst")).select(F.col("id").alias("src"), "dst"), "pairs-1")
    links = work.table(_confirmed(tried, sets, num, den), "links-1")
    for turn in (2, 3):
        found = connected_components(links, work, f"cc-{turn}")
        comp = work.table(members.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("comp")), f"comp-{turn}")
        if turn == 2:
            score = members.groupBy("id").agg(F.sum("size").alias("score"))
            central = members.join(score, "id").groupBy("band", "key").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("best")).select("band", "key", (-F.col("best.neg")).alias("center"))
            far = members.select("band", "key", "id").join(central, ["band", "key"]).where("id <> center").select("id", "center").distinct()
            far = far.join(comp, "id").join(comp.select(F.col("id").alias("center"), F.col("comp").alias("comp2")), "center").where("comp <> comp2")
            new = far.select(F.col("id").alias("src"), F.col("center").alias("dst"))
        else:
            new = _across(members, comp, sets, classes, sketch, num, den)
        new = work.table(new.join(tried, ["src", "dst"], "left_anti"), f"pairs-{turn}")
        links = work.table(links.union(_confirmed(new, sets, num, den)), f"links-{turn}")
        tried = work.table(tried.union(new), f"tried-{turn}")
    found = connected_components(links, work, "cc-4").withColumnRenamed("id", "rep")

    # Rows to classes (only classes with copies need the digest), classes to components.
    copied = classes.where("copies > 1").select(*same, "rep")
    whole = rows.drop("keys").join(copied, same, "left").withColumn("rep", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id")))
    out = whole.join(found, "rep", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    least = out.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("times")).where("times > 1")
    out = out.join(least.drop("times"), "doc_id", "left").withColumn("component_id", F.coalesce("least", "component_id")).drop("least")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across(members: DataFrame, comp: DataFrame, sets: DataFrame, classes: DataFrame, sketch: Sketch, num: int, den: int) -> DataFrame:
    """Pairs of one bucket that still lie in different components and may pass.

    A class shares at most ``free`` of its shingles with a class of another component (the rest occur
    in its own component only), so den * i >= num * (n1 + n2 - i) with i <= min(free1, free2) bounds a
    pair exactly.
    """
    floor = num / den - 5 * (num / den * (1 - num / den) / sketch.m) ** 0.5
    mixed = members.join(comp, "id")
    open_ = mixed.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    mixed = mixed.join(open_, ["band", "key"]).select("band", "key", "id", "n", "comp")
    shared = sets.join(mixed.select("id", "comp").distinct(), "id").select("id", "comp", F.explode("shingles").alias("x"))
    home = shared.groupBy("x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo = hi").select("x")
    lonely = shared.join(home, "x").groupBy("id").agg(F.count("*").alias("alone"))
    mixed = mixed.join(lonely, "id", "left").withColumn("free", F.col("n") - F.coalesce("alone", F.lit(0))).where(F.col("free") * den >= F.col("n") * num)
    mixed = mixed.join(classes.select(F.col("rep").alias("id"), "keys"), "id")
    one, two = (mixed.select("band", "key", *(F.col(c).alias(f"{c}{i}") for c in ("id", "n", "comp", "free", "keys"))) for i in (1, 2))
    most = F.least("free1", "free2")
    may = (F.col("id1") > F.col("id2")) & (F.col("comp1") != F.col("comp2")) & (most * den >= (F.col("n1") + F.col("n2") - most) * num)
    # Each pair once, in the first band it shares, and only if enough registers agree (about J of them do).
    may = may & _first_common("keys1", "keys2", "band") & (_equal_registers("keys1", "keys2") >= int(sketch.m * floor))
    pairs = one.join(two, ["band", "key"]).where(may)
    return _hopeful(pairs.select(F.col("id1").alias("src"), F.col("id2").alias("dst"), F.col("n1"), F.col("n2"), F.col("keys1").alias("k1"), F.col("keys2").alias("k2")), sketch, floor)


def _first_common(a: str, b: str, band: str):
    return F.array_position(F.zip_with(a, b, lambda x, y: x == y), True) == F.col(band) + 1


def _equal_registers(a: str, b: str):
    """How many 16-bit registers two arrays of band keys have in common."""
    lanes = lambda x: sum((F.when(F.shiftright(x, 16 * j).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0) for j in range(4)), F.lit(0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: lanes(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
