"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

1. Coarse centroids (about the square root of the rows) and the residual codebooks are fitted on a bounded
   sample (``sample`` rows of smallest hash of id); every valid row is indexed by its list and its codes.
2. A query probes the lists whose centroids are hardly farther than its nearest one. How much farther they may
   be is fitted too: so much that the lists hold ``recall`` of the nearest neighbours within the sample.
   Clustered vectors need few lists; vectors without any structure need most of them.
3. Lists lie together in shards of at most ``chunk`` rows (a longer list is dealt over several). A shard meets
   the queries that probe it: no raw vector of the table moves, only ids and codes. Asymmetric distance
   tables rank the rows of the probed lists.
4. The ``rerank`` best of a query over all shards are compared exactly, on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._names import column
from basalt.llm._scratch import Scratch


@dataclass(frozen=True)
class Settings:
    """lists of the inverted file (0: the square root of the rows; never more than a 32nd of the sample); the share
    of neighbours that probed lists shall hold; parts of the product quantiser (256 codes each); candidates
    a query reranked exactly; rows of a shard and queries that meet it at once; rows fitted on."""

    lists: int = 0
    recall: float = 0.95
    parts: int = 16
    rerank: int = 256
    chunk: int = 8192
    block: int = 4096
    sample: int = 20_000


def kmeans(x: np.ndarray, k: int, turns: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(turns):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        at = np.searchsorted(near[order], np.arange(len(c) + 1))
        full = np.flatnonzero(np.diff(at))
        sums = np.add.reduceat(x[order], at[full], axis=0)
        c[full] = sums / np.diff(at)[full][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([(half - x[s : s + 4096] @ c.T).argmin(1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Centroids (lists x dim), residual codebooks (parts x codes x dim / parts, zero-padded), and ``slack``:
    how much more than to its nearest centroid a query's squared distance to a probed one may be."""

    def __init__(self, x: np.ndarray, s: Settings, rows: int = 0):
        lists = s.lists or round(max(rows, len(x)) ** 0.5)
        distinct = np.unique(x, axis=0)
        self.centroids = kmeans(distinct, max(1, min(lists, len(distinct) // 32)), 10, 1)
        self.parts = min(s.parts, x.shape[1])
        self.width = -(-x.shape[1] // self.parts)
        r = self._split(x - self.centroids[nearest(x, self.centroids)])
        self.books = [kmeans(r[:, p], min(256, len(r)), 6, 2 + p) for p in range(self.parts)]
        self.slack = self._slack(distinct, s.recall)

    def _slack(self, x: np.ndarray, recall: float, k: int = 10, asked: int = 256) -> float:
        if len(x) <= k:
            return float("inf")
        q = x[np.random.default_rng(7).permutation(len(x))[:asked]]
        half, of, extra = (x**2).sum(1) / 2, nearest(x, self.centroids), []
        for s in range(0, len(q), 64):
            d = half - q[s : s + 64] @ x.T
            # The nearest of all is the query itself.
            near = np.argpartition(d, k, axis=1)[:, : k + 1]
            far = self.far(q[s : s + 64])
            extra.append(np.take_along_axis(far, of[near], 1) - far.min(1, keepdims=True))
        return float(np.quantile(np.concatenate(extra).ravel(), recall)) + 1e-9

    def far(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of queries to all centroids."""
        return np.maximum((q**2).sum(1)[:, None] - 2 * q @ self.centroids.T + (self.centroids**2).sum(1), 0)

    def _split(self, r: np.ndarray) -> np.ndarray:
        return np.pad(r, ((0, 0), (0, self.parts * self.width - r.shape[1]))).reshape(len(r), self.parts, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = nearest(x, self.centroids)
        r = self._split(x - self.centroids[of])
        return of, np.stack([nearest(r[:, p], b) for p, b in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray, of: int) -> np.ndarray:
        """Squared distances of each query's residual to every code: queries x parts x codes."""
        r = self._split(q - self.centroids[of])
        return np.stack([(r[:, p] ** 2).sum(1)[:, None] - 2 * r[:, p] @ b.T + (b**2).sum(1) for p, b in enumerate(self.books)], 1).astype(np.float32)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is whole, finite and not zero; a null id takes no part."""
    v = column(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(column(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & whole & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest scores, ties to smaller ids."""
    if len(scores) > n:
        edge = np.partition(scores, n - 1)[n - 1]
        at = np.flatnonzero(scores <= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], scores[at]))][:n]


class Index:
    """The inverted file of the valid rows of one table: ``table`` (id, list, codes) holds of equal vectors
    the k + 1 of smallest id, as no other can be an answer. ``count`` has the rows of each list."""

    def __init__(self, vectors: DataFrame, k: int, id_col: str, vector_col: str, settings: Settings):
        self.spark, self.k, self.settings = vectors.sparkSession, k, settings
        self.work = Scratch(self.spark, "ann")
        rows = valid(vectors, id_col, vector_col)
        dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        self.dim = dims.dim if dims else None
        if self.dim is None:
            return
        self.rows = rows.where(F.size("v") == self.dim)
        fitted = self.rows.orderBy(F.xxhash64("id"), "id").limit(settings.sample).collect()
        self.model = model = Quantiser(np.array([r.v for r in fitted]), settings, dims["count"])

        def encode(batches):
            for batch in batches:
                if batch.num_rows:
                    of, codes = model.encode(_matrix(batch.column(1), batch.num_rows))
                    yield pa.record_batch([batch.column(0), pa.array(of.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(2), batch.column(3)], names=["id", "list", "codes", "h1", "h2"])

        hashed = self.rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
        coded = hashed.mapInArrow(encode, "id long, list int, codes binary, h1 long, h2 long")
        # The limit is pushed below the shuffle, so a very common vector is few rows of each task.
        turn = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
        self.table = self.work.table(coded.withColumn("turn", turn).where(F.col("turn") <= k + 1).select("id", "list", "codes"), "index")
        sizes = {r["list"]: r["count"] for r in self.table.groupBy("list").count().collect()}  # a row a list
        self.count = np.array([sizes.get(i, 0) for i in range(len(model.centroids))])
        # Shards: neighbouring numbers of lists together, a long list over ``parts`` shards of its own.
        self.parts = np.maximum(1, -(-self.count // settings.chunk))
        self.first, shard, held = np.zeros(len(self.count), np.int64), 0, 0
        for i, n in enumerate(self.count.tolist()):
            if held and held + n > settings.chunk:
                shard, held = shard + 1, 0
            self.first[i] = shard
            held += n
            if self.parts[i] > 1:
                shard, held = shard + int(self.parts[i]), 0

    def probes(self, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """(id, v, shard, lists): the lists that a query probes, by shard. Of queries of one id the first counts."""
        model, count, parts, first, k = self.model, self.count, self.parts, self.first, self.k

        def probe(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                far = model.far(_matrix(batch.column(1), batch.num_rows))
                order = np.argsort(far, axis=1, kind="stable")
                # Enough lists, too, to hold k other rows.
                held = np.cumsum(count[order], axis=1)
                n = np.maximum((far <= far.min(1, keepdims=True) + model.slack).sum(1), (held < k + 1).sum(1) + 1).clip(max=len(count))
                who, shards, lists = [], [], []
                for i in range(len(far)):
                    by: dict[int, list[int]] = {}
                    for c in sorted(order[i, : n[i]].tolist()):
                        for p in range(parts[c]):
                            by.setdefault(int(first[c]) + p, []).append(c)
                    who += [i] * len(by)
                    shards += by.keys()
                    lists += by.values()
                yield pa.record_batch([batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array(shards, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["id", "v", "shard", "lists"])

        asked = valid(queries, id_col, vector_col).where(F.size("v") == self.dim).groupBy("id").agg(F.min("v").alias("v"))
        return asked.mapInArrow(probe, "id long, v array<double>, shard int, lists array<int>")

    def nearest(self, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k rows nearest each query."""
        model, settings, k = self.model, self.settings, self.k
        probes = self.work.table(self.probes(queries, id_col, vector_col), "probes")
        # Only where very many queries meet one shard are its codes sent more than once.
        blocks = self.work.table(probes.groupBy("shard").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("many")), "blocks")
        at = lambda per: F.element_at(F.array(*(F.lit(int(x)) for x in per)), F.col("list") + 1)
        left = probes.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("many")).cast("int")).drop("many")
        right = self.table.withColumn("shard", (at(self.first) + F.pmod(F.xxhash64("id"), at(self.parts))).cast("int"))
        right = right.join(blocks.toDF("shard", "times"), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times")

        def meet(q: pa.Table, x: pa.Table) -> pa.Table:
            names = ["query_id", "vec_id", "near"]
            if not q.num_rows or not x.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names=names)
            of = x["list"].to_numpy()
            order = np.argsort(of, kind="stable")
            of, ids = of[order], x["id"].to_numpy()[order]
            codes = np.frombuffer(b"".join(x["codes"].to_pylist()), np.uint8).reshape(x.num_rows, -1)[order]
            wants, who = q["lists"].combine_chunks(), np.repeat(np.arange(q.num_rows), q["lists"].combine_chunks().value_lengths().to_numpy())
            lists, qv, qi = wants.flatten().to_numpy(), _matrix(q["v"], q.num_rows), q["id"].to_numpy()
            found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(q.num_rows)]
            for c in np.unique(of).tolist():
                lo, hi = np.searchsorted(of, [c, c + 1])
                mine, asking = codes[lo:hi], who[lists == c]
                for s in range(0, len(asking), 64):
                    some = asking[s : s + 64]
                    tables, near = model.tables(qv[some], c), np.zeros((len(some), hi - lo), np.float32)
                    for p in range(mine.shape[1]):
                        near += tables[:, p, :][:, mine[:, p]]
                    for i, row in zip(some.tolist(), near):
                        found[i].append((row, ids[lo:hi]))
            cols = []
            for i, parts in enumerate(found):
                if parts:
                    near, their = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
                    other = their != qi[i]
                    near, their = near[other], their[other]
                    best = _best(near, their, settings.rerank)
                    cols.append((np.full(len(best), qi[i]), their[best], near[best]))
            return pa.table([np.concatenate(c) for c in zip(*cols)], names=names) if cols else pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names=names)

        found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, near float")
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "vec_id"))
        found = found.withColumn("turn", turn).where(F.col("turn") <= settings.rerank).select("query_id", "vec_id").distinct()
        # Only now the original vectors: those of the candidates, once each pair.
        asked = probes.select(F.col("id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id"])
        pairs = found.join(self.rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(asked, "query_id")
        square = F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, d: a + d)
        scored = pairs.select("query_id", "vec_id", F.sqrt(square).alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest each query by Euclidean distance, itself left out.

    ``queries`` has the same columns as ``vectors``. Invalid vectors (null, zero, null or non-finite
    components, or another length than the most common one) take no part on either side. Ties go
    to the smaller id; of rows that repeat an id the nearest counts, of such queries the first. With
    fewer than k other rows, all are returned. Empty tables give an empty result. Other columns are ignored.
    """
    index = Index(vectors, k, id_col, vector_col, settings)
    if index.dim is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return index.nearest(queries, id_col, vector_col)
