"""Operator 3, approximate nearest neighbours by balanced posting lists.

* Centroids: balanced, hierarchical k-means on a hash-picked sample (at most
  ``sample`` rows and 64 MB, the documented bound). Their number follows the
  number of vectors (``list_size`` a list) up to ``max_lists`` (and 64 MB), which
  bounds what is broadcast: the centroids and their in-memory neighbour graph.
* Index: every vector is written to the list of its nearest centroid, and
  boundary vectors also to other near lists: those within ``close`` times the
  least distance, unless a list already chosen is nearer to that centroid than
  the vector is; at most ``copies`` lists.
* Search: the graph is searched from well-spread entry points; the query's lists
  are those within ``reach`` times the least distance. Reach and the width of the
  search are calibrated: for ``tune`` queries the exact nearest are found by a
  scan, and reach is the ratio at which ``recall`` of them lie in a chosen list.
  How far apart the lists are differs between data and sizes; recall doesn't.
  Queries and lists are joined in blocks: a list is cut into blocks of
  ``block`` vectors and its queries into blocks of ``query_block``, so a list
  that holds a third of all vectors, or meets a third of the queries, is many
  tasks. Each pair of blocks keeps its k nearest per query, and the query's k
  best of those are merged.

* Queries whose lists held fewer than k candidates (an outlier that is its own
  centroid, a small cluster far from all others) are finished exactly, against
  all vectors, in the same blocks.

Nearness is the cosine in double precision on the original vectors, computed
the same way for every pair, so equal vectors tie exactly; ties go to the
smaller vec_id.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components, and rows with a null vec_id take no part;
rows are told apart by vec_id, so a repeated row counts once; with few vectors
there is one list and the search is exact; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import stored, table


#: Bound on the sample that reaches the driver, and on the centroids (doubles).
DRIVER_BYTES = 64 << 20


def balanced_centroids(x: np.ndarray, k: int, rng: np.random.Generator, fan: int = 16, rounds: int = 8) -> np.ndarray:
    """k unit centroids of the unit rows of x: split ``fan`` ways, each part in
    proportion to its size. A crowded cluster's score is lowered in the next
    round, which keeps the parts of like size."""
    if k <= 1 or len(x) <= k:
        return _unit(x.mean(axis=0, keepdims=True)) if k <= 1 else x
    n = min(k, fan)
    centre = x[rng.choice(len(x), n, replace=False)]
    load = np.zeros(n, np.float32)
    for _ in range(rounds):
        score = x @ centre.T - np.float32(0.05) * load
        own = score.argmax(axis=1)
        size = np.bincount(own, minlength=n)
        load = (size / (len(x) / n) - 1).astype(np.float32)
        for c in range(n):
            centre[c] = x[own == c].mean(axis=0) if size[c] else x[rng.integers(len(x))]
        centre = _unit(centre)
    if k <= fan:
        return centre
    size = np.bincount(own, minlength=n)
    share = np.maximum(1, np.round(k * size / len(x)).astype(int))
    return np.concatenate([balanced_centroids(x[own == c], int(share[c]), rng, fan, rounds) for c in range(n) if size[c]])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30).astype(x.dtype)


class Graph:
    """Neighbour graph over the centroids, searched by best-first beams."""

    def __init__(self, centre: np.ndarray, degree: int = 24):
        self.centre = centre
        k = len(centre)
        self.degree = min(degree, k - 1)
        self.near = np.zeros((k, max(1, self.degree)), np.int32)
        for a in range(0, k, 1024):
            score = centre[a : a + 1024] @ centre.T
            score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
            if self.degree:
                self.near[a : a + len(score)] = np.argpartition(-score, self.degree - 1, axis=1)[:, : self.degree]
        self.entry = np.arange(0, k, max(1, k // 64))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best centroids found per row of q, best first, and their
        squared distances (unit vectors)."""
        beam = min(beam, len(self.centre))
        ids = np.empty((len(q), beam), np.int32)
        scores = np.empty((len(q), beam), np.float32)
        for a in range(0, len(q), 512):
            ids[a : a + 512], scores[a : a + 512] = self._search(q[a : a + 512], beam)
        return ids, np.maximum(0.0, 2.0 - 2.0 * scores)

    def _search(self, q: np.ndarray, beam: int):
        rows = np.arange(len(q))[:, None]
        ids = np.broadcast_to(self.entry.astype(np.int32), (len(q), len(self.entry)))
        score = q @ self.centre[self.entry].T
        done = np.zeros(score.shape, bool)
        for _ in range(4 * beam):
            top = np.argsort(-score, axis=1, kind="stable")[:, :beam]
            ids, score, done = ids[rows, top], score[rows, top], done[rows, top]
            open_score = np.where(done, -np.inf, score)
            pick = open_score.argmax(axis=1)[:, None]
            if not self.degree or not np.isfinite(open_score.max()):
                break
            done[rows, pick] = True
            more = self.near[ids[rows, pick][:, 0]]
            found = np.einsum("bnd,bd->bn", self.centre[more], q)
            known = (more[:, :, None] == ids[:, None, :]).any(axis=2)
            found[known] = -np.inf
            ids = np.concatenate([ids, more], axis=1)
            score = np.concatenate([score, found.astype(np.float32)], axis=1)
            done = np.concatenate([done, known], axis=1)
        if ids.shape[1] < beam:  # fewer centroids reached than asked for
            pad = beam - ids.shape[1]
            ids = np.concatenate([ids, np.repeat(ids[:, :1], pad, axis=1)], axis=1)
            score = np.concatenate([score, np.full((len(q), pad), -np.inf, np.float32)], axis=1)
        score = np.where(np.isfinite(score), score, np.float32(-1.0))
        return ids[:, :beam], score[:, :beam]


def _finite(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part, an id once."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull())
    rows = rows.filter(_finite(F.col("v")))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("v") == (size["n"] if size else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(batch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists_of(rows: DataFrame, id_name: str, graph: Graph, ratio: float, most: int, beam: int, spread_out: bool,
             base: float = 0.0) -> DataFrame:
    """id, v, list: the lists within ``ratio`` times the least distance (``base``
    at least), at most ``most``. spread_out: leave out a list to whose centroid an already chosen
    one is nearer than the vector is."""

    def work(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = _matrix(part, "v")
                ids, dist = graph.search(_unit(x).astype(np.float32), beam)
                near = np.sqrt(dist) <= ratio * np.maximum(np.sqrt(dist[:, :1]), base) + 1e-6
                near[:, 0] = True
                chosen = np.zeros_like(near)
                count = np.zeros(len(x), int)
                for c in range(near.shape[1]):
                    take = near[:, c] & (count < most)
                    if spread_out and c:
                        centre = graph.centre[ids[:, c]]
                        for b in range(c):
                            between = 2.0 - 2.0 * np.einsum("ij,ij->i", centre, graph.centre[ids[:, b]])
                            take &= ~(chosen[:, b] & (between < dist[:, c]))
                    chosen[:, c] = take
                    count += take
                row, col = np.nonzero(chosen)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(ids[row, col].astype(np.int32))], names=["id", "v", "list"])

    return rows.select(F.col(id_name).alias("id"), "v").mapInArrow(work, "id long, v array<double>, list int")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in an order of operations that depends on the two rows only."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def best_of_block(q_id, q, v_id, v, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query number, vector id, score of the k nearest per query in one block."""
    score = _unit(q) @ _unit(v).T
    score[q_id[:, None] == v_id[None, :]] = -np.inf
    depth = min(k, score.shape[1])
    limit = np.partition(score, score.shape[1] - depth, axis=1)[:, score.shape[1] - depth] - 1e-9
    row, col = np.nonzero((score >= limit[:, None]) & np.isfinite(score))
    exact = cosine(np.ascontiguousarray(q[row]), np.ascontiguousarray(v[col]))
    order = np.lexsort((v_id[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], v_id[col[keep]], exact[keep]


def scan_nearest(rows: DataFrame, q_id: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(query id, vector id) of the exact k nearest of a few queries: every
    task keeps its k best per query, and those are merged."""

    def work(batches):
        best_id = np.zeros((len(q), 0), np.int64)
        best = np.zeros((len(q), 0))
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _matrix(batch, "v")
            for a in range(0, len(ids), 4096):
                score = _unit(q) @ _unit(v[a : a + 4096]).T
                score[q_id[:, None] == ids[None, a : a + 4096]] = -np.inf
                best = np.concatenate([best, score], axis=1)
                best_id = np.concatenate([best_id, np.broadcast_to(ids[a : a + 4096], score.shape)], axis=1)
                top = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, best_id = np.take_along_axis(best, top, 1), np.take_along_axis(best_id, top, 1)
        if best.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_id, best.shape[1])), pa.array(best_id.ravel()), pa.array(best.ravel())], names=["q", "id", "s"])

    near = rows.select("vec_id", "v").mapInArrow(work, "q long, id long, s double").filter(F.col("s") >= -2)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))).filter(F.col("r") <= k)
    return [(r["q"], r["id"]) for r in top.select("q", "id").collect()]


def calibrate(rows: DataFrame, is_query: Column, posted: DataFrame, graph: Graph, k: int, tune: int,
              recall: float) -> tuple[float, float, int]:
    """reach, the least distance that counts as such (a query that happens to be
    a centroid would otherwise see its own list only), and the number of lists
    to look for. Collects ``tune`` queries and their k nearest."""
    asked = rows.filter(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(tune).toPandas()
    if not len(asked) or len(graph.centre) == 1:
        return 1.0, 0.0, 1
    q_id, q = asked["vec_id"].to_numpy(np.int64), np.stack(asked["v"].to_numpy())
    true = scan_nearest(rows, q_id, q, k)
    wanted = rows.sparkSession.createDataFrame([(i,) for i in sorted({int(v) for _, v in true})], "id long")
    where: dict[int, list[int]] = {}
    for r in posted.select("id", "list").join(F.broadcast(wanted), "id").collect():
        where.setdefault(r["id"], []).append(r["list"])
    dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (_unit(q).astype(np.float32) @ graph.centre.T)))
    base = max(1e-6, float(np.median(dist.min(axis=1))))
    ratio = dist / np.maximum(dist.min(axis=1, keepdims=True), base)
    number = {int(i): n for n, i in enumerate(q_id)}
    need = [min((ratio[number[a]][c] for c in where.get(b, [])), default=1.0) for a, b in true]
    reach = float(np.quantile(need, recall)) if need else 1.0
    width = int((ratio <= reach).sum(axis=1).max())
    return reach * 1.001, base, max(1, math.ceil(1.25 * width))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, list_size: int = 128, max_lists: int = 16384, sample: int = 100_000,
            close: float = 1.15, copies: int = 4, tune: int = 64, recall: float = 0.98, block: int = 2048, query_block: int = 1024,
            seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found per query row."""
    rows = stored(usable(vectors), "vectors")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    total, room = shape["n"], DRIVER_BYTES // (8 * max(1, shape["dim"]))
    sample = min(sample, room)
    lists = max(1, min(max_lists, room, total // list_size))
    share = min(1.0, min(sample, 32 * lists) / max(total, 1))
    picked = (rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * sample)
              .toPandas()["v"] if total else pd.Series([], dtype=object))
    if len(picked):
        x = np.unique(_unit(np.stack(picked.to_numpy())).astype(np.float32), axis=0)  # copies pull no centroid
        centre = balanced_centroids(x, lists, np.random.default_rng(seed))
    else:
        first = rows.select("v").first()
        centre = _unit(np.array([first["v"] if first else [1.0]])).astype(np.float32)
    graph = Graph(np.ascontiguousarray(centre, dtype=np.float32))
    posted = stored(lists_of(rows, "vec_id", graph, close, copies, 16, True), "postings")
    reach, base, probes = calibrate(rows, is_query, posted, graph, k, tune, recall)
    asked = lists_of(rows.filter(is_query), "vec_id", graph, reach, probes, probes, False, base)
    # One row a list (at most max_lists): how many blocks its vectors and its queries make.
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    heads = stored(asked.select("id", "list"), "probed")
    heads = heads.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("query_blocks"))
    cut = F.broadcast(sizes.join(heads, "list"))
    salt = F.xxhash64("id")
    left = (posted.join(cut, "list").withColumn("b", F.pmod(salt, F.col("blocks")))
            .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1))).select("list", "b", "qb", "id", "v"))
    right = (asked.join(cut, "list").withColumn("qb", F.pmod(salt, F.col("query_blocks")))
             .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("list", "b", "qb", "id", "v"))

    def meet(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        qi = q["id"].to_numpy()
        row, found, score = best_of_block(qi, np.stack(q["v"].to_numpy()), v["id"].to_numpy(), np.stack(v["v"].to_numpy()), k)
        return pd.DataFrame({"query_id": qi[row], "vec_id": found, "score": score})

    keys = ["list", "b", "qb"]
    near = (left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double"))
    # A vector found in several lists has the same score in each.
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = stored(ranked(once, k), "nearest")
    full = found.filter(F.col("rank") == min(k, total - 1)).select(F.col("query_id").alias("vec_id"))
    short = stored(rows.filter(is_query).join(full, "vec_id", "left_anti").select(F.col("vec_id").alias("id"), "v"), "short")
    few = short.count() if total > 1 else 0
    if not few:
        return found
    vector_blocks, short_blocks = math.ceil(total / block), math.ceil(few / query_block)
    left = (rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(vector_blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(short_blocks - 1))).alias("qb"),
                        F.col("vec_id").alias("id"), "v"))
    right = (short.select(F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))).alias("b"),
                          F.pmod(F.xxhash64("id"), F.lit(short_blocks)).cast("int").alias("qb"), "id", "v")
             .withColumn("b", F.col("b").cast("long")))
    exact = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInPandas(meet, "query_id long, vec_id long, score double")
    return (found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
            .select("query_id", "rank", "vec_id", "score").unionByName(ranked(exact, k)))


def ranked(near: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best per query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
