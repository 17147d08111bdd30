"""Approximate nearest neighbours by collision counting on sorted single projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import column, read, shipped, staged

#: Random orthonormal bases whose axes are the projections; share of the vectors at the searched
#: radius that may miss the collision threshold; factor by which windows grow at most.
BASES, MISS, GROWTH = 2, 0.05, 1.15
#: Half a window's width in units of the radius.
REACH = 2.0
#: Rows of one block of the index: it bounds a task's memory. Queries that meet it in one task, at
#: most: they stream through, so this only bounds what a lost executor costs.
BLOCK = 32_768
QUERIES = 262_144


def axes(width: int, bases: int, seed: int = 5) -> np.ndarray:
    """Columns of `bases` random orthonormal bases, scaled so that a unit vector's projections have mean square 1.

    Within a basis the squared projections of a vector add up to its squared length, so the
    number of collisions varies less around its mean than with independent directions.
    """
    rng = np.random.default_rng(seed)
    return np.hstack([np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(bases)]) * math.sqrt(width)


def threshold(projections: np.ndarray, miss: float, reach: float, samples: int = 4000, seed: int = 6) -> int:
    """Most collisions that all but the share `miss` of vectors at the radius reach, by simulation over directions."""
    u = np.random.default_rng(seed).standard_normal((samples, projections.shape[0]))
    u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
    return max(1, int(np.quantile((np.abs(u @ projections) <= reach).sum(axis=1), miss)))


def power(x: float) -> float:
    """The power of two next above a positive number's size; dividing by it is exact."""
    return math.ldexp(1.0, min(1023, max(-1000, math.frexp(x)[1])))


class Block:
    """One block of the index: for each projection its rows' numbers, sorted by projected value.

    Inner products become distances on a sphere: a row gets one more component that lifts it to
    length `top`, the longest row's, and a query is stretched to that length. A query's window
    in a projection is centred at its own value and reaches REACH times the radius to both
    sides, so a row at the radius falls into it with a probability that is the same for all
    radii: widening windows in place rehashes without tables. Rows that fall into `need` windows
    are verified by their inner products. Collisions are counted from the windows' outsides,
    which hold fewer rows. Vectors are divided by `unit`, a power of two, so their squares
    neither overflow nor vanish beside the longest's.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, unit: float, top: float, bases: int = BASES, miss: float = MISS, growth: float = GROWTH, reach: float = REACH):
        self.ids, self.vectors, self.unit, self.top, self.growth, self.reach = ids, vectors, unit, top, growth, reach
        self.small = vectors / unit
        self.axes = axes(vectors.shape[1] + 1, bases)
        lift = np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", self.small, self.small), 0.0))
        values = np.hstack([self.small, lift[:, None]]) @ self.axes
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)
        self.allowed = self.axes.shape[1] - threshold(self.axes, miss, reach)
        self.asked = self.verified = 0

    def exact(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows by the inner products themselves, ties to the smaller id; NaN (of overflows) last."""
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (self.vectors * query).sum(axis=1)
        best = np.lexsort((self.ids, -np.where(np.isnan(scores), -np.inf, scores)))[:k]
        return best, scores[best]

    def search(self, query: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(row numbers, scores) of the k best verified and their ties, and the radius that they took, from a first radius on.

        Windows grow until the k-th best of the verified rows lies within the radius: then each
        row that is as near has met the threshold but with probability `miss`. Where inner
        products as such would overflow or vanish, all rows are compared.
        """
        n, own = len(self.ids), power(float(np.abs(query).max()))
        if n <= k or not 1e-250 < own * self.unit < 1e250:
            return *self.exact(query, k), radius
        q = query / own
        q /= math.sqrt(q @ q)
        centre = np.append(q * self.top, 0.0) @ self.axes
        missed, checked = np.zeros(n, np.int64), np.zeros(n, bool)
        got, near, low, high = np.empty(0, np.int64), np.empty(0), None, None
        while True:
            a = [int(s.searchsorted(c - radius * self.reach)) for s, c in zip(self.sorted, centre)]
            b = [int(s.searchsorted(c + radius * self.reach, "right")) for s, c in zip(self.sorted, centre)]
            if low is None:
                missed += np.bincount(np.concatenate([p for o, x, y in zip(self.order, a, b) for p in (o[:x], o[y:])]), minlength=n)
            else:
                missed -= np.bincount(np.concatenate([p for o, x, y, u, v in zip(self.order, a, b, low, high) for p in (o[x:u], o[v:y])]), minlength=n)
            low, high = a, b
            fresh = np.flatnonzero((missed <= self.allowed) & ~checked)
            checked[fresh] = True
            got, near = np.concatenate([got, fresh]), np.concatenate([near, self.small[fresh] @ q])
            if len(got) < k:
                radius *= self.growth
                continue
            kth = -np.partition(-near, k - 1)[k - 1]
            far = math.sqrt(max(0.0, 2 * self.top * (self.top - kth)))
            if far <= radius or len(got) == n:
                self.asked, self.verified = self.asked + 1, self.verified + len(got)
                keep = got[near >= kth - 1e-9 * max(abs(kth), self.top)]
                return keep, (self.vectors[keep] * query).sum(axis=1), radius  # the same sum wherever a row lies
            radius = min(radius * self.growth, max(far, radius * 1.02))


def valid(vector: Column, width: int) -> Column:
    """Of that many components, all finite, not all 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == width) & fine & F.exists(vector, lambda x: x != 0)


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bases: int = BASES, miss: float = MISS, block_rows: int = BLOCK, block_queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k rows of largest inner product that were found, itself left out.

    Equal vectors share one entry of the index, with their k + 1 smallest ids; ties go to the
    smaller id, so no more are needed and a vector with very many copies costs no more than
    another. The index is cut into blocks of rows by hash. A task holds one block, built once
    from its rows, which come first, and streams queries past it, in the order of their hashes;
    every row is indexed. Queries are parted so that there are tasks for all cores, and blocks'
    best are merged by windows over ids and scores only. A query meets every block: with a
    query set that is a share of the table, vectors shuffled and windows searched grow with the
    square of the table. Rows whose vector is null, zero, of another than
    the commonest length, or holds nulls or non-finite numbers, and rows without an id, take no
    part. Scores are computed in double precision on the original vectors; where they overflow
    or vanish (very long or short vectors) all rows are compared. Empty tables give
    no rows; rows that repeat an id are one row for each different vector. Other columns are
    not read.
    """
    spark = shipped(table.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = table.select(column(table, id_col, "long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null")
    widths = rows.filter("v is not null and size(v) > 0").groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return spark.createDataFrame([], schema)
    width = widths["w"]
    rows = rows.filter(valid(F.col("v"), width)).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.col("v"))})
    firsts = rows.withColumn("_n", F.dense_rank().over(W.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("_n") <= k + 1)  # ids, however often they repeat
    index = staged(firsts.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("v").alias("v")), "index")
    queries = staged(rows.filter("q").select("id", "h1", "h2").distinct(), "queries")
    asked = staged(index.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v"), "query-vectors")
    size = index.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    unit = power(size["most"])
    top = math.sqrt(index.agg(F.max(F.expr(f"aggregate(v, 0D, (s, x) -> s + (x / {unit!r}D) * (x / {unit!r}D))"))).first()[0])
    blocks = -(-size["n"] // block_rows)
    parts = max(-(-asked.count() // block_queries), -(-spark.sparkContext.defaultParallelism // blocks))

    cell = lambda block, part: (block * parts + part).cast("int").alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select("*", every(parts).alias("p")).select(cell(F.pmod("h1", F.lit(blocks)), F.col("p")), F.lit(0).alias("asks"), F.element_at("ids", 1).alias("id"), F.lit(0).cast("long").alias("h2"), "v")
    right = asked.select("*", every(blocks).alias("b")).select(cell(F.col("b"), F.pmod("h2", F.lit(parts))), F.lit(1).alias("asks"), F.col("h1").alias("id"), "h2", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block, radius = None, [], None, top / 2
        for b in batches:
            cells, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
            ids, h2, v = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).flatten().to_numpy().reshape(b.num_rows, width)
            found: list[tuple] = []
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks) != 0)) + 1), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if cells[x] != now:
                    now, held, block = cells[x], [], None
                if asks[x] == 0:
                    held.append((ids[x:y].copy(), v[x:y].copy()))
                    continue
                if block is None and held:
                    own, vectors = np.concatenate([i for i, _ in held]), np.concatenate([u for _, u in held])
                    order = np.argsort(own, kind="stable")
                    block, held = Block(own[order], vectors[order], unit, top, bases, miss), []
                if block is None:
                    continue
                for i in range(x, y):
                    rows_, scores, settled = block.search(v[i], k + 1, radius)
                    radius = 0.7 * radius + 0.3 * 0.97 * settled
                    best = np.lexsort((block.ids[rows_], -np.where(np.isnan(scores), -np.inf, scores)))[: k + 1]
                    found.extend((ids[i], h2[i], block.ids[rows_[j]], scores[j]) for j in best)
            if found:
                h1_, h2_, id_, score_ = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(h1_, pa.int64()), pa.array(h2_, pa.int64()), pa.array(id_, pa.int64()), pa.array(score_, pa.float64())], ["h1", "h2", "id", "score"])

    dealt = left.unionByName(right).repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", "asks", "id", "h2")
    found = dealt.mapInArrow(meet, "h1 long, h2 long, id long, score double")
    by_score = W.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    classes = found.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= k + 1)
    members = index.select(F.element_at("ids", 1).alias("id"), "ids")
    each = classes.join(members, "id").select("h1", "h2", "score", F.explode("ids").alias("id"))
    best = each.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= k + 1)
    lists = best.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct(F.col("_n"), F.col("id"), F.col("score")))).alias("found"))
    answers = queries.withColumnRenamed("id", "query_id").join(lists, ["h1", "h2"])
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("_p", "_x")).select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.id").alias("vec_id"), F.col("_x.score").alias("score"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found to each vector of `embeddings` whose vec_id is divisible by 20, among all others; see search for odd rows."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
