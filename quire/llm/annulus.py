"""Centroid clustering by annulus search: centroids whose norms can't be near enough are never compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import column, read, shipped, staged

WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Components beyond this have squared distances beyond 64 bits.
LARGEST = 1 << 27
#: Centroids, far from one another, whose distances give each vector its first upper bound.
PROBES = 6
#: Vectors of similar norm that are compared together.
SLAB = 512


class Annulus:
    """Centroids sorted by norm. |norm(x) - norm(c)| never exceeds the distance of x and c, so only
    centroids whose norms lie within a vector's upper bound of its own can be its nearest.

    The bound is the least exact distance to a few probes and to the centroid nearest in norm.
    Norms are rounded, distances aren't: the ring is wider by more than rounding can hide, and
    candidates in it are compared in integers.
    """

    def __init__(self, centroids: np.ndarray, probes: int = PROBES):
        self.centroids = centroids
        square = np.einsum("ij,ij->i", centroids.astype(float), centroids.astype(float))
        self.order = np.lexsort((np.arange(len(centroids)), square))
        self.sorted, self.norms = centroids[self.order], np.sqrt(square)[self.order]
        # in doubles products are exact up to 2**53
        self.small = len(centroids) == 0 or int(np.abs(centroids).max()) < 1 << 22
        self.probes = self._spread(min(probes, len(centroids)))
        self.asked = self.compared = 0

    def _spread(self, n: int) -> np.ndarray:
        """Places, by norm, of n centroids: each the farthest from those before."""
        found = [0]
        while len(found) < n:
            far = np.min([self.distances(self.sorted, np.array([f]))[:, 0] for f in found], axis=0)
            found.append(int(far.argmax()))
        return np.array(sorted(set(found)))

    def distances(self, x: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors and the centroids at these places."""
        c = self.sorted[places]
        if self.small and (not len(x) or int(np.abs(x).max()) < 1 << 22):
            a, b = x.astype(float), c.astype(float)
            return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)).astype(np.int64)
        return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid, ties to the smaller number, and the squared distance."""
        cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        norms = np.sqrt(np.einsum("ij,ij->i", x.astype(float), x.astype(float)))
        by_norm = np.argsort(norms, kind="stable")
        for at in range(0, len(x), SLAB):
            rows = by_norm[at : at + SLAB]
            own, n = x[rows], norms[rows]
            bound = self.distances(own, self.probes).min(axis=1)
            close = np.clip(np.searchsorted(self.norms, n), 0, len(self.norms) - 1)
            for place in np.unique(close):  # neighbours in norm are few, as the slab is sorted
                some = close == place
                bound[some] = np.minimum(bound[some], self.distances(own[some], np.array([place]))[:, 0])
            reach = np.sqrt(bound.astype(float))
            reach += 1e-9 * (reach + n + self.norms[-1]) + 1e-6
            low, high = np.searchsorted(self.norms, n - reach, "left"), np.searchsorted(self.norms, n + reach, "right")
            first, last = int(low.min()), int(high.max())
            places = np.arange(first, last)
            d = self.distances(own, places)
            inside = (places >= low[:, None]) & (places < high[:, None])
            self.asked, self.compared = self.asked + len(rows), self.compared + int(inside.sum())
            d = np.where(inside, d, np.iinfo(np.int64).max)
            least = d.min(axis=1)
            numbers = np.where(d == least[:, None], self.order[places], len(self.centroids))
            cluster[rows], distance[rows] = numbers.min(axis=1), least
        return cluster, distance


def quantised(vector: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null unless there are `width`, all finite and not beyond LARGEST."""
    v = vector.cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x) <= float(LARGEST)))
    return F.when((F.size(v) == width) & fine, whole)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def seeds(points: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the smallest hashes of their ids; rows without an id are none. As many rows as clusters reach the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = points.filter("id is not null").select(h.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floors of their vectors' means; those without vectors stay.

    A task sends one row of sums a centroid, whatever the number of its vectors.
    """
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, n = Annulus(centroids), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = _matrix(b.column(0), width)
            cluster, _ = search.nearest(x)
            if len(x):
                order = np.argsort(cluster, kind="stable")
                first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                total[cluster[order[first]]] += np.add.reduceat(x[order], first, axis=0)
            n += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = points.select("x").mapInArrow(sums, "cluster long, n long, sums array<long>")
    whole = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect():  # a row a centroid
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each vector kept, in integers.

    Vectors become integers floor(scale * x) and are written once; every round reads them,
    assigns them by Annulus and sends sums of at most `clusters` rows a task, so hot clusters
    cost no more than others and a lost executor costs its tasks' share of one round. The driver
    holds the centroids (clusters * width numbers, parameters both).

    Left out: vectors that are null, of another width, with nulls or non-finite components, or
    with components beyond LARGEST in size (their squared distances don't fit 64 bits). Rows
    count by themselves, repeated ones each; a null id is kept but is no seed, so without any id
    there are no centroids and no rows. With fewer vectors than clusters there are fewer
    centroids; equal seeds give equal centroids, of which the smaller number takes all. Other
    columns are not read. Empty tables give no rows.
    """
    spark = shipped(vectors.sparkSession)
    x = quantised(F.col(f"`{vector_col}`"), width, scale)
    points = staged(vectors.select(column(vectors, id_col, "long").alias("id"), x.cast("array<int>").alias("x")).filter("x is not null"), "points")
    centroids = seeds(points, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(points, centroids)
    final = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(final)
        for b in batches:
            number, distance = search.nearest(_matrix(b.column(1), width))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    placed = staged(points.mapInArrow(assign, "id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, final[c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    sides = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(sides), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of whole `embeddings`; see cluster for odd rows."""
    return cluster(read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """DuckDB's form, its rounds written out, components as rows."""
    nearest = """select rid, c, d from (select rid, c, d, row_number() over (partition by rid order by d, c) as r from (
    select v.rid, m.c, sum((v.x - m.x) * (v.x - m.x))::bigint as d from v join {m} m using (i) group by v.rid, m.c)) where r = 1"""
    parts = [
        "with kept as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64)",
        "v as materialized (select rid, unnest(x) as x, generate_subscripts(x, 1) as i from kept)",
        f"first as (select rid, row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as c from kept order by sha256('{SEED}:' || vec_id) limit {CLUSTERS})",
        "m0 as materialized (select c, i, x from first join v using (rid))",
    ]
    for r in range(ROUNDS):
        parts.append(f"a{r} as materialized ({nearest.format(m=f'm{r}')})")
        parts.append(f"s{r} as materialized (select c, i, sum(x)::hugeint as s, count(*)::hugeint as n from a{r} join v using (rid) group by c, i)")
        parts.append(f"m{r + 1} as materialized (select m.c, m.i, coalesce((s - ((s % n) + n) % n) // n, m.x)::bigint as x from m{r} m left join s{r} using (c, i))")
    parts.append(f"placed as materialized ({nearest.format(m=f'm{ROUNDS}')})")
    parts.append(f"sha as (select c, sha256(string_agg(x, ',' order by i)) as centroid_sha256 from m{ROUNDS} group by c)")
    return ",\n".join(parts) + """
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256
from placed join kept using (rid) join sha using (c)"""


SQL = _sql()
