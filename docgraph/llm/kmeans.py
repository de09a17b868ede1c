"""Ball k-means in exact integers: a pass over the vectors a round, each vector compared with the neighbours of its ball alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import Tables

#: Components are below this in size, so that squared distances and their sums stay within a long.
BOUND = 1 << 26


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact squared distance of every row of x to every row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 21 and x.shape[1] <= 512:  # all of it is exact in doubles
        y, d = x.astype(np.float64), c.astype(np.float64)
        return ((y * y).sum(1)[:, None] - 2 * (y @ d.T) + (d * d).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class Balls:
    """Clusters as balls: centres, the radius that covers each one's members, and for each its neighbours by distance.

    A ball whose centre is `far` away or farther has no member to give: neighbours are those whose centre is at most twice the
    radius away. radius: None where no vector has a cluster yet.
    """

    def __init__(self, centres: np.ndarray, radius: np.ndarray | None = None, moved: np.ndarray | None = None):
        self.centres, self.near, self.still = centres, None, None
        if radius is None:
            return
        between = squared(centres, centres)
        order = np.argsort(between, axis=1, kind="stable")
        reach = np.ceil(4 * radius.astype(np.float64) ** 2 * (1 + 1e-9) + 1)
        self.near = [[j for j in row.tolist() if j != i and between[i, j] <= reach[i]] for i, row in enumerate(order)]
        self.apart = [between[i, js] for i, js in enumerate(self.near)]
        #: Neither the ball nor a neighbour has moved: its members stay, distances and all.
        self.still = [not moved[[i, *js]].any() for i, js in enumerate(self.near)]

    def assign(self, x: np.ndarray, cluster: np.ndarray | None, distance: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's nearest centre (ties: the smaller number), the squared distance, and how many distances were computed.

        A member nearer to its centre than half of the way to the nearest neighbour is in the stable core. The others are in
        the annuli between the halves of the ways to two neighbours in a row, and are compared with the neighbours up to theirs.
        """
        if self.near is None or cluster is None:
            d = squared(x, self.centres)
            best = d.argmin(1)
            return best, d[np.arange(len(x)), best], d.size
        best, least, n = cluster.copy(), distance.copy(), 0
        order = np.argsort(cluster, kind="stable")
        bounds = np.searchsorted(cluster[order], np.arange(len(self.centres) + 1))
        for i, js in enumerate(self.near):
            mine = order[bounds[i] : bounds[i + 1]]
            if not len(mine) or self.still[i]:
                continue
            own = squared(x[mine], self.centres[i : i + 1])[:, 0]
            annulus = np.searchsorted(self.apart[i], 4 * own, side="right")
            n += len(mine)
            who, nearest = np.full(len(mine), i), own
            for k, j in enumerate(js):
                at = np.flatnonzero(annulus > k)
                if not len(at):
                    break
                d = squared(x[mine[at]], self.centres[j : j + 1])[:, 0]
                n += len(at)
                better = (d < nearest[at]) | ((d == nearest[at]) & (j < who[at]))
                nearest[at[better]], who[at[better]] = d[better], j
            best[mine], least[mine] = who, nearest
        return best, least, n


def _rows(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _assigned(vectors: DataFrame, balls: Balls) -> DataFrame:
    """(id, v, cluster, distance) under the balls; vectors has a cluster and a distance of the round before, or neither."""
    known = "cluster" in vectors.columns
    shared = vectors.sparkSession.sparkContext.broadcast(balls)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 8192):
                batch = whole.slice(i, 8192)
                x = _rows(batch.column(1))
                if np.abs(x).max(initial=0) >= BOUND:
                    raise ValueError(f"a component is {BOUND} or more in size: squared distances would not fit a long")
                before = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)] if known else (None, None)
                cluster, distance, _ = shared.value.assign(x, *before)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.int32())), pa.array(cluster, pa.int64()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    return vectors.mapInArrow(run, "id long, v array<int>, cluster long, distance long")


def _sums(assigned: DataFrame, dim: int) -> dict[int, tuple[int, int, np.ndarray]]:
    """By cluster its size, its largest squared distance and its vectors' sum. A task sends a row a cluster."""

    def run(batches):
        n, most, total = {}, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cluster, distance = _rows(batch.column(0)), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            order = np.argsort(cluster, kind="stable")
            which, first = np.unique(cluster[order], return_index=True)
            for k, a, b in zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                rows = order[a:b]
                n[k], most[k] = n.get(k, 0) + b - a, max(most.get(k, 0), int(distance[rows].max()))
                total[k] = total.get(k, 0) + x[rows].sum(0)
        ks = sorted(n)
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([n[k] for k in ks], pa.int64()), pa.array([most[k] for k in ks], pa.int64()), pa.array([total[k] for k in ks], pa.list_(pa.int64()))], ["cluster", "n", "most", "total"])

    parts = assigned.select("v", "cluster", "distance").mapInArrow(run, "cluster long, n long, most long, total array<long>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("most").alias("most"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)])
    return {r["cluster"]: (r["n"], r["most"], np.array([r[f"t{i}"] for i in range(dim)], np.int64)) for r in found.collect()}


def cluster(vectors: DataFrame, start: DataFrame, rounds: int = 5) -> tuple[DataFrame, list[list[int]]]:
    """(id, v, cluster, distance) of every row of vectors (id long, v: an array of longs, all of one length), and the centres.

    start: the first centres, (v), in order; both are bounded by the number of clusters k. Each round assigns every vector to
    the nearest centre by squared Euclidean distance (ties: the smaller number) and replaces each non-empty cluster's centre by
    its vectors' componentwise floor(sum / count), in exact integers; then vectors are assigned once more.

    Ball k-means: a cluster is a ball with the radius that covers its members, known from the round before: their largest
    distance from the old centre plus the way that the centre went. Two balls are neighbours where half the way between their
    centres is no more than the radius, and only neighbours are compared, exactly, by annulus (`Balls.assign`). The vectors
    with their clusters are written once a round to the shared checkpoint folder and the round's before are dropped; a task
    sends a row per cluster, so nothing that grows with the vectors is shuffled or comes to the driver.

    Repeated rows count as often as they come. Without vectors there are no centres and no rows. Raises if a component is
    2**26 or more in size, since the squares would not fit a long.
    """
    tables = Tables(vectors.sparkSession, "kmeans")
    centres = np.array([r.v for r in start.select("v").collect()], np.int64)
    if not len(centres):
        return vectors.select("id", "v", F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False)), []
    if np.abs(centres).max() >= BOUND:
        raise ValueError(f"a component is {BOUND} or more in size: squared distances would not fit a long")
    state, balls, before = vectors.select("id", "v"), Balls(centres), None
    for _ in range(rounds):
        state = tables.keep(_assigned(state, balls))
        if before is not None:
            tables.drop(before)
        before, new, radius = state, centres.copy(), np.zeros(len(centres))
        for k, (n, most, total) in _sums(state, centres.shape[1]).items():
            new[k] = total // n
            radius[k] = np.sqrt(float(most)) + np.sqrt(float(((new[k] - centres[k]) ** 2).sum()))
        balls, centres = Balls(new, radius, (new != centres).any(1)), new
    out = tables.keep(_assigned(state, balls))
    if before is not None:
        tables.drop(before)
    return out, centres.tolist()


def whole_vectors(rows: DataFrame, vector: str, dim: int, scale: int) -> F.Column:
    """The condition that a row's vector has exactly `dim` components, none null or not finite."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(F.col(vector)) == dim) & finite, F.lit(False))


def cluster_embeddings(rows: DataFrame, k: int = 40, dim: int = 64, scale: int = 256, rounds: int = 5, seed: int = 2, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row whose vector has `dim` components, none
    null or not finite; other rows, null vectors among them, are left out, other columns are ignored.

    A component x counts as floor(scale * x), x as a double. The first centres are the `k` kept vectors of the least lower-case
    hex SHA-256 of `seed:id`, in its order (null ids last; equal ids by their vectors); with fewer vectors there are fewer
    clusters. See `cluster` for the rounds. cluster_inertia and inertia are the distances summed over the row's cluster and
    over all; centroid_sha256 is of the cluster's final centre, its components joined by commas.
    """
    spark = rows.sparkSession
    # a product beyond a long's range stays beyond the bound that `cluster` raises at
    whole = F.transform(F.col(vector), lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))))
    kept = rows.where(whole_vectors(rows, vector, dim, scale)).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found, centres = cluster(kept, kept.orderBy(digest.asc_nulls_last(), "v").limit(k), rounds)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(i, sums.get(i, 0), sum(sums.values()), ",".join(map(str, c))) for i, c in enumerate(centres)]
    each = F.broadcast(spark.createDataFrame(known, "cluster long, cluster_inertia long, inertia long, centre string"))  # k rows
    out = found.join(each, "cluster")
    return out.select(F.col("id").alias(id_col), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", F.sha2("centre", 256).alias("centroid_sha256"))
