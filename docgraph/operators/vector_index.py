"""An inverted-file index of vectors: a Parquet table partitioned by cell, searched by cells until a bound says that the rest hold nothing nearer."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from docgraph.functions.session import ensure_checkpoint_dir
from docgraph.functions.vectors import index_score
from docgraph.operators import retrieval

#: Cosines are rounded to six places, so a vector this much farther than the k-th may still tie with it.
_SLACK = 2e-6


def _units(column, dim: int) -> np.ndarray:
    """Rows of unit length and of `dim` values; missing and zero vectors, and those with a null or a value that is not finite, are
    rows of zeros; short ones are filled up with zeros, long ones cut."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        if v is not None:
            out[i, : min(len(v), dim)] = np.asarray(v[:dim], float)
    out[~np.isfinite(out).all(1)] = 0
    n = np.sqrt((out * out).sum(1))
    return out / np.where(n > 0, n, 1)[:, None]


def _cells_of(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest cell and its angle to the centre; vectors without a direction are in the cell after the last, at angle pi."""
    cos = units @ centres.T
    cell = cos.argmax(1)
    angle = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
    none = ~units.any(1)
    return np.where(none, len(centres), cell), np.where(none, np.pi, angle)


def fit(vectors: DataFrame, cells: int, dim: int, sample: int = 20_000, rounds: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Centres of at most `cells` cells: spherical k-means over the `sample` rows of the least hash of their id, which the driver holds.

    The sample only shapes the cells; every vector is in the index, and an exact search does not depend on the fit.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(id_col, F.lit(7)).alias("h"), id_col).orderBy("h", id_col).limit(sample).select(vector)
    x = _units([r[0] for r in rows.collect()], dim)
    x = np.unique(x[x.any(1)], axis=0)
    if not len(x):
        return np.eye(1, dim)
    r = np.random.default_rng(len(x))
    centres = x[np.sort(r.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        n = np.sqrt((sums * sums).sum(1))
        centres = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1)[:, None], centres)
    return centres


class VectorIndex:
    """What `build` has written under a folder: `vectors`, partitioned by cell, and `cells`, a row per cell and each build or append."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector: str = "embedding"):
        self.spark, self.path, self.id_col, self.vector = spark, path, id_col, vector
        self.refresh()

    def refresh(self) -> None:
        """Reads the cells' sizes and radii again, as they are after an append. They are few: cells by appends."""
        cells = self.spark.read.parquet(f"{self.path}/cells").groupBy("cell")
        rows = cells.agg(F.max("centre").alias("centre"), F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("schema").alias("schema")).collect()
        rows.sort(key=lambda r: r["cell"])
        self.centres = np.array([r["centre"] for r in rows[:-1]])
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.radius = np.array([r["radius"] for r in rows])
        self.schema = StructType.fromJson(json.loads(rows[0]["schema"]))

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def append(self, more: DataFrame, rows_per_file: int = 250_000) -> None:
        """Puts more vectors into the cells there are; sizes and radii follow. Nothing that is there already is read or written."""
        _write(more, self.path, self.centres, self.id_col, self.vector, rows_per_file)
        self.refresh()

    # ---- search --------------------------------------------------------------------------------------------------

    def _cells_by_angle(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's angle to every cell's centre, and the least angle to any vector there. The last cell can't be ruled out."""
        angle = np.arccos(np.clip(units @ self.centres.T, -1, 1))
        angle = np.c_[angle, np.zeros(len(units))]
        least = np.maximum(0, angle - np.r_[self.radius[:-1], np.pi])
        least[~units.any(1)] = 0  # a query without a direction has cosine 0 with everything
        return angle, np.where(self.n > 0, least, np.pi)

    def _scan(self, plan: np.ndarray, ids: list, units: np.ndarray, k: int, schema: StructType) -> DataFrame:
        """A task's k best of the vectors in the cells that plan (queries by cells) marks. Other cells' folders are not read."""
        cells = np.flatnonzero(plan.any(0) & (self.n > 0))
        shared = self.spark.sparkContext.broadcast((plan, ids, units))
        id_col, vector, n_out = self.id_col, self.vector, len(schema) - 2

        def run(batches):
            plan, ids, units = shared.value
            best: dict[int, retrieval.Best] = {}
            slices = (whole.slice(i, retrieval.TILE[0]) for whole in batches for i in range(0, whole.num_rows, retrieval.TILE[0]))
            for batch in slices:
                at = batch.schema.get_field_index(vector)
                cell = batch.column(batch.schema.get_field_index("cell")).to_numpy(zero_copy_only=False)
                x = _units(batch.column(at).to_numpy(zero_copy_only=False), units.shape[1])
                kept = batch.select([j for j in range(batch.num_columns) if j != at and batch.schema.names[j] != "cell"])
                for t in range(0, len(units), retrieval.TILE[1]):
                    tile = slice(t, t + retrieval.TILE[1])
                    cos = np.where(plan[tile][:, cell].T, np.round(x @ units[tile].T, 6) + 0.0, -2.0)
                    mine = best.setdefault(t, retrieval.Best(k, cos.shape[1], id_col))
                    row, query = mine.among(cos)
                    columns = kept.take(pa.array(row)).columns
                    mine.take(pa.Table.from_arrays([*columns, pa.array(query), pa.array(cos[row, query])], [*kept.schema.names, "__q", "cos"]))
            for t, mine in best.items():
                if mine.rows is not None:
                    q = pa.array(ids[t : t + retrieval.TILE[1]]).take(mine.rows.column("__q").combine_chunks())
                    columns = [mine.rows.column(j) for j in range(n_out)]
                    yield from pa.Table.from_arrays([*columns, q, mine.rows.column("cos")], schema.names).to_batches()

        items = self.vectors.where(F.col("cell").isin(cells.tolist())).drop("angle")
        return items.mapInArrow(run, schema)

    def _schema(self, queries: DataFrame) -> StructType:
        kept = [f for f in self.vectors.schema if f.name not in (self.vector, "cell", "angle")]
        return StructType(kept).add("qid", queries.schema["qid"].dataType).add("cos", DoubleType())

    def search(self, queries: DataFrame, k: int, share: float = 0.05, exact: bool = True, block: int = 2048) -> DataFrame:
        """Each of the queries' (qid, q) k nearest vectors by cosine to six places, ties by id: the other columns of the index, qid,
        cos, rank, score_index, and rows_read, the vectors in the cells that were searched for the query.

        Cells are searched from the nearest centre on until they hold `share` of all vectors, and k at least. If `exact`, so is
        every other cell that may hold a vector as near as the k-th best so far: the angle to its centre less its radius says
        so. Then the result is that of a full scan, whatever the cells; else recall depends on the share.

        Queries are a stated, counted set: they are taken in blocks of about `block`, a block's plan over the cells is made on
        the driver, and of its results only each query's k-th cosine comes there. Null and zero queries have cosine 0
        with all. An empty index or no queries give no rows.
        """
        schema, dim, out = self._schema(queries), self.centres.shape[1], None
        blocks = max(1, -(-queries.count() // block))
        total = int(self.n.sum())
        for b in range(blocks):
            rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "q").collect()
            if not rows or not total:
                continue
            ids, units = [r.qid for r in rows], _units([r.q for r in rows], dim)
            angle, least = self._cells_by_angle(units)
            order = np.argsort(angle, axis=1, kind="stable")
            before = np.cumsum(self.n[order], axis=1) - self.n[order]
            plan = np.zeros(angle.shape, bool)
            np.put_along_axis(plan, order, before < max(k, share * total), axis=1)
            found = self._scan(plan, ids, units, k, schema)
            if exact:
                found = _kept(found, f"{self.path}/found-{uuid.uuid4().hex}")
                place = Window.partitionBy("qid").orderBy(F.desc("cos"), self.id_col)
                kth = {r.qid: r.cos for r in found.withColumn("n", F.row_number().over(place)).where(F.col("n") == k).select("qid", "cos").collect()}
                far = np.array([kth.get(i, -2.0) for i in ids])
                more = ~plan & (np.cos(least) >= far[:, None] - _SLACK)
                if (more & (self.n > 0)).any():
                    found = found.unionByName(self._scan(more, ids, units, k, schema))
                plan |= more
            read = self.spark.createDataFrame([(i, int(n)) for i, n in zip(ids, (plan * self.n).sum(1))], StructType([queries.schema["qid"]]).add("rows_read", LongType()))
            found = found.join(F.broadcast(read), "qid")
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.spark.createDataFrame([], StructType([*schema.fields]).add("rows_read", LongType()))
        w = Window.partitionBy("qid").orderBy(F.desc("cos"), self.id_col)
        return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).withColumn("score_index", F.round(index_score(F.col("cos")), 7))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(vectors: DataFrame, path: str, centres: np.ndarray, id_col: str, vector: str, rows_per_file: int) -> None:
    at, dim = vectors.columns.index(vector), centres.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    schema = StructType([*vectors.schema.fields]).add("cell", IntegerType()).add("angle", DoubleType())

    def run(batches):
        for batch in batches:
            cell, angle = _cells_of(_units(batch.column(at).to_numpy(zero_copy_only=False), dim), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], schema.names)

    # a cell with many vectors is dealt over several tasks and files
    pieces = max(1, -(-vectors.count() // rows_per_file))
    found = vectors.mapInArrow(run, schema).repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(pieces)))
    found.write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in vectors.mapInArrow(run, schema).groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row a cell
    rows = [(c, centres[c].tolist() if c < len(centres) else [], *sizes.get(c, (0, 0.0)), schema.json()) for c in range(len(centres) + 1)]
    vectors.sparkSession.createDataFrame(rows, "cell int, centre array<double>, n long, radius double, schema string").coalesce(1).write.mode("append").parquet(f"{path}/cells")


def build(vectors: DataFrame, path: str | None = None, cells: int | None = None, sample: int = 20_000, rows_per_file: int = 250_000, id_col: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """Writes an index of every row of vectors (an id, a vector, other columns but `cell` and `angle`) under path and opens it.

    path: a folder that all machines share; by default one in the checkpoint folder. cells: by default the square root of the
    number of rows, 4096 at most. Vectors are as long as the longest of the sample; longer ones are cut, shorter ones filled
    up with zeros. Vectors that are null, zero or not finite are indexed too, in a cell of their own that every search reads,
    and have cosine 0. Rows that repeat are indexed as often. An empty table makes an empty index.
    """
    spark = vectors.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    dim = vectors.agg(F.max(F.size(vector))).first()[0]
    n = vectors.count()
    centres = fit(vectors, cells or max(1, min(4096, round(n**0.5))), max(1, dim or 1), sample, id_col=id_col, vector=vector)
    _write(vectors, path, centres, id_col, vector, rows_per_file)
    return VectorIndex(spark, path, id_col, vector)

