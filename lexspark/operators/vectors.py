"""An approximate index of vectors: cells around means, of which a search looks at the nearest.

Means are fitted by Spark's own k-means on a sample of at most SAMPLE_A_CELL vectors a cell; every vector is then put
into the cell of its nearest mean, and the cells are the partitions of a table. A search ranks the means for each
question, reads the cells that any question wants, and compares each row with the questions that want its cell. What is
missed lies in cells that were not looked at; `search.recall_of` measures it against the exact leg, which stays.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions.shared import written
from lexspark.functions.sizes import LIMIT_BYTES
from lexspark.operators.search import CANDIDATES, _nearest, _top

#: Vectors that a cell's mean is fitted on, on average.
SAMPLE_A_CELL = 256
#: Most cells: k-means sends the distances between all means to the driver in each round, the square of the cells.
MOST_CELLS = 120
#: The cell of vectors that have no direction (a norm of 0) or another width: every search looks at it.
NOWHERE = -1


def _placeable(width: int):
    """Whether a vector can be compared with a mean."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (F.size("embedding") == width) & F.coalesce(square > 0, F.lit(False))


def fit(chunks: DataFrame, cells: int, seed: int = 1, rounds: int = 10) -> KMeansModel:
    """Means of the embedded `chunks`, by cosine. If there are more than cells * SAMPLE_A_CELL of them, a random share of
    about so many is used. Fewer vectors than cells give fewer cells; none at all are an error."""
    rows = chunks.where("embedding is not null").select("embedding")
    width = rows.agg(F.mode(F.size("embedding"), True).alias("w")).first().w
    if width is None:
        raise ValueError("there is no vector to fit means on")
    rows = rows.where(_placeable(width)).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    n, most = rows.count(), cells * SAMPLE_A_CELL
    if n > most:
        rows = rows.sample(most / n, seed)
    return KMeans(k=max(2, min(cells, n)), seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(rows)


def cells_for(n: int) -> int:
    """How many cells suit `n` vectors: twice the root, so that ranking the means costs no more than a few cells, but no more
    than MOST_CELLS; beyond these, cells grow with the vectors."""
    return max(1, min(MOST_CELLS, 2 * math.isqrt(n)))


def write_vectors(chunks: DataFrame, path: str, cells: int, seed: int = 1) -> None:
    """Writes every embedded row of `chunks` (chunk_id, embedding, repealed) in its cell below `path`/vectors, and the means
    below `path`/means. A cell with very many rows becomes several files of even size."""
    rows = written(chunks.where("embedding is not null").select("chunk_id", "embedding", "repealed"), "embedded")  # fitting reads them several times
    spark, model = chunks.sparkSession, fit(rows, cells, seed)
    means = [(i, [float(x) for x in m]) for i, m in enumerate(model.clusterCenters())]
    spark.createDataFrame(means, "cell int, mean array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/means")
    width = len(means[0][1])
    rows = rows.withColumn("__here", _placeable(width))
    other = F.array_repeat(F.lit(1.0), width)  # k-means takes no vector without a direction; where that is put is not used
    features = array_to_vector(F.when(F.col("__here"), F.col("embedding").cast("array<double>")).otherwise(other))
    placed = model.setPredictionCol("cell").transform(rows.withColumn("features", features))
    placed = placed.withColumn("cell", F.when(F.col("__here"), F.col("cell")).otherwise(NOWHERE)).select("chunk_id", "embedding", "repealed", "cell")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their cells, means)."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/means")


def nearest_cells(means: list, vectors: np.ndarray, probes: int) -> np.ndarray:
    """Cells of the `probes` means that are nearest to each vector, by cosine."""
    held = np.array([m.mean for m in means])
    held /= np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-300)
    order = np.argsort(-(vectors @ held.T), axis=1, kind="stable")[:, :probes]
    return np.array([m.cell for m in means])[order]


def approximate_search(
    rows: DataFrame, means: DataFrame, asked: DataFrame, probes: int, limit: int = CANDIDATES, include_repealed: bool = False, most_bytes: int = LIMIT_BYTES
) -> DataFrame:
    """(qid, chunk_id, score, rank) like `search.dense_search`, of the rows in the `probes` cells that are nearest to each of
    `asked` (qid, vector). With as many probes as cells it is the exact search.

    A stated set of questions, in blocks of at most `most_bytes`: each goes to the executors once with the cells that
    it wants; cells that nobody wants are not read. The means are as many as the index has cells.
    """
    spark = rows.sparkSession
    rows = rows if include_repealed else rows.where("not repealed")
    rows = rows.select("chunk_id", F.col("embedding").alias("e"), "cell")
    means = means.orderBy("cell").collect()
    asked = asked.select("qid", "vector")
    held = asked.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    n = max(1, -(-held // most_bytes))
    kinds = T.StructType([asked.schema["qid"], rows.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    found = None
    for i in range(n):
        block = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)).toArrow()
        wanted = _wanted(block, means, probes)
        shared = spark.sparkContext.broadcast((block, wanted))
        there = rows.where(F.col("cell").isin(list(wanted)))
        met = there.mapInArrow(lambda batches, q=shared: _nearest(batches, q.value[0], limit, q.value[1]), kinds)
        found = met if found is None else found.union(met)
    return _top(found, limit)


def rows_compared(rows: DataFrame, means: DataFrame, asked: DataFrame, probes: int) -> DataFrame:
    """(compared, all): comparisons of a row with a question that `approximate_search` makes and that the exact leg makes,
    repealed rows apart."""
    n = rows.where("not repealed").groupBy("cell").agg(F.count("*").alias("n"))
    held = {r.cell: r.n for r in n.collect()}  # one row a cell
    wanted = _wanted(asked.select("qid", "vector").toArrow(), means.orderBy("cell").collect(), probes)
    compared = sum(held.get(c, 0) * len(q) for c, q in wanted.items())
    return rows.sparkSession.createDataFrame([(compared, sum(held.values()) * asked.count())], "compared long, all long")


def _wanted(block, means: list, probes: int) -> dict[int, np.ndarray]:
    """Numbers of the questions of `block` by the cell that they look at. One without a direction or of another width
    looks at all, since nothing is nearer to it than the rest."""
    width = len(means[0].mean)
    out: dict[int, list[int]] = {NOWHERE: list(range(block.num_rows))}
    given = block["vector"].to_pylist()
    known = [i for i, v in enumerate(given) if v is not None and len(v) == width and any(v) and None not in v]
    cells = nearest_cells(means, np.array([given[i] for i in known], np.float64).reshape(-1, width), probes)
    for i, own in zip(known, cells.tolist(), strict=True):
        for cell in own:
            out.setdefault(cell, []).append(i)
    for i in set(range(len(given))) - set(known):
        for m in means:
            out.setdefault(m.cell, []).append(i)
    return {c: np.array(sorted(q), np.int64) for c, q in out.items() if q}
