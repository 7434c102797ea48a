"""Clustering around centroids, with the equal-average equal-variance search for the nearest one.

**Search.** Centroids are sorted by the sum of their components. A vector's search starts where its own sum
would stand and goes outward, always to the side that is nearer in the sum. With ``s`` the sums, ``r`` the
roots of ``dim * sum(x * x) - s * s`` (that is, the deviations) and ``d`` the squared distance,

    dim * d >= (s1 - s2) ** 2 + (r1 - r2) ** 2

holds for any two vectors. Once the first term alone is beyond the best distance, so is that of every centroid
farther out, and the search ends; if both terms are, the centroid is passed over. What is left is
computed exactly. All numbers are integers (a root is rounded down and its error is allowed for), so nothing
is decided by rounding.

**Rounds.** Every task adds up its vectors by cluster; only these sums, one number for each centroid and component,
are shuffled and come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buywave.llm.common import materialize, ship

CENTROIDS, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, 1
LONG = 1 << 63
#: Vectors searched at once.
ROWS_AT_ONCE = 8192


def quantized(vectors: DataFrame, id_column: str, vector_column: str, width: int, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component x as double. Vectors of another width, and those that
    are null or hold a null or non-finite component, are left out; a component beyond a long is an error."""
    x = F.col("x")

    def whole(c: Column) -> Column:
        too_large = F.raise_error(F.lit("a scaled component does not fit a long")).cast("bigint")
        return F.when(F.abs(c * scale) < F.lit(float(LONG)), F.floor(c * scale)).otherwise(too_large)

    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    named = vectors.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("x")
    )
    return named.filter(x.isNotNull() & (F.size("x") == width) & finite).select("id", F.transform("x", whole).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k smallest hashes of ``seed:id``; of equal hashes the smaller vectors first.

    Only k rows come to the driver. A null id is hashed as the text ``null``.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    return [list(r["v"]) for r in rows.orderBy(F.sha2(name.cast("binary"), 256), "v").limit(k).select("v").collect()]


@dataclass
class Search:
    """Centroids ordered by their sums, for the search of nearest ones."""

    centroids: list[list[int]]

    def __post_init__(self) -> None:
        self.width = len(self.centroids[0])
        self.largest = max((abs(x) for c in self.centroids for x in c), default=0)
        totals = [sum(c) for c in self.centroids]
        self.order = sorted(range(len(totals)), key=lambda n: (totals[n], n))
        self.rows = [self.centroids[n] for n in self.order]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row; the smaller number of equals.

        Longs are used where no product can leave them, else Python's integers; a distance that fits no
        long is an error.
        """
        largest = max(self.largest, int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
        kind = np.int64 if self.width * largest < 1 << 29 else object
        numbers, distances = [], []
        for k in range(0, len(vectors), ROWS_AT_ONCE):
            number, distance = self._outward(vectors[k : k + ROWS_AT_ONCE].astype(kind), kind)
            numbers.append(number)
            distances.append(distance)
        found = np.concatenate(distances) if distances else np.zeros(0, dtype=np.int64)
        if len(found) and int(found.max()) >= LONG:
            raise OverflowError("a squared distance does not fit a long")
        return np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64), found.astype(np.int64)

    def _outward(self, vectors: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        centroids, number_of = np.array(self.rows, dtype=kind), np.array(self.order)
        own, own_root = _moments(vectors)
        total, root = _moments(centroids)
        right = np.searchsorted(total, own)
        left = right - 1
        # Before anything is found no centroid is beyond the best.
        best = np.full(len(vectors), -1, dtype=kind)
        number = np.full(len(vectors), len(centroids), dtype=np.int64)
        open_ = np.arange(len(vectors))
        for _ in range(len(centroids)):
            lo, hi = left[open_], right[open_]
            down, up = own[open_] - total[np.maximum(lo, 0)], total[np.minimum(hi, len(total) - 1)] - own[open_]
            take_left = (lo >= 0) & ((hi >= len(total)) | (down <= up))
            at, gap = np.where(take_left, lo, hi), np.where(take_left, down, up)
            limit = self.width * best[open_]
            ahead = (limit < 0) | (gap * gap <= limit)  # an equal distance may belong to a smaller number
            open_, at, gap, limit, take_left = open_[ahead], at[ahead], gap[ahead], limit[ahead], take_left[ahead]
            if not len(open_):
                break
            apart = np.maximum(np.abs(own_root[open_] - root[at]) - 2, 0)
            near = (limit < 0) | (gap * gap + apart * apart <= limit)
            row, c = open_[near], at[near]
            step = vectors[row] - centroids[c]
            distance = (step * step).sum(axis=1)
            better = (best[row] < 0) | (distance < best[row]) | ((distance == best[row]) & (number_of[c] < number[row]))
            best[row[better]], number[row[better]] = distance[better], number_of[c[better]]
            left[open_[take_left]] -= 1
            right[open_[~take_left]] += 1
        return number, best


def _moments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows and the roots of ``width * sum of squares - sum ** 2``, right to one."""
    total = rows.sum(axis=1)
    spread = rows.shape[1] * (rows * rows).sum(axis=1) - total * total
    if rows.dtype == object:
        return total, np.array([math.isqrt(x) for x in spread], dtype=object)
    return total, np.sqrt(spread.astype(np.float64)).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def next_centroids(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid that is nearest to some rows moves to their mean, rounded down; others stay."""
    width, search = len(centroids[0]), Search(centroids)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            vectors = _matrix(batch.column("v"), width)
            number, _ = search.nearest(vectors)
            for c in np.unique(number).tolist():
                mine = vectors[number == c]
                # Python's integers where a sum of longs could leave them.
                safe = max(int(mine.max()), -int(mine.min())) * len(mine) < LONG
                column = mine.sum(axis=0) if safe else mine.astype(object).sum(axis=0)
                held = totals.setdefault(c, [0] * (width + 1))
                totals[c] = [a + b for a, b in zip(held, [*column.tolist(), len(mine)])]
        if totals:
            flat = [(c, place, str(x)) for c, held in totals.items() for place, x in enumerate(held)]
            columns = [pa.array(x, t) for x, t in zip(zip(*flat), (pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "total"])

    parts = rows.select("v").mapInArrow(summed, "cluster int, place int, total string")
    found = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {(r["cluster"], r["place"]): int(r["total"]) for r in found}  # centroids x (width + 1) numbers
    return [
        [totals[n, place] // totals[n, width] for place in range(width)] if (n, width) in totals else c
        for n, c in enumerate(centroids)
    ]


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """id, cluster and (squared) distance of every row."""
    width, search = len(centroids[0]), Search(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = search.nearest(_matrix(batch.column("v"), width))
            columns = [batch.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return rows.mapInArrow(nearest, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance bigint")


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = SEED,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Vectors of another width, null ones and those with a null or non-finite component take no part. Fewer
    vectors than ``k`` give fewer centroids; an empty table gives no rows. Null ids are kept, repeated rows
    all come back, and equal distances go to the smaller cluster. Distances and their sums that fit no long are an
    error. Other columns are not read, so their names cannot clash.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(quantized(vectors, id_column, vector_column, width, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        kinds = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
        return rows.select(F.col("id").alias(id_column), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids)
    found = materialize(assigned(rows, centroids), "assigned")
    prints = [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centroids)]
    named = spark.createDataFrame(prints, "number int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("in_cluster"))
    whole = F.sum("in_cluster").over(Window.partitionBy())  # one row for each centroid
    sums = sums.select(
        F.col("cluster").alias("number"), F.col("in_cluster").cast("bigint").alias("cluster_inertia"), whole.cast("bigint").alias("inertia")
    )
    facts = sums.join(named, "number")
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("number")).select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
