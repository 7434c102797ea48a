"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors become integers. Rows are cut into slabs by id range and slabs into blocks; every block keeps its
forward index (the rows' components) and, per dimension, the largest and smallest component. A query's
bound for a block is the sum over dimensions of what the block's extremes could give at most. Blocks are
scored in the order of their largest bounds, each for the queries whose bound for it is not below their
k-th best score; an equal bound is still scored, since a tie may go to a smaller id.

Work is dealt as a grid: a task has some query groups and a pile of slabs, both read from where they are
stored, so that no query is shuffled to every slab. A task returns its k best per query over the whole pile,
and the best of those are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buywave.llm.common import materialize, ship

SCALE = 256
SLAB_ROWS, BLOCK_ROWS, GROUP_QUERIES = 4096, 256, 2048
#: Slabs that a task searches at most, and piles a core where there are fewer.
SLABS_AT_ONCE, PILES_A_CORE = 64, 4
LOW = np.iinfo(np.int64).min
_PACKED = "ids binary, width int, body binary"


def quantized(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): floor(256 x) of every component. Rows with a null id, a null vector, no components or
    a null or non-finite component are left out. A component that does not fit a long is an error."""
    x = F.col("x")

    def whole(c: Column) -> Column:
        too_large = F.raise_error(F.lit("a component times 256 does not fit a long")).cast("bigint")
        return F.when(F.abs(c * SCALE) < F.lit(2.0**63), F.floor(c * SCALE)).otherwise(too_large)

    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("x"))
        .filter(F.col("id").isNotNull() & x.isNotNull() & (F.size("x") > 0) & finite)
        .select("id", F.transform("x", whole).alias("v"))
    )


def _pack(rows: DataFrame, most: int) -> DataFrame:
    """Rows in id ranges, packed as matrices of at most ``most`` rows of one width."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch["id"], batch["v"]):
                part = held.setdefault(len(v), [])
                part.append((i, v))
                if len(part) == most:
                    yield _packed(held.pop(len(v)))
        for part in held.values():
            yield _packed(part)

    return rows.repartitionByRange("id").sortWithinPartitions("id").mapInPandas(packed, _PACKED)


def _packed(part: list) -> pd.DataFrame:
    ids = np.array([i for i, _ in part], dtype=np.int64)
    body = np.array([v for _, v in part], dtype=np.int64)
    # Half as many bytes where they do; the reader tells the two apart by the length.
    if _largest(body) < 1 << 31:
        body = body.astype(np.int32)
    return pd.DataFrame({"ids": [ids.tobytes()], "width": [body.shape[1]], "body": [body.tobytes()]})


def _unpacked(ids: bytes, body: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(ids, dtype=np.int64)
    kind = np.int32 if len(body) == 4 * width * len(whole) else np.int64
    return whole, np.frombuffer(body, dtype=kind).reshape(-1, width)


def _largest(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.max(initial=0))), abs(int(matrix.min(initial=0))))


def _exact_type(queries: np.ndarray, rows: np.ndarray) -> type:
    """A type in which all scores and bounds of the two are exact. Sums below 2**24 or 2**53 are so in
    floating point, which is far the fastest; then longs, then Python's integers."""
    most = _largest(queries) * _largest(rows) * rows.shape[1]
    largest = max(most, _largest(queries), _largest(rows))
    if largest < 1 << 52:
        return np.float32 if largest < 1 << 24 else np.float64
    return np.int64 if most < 1 << 62 else object


def _as_long(numbers: np.ndarray) -> np.ndarray:
    return numbers if numbers.dtype == object else numbers.astype(np.int64)


def none_found(n: int, k: int, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of n queries before any row is seen: row ids, scores, and which places are taken."""
    return np.full((n, k), -1, dtype=np.int64), np.full((n, k), LOW, dtype=kind), np.zeros((n, k), dtype=bool)


def _limit(best: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The scores that a row must reach to enter."""
    return np.where(found[:, -1], best[:, -1], LOW)


def enter(held: tuple[np.ndarray, np.ndarray, np.ndarray], query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Puts rows into the k best ``held``; equal scores go to the smaller id."""
    if not len(query):
        return
    best_id, best, found = held
    k = best.shape[1]
    seen = np.zeros(len(best), dtype=bool)
    seen[query] = True
    old, place = np.nonzero(found & seen[:, None])
    query = np.concatenate([old, query])
    ids = np.concatenate([best_id[old, place], ids])
    scores = np.concatenate([best[old, place], scores])
    if scores.dtype == object:
        order = np.array(sorted(range(len(query)), key=lambda j: (query[j], -scores[j], ids[j])))
    else:
        order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    top = rank < k
    at = query[top], rank[top]
    best_id[at], best[at], found[at] = ids[top], scores[top], True


def search_slab(
    query_ids: np.ndarray,
    queries: np.ndarray,
    ids: np.ndarray,
    rows: np.ndarray,
    k: int,
    block_rows: int = BLOCK_ROWS,
    least: np.ndarray | None = None,
):
    """The k best (query, row, score) within one slab: arrays (queries, k), filled up with -1.

    ``least`` are scores that k rows of other slabs reach already: what is below them is left out. Raises if a score among them does not fit a long."""
    exact = _exact_type(queries, rows)
    queries, rows = queries.astype(exact, copy=False), rows.astype(exact, copy=False)
    cuts = [slice(b, b + block_rows) for b in range(0, len(ids), block_rows)]
    highest = np.stack([rows[c].max(axis=0) for c in cuts])
    lowest = np.stack([rows[c].min(axis=0) for c in cuts])
    bounds = np.maximum(queries, 0) @ highest.T + np.minimum(queries, 0) @ lowest.T
    n = len(query_ids)
    held = best_id, best, found = none_found(n, k, object if exact is object else np.int64)
    least = np.full(n, LOW) if least is None else least
    for b in np.argsort(-bounds.max(axis=0), kind="stable"):
        # Rounding to ``exact`` moves no limit over a score: those of these rows are whole in it.
        limit = np.maximum(_limit(best, found), least).astype(exact)
        mine = np.flatnonzero(bounds[:, b] >= limit)
        if not len(mine):
            continue
        every = len(mine) == n
        score = (queries if every else queries[mine]) @ rows[cuts[b]].T
        # Only rows that can still enter are ranked.
        enters = score >= limit[mine][:, None]
        enters &= ids[cuts[b]][None, :] != query_ids[mine][:, None]
        if exact is not object and score.shape[1] > k and np.count_nonzero(enters) > 4 * k * len(mine):
            place = score.shape[1] - k
            own = np.where(enters, score, score.dtype.type(LOW))
            enters &= own >= np.partition(own, place, axis=1)[:, place][:, None]
        query, row = np.nonzero(enters)
        enter(held, mine[query], ids[cuts[b]][row], _as_long(score[query, row]))
    if exact is object:
        if any(not LOW <= x < 1 << 63 for x in best[found]):
            raise OverflowError("a score does not fit a long")
        best = best.astype(np.int64)
    return best_id, best, found


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    slab_rows: int = SLAB_ROWS,
    group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    ``is_query`` is a condition on ``id``. Candidates are all rows but those with the query's own id,
    of the query's number of dimensions. Equal scores go to the smaller id. Queries without a candidate
    give no row; rows with an unusable vector take no part; a repeated id is repeated as query and as
    candidate, but its repeats do not find each other. Scores are exact at any size; a component or a score
    that does not fit a long is an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(quantized(vectors, id_column, vector_column), "quantized")
    # Only the number of slabs comes to the driver; their rows are never numbered in one place.
    slabs = materialize(_pack(rows, slab_rows), "slabs")
    piled = slabs.repartition(piles(slabs.count(), spark.sparkContext.defaultParallelism))
    groups = materialize(_pack(rows.filter(is_query), group_queries), "query groups").select(
        "width", F.xxhash64("ids", "body").alias("group"), F.col("ids").alias("query_ids"), F.col("body").alias("query_body")
    )
    # Every query group meets every slab of its width, as the operator is asked to. A task pairs a part of the
    # one with a pile of the other; nothing is copied to be shuffled.
    cells = groups.hint("shuffle_replicate_nl").join(piled, "width")

    def found_rows(group: int, query_ids: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
        best_id, best, found = held
        query, place = np.nonzero(found)
        found_ids = {"query_id": query_ids[query], "query": query, "vec_id": best_id[query, place], "score": best[query, place]}
        return pd.DataFrame(found_ids).assign(group=group)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The cells of a query group follow each other: its best rows are held from slab to slab, prune the next ones and leave once.
        last, query_ids, queries, held = None, None, None, None
        for batch in batches:
            for cell in batch.itertuples(index=False):
                if last != (cell.group, cell.width):
                    if held is not None:
                        yield found_rows(last[0], query_ids, held)
                    query_ids, queries = _unpacked(cell.query_ids, cell.query_body, cell.width)
                    last, held = (cell.group, cell.width), none_found(len(query_ids), k)
                ids, body = _unpacked(cell.ids, cell.body, cell.width)
                best_id, best, found = search_slab(query_ids, queries, ids, body, k, least=_limit(held[1], held[2]))
                query, place = np.nonzero(found)
                enter(held, query, best_id[query, place], best[query, place])
        if held is not None:
            yield found_rows(last[0], query_ids, held)

    found = cells.select("group", "width", "query_ids", "query_body", "ids", "body").mapInPandas(
        search, "query_id bigint, query int, vec_id bigint, score bigint, group bigint"
    )
    per_query = Window.partitionBy("group", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(per_query))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def piles(slabs: int, cores: int) -> int:
    """Parts into which the slabs are dealt: some a core, and more where a part would have too many slabs."""
    return max(1, min(slabs, cores * PILES_A_CORE), -(-slabs // SLABS_AT_ONCE))
