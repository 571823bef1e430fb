"""Nearest neighbours by block matrix join.

Vectors are normalised and quantised to int8 once, and packed into blocks of numbers, scales and lengths of rounding errors. A tile, the product of a query block and a candidate block in whole
numbers, gives every cosine with a proven bound of its error. Bounded heaps keep each query's k best lower bounds, in a tile's task and then over all tiles; only pairs whose upper bound reaches
the k-th of them are joined with the original vectors, computed again in double precision, and merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

QUERY_BLOCK, BLOCK = 4096, 2048
#: Components whose products of int8 numbers sum to less than 2**24, up to which float32 holds whole numbers exactly.
EXACT = 1024


def usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors (double) of the rows that take part, one pair of arrays for each length of vector."""
    ids, column = batch.column("vec_id"), batch.column("embedding")
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    there = ids.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
    for width in np.unique(sizes[there]):
        place = np.flatnonzero(there & (sizes == width))
        v = column.take(pa.array(place)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(place), -1)  # a null component becomes NaN
        fine = np.isfinite(v).all(1) & (v != 0).any(1)
        if fine.any():
            yield ids.take(pa.array(place[fine])).to_numpy(zero_copy_only=False), v[fine]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows, summed from the first component to the last wherever the rows stand, so that equal vectors give equal numbers."""
    return np.cumsum(a * b, axis=1)[:, -1]


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(v, v))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that the largest component is from a half to 1: squares neither vanish nor overflow, and no digit of a cosine changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, the scale of each, and the length of each row's rounding error, of the normalised vectors."""
    v = scaled(v)
    u = v / norms(v)[:, None]
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((u - q * scale[:, None]) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of int8 rows with int8 rows, in whole numbers, exact at any width: slices of EXACT components are multiplied and summed as 64-bit integers."""
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], EXACT):
        part = slice(at, at + EXACT)
        out += (a[:, part].astype(np.float32) @ b[:, part].T.astype(np.float32)).astype(np.int64)
    return out


def first_copies(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that stand behind k + 1 equal vectors of smaller id in this block: they can be no query's k nearest."""
    order = np.lexsort(ids[None])
    _, inverse = np.unique(v[order].view(f"V{v.shape[1] * 8}").ravel(), return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    start = np.flatnonzero(np.append(True, inverse[by][1:] != inverse[by][:-1]))
    rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return np.sort(order[by[rank <= k]])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = scaled(a), scaled(b)
    return np.clip(dots(a, b) / (norms(a) * norms(b)), -1.0, 1.0)


def tile(query: tuple, candidates: tuple, k: int, floors: dict[int, list[float]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, candidate id, least cosine, largest cosine) of the pairs of two blocks (ids, int8 rows, scales, errors) that may be among a query's k nearest, a part of the queries at a time.

    floors holds a heap of each query's k largest lower bounds so far, which the tile raises; a query is no candidate of its own.
    """
    (q_ids, qa, sa, ea), (ids, qb, sb, eb) = query, candidates
    for at in range(0, len(q_ids), 256):
        rows = slice(at, at + 256)
        near = products(qa[rows], qb) * sa[rows, None] * sb
        error = ea[rows, None] + eb + ea[rows, None] * eb + 1e-9  # of unit vectors
        own = q_ids[rows, None] == ids
        low = np.where(own, -np.inf, near - error)
        best = np.partition(low, -k, axis=1)[:, -k:] if len(ids) > k else low
        least = np.empty(len(low))
        for i, (q, values) in enumerate(zip(q_ids[rows].tolist(), best.tolist(), strict=True)):
            heap = floors.setdefault(q, [-np.inf] * k)
            for x in values:
                if x > heap[0]:
                    heapq.heapreplace(heap, x)
            least[i] = heap[0]
        i, j = np.nonzero((near + error >= least[:, None]) & ~own)
        yield q_ids[rows][i], ids[j], low[i, j], near[i, j] + error[i, j]


BLOCKS = pa.schema([("q", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("scales", pa.binary()), ("errors", pa.binary())])
BLOCKS_DDL = "q int, width int, ids binary, rows binary, scales binary, errors binary"
PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def _packed(q: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    row = (q, v.shape[1], ids.astype(np.int64).tobytes(), *(x.tobytes() for x in quantised(v)))
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    of = lambda c, kind: np.frombuffer(row[side + c], kind)
    return of("ids", np.int64), of("rows", np.int8).reshape(-1, row["width"]), of("scales", np.float64), of("errors", np.float64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """vectors(vec_id, embedding, ...) to each query's k nearest by cosine: query_id, rank, vec_id, score; all candidates if they are fewer.

    Queries are the rows where is_query holds; all rows but the query's own id are candidates. Vectors that are null, empty, zero or have a null, infinite or NaN component, and
    rows with a null id, take no part; vectors of different lengths do not meet. Rows of one id count once, by the least of their vectors and of is_query. Ties go to the smaller id. Other columns are not read. An empty table gives no rows.
    Each candidate block meets each query block once, by an equi-join on the query block's number: blocks are rows, so no pair of vectors is a row.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query.cast("boolean"), F.lit(False)).alias("asked"))
    least = F.min(F.when(F.col("embedding").isNotNull(), F.struct("embedding", "asked"))).alias("v")
    own = written(own.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(least).select("vec_id", "v.embedding", F.coalesce("v.asked", F.lit(False)).alias("asked")), "vectors")  # a plain table, so that Spark can split the join of a vector that is near many queries
    asked = own.filter("asked").select("vec_id", "embedding")
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    lanes = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def pack_queries(batches):
        for batch in batches:
            q = batch.column("q").to_numpy()
            for g in np.unique(q):
                for ids, v in usable(batch.filter(pa.array(q == g))):
                    yield _packed(g, ids, v)

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for ids, v in usable(batch.slice(at, BLOCK)):
                    kept = first_copies(ids, v, k)
                    yield _packed(0, ids[kept], v[kept])

    # Of equal vectors the k + 1 of smallest ids can be among a query's k nearest; Spark keeps as many of each task before the shuffle, so that a vector of very many rows is no task's and no query's.
    copy = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = own.select("vec_id", "embedding").withColumn("copy", copy).filter(F.col("copy") <= k + 1).drop("copy")
    queries = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).repartition(groups, "q").mapInArrow(pack_queries, BLOCKS_DDL)
    queries = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    blocks = few.mapInArrow(pack, BLOCKS_DDL).select("width", *(F.col(c).alias("c_" + c) for c in ("ids", "rows", "scales", "errors")), F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q"))
    tiles = blocks.join(queries.hint("shuffle_hash"), ["q", "lane", "width"])

    def multiply(batches):
        floors: dict[int, list[float]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for part in tile(_unpacked(row, ""), _unpacked(row, "c_"), k, floors):
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, part)), schema=PAIRS)

    def bounded(batches):
        """Pairs whose upper bound reaches their query's k-th best lower bound over all tiles; what waits for a query is thinned whenever it has doubled."""
        floors: dict[int, list[float]] = {}
        waiting: dict[int, list[tuple[float, int]]] = {}
        room: dict[int, int] = {}
        for batch in batches:
            for q, c, low, high in zip(*(batch.column(x).to_pylist() for x in PAIRS.names), strict=True):
                heap = floors.setdefault(q, [-np.inf] * k)
                if high < heap[0]:
                    continue
                if low > heap[0]:
                    heapq.heapreplace(heap, low)
                held = waiting.setdefault(q, [])
                held.append((high, c))
                if len(held) > room.get(q, 8 * k):
                    waiting[q] = held = [x for x in held if x[0] >= heap[0]]
                    room[q] = 2 * max(4 * k, len(held))
        for q, held in waiting.items():
            ids = [c for high, c in held if high >= floors[q][0]]
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), pa.int64()), pa.array(ids, pa.int64())], names=["query_id", "vec_id"])

    pairs = tiles.mapInArrow(multiply, "query_id long, vec_id long, low double, high double").repartition(lanes, "query_id").mapInArrow(bounded, "query_id long, vec_id long")
    met = pairs.join(own.select("vec_id", F.col("embedding").alias("c")), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")

    def exact(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("q")).to_numpy()
            for width in np.unique(sizes):
                part = batch.filter(pa.array(sizes == width))
                q, c = (part.column(x).flatten().to_numpy().reshape(-1, width) for x in ("q", "c"))
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("vec_id"), pa.array(cosines(q, c))], names=["query_id", "vec_id", "score"])

    def merged(batches):
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for q, c, score in zip(*(batch.column(x).to_pylist() for x in ("query_id", "vec_id", "score")), strict=True):
                heap = heaps.setdefault(q, [])
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -c))
        for q, heap in heaps.items():
            best = sorted(heap, reverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-c for _, c in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    found = met.select("query_id", "vec_id", "q", "c").mapInArrow(exact, "query_id long, vec_id long, score double").repartition(lanes, "query_id")
    return found.mapInArrow(merged, "query_id long, rank int, vec_id long, score double")
