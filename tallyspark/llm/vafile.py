"""Exact top-k search by vector-approximation files.

Every vector gets an approximation: one byte a component, which names the cell of a common grid that holds the component.
The inner product of a query with a cell's centre is certain up to a slack that depends on the query alone, so the
approximations bound every exact score. The file of approximations is scanned twice, in blocks of vectors and queries:

1. Each query takes the READ vectors with the best bounds. Only their exact vectors are read, by a join; the k-th of
   their scores is a floor that no result falls below.
2. Vectors whose bound reaches the floor of a query of the block are read exactly, once for a block of queries; for any
   other the result is certain without them. Each query scores those in the order of its bounds until no bound that is
   left reaches its k-th score. The best of a block merge per query.

A task holds one block of vectors and one of queries, whatever the number of rows or of equal vectors, and sends k rows
for each query and block at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

TOP = 5
QUERY_EVERY = 50
SCALE = 256
CELLS = 256
#: Rows in a block of vectors and in a block of queries, at most on average; small tables still make LEAST_BLOCKS.
BLOCK_ROWS = 16_384
QUERY_ROWS = 2_048
LEAST_BLOCKS = 8
#: Components and scores beyond a long count as its ends.
LARGEST, SMALLEST = 2**63 - 1, -(2**63)
#: Exact vectors that a query reads for its floor.
READ = 16
_QUERIES_AT_A_TIME = 128


def _floored(x):
    product = x.cast("double") * SCALE
    return F.when(product >= float(2**63), F.lit(LARGEST)).when(product < float(SMALLEST), F.lit(SMALLEST)).otherwise(F.floor(product))


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): floor(SCALE * x) of each component, at most the ends of a long; vectors that are null, or
    hold null or non-finite components, go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return good.select(F.col("vec_id").cast("long"), F.transform("embedding", _floored).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([len(x) for x in column], np.int64)
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy()
    if sizes.size and (sizes == width).all():
        return flat.reshape(len(column), width)
    rows = np.repeat(np.arange(sizes.size), sizes)
    out[rows, np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Grid:
    """Cells of equal width in each dimension, from the least to the largest component there."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low = low.astype(np.float64)
        self.step = np.maximum((high - self.low) / CELLS, 1e-9)

    def codes(self, exact: np.ndarray) -> np.ndarray:
        return np.clip((exact - self.low) / self.step, 0, CELLS - 1).astype(np.uint8)

    def bounds(self, codes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(middle [vector, query], slack [query]): every exact inner product is within the slack of its middle."""
        q = queries.astype(np.float64)
        scaled = q * self.step
        kind = np.float32 if float(np.abs(scaled).sum(axis=1).max(initial=0)) < 1e30 else np.float64
        centre = codes.astype(kind) @ scaled.T.astype(kind)
        # Half a cell in each dimension, what single precision may lose in the sum, and double precision in large numbers.
        loss = 255.0 * np.abs(scaled).sum(axis=1) * (q.shape[1] + 4) * 2.0**-23 + 1.0
        loss += np.abs(q) @ (np.abs(self.low) + CELLS * self.step) * (q.shape[1] + 4) * 2.0**-50
        return centre.astype(np.float64) + q @ (self.low + self.step / 2), (np.abs(q) * self.step).sum(axis=1) / 2 + loss


def products(exact: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products [vector, query], exact as long as they and their parts fit a long."""
    if _largest(exact, queries) < 2**53:
        return (exact.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    return exact @ queries.T


def _largest(exact: np.ndarray, queries: np.ndarray) -> float:
    return float(np.abs(exact.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * exact.shape[1]


def clamped_products(exact: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products [vector, query] of any longs; those beyond a long count as its ends."""
    if _largest(exact, queries) < 2**62:
        return products(exact, queries)
    return np.clip(exact.astype(object) @ queries.astype(object).T, SMALLEST, LARGEST).astype(np.int64)


def best_in_order(exact: np.ndarray, ids: np.ndarray, query: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, vectors scored) of the k largest scores, ties to the smaller id: vectors are scored in the order of
    their bounds, in portions that double, until the k-th score is above every bound that is left."""
    order = np.argsort(-bound, kind="stable")
    rows, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(k, 4)
    while at < order.size:
        if rows.size >= k and bound[order[at]] < float(scores[-1]) and scores[-1] < LARGEST:
            break
        part = order[at : at + step]
        if rows.size >= k and scores[-1] < LARGEST:
            part = part[bound[part] >= float(scores[-1])]
        rows, scores = np.r_[rows, part], np.r_[scores, clamped_products(exact[part], query[None])[:, 0]]
        best = np.lexsort((ids[rows], ~scores))[:k]
        rows, scores, at, step = rows[best], scores[best], at + part.size, 2 * step
    return rows, scores, at


def _ranges(width: int):
    """(dim, low, high) of each batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                exact = _matrix(batch.column("v"), width)
                yield pa.record_batch({"dim": pa.array(np.arange(width)), "low": pa.array(exact.min(axis=0)), "high": pa.array(exact.max(axis=0))})

    return rows


def _coded(width: int, grid: Grid):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = grid.codes(_matrix(batch.column("v"), width))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * width
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "code": pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(codes.tobytes())])})

    return rows


def _codes_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _portions(left: pa.Table, right: pa.Table, width: int, grid: Grid):
    """(first query, middle, slack, own) of portions of the block's queries; own marks a query's own vector."""
    ids, codes = left.column("vec_id").to_numpy(), _codes_of(left.column("code"), width)
    query_ids, queries = right.column("query_id").to_numpy(), _matrix(right.column("q"), width)
    for at in range(0, query_ids.size, _QUERIES_AT_A_TIME):
        middle, slack = grid.bounds(codes, queries[at : at + _QUERIES_AT_A_TIME])
        yield at, middle, slack, ids[:, None] == query_ids[None, at : at + _QUERIES_AT_A_TIME]


def _best_bounds(width: int, grid: Grid):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("bound", pa.float64())])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float64)]]
        if left.num_rows and right.num_rows:
            ids, query_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            n = min(READ, ids.size)
            for at, middle, slack, own in _portions(left, right, width, grid):
                middle[own] = -np.inf
                best = np.argpartition(-middle, n - 1, axis=0)[:n]
                bound = np.take_along_axis(middle, best, axis=0) + slack
                rows, columns = np.nonzero(bound > -np.inf)
                for column, values in zip(out, (query_ids[at + columns], ids[best[rows, columns]], bound[rows, columns]), strict=True):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], schema=schema)

    return scan


def _open(width: int, grid: Grid):
    schema = pa.schema([("block", pa.int32()), ("query_block", pa.int32()), ("vec_id", pa.int64())])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            floor = right.column("floor").to_numpy()
            reached = np.zeros(left.num_rows, bool)
            for at, middle, slack, own in _portions(left, right, width, grid):
                reached |= ((middle + slack >= floor[at : at + slack.size]) & ~own).any(axis=1)
            found = left.column("vec_id").to_numpy()[reached]
        place = [left.column(c)[0].as_py() if found.size else 0 for c in ("block", "query_block")]
        return pa.table([pa.array(np.full(found.size, x, np.int32)) for x in place] + [pa.array(found)], schema=schema)

    return scan


def _best_scores(width: int, grid: Grid, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        if left.num_rows and right.num_rows:
            ids, exact = left.column("vec_id").to_numpy(), _matrix(left.column("v"), width)
            codes = grid.codes(exact)
            query_ids, queries = right.column("query_id").to_numpy(), _matrix(right.column("q"), width)
            floor = right.column("floor").to_numpy()
            for at in range(0, query_ids.size, _QUERIES_AT_A_TIME):
                middle, slack = grid.bounds(codes, queries[at : at + _QUERIES_AT_A_TIME])
                for i, query in enumerate(query_ids[at : at + _QUERIES_AT_A_TIME].tolist()):
                    bound = middle[:, i] + slack[i]
                    near = np.flatnonzero((bound >= floor[at + i]) & (ids != query))
                    rows, scores, _ = best_in_order(exact[near], ids[near], queries[at + i], bound[near], k)
                    for column, values in zip(out, (np.full(rows.size, query), ids[near[rows]], scores), strict=True):
                        column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], schema=schema)

    return read


class Search:
    """The steps of a search; open_vectors() are the exact vectors that its last step reads."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int) -> None:
        vectors, queries = vectors.select("vec_id", "v"), queries.select("vec_id", "v")
        facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
        self.vectors, self.k, self.width = vectors, k, max(1, facts.width or 0)
        self.blocks = max(LEAST_BLOCKS, -(-facts.n // BLOCK_ROWS))
        self.query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
        width, low, high = self.width, np.zeros(self.width), np.zeros(self.width)
        # One row a dimension.
        for r in vectors.mapInArrow(_ranges(width), "dim long, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            low[r.dim], high[r.dim] = r.low, r.high
        self.grid = Grid(low, high)
        self.queries = queries.select(self._part("vec_id", "query", self.query_blocks).alias("query_block"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        codes = vectors.mapInArrow(_coded(width, self.grid), "vec_id long, code binary")
        self.file = codes.select(self._part("vec_id", "block", self.blocks).alias("block"), self._every(self.query_blocks).alias("query_block"), "vec_id", "code")

    @staticmethod
    def _part(column: str, seed: str, n: int):
        return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(n)).cast("int")

    @staticmethod
    def _every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def _met(self, left: DataFrame, queries: DataFrame, step, schema: str) -> DataFrame:
        right = queries.select(self._every(self.blocks).alias("block"), *queries.columns)
        return left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInArrow(step, schema)

    def floors(self) -> DataFrame:
        """(query_id, floor): the k-th score among the READ vectors with the best bounds; no row if they are fewer."""
        bounds = self._met(self.file, self.queries, _best_bounds(self.width, self.grid), "query_id long, vec_id long, bound double")
        by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "vec_id")
        first = bounds.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= READ).select("query_id", "vec_id")
        none = F.lit(0.0)
        terms = F.zip_with("q", "v", lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), none))
        # Double precision loses a little of each term: the floor is what the score has at least.
        sums = F.aggregate(terms, F.struct(none.alias("sum"), none.alias("size")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["size"] + F.abs(x)).alias("size")), lambda s: s["sum"] - s["size"] * (self.width + 4) * 2.0**-52)
        scored = first.join(self.vectors, "vec_id").join(self.queries, "query_id").select("query_id", sums.alias("score"))
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
        return checkpointed(scored.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == self.k).select("query_id", F.col("score").alias("floor")))

    def floored(self) -> DataFrame:
        """The queries with their floors. Scores beyond a long are ties, so none of them may be above a floor."""
        floor = F.when(F.col("floor") > float(SMALLEST), F.least(F.col("floor"), F.lit(float(2**62))))
        floor = F.coalesce(floor, F.lit(float("-inf")))
        return checkpointed(self.queries.join(self.floors(), "query_id", "left").select("query_block", "query_id", "q", floor.alias("floor")))

    def open_vectors(self, queries: DataFrame) -> DataFrame:
        """(block, query_block, vec_id) of the vectors whose bound reaches the floor of a query of the block."""
        return self._met(self.file, queries, _open(self.width, self.grid), "block int, query_block int, vec_id long")

    def found(self) -> DataFrame:
        queries = self.floored()
        read = self.open_vectors(queries).join(self.vectors, "vec_id")
        best = self._met(read, queries, _best_scores(self.width, self.grid, self.k), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k largest inner products among `vectors`.

    Both are (vec_id, v array<long>) with unique ids; shorter vectors count as padded with zeros, empty ones as zeros;
    rows with the query's own vec_id are not its candidates; ties go to the smaller vec_id, also among equal vectors. A
    query with fewer candidates gets them all; empty tables give no rows; other columns are ignored, whatever their
    names. Scores are exact; those beyond a long count as its ends, and tie.
    """
    return Search(vectors, queries, k).found()


def exact_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v), checkpointed: scaled(), where rows that repeat an id are one vector, the smallest of them."""
    return checkpointed(scaled(embeddings).groupBy("vec_id").agg(F.min("v").alias("v")))


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """top_k of all `embeddings`, queries are those whose vec_id is divisible by 50. Rows without an id, or with null or
    non-finite components, take no part; other columns are ignored; of rows with one id the smallest vector counts."""
    vectors = exact_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


OP3_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
