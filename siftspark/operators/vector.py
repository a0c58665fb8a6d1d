"""Exact nearest neighbours by cosine distance for a stated set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import local_table

#: Query vectors that go to every task at once, in bytes.
MOST_QUERY_BYTES = 64 << 20
#: Vectors of a block that a table of queries meets, on average at most.
BLOCK = 65_536


def knn(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, *, id_col: str = "message_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, vec_rank): the ``k`` nearest of every query, equal distances by id.

    Every vector is compared. Tasks multiply blocks of vectors with the matrix of queries and keep ``k`` per block and
    query, so what is shuffled is bounded by blocks x queries x k.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    fields = f"query_id long, id {kind}, distance double"
    if not queries:
        return spark.createDataFrame([], f"{fields}, vec_rank long")
    dims = {len(v) for _, v in queries}
    if len(dims) > 1 or 0 in dims:
        raise ValueError("query vectors must have one length")
    matrix = np.array([v for _, v in queries], float)
    if matrix.nbytes > MOST_QUERY_BYTES:
        half = len(queries) // 2
        return knn(vectors, queries[:half], k, id_col=id_col, vector_col=vector_col).unionByName(knn(vectors, queries[half:], k, id_col=id_col, vector_col=vector_col))
    names = np.array([q for q, _ in queries])
    shared = spark.sparkContext.broadcast(matrix / np.linalg.norm(matrix, axis=1, keepdims=True))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows[rows["v"].notna()]
            if not len(rows):
                continue
            x = np.stack(rows["v"].to_numpy()).astype(float)
            if x.shape[1] != shared.value.shape[1]:
                raise ValueError(f"vectors of {x.shape[1]} dimensions, queries of {shared.value.shape[1]}")
            ids = rows["id"].to_numpy()
            distance = 1 - shared.value @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            # all that ties with the k-th stays, for the ids to decide
            keep = distance <= np.partition(distance, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1][:, None] + 1e-12
            q, i = np.nonzero(keep)
            yield pd.DataFrame({"query_id": names[q], "id": ids[i], "distance": distance[q, i]})

    return _best(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInPandas(nearest, fields), k)


def _best(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "id")
    return near.withColumn("vec_rank", F.row_number().over(order).cast("long")).where(F.col("vec_rank") <= k)


def _unit(column: pa.Array) -> np.ndarray:
    """The rows of a list column, none of them null, at unit length."""
    x = column.flatten().to_numpy().reshape(len(column), -1).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def knn_table(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "message_id", vector_col: str = "embedding") -> DataFrame:
    """As ``knn``, for a table of queries (query_id, v) of any number.

    The vectors are dealt into blocks of bounded size, every query goes to each block, and a block gives its ``k`` nearest of
    every query; queries pass a block's vectors in batches. Nothing goes through the driver.
    """
    spark = vectors.sparkSession
    # a block for each core: more of them would each give ``k`` rows of every query
    blocks = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // BLOCK))
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = queries.where("v is not null").select(block.alias("block"), F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    return _best(_in_blocks(rows, asked, k, blocks), k)


def _in_blocks(rows: DataFrame, asked: DataFrame, k: int, parts: int) -> DataFrame:
    """(query_id, id, distance): of each block (block, id, v) the ``k`` nearest of every query (block, query_id, v) that asks it."""
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("block", F.lit(None).cast("long").alias("query_id"), "id", "v")
    asked = asked.select("block", "query_id", F.lit(None).cast(kind).alias("id"), "v")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, unit = None, [], [], None
        for batch in batches:
            place, is_query = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(place)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if place[a] != now:
                    now, ids, parts, unit = place[a], [], [], None
                if not is_query[a]:
                    ids.append(part.column(2))
                    parts.append(_unit(part.column(3)))
                elif parts or unit is not None:
                    if unit is None:
                        unit, ids, parts = np.concatenate(parts), pa.concat_arrays(ids), []
                    asked = _unit(part.column(3))
                    if asked.shape[1] != unit.shape[1]:
                        raise ValueError(f"vectors of {unit.shape[1]} dimensions, queries of {asked.shape[1]}")
                    step = max(1, (4 << 20) // len(unit))
                    for c in range(0, len(asked), step):
                        distance = 1 - asked[c : c + step] @ unit.T
                        least = min(k, len(unit)) - 1
                        keep = distance <= np.partition(distance, least, axis=1)[:, least][:, None] + 1e-12
                        q, i = np.nonzero(keep)
                        names = part.column(1).take(pa.array(q + c))
                        yield pa.RecordBatch.from_arrays([names, ids.take(pa.array(i)), pa.array(distance[q, i])], names=["query_id", "id", "distance"])

    both = rows.unionByName(asked).repartition(parts, "block").sortWithinPartitions("block", F.col("query_id").asc_nulls_first())
    return both.mapInArrow(nearest, f"query_id long, id {kind}, distance double")


# --- cells: blocks that a query need not open ----------------------------------------------------------

#: Cells of a table of vectors at most: their pivots go to every task.
MOST_CELLS = 1024
#: What rounding may take from an angle.
SLACK = 1e-6


@dataclass
class Cells:
    """Vectors by the pivot they are nearest to (cell, chunk, id, v), and of each cell its pivot, its number of vectors, and the
    least and greatest angle between them and the pivot."""

    rows: DataFrame
    pivots: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    chunks: np.ndarray

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The least angle that each query may have with any vector of each cell, by the triangle inequality of angles."""
        at = np.arccos(np.clip(unit @ self.pivots.T, -1, 1))
        return np.maximum(0, np.maximum(at - self.high, self.low - at))

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """The cells that a query opens at first: those of least bound, until they hold ``k`` vectors."""
        order = np.argsort(bounds, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.counts[order]), k)) + 1]


def make_cells(vectors: DataFrame, path: str, *, cells: int | None = None, id_col: str = "message_id", vector_col: str = "embedding") -> Cells:
    """Writes the vectors to ``path`` by cells: the pivots are ``cells`` of them, those of smallest hash (about the square root
    of their number, ``MOST_CELLS`` at most). A cell of more than ``BLOCK`` vectors is dealt into chunks."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    cells = min(MOST_CELLS, cells or max(1, int(rows.count() ** 0.5)))
    some = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(cells).collect()]
    pivots = np.array(some, float) if some else np.zeros((0, 1))
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cos = _unit(batch.column(1)) @ pivots.T
            cell = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns, pa.array(angle)], names=["cell", "id", "v", "angle"])

    rows.mapInArrow(placed, f"cell int, id {kind}, v array<double>, angle double").write.parquet(path)
    held = spark.read.schema(f"cell int, id {kind}, v array<double>, angle double").parquet(path)
    counts, low, high = np.zeros(len(some), np.int64), np.zeros(len(some)), np.zeros(len(some))
    for r in held.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row a cell
        counts[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    chunks = np.maximum(1, -(-counts // BLOCK))
    dealt = local_table(spark, [(i, int(n)) for i, n in enumerate(chunks)], "cell int, chunks int")
    held = held.join(F.broadcast(dealt), "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))  # MOST_CELLS rows
    return Cells(held.select("cell", "chunk", "id", "v"), pivots, counts, low, high, chunks)


def knn_cells(cells: Cells, queries: DataFrame, k: int, path: str) -> tuple[DataFrame, DataFrame]:
    """As ``knn_table``, exact, in two rounds: a query opens the cells nearest to it until they hold ``k`` vectors, and then
    those only whose bound does not exceed the ``k``-th angle it has found. Beside the neighbours (query_id, opened): how
    many cells each query opened. ``path``: a folder for what the rounds found."""
    spark = cells.rows.sparkSession
    shared = spark.sparkContext.broadcast(replace(cells, rows=None))  # pivots: MOST_CELLS vectors at most; the rows stay where they are
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    fields = "query_id long, v array<double>, cell int, chunk int"

    def opened(later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c: Cells = shared.value
            for batch in batches:
                if not batch.num_rows or not len(c.pivots):
                    continue
                bounds = c.bounds(_unit(batch.column(1)))
                which, cell = [], []
                for i, b in enumerate(bounds):
                    first = c.first(b, k)
                    if later:
                        far = batch.column(2)[i].as_py()
                        first = np.setdiff1d(np.flatnonzero(b <= np.arccos(np.clip(1 - far, -1, 1)) + SLACK), first)
                    first = first[c.counts[first] > 0]
                    for n in range(int(c.chunks[first].max(initial=0))):
                        there = first[c.chunks[first] > n]
                        which.append(np.stack((np.full(len(there), i), there, np.full(len(there), n)), 1))
                which = np.concatenate(which) if which else np.zeros((0, 3), np.int64)
                at = pa.array(which[:, 0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(which[:, 1].astype(np.int32)), pa.array(which[:, 2].astype(np.int32))], names=["query_id", "v", "cell", "chunk"])

        return run

    by_block = (F.col("cell").cast("long") * (1 << 32) + F.col("chunk")).alias("block")
    asked = queries.where("v is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    held = cells.rows.select(by_block, "id", "v")

    def round_of(rows: DataFrame, later: bool, name: str) -> tuple[DataFrame, DataFrame]:
        rows.mapInArrow(opened(later), fields).write.parquet(f"{path}/asked-{name}")
        asks = spark.read.schema(fields).parquet(f"{path}/asked-{name}")
        near = _in_blocks(held, asks.select(by_block, "query_id", "v"), k, parts)
        near.write.parquet(f"{path}/near-{name}")
        return spark.read.schema(near.schema).parquet(f"{path}/near-{name}"), asks.select("query_id", "cell")

    near, first = round_of(asked, False, "first")
    kth = _best(near, k).groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    kth = kth.select("query_id", F.when(F.col("n") >= k, F.col("far")).otherwise(2.0).alias("far"))
    more, second = round_of(asked.join(kth, "query_id").select("query_id", "v", "far"), True, "second")
    counts = first.unionByName(second).groupBy("query_id").agg(F.count_distinct("cell").alias("opened"))
    return _best(near.unionByName(more), k), counts


def cosine_search(vectors: DataFrame, text: DataFrame, queries: list[tuple[int, list[float]]], k: int = 10) -> DataFrame:
    """The cosine-only path: (query_id, id, subject, from_addr, score, distance, snippet), score = 1 - distance."""
    return with_text(F.broadcast(knn(vectors, queries, k)), text)  # k rows for each query of the driver


def with_text(found: DataFrame, text: DataFrame) -> DataFrame:
    """Neighbours (query_id, id, distance) with what a cosine search shows of them."""
    from ..functions.text import snippet

    rows = text.select(F.col("id"), "subject", "from_addr", snippet("body").alias("snippet"))
    return found.join(rows, "id", "left").select("query_id", "id", "subject", "from_addr", (1 - F.col("distance")).alias("score"), "distance", "snippet")
