"""Exact top-k inner products, a block at a time.

Rows are put in an order that keeps alike vectors together and cut into blocks of that order. A
block has its forward index (the whole-number vectors of its rows) and, per dimension, the largest
and smallest value, whose products with a query add up to a bound for all its rows. A query takes
blocks in falling order of their bounds and stops at the first one below its k-th score. It starts
with the k-th score over a small fixed set of rows, which is a lower bound of the final one, so poor
blocks are never scored. Bounds and scores are exact, and a block whose bound ties is scored.

Queries and blocks meet in a grid: query chunks by ranges of blocks, each cell one task's work with
its own small answer; the answers of a query are merged at the end. Nothing depends on how often a
vector or value occurs.

Defined cases: vectors that are null, empty or hold null, NaN or infinite components take no part,
nor do those of another length than most, nor rows with a null id; every other row counts, also rows
that share an id or are repeated; a query's candidates are the rows with another id, and queries that
share an id have one list, the best of all their products; ties go to the smaller id; fewer candidates
than k give a shorter list, an empty table none; scores beyond 64 bits are held at their ends. Other
columns of the input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.hash_forest import strings, unit_rows
from palisade.llm.vectors import as_lists, dimension, matrix, usable
from palisade.session import stored

SCALE = 256
#: Rows of a block, blocks of a range, queries of a chunk, rows that give a query its first bound.
BLOCK, RANGE, CHUNK, SEED_ROWS = 256, 32, 1024, 1024
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_MOST = float(np.finfo(np.float64).max)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T`` of whole numbers, held at the ends of 64 bits."""
    largest = _largest(a) * _largest(b) * a.shape[1]
    x, y = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
    if largest < 1 << 53:
        return (x @ y.T).astype(np.int64)
    whole = _low_bits(a) @ _low_bits(b).T  # right in its low 64 bits, so right if the product fits
    if largest < 1 << 63:
        return whole
    with np.errstate(over="ignore", invalid="ignore"):
        near = x @ y.T
        off = np.abs(x) @ np.abs(y).T * ((a.shape[1] + 2) * 2.0**-52) + 2048  # more than it is wrong by
        above, below = near - off >= 2.0**63, near + off <= -(2.0**63)
        open_ = ~(above | below | (np.abs(near) + off < 2.0**63))
    whole[above], whole[below] = _HIGH, _LOW + 1
    for i, j in np.argwhere(open_):  # near an end
        exact = sum(int(p) * int(q) for p, q in zip(a[i], b[j]))
        whole[i, j] = min(max(exact, _LOW + 1), _HIGH)
    return whole


def _low_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as the 64-bit numbers with the same low bits."""
    if values.dtype.kind == "i":
        return values
    rest = np.fmod(values, 2.0**64)
    rest = np.where(rest >= 2.0**63, rest - 2.0**64, np.where(rest < -(2.0**63), rest + 2.0**64, rest))
    return rest.astype(np.int64)


def _largest(values: np.ndarray) -> int:
    return max(-int(values.min(initial=0)), int(values.max(initial=0)))


def _whole(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, v``: every row that takes part, with ``floor(256 * x)`` of each component, as doubles:
    64 bits don't hold all of these numbers, doubles do (beyond their range they are held at its ends)."""
    clean = vectors.where(F.col(vec_id).isNotNull() & usable(vector)).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")
    )

    def floor(x: Column) -> Column:
        y = F.greatest(F.least(x * float(SCALE), F.lit(_MOST)), F.lit(-_MOST))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return clean.select("id", F.transform("x", floor).alias("v"))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = matrix(batch.column("v"))
        if len(rows):
            rows[~rows.any(axis=1)] = 1.0
            key = pa.array(strings(unit_rows(rows), 0, 64))
            yield pa.RecordBatch.from_arrays([*batch.columns, key], names=[*batch.schema.names, "key"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of BLOCK rows in the order in which rows come."""
    def block(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([list(ids)], pa.list_(pa.int64())),
             *(pa.array([list(v)], pa.list_(pa.float64())) for v in
               (rows.reshape(-1), rows.max(axis=0), rows.min(axis=0)))],
            names=["ids", "forward", "most", "least"],
        )

    ids, rows = np.zeros(0, np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        more = matrix(batch.column("v"))
        ids = np.concatenate([ids, batch.column("id").to_numpy()])
        rows = more if rows is None else np.concatenate([rows, more])
        while len(ids) >= BLOCK:
            yield block(ids[:BLOCK], rows[:BLOCK])
            ids, rows = ids[BLOCK:], rows[BLOCK:]
    if len(ids):
        yield block(ids, rows)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: largest score, then smallest id."""
    order = np.lexsort((ids, -np.maximum(scores, _LOW + 1)), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        asked, query = matrix(left["v"]), left["id"].to_numpy()
        kth = left["bound"].to_numpy().copy()
        blocks = [np.array(x, np.int64) for x in right["ids"].to_pylist()]
        forward = [np.array(x, np.float64).reshape(-1, asked.shape[1]) for x in right["forward"].to_pylist()]
        most, least = matrix(right["most"]), matrix(right["least"])
        # One product of both halves: two of them, each held at an end, could not be added.
        bounds = products(
            np.hstack([np.maximum(asked, 0), np.minimum(asked, 0)]), np.hstack([most, least])
        )
        order = np.argsort(-bounds, axis=1, kind="stable")
        top = np.full((len(query), k), _LOW)
        owner = np.full((len(query), k), _HIGH)
        for place in range(len(blocks)):
            turn = order[:, place]
            live = np.flatnonzero(bounds[np.arange(len(query)), turn] >= kth)
            if not len(live):
                break
            for b in np.unique(turn[live]):
                who = live[turn[live] == b]
                scores = products(asked[who], forward[b])
                ids = np.broadcast_to(blocks[b], scores.shape)
                scores[ids == query[who, None]] = _LOW
                top[who], owner[who] = _best(
                    np.concatenate([top[who], scores], axis=1), np.concatenate([owner[who], ids], axis=1), k
                )
            kth = np.maximum(kth, top[:, -1])
        row, col = np.nonzero(top > _LOW)
        return pa.table(
            [pa.array(query[row]), pa.array(owner[row, col]), pa.array(top[row, col])], schema=schema
        )

    return search


def _first_bounds(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Adds ``bound``: the k-th score over SEED_ROWS rows drawn by hash."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SEED_ROWS).toPandas()
    sent = queries.sparkSession.sparkContext.broadcast((
        sample["id"].to_numpy(np.int64),
        np.stack(sample["v"].to_numpy()).astype(np.float64) if len(sample) else np.zeros((0, 0)),
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seed = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = np.full(batch.num_rows, _LOW)
            if len(ids) > k:
                scores = products(matrix(batch.column("v")), seed)
                scores[batch.column("id").to_numpy()[:, None] == ids] = _LOW
                bound = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], names=["id", "v", "bound"])

    return queries.select("id", "v").mapInArrow(run, "id long, v array<double>, bound long")


def search(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest products; ``is_query`` is about ``id``."""
    rows = _whole(vectors, vec_id, vector)
    rows = stored(rows, "topk-rows")
    rows = rows.where(F.size("v") == dimension(rows, "v"))
    keyed = rows.mapInArrow(_ordered, "id long, v array<double>, key long")
    blocks = stored(
        keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
        .mapInArrow(_cut, "ids array<long>, forward array<double>, most array<double>, least array<double>")
        .withColumn("block", F.monotonically_increasing_id()),
        "topk-blocks",
    )
    queries = rows.where(is_query)
    chunks = max(1, -(-queries.count() // CHUNK))
    ranges = blocks.select(F.shiftright("block", RANGE.bit_length() - 1).alias("range")).distinct()
    # One number per RANGE * BLOCK rows.
    known = sorted(row["range"] for row in ranges.collect())
    ask = (
        _first_bounds(queries, rows, k)
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
        .withColumn("range", F.explode(F.array(*map(F.lit, known)) if known else F.array().cast("array<long>")))
    )
    hold = blocks.withColumn("range", F.shiftright("block", RANGE.bit_length() - 1)).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    )
    found = ask.groupBy("chunk", "range").cogroup(
        hold.select("chunk", "range", "ids", "forward", "most", "least").groupBy("chunk", "range")
    ).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        found.withColumn("rank", place).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
