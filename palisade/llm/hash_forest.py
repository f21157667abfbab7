"""Approximate nearest neighbours with a forest of hash prefixes.

A tree gives every vector a long string of symbols: a random rotation, cut into groups of axes; each
symbol is the axis of its group (with its sign) that the rotated vector is closest to. Vectors with a
long common prefix are near each other with high chance. A tree is kept as sorted arrays of (string,
row), so the rows that share a prefix with a query are one stretch of an array.

A query descends in every tree to its longest matching prefix, by binary search, and then ascends in
all trees at once, symbol by symbol, until the stretches of all trees together hold the wanted number
of rows (``wanted``) or the floor is reached. All rows of these stretches are compared with it,
however many they are, by the exact measure in double precision.

Trees are dealt by their first symbols (the floor). A cell with more rows or queries than fit one task
is split into a grid of row blocks and query blocks: each block is a sorted array of its own, and
counts of blocks add up, so a hot cell is many tasks. Only strings and row numbers travel once per
tree. Vectors stay with their block of rows; a query's vector goes to each block that has a candidate
of its own once.

Trees, axes, floor and wanted number are fitted: a documented sample of queries is compared with all
rows, descent and ascent are followed exactly on counts over all rows, and the setting with the fewest
comparisons is taken that finds ``RECALL`` of the true neighbours. If none does, the floor is 0 and
every row is wanted. Every row is indexed; equal vectors share one entry that carries its smallest
ids, which is all that a list of the nearest can show of them.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite components take no
part, nor do those of another length than most, nor rows with a null id. Repeated rows of one id and
vector are one. An id with several vectors asks with the smallest of them, is a candidate with each,
and is none of its own. Rank goes by the unrounded score; equal scores go to the smaller id; fewer
candidates than asked for give a shorter list. An empty table gives an empty result. Other columns
of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.vectors import dimension, matrix, usable
from palisade.session import stored

#: Bits of a string, and seed of the rotations.
BITS, SEED = 40, 99
#: Settings from which the fit chooses, and the recall that it wants on its sample of queries.
TREES, AXES, RECALL, SAMPLE_QUERIES = (16, 24, 32, 48, 64, 96), (8, 16, 32), 0.95, 128
#: Rows and queries of a block of a tree, and bits of a row's number within its block of vectors.
BLOCK_ROWS, BLOCK_QUERIES, PLACE_BITS = 16_384, 1_024, 13


def symbol_bits(axes: int) -> int:
    return (2 * axes - 1).bit_length()


def symbols(axes: int) -> int:
    """Symbols per string."""
    return BITS // symbol_bits(axes)


@lru_cache(maxsize=256)
def _rotation(tree: int, turn: int, size: int) -> np.ndarray:
    random = np.random.default_rng((SEED, tree, turn, size))
    return np.linalg.qr(random.standard_normal((size, size)))[0]


def strings(unit: np.ndarray, tree: int, axes: int) -> np.ndarray:
    """Every row's string as one number, first symbol highest."""
    size = unit.shape[1]
    width = min(axes, size)
    groups, count = size // width, symbols(axes)
    out = np.zeros(len(unit), np.int64)
    for at in range(count):
        turn, group = divmod(at, groups)
        if not group:
            turned = unit @ _rotation(tree, turn, size)
        part = turned[:, group * width : (group + 1) * width]
        axis = np.abs(part).argmax(axis=1)
        out = out << symbol_bits(axes) | axis * 2 + (part[np.arange(len(unit)), axis] > 0)
    return out


def stretches(ordered: np.ndarray, asked: np.ndarray, axes: int, depth: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end, in a sorted array, of what shares the first ``depth`` symbols with each string."""
    rest = (symbols(axes) - depth) * symbol_bits(axes)
    least = asked >> rest << rest
    return np.searchsorted(ordered, least), np.searchsorted(ordered, least + (np.int64(1) << rest))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square overflows."""
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@dataclass
class Setting:
    """Trees, axes per symbol, symbols that every candidate shares, and rows to ascend for."""

    trees: int
    axes: int
    floor: int
    wanted: int
    recall: float = 1.0


def _clean(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    return vectors.where(F.col(vec_id).isNotNull() & usable(vector)).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    ).where(F.exists("vector", lambda x: x != 0))


def _entries(clean: DataFrame, keep: int) -> DataFrame:
    """``ids, vector``: distinct vectors with their smallest ids."""
    # The digest, not the vector, is the key; a bucket of ids first, so that a very common vector
    # is pre-aggregated in many tasks.
    digest = F.md5(F.to_json(F.struct("vector")).cast("binary"))
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    least = F.slice(F.array_sort(F.collect_set("id")), 1, keep)
    return (
        clean.withColumn("digest", digest).withColumn("part", part)
        .groupBy("digest", "part").agg(least.alias("ids"), F.first("vector").alias("vector"))
        .groupBy("digest").agg(
            F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"),
            F.first("vector").alias("vector"),
        ).select("ids", "vector")
    )


def _true_neighbours(entries: DataFrame, asked: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the query and direction of the neighbour, for the nearest of each query."""
    sent = entries.sparkSession.sparkContext.broadcast(asked)  # SAMPLE_QUERIES vectors

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            rows = matrix(batch.column(0))
            if not len(rows):
                continue
            near = q @ unit_rows(rows).T
            near[near > 1 - 1e-9] = -2  # the query itself
            k = min(nearest, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(q)), k)),
                 pa.array(np.take_along_axis(near, best, 1).reshape(-1)),
                 pa.array(list(rows[best.reshape(-1)]), pa.list_(pa.float64()))],
                names=["q", "score", "vector"],
            )

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    truth = (
        entries.select("vector").mapInArrow(top, "q long, score double, vector array<double>")
        .where("score > -2").withColumn("place", place).where(F.col("place") <= nearest)
        .select("q", "vector").toPandas()
    )
    if not len(truth):
        return np.zeros(0, np.int64), np.zeros((0, asked.shape[1]))
    return truth["q"].to_numpy(), unit_rows(np.stack(truth["vector"].to_numpy()).astype(np.float64))


def _stretch_sizes(entries: DataFrame, asked: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """(axes, trees) -> for every depth and query, how many rows the first trees' stretches hold."""
    sent = entries.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        sums = {(a, t): np.zeros((symbols(a) + 1, len(q)), np.int64) for a in AXES for t in TREES}
        for batch in batches:
            rows = matrix(batch.column(0))
            if not len(rows):
                continue
            unit = unit_rows(rows)
            for axes in AXES:
                for tree in range(max(TREES)):
                    ordered, ours = np.sort(strings(unit, tree, axes)), strings(q, tree, axes)
                    found = np.stack([
                        np.subtract(*stretches(ordered, ours, axes, d)[::-1]) for d in range(symbols(axes) + 1)])
                    for trees in TREES:
                        if tree < trees:
                            sums[axes, trees] += found
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in sums], pa.int32()), pa.array([t for _, t in sums], pa.int32()),
             pa.array([s.reshape(-1) for s in sums.values()], pa.list_(pa.int64()))],
            names=["axes", "trees", "sizes"],
        )

    rows = (
        entries.select("vector").mapInArrow(count, "axes int, trees int, sizes array<long>")
        .select("axes", "trees", F.posexplode("sizes")).groupBy("axes", "trees", "pos").agg(F.sum("col").alias("n"))
        .groupBy("axes", "trees").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("sizes")).collect()
    )
    return {
        (r["axes"], r["trees"]): np.array([s["n"] for s in r["sizes"]]).reshape(symbols(r["axes"]) + 1, -1)
        for r in rows
    }


def levels(sizes: np.ndarray, floor: int, wanted: int) -> np.ndarray:
    """The depth at which each query's ascent ends: the deepest with enough rows, or the floor."""
    depth = np.arange(len(sizes))[:, None]
    return np.where((sizes >= wanted) & (depth > floor), depth, floor).max(axis=0)


def fit(entries: DataFrame, queries: DataFrame, nearest: int) -> Setting:
    """Follows a bounded sample of queries and takes the cheapest setting that finds what is near."""
    rows = entries.count()
    best, cost = Setting(1, AXES[0], 0, max(rows, 1)), float(rows)
    sample = (
        queries.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE_QUERIES).toPandas()["vector"]
    )
    if not len(sample):
        return best
    asked = unit_rows(np.stack(sample.to_numpy()).astype(np.float64))
    of, found = _true_neighbours(entries, asked, nearest)
    if not len(of):
        return best
    sizes = _stretch_sizes(entries, asked)
    for axes in AXES:
        depth = np.zeros((max(TREES), len(of)), np.int64)
        for tree in range(max(TREES)):
            apart = strings(asked, tree, axes)[of] ^ strings(found, tree, axes)
            for d in range(1, symbols(axes) + 1):
                depth[tree] += apart >> (symbols(axes) - d) * symbol_bits(axes) == 0
        for trees in TREES:
            deepest, held = depth[:trees].max(axis=0), sizes[axes, trees]
            for floor in range(symbols(axes)):
                for wanted in (nearest * 2**k for k in range(40)):
                    if wanted > 2 * trees * rows:
                        break
                    level = levels(held, floor, wanted)
                    recall = float((deepest >= level[of]).mean())
                    compared = np.minimum(held[level, np.arange(len(level))], rows).mean()
                    # A query's share of the strings that its cells send to its block of queries.
                    searched = held[floor].mean() / BLOCK_QUERIES
                    price = float(compared + searched + trees)
                    if recall >= RECALL and price < cost:
                        best, cost = Setting(trees, axes, floor, wanted, recall), price
    return best


def _strings_of(setting: Setting, own: str):
    """``tree, cell, string`` of every row, with its own number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (symbols(setting.axes) - setting.floor) * symbol_bits(setting.axes)
        for batch in batches:
            rows = matrix(batch.column("vector"))
            if not len(rows):
                continue
            unit = unit_rows(rows)
            for tree in range(setting.trees):
                string = strings(unit, tree, setting.axes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(own), pa.array(np.full(len(rows), tree, np.int32)), pa.array(string >> rest),
                     pa.array(string)],
                    names=[own, "tree", "cell", "string"],
                )

    return run


def _count_cell(setting: Setting):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        """How many rows of a block share each number of symbols with each query."""
        ordered, asked = np.sort(right["string"].to_numpy()), left["string"].to_numpy()
        depths = range(setting.floor + 1, symbols(setting.axes) + 1)
        sizes = [np.subtract(*stretches(ordered, asked, setting.axes, d)[::-1]) for d in depths]
        found = [pa.array(np.tile(left["query"].to_numpy(), len(sizes))),
                 pa.array(np.repeat(np.array(depths, np.int32), len(asked))), pa.array(np.concatenate(sizes))]
        table = pa.table(found, names=["query", "depth", "n"])
        return table.filter(pc.greater(table["n"], 0))

    return cell


def _fetch_cell(setting: Setting, place_bits: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows of a block in each query's stretch, by block of vectors."""
        string, entry = right["string"].to_numpy(), right["entry"].to_numpy()
        order = np.argsort(string, kind="stable")
        ordered, entry = string[order], entry[order]
        begin, end = stretches(ordered, left["string"].to_numpy(), setting.axes, left["level"].to_numpy().astype(np.int64))
        queries, blocks, places = [], [], []
        for query, a, b in zip(left["query"].to_numpy(), begin, end):
            own = np.sort(entry[a:b])
            cuts = np.flatnonzero(np.diff(own >> place_bits)) + 1
            for part in np.split(own, cuts) if len(own) else []:
                queries.append(query)
                blocks.append(part[0] >> place_bits)
                places.append((part & (1 << place_bits) - 1).astype(np.int16))
        return pa.table(
            [pa.array(queries, pa.int64()), pa.array(blocks, pa.int64()), pa.array(places, pa.list_(pa.int16()))],
            names=["query", "block", "places"],
        )

    return cell


def _cosines(query: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """What ``cosine`` says of a query and the columns of a matrix, to the last bit: sums in order."""
    product, own, square = 0.0, 0.0, 0.0
    for q, p in zip(query, parts):
        product, own, square = product + q * p, own + q * q, square + p * p
    return product / (np.sqrt(own) * np.sqrt(square))


def _compare_block(nearest: int, place_bits: int):
    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: queries with their candidates' places in a block of vectors, right: the block."""
        entry, first = right["entry"].to_numpy(), right["first"].to_numpy()
        order = np.argsort(entry)
        entry, first = entry[order], first[order]
        parts = np.ascontiguousarray(matrix(right["vector"])[order].T)
        place, found, scores = entry & (1 << place_bits) - 1, [], []
        for query, places in zip(matrix(left["vector"]), left["places"].to_pylist()):
            at = np.searchsorted(place, np.array(places, np.int64))
            score = _cosines(query, parts[:, at])
            best = np.lexsort((first[at], -score))[:nearest]
            found.append(at[best])
            scores.append(score[best])
        # A block of queries may be empty.
        of = np.repeat(left["query"].to_numpy(), np.array([len(f) for f in found], np.int64))
        at = np.concatenate([np.zeros(0, np.int64), *found])
        score = np.concatenate([np.zeros(0), *scores])
        return pa.table([of, entry[at], first[at], score], names=["query", "entry", "first", "near"])

    return block


def _blocks_of(column: str, count: str) -> Column:
    return F.pmod(F.xxhash64(column), F.col(count))


def _each(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def _candidates(entries: DataFrame, asked: DataFrame, setting: Setting) -> DataFrame:
    """``query, block, places``: what descent and ascent find in every tree."""
    kind = "{} long, tree int, cell long, string long"
    located = stored(
        asked.select("query", "vector").mapInArrow(_strings_of(setting, "query"), kind.format("query")), "forest-asked")
    indexed = stored(
        entries.select("entry", "vector").mapInArrow(_strings_of(setting, "entry"), kind.format("entry")), "forest-index")
    # Cells have at most trees * (symbols of an alphabet) ** floor kinds, but count what is there.
    row_counts = indexed.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("n_rows"))
    query_counts = located.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("n_queries"))
    grid = stored(
        query_counts.join(row_counts, ["tree", "cell"]).select(
            "tree", "cell",
            F.ceil(F.col("n_rows") / BLOCK_ROWS).cast("long").alias("row_blocks"),
            F.ceil(F.col("n_queries") / BLOCK_QUERIES).cast("long").alias("query_blocks"),
        ),
        "forest-grid",
    )
    grid = F.broadcast(grid) if grid.count() <= 200_000 else grid
    keys = ["tree", "cell", "row_block", "query_block"]
    rows = (
        indexed.join(grid, ["tree", "cell"]).withColumn("row_block", _blocks_of("entry", "row_blocks"))
        .withColumn("query_block", _each("query_blocks"))
    )

    def ask(queries: DataFrame) -> DataFrame:
        return (
            queries.join(grid, ["tree", "cell"]).withColumn("query_block", _blocks_of("query", "query_blocks"))
            .withColumn("row_block", _each("row_blocks"))
        )

    # Descent in every tree, and ascent in all of them at once.
    sizes = ask(located).select(*keys, "query", "string").groupBy(*keys).cogroup(
        rows.select(*keys, "string").groupBy(*keys)
    ).applyInArrow(_count_cell(setting), "query long, depth int, n long")
    ends = (
        sizes.groupBy("query", "depth").agg(F.sum("n").alias("n")).where(F.col("n") >= setting.wanted)
        .groupBy("query").agg(F.max("depth").alias("level"))
    )
    level = F.coalesce(F.col("level"), F.lit(setting.floor))
    leveled = stored(located.join(ends, "query", "left").withColumn("level", level), "forest-levels")
    return ask(leveled).select(*keys, "query", "string", "level").groupBy(*keys).cogroup(
        rows.select(*keys, "string", "entry").groupBy(*keys)
    ).applyInArrow(_fetch_cell(setting, PLACE_BITS), "query long, block long, places array<short>")


def search(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", nearest: int = 5,
    setting: Setting | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest by cosine that were found for each query."""
    clean = _clean(vectors, vec_id, vector)
    size = dimension(clean, "vector")
    entries = stored(
        _entries(clean.where(F.size("vector") == size), nearest + 1)
        .withColumn("entry", F.monotonically_increasing_id()),
        "forest-entries",
    )
    asked = stored(
        _clean(vectors.where(is_query), vec_id, vector).where(F.size("vector") == size)
        .groupBy(F.col("id").alias("query")).agg(F.min("vector").alias("vector")),
        "forest-queries",
    )
    setting = setting or fit(entries, asked, nearest)

    found = (
        _candidates(entries, asked, setting)
        .groupBy("query", "block").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    )
    found = stored(found, "forest-candidates")
    grid = found.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("long").alias("query_blocks"))
    # Vectors travel in their own precision.
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    own = F.col("vector").cast(kind).alias("vector")
    keys = ["block", "query_block"]
    left = (
        found.join(grid, "block").withColumn("query_block", _blocks_of("query", "query_blocks"))
        .join(asked.select("query", own), "query")
    )
    right = (
        entries.select(F.shiftright("entry", PLACE_BITS).alias("block"), "entry", F.col("ids")[0].alias("first"), own)
        .join(grid, "block").withColumn("query_block", _each("query_blocks"))
    )
    best = left.select(*keys, "query", "places", "vector").groupBy(*keys).cogroup(
        right.select(*keys, "entry", "first", "vector").groupBy(*keys)
    ).applyInArrow(_compare_block(nearest + 1, PLACE_BITS), "query long, entry long, first long, near double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "first"))
    best = best.withColumn("place", place).where(F.col("place") <= nearest + 1)
    # The exact measure on the original vectors, in one fixed order of summation.
    hits = (
        best.select("query", "entry")
        .join(entries.select("entry", "ids", F.col("vector").alias("v")), "entry")
        .join(asked.select("query", F.col("vector").alias("q")), "query")
        .select("query", F.explode("ids").alias("vec_id"), cosine("q", "v").alias("score"))
        .where("vec_id <> query")
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return (
        hits.withColumn("rank", place).where(F.col("rank") <= nearest)
        .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def cosine(a: str, b: str) -> Column:
    def total(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    return total(a, b) / (F.sqrt(total(a, a)) * F.sqrt(total(b, b)))
