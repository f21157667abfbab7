"""Hard negatives by inner product, through cover trees over norm-augmented vectors.

Whole-number vectors get one more component, the root of (largest squared norm - own squared norm),
so all have one length and the nearest one to a query is the one with the largest inner product. The
rows fall into the cells of the upper levels of a cover tree, which is grown on a bounded sample; each
cell, cut by a hash into parts of about ``PART`` rows however many of its rows are alike, gets the
lower levels. A node has a centre, which is one of its rows, and the largest distance of its rows from
it, its covering radius; radii shrink level by level. For an anchor q and a node with centre c and
radius r every inner product lies within q.c +- |q| r.

A search asks for the k best rows of one kind (same or other label) whose product lies in a window.
It descends best first: the node with the largest upper bound that is still open is opened next, nodes
whose bounds lie outside of the window or below the k-th product so far are skipped, and rows of
leaves are verified in exact whole-number arithmetic. It starts from the k-th product over a small
fixed set of rows, which is a lower bound of the final one. Positives are one such search; their
products make the windows of the second one, for negatives.

Anchors meet parts in a grid of chunks of anchors by ranges of parts, each pair one task's work. Parts
are numbered in the order of the upper cells and a range is up to ``GROUP`` successive ones. An anchor
goes once to each range that holds an upper cell whose bounds reach one of its windows (the upper levels
are at most ``UPPER`` nodes and are sent to all tasks), with the windows concerned as lists; there its
k-th product is carried from part to part, so a range gives at most k rows a search. Neither vectors of
anchors nor parts are broadcast. Nothing depends on how often a vector occurs.

Defined cases: rows whose id, label or vector is null, or whose vector is empty, of another length
than most, or holds null, NaN or infinite components take no part. Every other row counts, repeated
rows and rows that share an id as well; an anchor's candidates are all rows with another id than its
own, and each anchor row has its own answer. Ties go to the smaller id. An anchor without positives, or
whose windows are empty, gives no rows; an empty table gives none. Products beyond 64 bits are held at
their ends. Other columns of the input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.block_topk import products
from palisade.llm.vectors import as_lists, dimension, matrix, usable
from palisade.session import stored

SCALE = 256
#: Rows of the sample that the upper levels are grown on, upper nodes at most, rows of a part and of a
#: leaf, anchors of a chunk, rows that give each search its first bound.
SAMPLE, UPPER, PART, LEAF, CHUNK, SEED_ROWS = 8192, 512, 2048, 256, 8192, 1024
#: Parts of a range at most, chunks times ranges wanted at least, searches that descend together, rows
#: that anchors become before they are handed on.
GROUP, TILES, TOGETHER, ASKS = 32, 32, 2048, 8192
#: By how much radii shrink from level to level.
SHRINK = 1.4
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def augmented(rows: np.ndarray, largest: float) -> np.ndarray:
    """Rows with one more component, after which all squared norms are ``largest``."""
    rows = rows.astype(np.float64)
    missing = np.sqrt(np.maximum(largest - (rows * rows).sum(axis=1), 0.0))
    return np.concatenate([rows, missing[:, None]], axis=1)


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def cover(points: np.ndarray, radius: float, most: int = 1 << 30) -> tuple[np.ndarray, np.ndarray]:
    """Centres, the first row first, of which each point is within ``radius`` of one and no two are
    within it of each other; and the nearest centre's place for each point. With ``most`` centres the
    radius stays at what they reach: in many dimensions points lie so far apart that each would be a
    centre otherwise."""
    centres, nearest = [0], np.zeros(len(points), np.int64)
    least = _distances(points, points[0])
    while least.max() > radius and len(centres) < most:
        far = int(least.argmax())  # the farthest point, so later centres stay apart
        apart = _distances(points, points[far])
        nearer = apart < least
        nearest[nearer], least[nearer] = len(centres), apart[nearer]
        centres.append(far)
    return np.array(centres), nearest


def grow(points: np.ndarray, leaf: int, most: int = 1 << 30) -> dict[str, np.ndarray]:
    """A cover tree: rows in tree order, and per node its range of rows, centre, radius and children.

    A node has children as long as it has more than ``leaf`` rows that differ and the tree fewer than
    ``most`` nodes; nodes are split level by level. A child's centre is a row of its parent, the first
    child's is the parent's."""
    order = np.arange(len(points))
    begin, end, centre, radius, first, last = [0], [len(points)], [0], [0.0], [0], [0]
    radius[0] = float(_distances(points, points[0]).max()) if len(points) else 0.0
    node = 0
    while node < len(begin):
        inside = order[begin[node] : end[node]].copy()
        reach = radius[node]
        if len(inside) > leaf and reach > 0 and len(begin) < most:
            own = np.flatnonzero(inside == centre[node])[0]
            inside[[0, own]] = inside[[own, 0]]  # nesting: the parent's centre comes first
            chosen, nearest = cover(points[inside], reach / SHRINK, max(4, 2 * len(inside) // leaf))
            if len(begin) + len(chosen) <= most:
                dealt = np.argsort(nearest, kind="stable")
                order[begin[node] : end[node]] = inside[dealt]
                sizes = np.bincount(nearest, minlength=len(chosen))
                first[node], last[node] = len(begin), len(begin) + len(chosen)
                at = begin[node]
                for c, size in zip(inside[chosen].tolist(), sizes.tolist()):
                    begin.append(at)
                    end.append(at + size)
                    centre.append(c)
                    radius.append(float(_distances(points[order[at : at + size]], points[c]).max()))
                    first.append(0)
                    last.append(0)
                    at += size
        node += 1
    return {
        "order": order, "begin": np.array(begin), "end": np.array(end), "centre": np.array(centre),
        "radius": np.array(radius), "first": np.array(first), "last": np.array(last),
    }


def _bounds(asked: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of each query with any row of each node. The last component of a
    query is zero, so centres come without theirs; a part in 10**9 covers rounding."""
    asked, centres = asked.astype(np.float64), centres.astype(np.float64)
    middle = asked @ centres.T
    length = np.sqrt((asked * asked).sum(axis=1))
    width = length[:, None] * radius * (1 + 1e-9)
    width += 1e-9 * length[:, None] * np.sqrt((centres * centres).sum(axis=1)) + 1e-6
    return middle - width, middle + width


def descend(tree: dict, ids, labels, rows, asked, ask_id, ask_label, low, high, same: bool, k: int, of=None):
    """The k best rows of each search in this tree: products and places, worst values where fewer.

    ``low`` and ``high`` are the ends of the windows; ``low`` also holds what is known of the k-th and is
    above the lowest number. ``of`` has the anchor of each search, if these have several. In each turn every
    search opens its best node; searches that open the same one do so together, and those of one anchor
    share their products."""
    of = np.arange(len(asked)) if of is None else of
    count, nodes, order = len(of), len(tree["begin"]), tree["order"]
    top, owner = np.full((count, k), _LOW), np.full((count, k), -1)
    least_score = low.copy()
    opened = np.full((count, nodes), -np.inf)
    least, most = (x[of] for x in _bounds(asked, rows[tree["centre"][:1]], tree["radius"][:1]))
    opened[:, :1] = np.where(least <= high[:, None], most, -np.inf)
    held, held_id, held_label = rows[order], ids[order], labels[order]
    while True:
        best = opened.argmax(axis=1)
        bound = opened[np.arange(count), best]
        # Bounds have a margin for rounding, and ties are opened.
        live = np.flatnonzero((bound > -np.inf) & (bound >= least_score))
        if not len(live):
            return top, owner
        opened[live, best[live]] = -np.inf
        live = live[np.argsort(best[live], kind="stable")]
        cuts = np.flatnonzero(np.diff(best[live])) + 1
        found = []
        for who in np.split(live, cuts):
            node = best[who[0]]
            below = slice(tree["first"][node], tree["last"][node])
            anchor, at = np.unique(of[who], return_inverse=True)
            if below.stop:
                ends = _bounds(asked[anchor], rows[tree["centre"][below]], tree["radius"][below])
                least, most = (x[at] for x in ends)
                opened[who, below] = np.where(
                    (least <= high[who, None]) & (most >= least_score[who, None]), most, -np.inf)
                continue
            leaf = slice(tree["begin"][node], tree["end"][node])
            score = products(asked[anchor], held[leaf])
            other = (held_label[leaf] == ask_label[anchor, None]) != same
            other |= held_id[leaf] == ask_id[anchor, None]
            score[other] = _LOW
            score = score[at]
            row, col = np.nonzero((score >= least_score[who, None]) & (score <= high[who, None]))
            found.append((who[row], order[leaf][col], score[row, col]))
        if found:
            _merge(top, owner, ids, *map(np.concatenate, zip(*found)))
            full = owner[:, -1] >= 0
            least_score[full] = np.maximum(least_score[full], top[full, -1])


def _merge(top: np.ndarray, owner: np.ndarray, ids: np.ndarray, who, place, score) -> None:
    """Takes new rows of some searches into their k best: largest product, then smallest id."""
    changed = np.unique(who)
    row, col = np.nonzero(owner[changed] >= 0)
    who = np.concatenate([who, changed[row]])
    place = np.concatenate([place, owner[changed[row], col]])
    score = np.concatenate([score, top[changed[row], col]])
    order = np.lexsort((ids[place], -np.maximum(score, _LOW + 1), who))
    who, place, score = who[order], place[order], score[order]
    first = np.searchsorted(who, who)
    rank = np.arange(len(who)) - first
    kept = rank < top.shape[1]
    top[changed], owner[changed] = _LOW, -1
    top[who[kept], rank[kept]], owner[who[kept], rank[kept]] = score[kept], place[kept]


def _clean(vectors: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """``id, label, v``: every row that takes part, with ``floor(256 * x)`` of each component."""
    return vectors.where(
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & usable(vector)
    ).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(
            F.col(vector).cast("array<double>"), lambda x: F.floor(x * float(SCALE)).cast("long")
        ).alias("v"),
    )


def _upper(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Centres of the upper levels, grown on a sample drawn by hash, and the largest squared norm."""
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = rows.agg(F.max(squared)).first()[0] or 0.0
    drawn = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toPandas()
    if not len(drawn):
        return np.zeros((0, 0), np.int64), largest
    sample = np.stack(drawn["v"].to_numpy()).astype(np.int64)
    count = rows.count()
    wanted = max(1, min(UPPER, count // PART))
    tree = grow(augmented(sample, largest), max(1, len(sample) // (4 * wanted)), wanted)
    leaves = tree["centre"][tree["first"] == 0]
    return sample[leaves], largest


def _placed(rows: DataFrame, centres: np.ndarray, largest: float) -> DataFrame:
    """Adds ``cell``, the nearest upper centre, and the distance from it."""
    sent = rows.sparkSession.sparkContext.broadcast((centres, largest))  # at most UPPER vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, norm = sent.value
        middle = augmented(middle, norm)
        squared = (middle * middle).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = augmented(matrix(batch.column("v"), np.int64), norm)
            cell = (squared - 2 * (points @ middle.T)).argmin(axis=1)
            apart = np.sqrt(((points - middle[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(apart)],
                names=[*batch.schema.names, "cell", "apart"],
            )

    return rows.mapInArrow(run, "id long, label long, v array<long>, cell long, apart double")


_TREE = ("order", "begin", "end", "centre", "radius", "first", "last")
_PART_SCHEMA = (
    "part long, ids array<long>, labels array<long>, flat array<long>,"
    + ",".join(f"{n} array<{'double' if n == 'radius' else 'long'}>" for n in _TREE)
)


def _grown(largest: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        values = matrix(rows["v"], np.int64)
        tree = grow(augmented(values, largest), LEAF)
        lists = [rows["id"].to_numpy(), rows["label"].to_numpy(), values.reshape(-1), *(tree[n] for n in _TREE)]
        return pa.table(
            [pa.array([k.as_py()], pa.int64()) for k in key]
            + [pa.array([x], pa.list_(pa.float64() if x.dtype == float else pa.int64())) for x in lists],
            names=["part", "ids", "labels", "flat", *_TREE],
        )

    return run


def _ranges(counts: np.ndarray, chunks: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Parts of a range, and the first and the last upper cell of each range; ``counts`` are the parts of
    each cell."""
    cell = np.repeat(np.arange(len(counts)), counts)  # a number per part
    size = max(1, min(GROUP, len(cell) * chunks // TILES))
    begin = np.arange(0, len(cell), size)
    return size, cell[begin], cell[np.minimum(begin + size, len(cell)) - 1]


_WINDOW = ("window", "low", "high")
_ASK_SCHEMA = (
    "row long, id long, label long, v array<long>, window array<long>, low array<long>, high array<long>,"
    "range long"
)


def _searches(anchors: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """Of each window of each anchor: the anchor's place, the window and its ends."""
    window, low, high = (
        c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in map(anchors.column, _WINDOW))
    of = np.repeat(np.arange(len(window)), pc.list_value_length(window).to_numpy())
    return of, *(c.flatten().to_numpy() for c in (window, low, high))


def _asks(searches: DataFrame, upper: tuple, seeds: tuple, spans: tuple, same: bool, k: int) -> DataFrame:
    """One row per anchor and range that one of its searches has to look into, with these searches'
    windows; ``low`` raised to the first bound."""
    sent = searches.sparkSession.sparkContext.broadcast((upper, seeds, spans))  # UPPER and SEED_ROWS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (centres, radius), (seed_id, seed_label, seed), (first, last) = sent.value
        step = max(1, min(512, ASKS // len(first)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                asked = matrix(part.column("v"), np.int64)
                of, window, low, high = _searches(part)
                if len(seed_id) > k:
                    score = products(asked, seed)
                    fits = (seed_label == part.column("label").to_numpy()[:, None]) == same
                    fits &= seed_id != part.column("id").to_numpy()[:, None]
                    score[~fits] = _LOW
                    score = score[of]
                    score[(score < low[:, None]) | (score > high[:, None])] = _LOW
                    low = np.maximum(low, np.partition(score, -k, axis=1)[:, -k])
                least, most = _bounds(asked, centres, radius)
                reached = (most[of] >= low[:, None]) & (least[of] <= high[:, None])
                upto = np.pad(np.cumsum(reached, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
                search, place = np.nonzero(upto[:, last + 1] > upto[:, first])
                dealt = np.lexsort((place, of[search]))
                search, place = search[dealt], place[dealt]
                own = np.flatnonzero(np.diff(of[search] * len(first) + place, prepend=-1))
                ends = pa.array(np.append(own, len(search)), pa.int32())
                out = part.select(["row", "id", "label", "v"]).take(pa.array(of[search[own]]))
                lists = (pa.ListArray.from_arrays(ends, pa.array(x[search])) for x in (window, low, high))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, *lists, pa.array(place[own])], names=[*out.schema.names, *_WINDOW, "range"])

    return searches.select("row", "id", "label", "v", *_WINDOW).mapInArrow(run, _ASK_SCHEMA)


_FOUND = pa.schema([
    ("row", pa.int64()), ("window", pa.int64()), ("found_id", pa.int64()), ("score", pa.int64())])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line: largest product, then smallest id; places without a row have the lowest number."""
    order = np.lexsort((ids, -np.maximum(score, _LOW + 1), score == _LOW), axis=-1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _answer(same: bool, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        anchors = matrix(left["v"], np.int64)
        row, anchor_id, anchor_label = (left[c].to_numpy() for c in ("row", "id", "label"))
        parts = [
            {n: np.asarray(right[n][place].values) for n in ("ids", "labels", "flat", *_TREE)}
            for place in range(right.num_rows)
        ]
        out = []
        of, *searches = _searches(left)
        for begin in range(0, len(of), TOGETHER):
            own, window, low, high = (x[begin : begin + TOGETHER] for x in (of, *searches))
            asked = slice(own[0], own[-1] + 1)  # searches are in the order of anchors
            score, found = np.full((len(own), k), _LOW), np.zeros((len(own), k), np.int64)
            for part in parts:
                rows = part["flat"].reshape(len(part["ids"]), -1)
                top, owner = descend(
                    part, part["ids"], part["labels"], rows, anchors[asked], anchor_id[asked], anchor_label[asked],
                    low, high, same, k, own - own[0])
                score, found = _best(
                    np.concatenate([score, top], axis=1), np.concatenate([found, part["ids"][owner]], axis=1), k)
                low = np.maximum(low, score[:, -1])
            which, col = np.nonzero(score > _LOW)
            out.append(pa.table([row[own[which]], window[which], found[which, col], score[which, col]], schema=_FOUND))
        return pa.concat_tables(out)

    return run


def _search(searches: DataFrame, parts: DataFrame, upper: tuple, seeds: tuple, chunks: int, ranges: tuple,
            same: bool, k: int) -> DataFrame:
    """``row, window, found_id, score, rank`` of the k best of each search."""
    size, *spans = ranges
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk")
    asks = _asks(searches, upper, seeds, spans, same, k).withColumn("chunk", chunk)
    # Two numbers per pair of the grid. Spark can't know how many rows mapInArrow makes, so it is told what to send.
    needed = F.broadcast(asks.select(F.col("range").alias("of_range"), F.col("chunk").alias("of_chunk")).distinct())
    held = parts.withColumn("of_range", F.expr(f"part div {size}")).join(needed, "of_range")
    found = asks.groupBy("range", "chunk").cogroup(held.groupBy("of_range", "of_chunk")).applyInArrow(
        _answer(same, k), "row long, window long, found_id long, score long")
    place = F.row_number().over(Window.partitionBy("row", "window").orderBy(F.desc("score"), "found_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label",
    vector: str = "embedding", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is about ``id``; ``least`` and ``most`` are the percents of the positive's product
    between which a negative's lies."""
    rows = stored(_clean(vectors, vec_id, label, vector), "negatives-rows")
    rows = rows.where(F.size("v") == dimension(rows, "v"))
    centres, largest = _upper(rows)
    if not len(centres):
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    placed = stored(_placed(rows, centres, largest), "negatives-placed")
    # At most UPPER rows.
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("count"), F.max("apart").alias("radius"))
    sizes = cells.toPandas()
    radius = np.zeros(len(centres))
    radius[sizes["cell"]] = sizes["radius"]
    upper = (centres, radius)
    counts = np.zeros(len(centres), np.int64)
    counts[sizes["cell"]] = -(-sizes["count"] // PART)
    # Parts are numbered in the order of their cells.
    numbers = rows.sparkSession.createDataFrame(
        [(c, int(n), int(end - n)) for c, (n, end) in enumerate(zip(counts, np.cumsum(counts)))],
        "cell long, parts long, before long")
    part = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), "parts") + F.col("before")
    dealt = placed.join(F.broadcast(numbers), "cell").select(part.alias("part"), "id", "label", "v")
    # Spark's reader takes thousands of rows of a file at once, and a row is a part here.
    parts = stored(dealt.groupBy("part").applyInArrow(_grown(largest), _PART_SCHEMA), "negatives-parts", GROUP)

    drawn = rows.orderBy(F.xxhash64(F.lit(1), "id", "v"), "id").limit(SEED_ROWS).toPandas()
    seeds = (
        drawn["id"].to_numpy(np.int64), drawn["label"].to_numpy(np.int64),
        np.stack(drawn["v"].to_numpy()).astype(np.int64),
    )
    anchors = stored(rows.where(is_anchor).withColumn("row", F.monotonically_increasing_id()), "negatives-anchors")
    chunks = max(1, -(-anchors.count() // CHUNK))
    ranges = _ranges(counts, chunks)
    nearest = anchors.select("*", *(
        F.array(F.lit(x).cast("long")).alias(n) for n, x in zip(_WINDOW, (0, _LOW + 1, _HIGH))))
    found = stored(_search(nearest, parts, upper, seeds, chunks, ranges, True, positives), "negatives-positives")

    # Ends of the windows in whole numbers, without products that could overflow.
    tens, ones = F.expr("window div 100"), F.expr("window % 100")
    windows = found.select("row", F.col("score").alias("window")).where("window >= 0").select(
        "row", F.struct(
            "window",
            (tens * least + F.ceil(ones * least / 100)).cast("long").alias("low"),
            (tens * most + F.floor(ones * most / 100)).cast("long").alias("high")).alias("w"))
    windows = windows.groupBy("row").agg(F.array_sort(F.collect_set("w")).alias("w"))  # one per positive at most
    windows = anchors.join(windows.hint("merge"), "row").select("*", *(F.col("w")[n].alias(n) for n in _WINDOW))
    wrong = _search(windows, parts, upper, seeds, chunks, ranges, False, negatives)
    right = found.select(
        "row", F.col("score").alias("window"), F.col("found_id").alias("positive_id"))
    return right.hint("merge").join(wrong, ["row", "window"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        F.col("window").alias("positive_score"), F.col("score").alias("negative_score"))
