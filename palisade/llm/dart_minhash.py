"""Near-duplicate detection with DartMinHash signatures.

A document is the bag of its runs of five words, each weighing as often as it occurs. Darts with a
hashed weight and a hashed rank are thrown into the plane of every run; a document is hit by those
below the run's weight in it. Per coordinate of the signature the dart of the earliest rank counts,
so two documents agree in a coordinate with the probability of their weighted Jaccard similarity.
The cost is the number of runs plus the number of darts, not their product: ranks are looked at up
to the point where enough darts are expected, and further only while a coordinate is empty.

Candidates share a band of coordinates. They are compared exactly, on all runs (as 32-bit hashes).
Texts with equal word sequences are one node from the start. Within a band's bucket every member is
compared with two others, one after the other; that joins nearly all of what belongs together. Where
a bucket still has members of several components, those outside the largest are compared with all
others, in blocks. So no pair of a bucket is left out unless both are already connected, and a group
of copies costs a few comparisons per member instead of all pairs.

Words are runs of letters and digits in lower case. A text with fewer than five words is one run.
Defined cases: null and wordless texts are equal to each other, so they are one class; rows with a
null id get the class of their text; a class is named by its smallest id (null if it has none);
repeated rows are copies; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import BASE, MIX, codes_of, letter_hashes, powers, segment_hashes, slices
from palisade.llm.components import components
from palisade.session import stored

WORDS, SIMILARITY = 5, 0.8
#: 20 bands of 4: at similarity 0.8 a pair is missed with probability 3e-5.
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
#: Darts expected per document; an empty coordinate is then rare, and looked after.
DARTS = COORDINATES * (np.log(COORDINATES) + 2)
SLICE_BYTES = 1_000_000
#: Ids of documents to compare are sent to all tasks up to so many; beyond, texts are joined by id.
BROADCAST_IDS = 1_000_000
#: Sides of a block in which a bucket's outsiders are compared with its members.
OUTSIDERS, MEMBERS = 256, 2_048
#: Bits of a rank's fraction; the rest is its whole part.
_FRACTION = 40
#: Chances of at most 0, 1, 2, ... darts where one is expected.
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(20)])


@lru_cache(maxsize=1)
def _word_letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in turn, and the number of the text of each."""
    codes, size = codes_of([(t or "").lower() for t in texts])
    doc = np.repeat(np.arange(len(texts)), size)
    inside = _word_letters()[codes]
    edge = np.ones(len(codes), bool)
    edge[1:] = doc[1:] != doc[:-1]
    before = np.zeros(len(codes), bool)
    before[1:] = inside[:-1]
    at = np.flatnonzero(inside & (edge | ~before))
    close = np.ones(len(codes), bool)
    close[:-1] = ~inside[1:] | edge[1:]
    end = np.flatnonzero(inside & close) + 1
    return segment_hashes(codes, at, end - at), doc[at]


def shingles(hashes: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
    """Distinct runs of WORDS words: text number, hash, and how often it occurs there."""
    mixed = letter_hashes(hashes)
    count = np.bincount(doc, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    usual = np.flatnonzero(np.arange(len(doc)) - first[doc] <= count[doc] - WORDS) if len(doc) else first[:0]
    value = np.zeros(len(usual), np.uint64)
    for k in range(WORDS):
        value = value * BASE + mixed[usual + k]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    whole = np.zeros(len(short), np.uint64)
    for k in range(WORDS - 1):
        has = count[short] > k
        whole[has] = whole[has] * BASE + mixed[first[short[has]] + k]
    of, run = np.concatenate([doc[usual], short]), letter_hashes(np.concatenate([value, whole]))
    order = np.lexsort((run, of))
    of, run = of[order], run[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (run[1:] != run[:-1])
    at = np.flatnonzero(new)
    return of[at], run[at], np.diff(at, append=len(of))


def signatures(of: np.ndarray, run: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """COORDINATES earliest ranks per text; texts without runs keep the largest number."""
    total = np.bincount(of, weight, minlength=rows)
    out = np.full((rows, COORDINATES), np.iinfo(np.uint64).max, np.uint64)
    limit = np.zeros(rows)
    limit[total > 0] = DARTS / total[total > 0]
    live = total > 0
    done = np.zeros(rows, np.int64)  # whole ranks already looked at
    while live.any():
        upto = np.ceil(limit).astype(np.int64)
        pick = np.flatnonzero(live[of])
        # One cell per element, whole unit of weight begun, and whole rank up to the limit.
        levels = np.ceil(weight[pick]).astype(np.int64)
        pick = np.repeat(pick, levels)
        level = np.arange(len(pick)) - np.repeat(np.cumsum(levels) - levels, levels)
        span = (upto - done)[of[pick]]
        cell = np.repeat(np.arange(len(pick)), span)
        rank = np.arange(len(cell)) - np.repeat(np.cumsum(span) - span, span) + done[of[pick[cell]]]
        level, pick = level[cell], pick[cell]
        seed = letter_hashes(run[pick] + level.astype(np.uint64) * MIX + rank.astype(np.uint64) * BASE)
        darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)) / 2.0**53, side="right")
        each = np.repeat(np.arange(len(pick)), darts)
        number = np.arange(len(each)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = letter_hashes(seed[each] ^ letter_hashes(number))
        spot = letter_hashes(dart)
        inside = level[each] + (spot >> np.uint64(32)) / 2.0**32 < weight[pick[each]]
        place = (rank[each].astype(np.uint64) << np.uint64(_FRACTION)) | (dart >> np.uint64(64 - _FRACTION))
        early = place / 2.0**_FRACTION < limit[of[pick[each]]]
        ok = inside & early
        coordinate = (spot[ok] & np.uint64(0xFFFFFFFF)) % np.uint64(COORDINATES)
        np.minimum.at(
            out.reshape(-1), of[pick[each[ok]]] * COORDINATES + coordinate.astype(np.int64), place[ok]
        )
        # A limit inside a whole rank is looked at again from that rank's start.
        live &= (out == np.iinfo(np.uint64).max).any(axis=1)
        done[live] = np.floor(limit[live]).astype(np.int64)
        limit[live] *= 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    mixed = letter_hashes(signature).reshape(len(signature), BANDS, ROWS)
    value = (mixed * powers(ROWS)).sum(axis=2, dtype=np.uint64)
    return letter_hashes(value + np.arange(BANDS, dtype=np.uint64) * MIX).view(np.int64)


def _digests(hashes: np.ndarray, doc: np.ndarray, rows: int) -> list[np.ndarray]:
    """Two independent hashes of each text's word sequence."""
    count = np.bincount(doc, minlength=rows)
    has = np.flatnonzero(count)
    at = (np.cumsum(count) - count)[has]
    out = []
    for salt in (np.uint64(1), MIX):
        digest = np.full(rows, salt, np.uint64)
        digest[has] = segment_hashes(letter_hashes(hashes ^ salt) >> np.uint64(1), at, count[has])
        out.append(digest.view(np.int64))
    return out


def _elements(of: np.ndarray, run: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bag as a set: the k-th occurrence of a run is an element of its own, as 32 bits."""
    each = np.repeat(np.arange(len(of)), weight)
    kth = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
    value = letter_hashes(run[each] + kth.astype(np.uint64) * BASE) >> np.uint64(32)
    return of[each], value.astype(np.uint32).view(np.int32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in slices(batch.column(1), SLICE_BYTES):
            part = batch.slice(begin, end - begin)
            hashes, doc = word_hashes(part.column(1).to_pylist())
            rows = part.num_rows
            first, second = _digests(hashes, doc, rows)
            of, run, weight = shingles(hashes, doc, rows)
            found = bands(signatures(of, run, weight, rows))
            total = np.bincount(of, weight, minlength=rows).astype(np.int64)
            offsets = np.arange(rows + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(first), pa.array(second), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))],
                names=["doc_id", "d1", "d2", "n", "bands"],
            )


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in slices(batch.column(1), SLICE_BYTES):
            part = batch.slice(begin, end - begin)
            hashes, doc = word_hashes(part.column(1).to_pylist())
            rows = part.num_rows
            first, second = _digests(hashes, doc, rows)
            of, value = _elements(*shingles(hashes, doc, rows))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(first), pa.array(second),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))],
                names=["doc_id", "d1", "d2", "bag"],
            )


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id`` of every document."""
    docs = docs.select("doc_id", "text")
    signed = stored(
        docs.mapInArrow(_signed, "doc_id long, d1 long, d2 long, n long, bands array<long>"), "dart-signed"
    )
    nodes = stored(
        signed.groupBy("d1", "d2").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")
        ).withColumn("node", F.monotonically_increasing_id()),
        "dart-nodes",
    )
    in_bucket = Window.partitionBy("band").orderBy("node")
    buckets = stored(
        nodes.where("n > 0 and rep is not null").select("node", "n", F.explode("bands").alias("band"))
        .withColumn("more", F.lead("node").over(in_bucket).isNotNull() | F.lag("node").over(in_bucket).isNotNull())
        .where("more").drop("more"),
        "dart-buckets",
    )
    bags = _candidate_bags(docs, nodes, buckets)
    roots = _linked(buckets, bags, similarity)
    known = nodes.join(roots, "node", "left").select(
        "d1", "d2", "rep", F.coalesce("root", "node").alias("root")
    )
    # A class is a root and what hangs on it; only those that are no single node are regrouped.
    names = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = known.join(names, "root").select("d1", "d2", "class_id")
    return signed.select("doc_id", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "class_id")


def _candidate_bags(docs: DataFrame, nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """``node, bag`` of the nodes that share a bucket with another."""
    wanted = stored(
        nodes.join(buckets.select("node").distinct(), "node").select(
            "node", F.col("rep").alias("doc_id"), "d1", "d2"
        ),
        "dart-wanted",
    )
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    bags = docs.join(ids, "doc_id", "left_semi").mapInArrow(
        _bags, "doc_id long, d1 long, d2 long, bag array<int>"
    )
    # Repeated ids are told apart by their text.
    return stored(
        bags.join(wanted, ["doc_id", "d1", "d2"]).groupBy("node").agg(F.first("bag").alias("bag")),
        "dart-bags",
    )


def _linked(buckets: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """``node, root`` of all nodes that are linked to another."""
    roots = None
    # Two stars per bucket, around its first and its last member, join most of what belongs together.
    for order in (F.asc("mixed"), F.desc("mixed")):
        mixed = buckets.withColumn("mixed", F.xxhash64("node", "band"))
        member = Window.partitionBy("band").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        if roots is not None:
            mixed = _unsettled(mixed, roots)
        pairs = mixed.select(
            F.first("node").over(member).alias("a"), F.first("n").over(member).alias("an"),
            F.col("node").alias("b"), F.col("n").alias("bn"),
            *([F.first("root").over(member).alias("ar"), F.col("root").alias("br")] if roots is not None else []),
        ).where("a <> b" if roots is None else "a <> b and ar <> br").drop("ar", "br")
        roots = _merged(roots, _similar(pairs, bags, similarity))
    return _merged(roots, _settled(_unsettled(buckets, roots), bags, similarity))


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    if roots is None:
        return components(links, "dart-components")
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = stored(links, "dart-links")
    return roots if links.isEmpty() else components(known.unionByName(links), "dart-components")


def _unsettled(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets whose members are in several components, with each member's ``root``."""
    placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return placed.join(several.where("low <> high").select("band"), "band")


def _settled(buckets: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links between members of a bucket that are in different components.

    Of two such members one at least is outside the bucket's largest component. So the outsiders are
    compared with all members, in a grid of blocks of both.
    """
    buckets = stored(buckets.select("band", "node", "root"), "dart-unsettled")
    sizes = buckets.groupBy("band", "root").agg(F.count(F.lit(1)).alias("rows"))
    largest = sizes.groupBy("band").agg(
        F.max_by("root", F.struct("rows", "root")).alias("largest"), F.max("rows").alias("most"),
        F.sum("rows").alias("rows"),
    ).select(
        "band", "largest",
        F.ceil((F.col("rows") - F.col("most")) / OUTSIDERS).cast("long").alias("out_blocks"),
        F.ceil(F.col("rows") / MEMBERS).cast("long").alias("blocks"),
    )
    full = stored(buckets.join(largest, "band").join(bags, "node"), "dart-unsettled-bags")

    def all_of(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    spread = F.xxhash64("node", F.lit(1))
    outside = (
        full.where("root <> largest")
        .withColumn("out_block", F.pmod(spread, F.col("out_blocks"))).withColumn("block", all_of("blocks"))
    )
    inside = (
        full.withColumn("block", F.pmod(spread, F.col("blocks"))).withColumn("out_block", all_of("out_blocks"))
    )
    keys, values = ["band", "out_block", "block"], ["node", "root", "bag"]
    return (
        outside.select(*keys, *values).groupBy(*keys)
        .cogroup(inside.select(*keys, *values).groupBy(*keys))
        .applyInArrow(_compare(similarity), "a long, b long").distinct()
    )


def _compare(similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each row of left with all rows of right; one link per component of right will do."""
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        bags = right["bag"].combine_chunks()
        sizes = pc.list_value_length(bags).to_numpy()
        starts = np.cumsum(sizes) - sizes
        kinds, flat = np.unique(bags.flatten().to_numpy(), return_inverse=True)
        node, root = right["node"].to_numpy(), right["root"].to_numpy()
        marked = np.zeros(len(kinds) + 1, np.int32)
        a, b = [], []
        rows = zip(left["node"].to_numpy(), left["root"].to_numpy(), left["bag"].combine_chunks())
        for own, own_root, bag in rows:
            bag = bag.values.to_numpy()
            at = np.searchsorted(kinds, bag)
            at = at[(at < len(kinds)) & (kinds[np.minimum(at, len(kinds) - 1)] == bag)]
            marked[at] = 1
            common = np.add.reduceat(marked[flat], starts)
            marked[at] = 0
            ok = (common >= similarity * (len(bag) + sizes - common)) & (root != own_root)
            hits = np.flatnonzero(ok)
            hits = hits[np.unique(root[hits], return_index=True)[1]]
            a.append(np.full(len(hits), own))
            b.append(node[hits])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    return compare


def _similar(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` with a weighted Jaccard similarity of ``similarity`` or more."""
    pairs = (
        pairs.where(F.least("an", "bn") >= F.greatest("an", "bn") * similarity)
        .select("a", "b").distinct()
    )
    size = F.size(F.array_intersect("bag_a", "bag_b"))
    return (
        pairs.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
        .join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
        .where(size >= similarity * (F.size("bag_a") + F.size("bag_b") - size))
        .select("a", "b")
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the smallest id; rows keep their columns.

    Rows with a null id stay, as nothing can name them.
    """
    found = stored(classes(docs, similarity), "dart-classes")
    counted = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max((F.col("doc_id") == F.col("class_id")).cast("int")).alias("keeps")
    )
    gone = stored(
        counted.where("doc_id is not null and (keeps = 0 or keeps is null or rows > 1)").select("doc_id", "keeps"), "dart-gone"
    )
    few = gone.count() <= BROADCAST_IDS
    single = docs.join(F.broadcast(gone.select("doc_id")) if few else gone.select("doc_id"), "doc_id", "left_anti")
    again = gone.where("keeps = 1").select("doc_id")
    if again.isEmpty():
        return single.select(*docs.columns)
    # Ids on several rows: one row of a class's first id stays.
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    repeated = docs.join(F.broadcast(again) if few else again, "doc_id", "left_semi")
    repeated = repeated.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")
    return single.select(*docs.columns).unionByName(repeated.select(*docs.columns))
