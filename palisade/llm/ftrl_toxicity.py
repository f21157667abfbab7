"""Toxicity by logistic regression that is trained with FTRL-proximal.

A text is the set of its hashed word n-grams (one to three words), skip-grams (two words with one or
two between them) and word beginnings (five letters, so that compounds of a word share a feature).
Each is there at two levels: it occurs at all, and it makes up at least one in ``DENSE`` words. A
feature counts once however often it occurs, so a long clean text doesn't gather score by its length.
Words are runs of letters and digits in lower case, so marks attached to a word don't hide it;
characters from U+3040 on are words of their own.

FTRL-proximal keeps two numbers per coordinate: ``z``, the gradients with the proximal terms, and
``n``, the squared gradients, from which each coordinate has its own rate. A weight is zero as long
as its ``z`` is within the L1 bound, which is charged per example, so it grows with the examples
seen; it leaves some dozens of weights. The last rounds start again on these features alone and
without the bound, which would otherwise keep their weights small. The model is a short sorted list
of features and weights that is sent to all tasks.

A feature is named by 63 bits of its hash and its level, so features of a large corpus don't share a
weight. Two passes over the sample pick the candidates: the first counts documents of either label in
``2 << BITS`` buckets, the second the features themselves in the buckets that stand out. A feature
stands out if label 1 is so much commoner or rarer among its documents than in the sample that its
first gradient is beyond ``STAND_OUT`` standard deviations; the others would stay within the L1 bound.

Training goes in rounds. The sample is dealt by a hash of the id into ``SHARDS`` shards; in each
round every shard runs the online updates over its rows from the common state and gives back what it
changed, coordinate by coordinate, and these changes are averaged. The sample holds at most
``FIT_TOXIC`` rows of label 1 and ``FIT_CLEAN`` of label 0, those with the smallest hashes of their
id; within it nothing depends on the layout of the table. Everything else covers all rows. What comes
to the driver is a pair of numbers per candidate, at most ``CANDIDATES``.

Defined cases: null and empty texts, and texts without words, get the score of an empty text; a very
long text is scored whole, in chunks of words; a null id is not learned from; several labels for one id
count as 1 if one of them is 1; an id on several documents is learned from once (its smallest text) and
every row is scored; without labels of both kinds the score is their share of 1, or 0 without labels; an
empty table gives an empty result. Columns of the input are kept; a column with the name of an output
column is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import BASE, MIX, codes_of, segment_hashes, slices, with_fields
from palisade.session import stored

#: Rows of each label that the fit uses at most.
FIT_TOXIC, FIT_CLEAN = 6_000, 12_000
#: Scores from here on are predicted 1.
THRESHOLD = 0.5
#: Buckets are numbered by this many bits, one more bit is the level.
BITS = 20
#: Standard deviations from which a feature is a candidate, and how many candidates there are at most.
STAND_OUT, CANDIDATES = 3.5, 1 << 15
#: Distances of the words of each kind of feature, letters of a beginning, and words per occurrence.
GRAMS = ((1,), (1, 2), (2,), (3,))
BEGINNING, DENSE = 5, 100
SHARDS, ROUNDS, REFITS, SEED = 4, 4, 6, 13
#: Rate and its offset; L2; L1 at the start and per example, times the root of all examples.
ALPHA, BETA, L2, L1_START, L1_GROWTH = 1.0, 1.0, 0.1, 2.0, 0.03
#: Bytes of a slice of texts, words whose features are held at once, and buckets of a counted range.
SLICE_BYTES, CHUNK_WORDS, RANGE = 1_000_000, 200_000, 1 << 15
_LEVEL, _BUCKET = np.uint64(1), np.uint64(64 - BITS)

#: From here on each character is a word.
_OWN = 0x3040
_WORD = np.array([chr(c).isalnum() for c in range(_OWN)])
_LOWER = np.array([ord(chr(c).lower()[:1]) for c in range(_OWN)], np.uint32)


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of every word and of its beginning, and the text it is in."""
    codes, size = codes_of([t or "" for t in texts])
    doc = np.repeat(np.arange(len(size)), size)
    small = np.minimum(codes, _OWN - 1)
    own = codes >= _OWN
    inside = own | _WORD[small]
    codes = np.where(own, codes, _LOWER[small])
    begins, ends = inside.copy(), inside.copy()
    if len(codes) > 1:
        apart = own[1:] | own[:-1] | (doc[1:] != doc[:-1]) | ~inside[1:] | ~inside[:-1]
        begins[1:] &= apart
        ends[:-1] &= apart
    at = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - at
    # Both in one call: the running sums behind the hashes are made once.
    both = segment_hashes(
        codes, np.concatenate([at, at]), np.concatenate([length, np.minimum(length, BEGINNING)]))
    return both[: len(at)], both[len(at) :], doc[at]


def _hashes(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all features with repeats, a kind and a chunk of words at a time, and their texts;
    at last the number of words of each text."""
    word, beginning, doc = _words(texts)
    for begin in range(0, len(word), CHUNK_WORDS):
        end = min(begin + CHUNK_WORDS, len(word))
        values = [(word[begin:end], doc[begin:end]), (beginning[begin:end] + MIX, doc[begin:end])]
        for kind, distances in enumerate(GRAMS, 2):
            stop = min(end, len(word) - distances[-1])
            if stop <= begin:
                continue
            value = word[begin:stop] + np.array([kind], np.uint64) * MIX
            for d in distances:
                value = (value ^ (value >> np.uint64(29))) * BASE + word[begin + d : stop + d]
            same = doc[begin:stop] == doc[begin + distances[-1] : stop + distances[-1]]
            values.append((value[same], doc[begin:stop][same]))
        for value, text in values:
            yield ((value ^ (value >> np.uint64(31))) * MIX) & ~_LEVEL, text
    yield np.zeros(0, np.uint64), np.bincount(doc, minlength=len(texts))


def bucket_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and distinct buckets, those of dense features beyond ``1 << BITS``."""
    keys, words = [np.zeros(0, np.int64)], np.zeros(0)
    for value, text in _hashes(texts):
        if len(value):
            keys.append(text << BITS | (value >> _BUCKET).astype(np.int64))
        else:
            words = text
    keys, times = np.unique(np.concatenate(keys), return_counts=True)
    doc, bucket = keys >> BITS, keys & ((1 << BITS) - 1)
    dense = times * DENSE >= words[doc]
    return np.concatenate([doc, doc[dense]]), np.concatenate([bucket, bucket[dense] | 1 << BITS])


def feature_sets(
    texts: list[str | None], wanted: np.ndarray, known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, ascending, distinct features and whether each is dense.

    Only features in ``wanted`` buckets are looked for, and only those in ``known`` if it is given."""
    docs, found, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], np.zeros(0)
    for value, text in _hashes(texts):
        if not len(value):
            words = text
            continue
        hits = np.flatnonzero(wanted[(value >> _BUCKET).astype(np.int64)])
        value, text = value[hits], text[hits]
        if known is not None:
            hits = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
            value, text = value[hits], text[hits]
        docs.append(text)
        found.append(value)
    doc, value = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    doc, value = doc[first], value[first]
    return doc, value, np.diff(first, append=len(new)) * DENSE >= words[doc]


def weights_of(z: np.ndarray, n: np.ndarray, bound: np.ndarray | float) -> np.ndarray:
    """The closed form of the proximal step."""
    pulled = np.sign(z) * np.maximum(np.abs(z) - bound, 0.0)
    return -pulled / ((BETA + np.sqrt(n)) / ALPHA + L2)


def online_pass(
    sets: list[np.ndarray], toxic: np.ndarray, z: np.ndarray, n: np.ndarray, bound: float, growth: float
) -> None:
    """One pass of FTRL-proximal over the examples; changes ``z`` and ``n``, the intercept's last."""
    for features, label in zip(sets, toxic):
        at = np.append(features, len(z) - 1)
        limit = np.full(len(at), bound)
        limit[-1] = 0.0
        weight = weights_of(z[at], n[at], limit)
        chance = 1 / (1 + np.exp(-np.clip(weight.sum(), -35, 35)))
        slope = chance - label
        grown = n[at] + slope * slope
        z[at] += slope - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * weight
        n[at] = grown
        bound += growth


@dataclass
class Model:
    """Features with a weight, ascending, their weights when they occur and what is added when they
    are dense, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def wanted(self) -> np.ndarray:
        out = np.zeros(1 << BITS, bool)
        out[(self.features >> _BUCKET).astype(np.int64)] = True
        return out


def score_texts(texts: list[str | None], model: Model, wanted: np.ndarray) -> np.ndarray:
    """The chance of label 1 of each text."""
    total = np.zeros(len(texts))
    if len(model.features):
        doc, value, dense = feature_sets(texts, wanted, model.features)
        at = np.searchsorted(model.features, value)
        weight = model.weights[at, 0] + np.where(dense, model.weights[at, 1], 0.0)
        total = np.bincount(doc, weight, minlength=len(texts))[: len(texts)]
    return 1 / (1 + np.exp(-np.clip(total + model.intercept, -35, 35)))


def _sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> tuple[DataFrame, float]:
    """At most ``toxic`` and ``clean`` labelled texts with their shards, and the share of label 1."""
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("order", F.xxhash64(F.lit(SEED), "doc_id"))
    )
    counts = marked.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    share = counts[1] / counts[0] if counts[0] else 0.0
    chosen = marked.where("toxic = 1").orderBy("order", "doc_id").limit(toxic).unionByName(
        marked.where("toxic = 0").orderBy("order", "doc_id").limit(clean))
    # At most toxic + clean rows of three numbers; a repeated id gives one text.
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "order", "toxic").agg(F.min("text").alias("text"))
    )
    return texts.withColumn("shard", F.pmod(F.shiftright("order", 17), F.lit(SHARDS)).cast("int")), share


def _stands_out(docs: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """How many standard deviations the share of label 1 is from the sample's; 0 within the L1 start."""
    gradient = np.abs(toxic - docs * share)
    value = gradient / np.sqrt(np.maximum(docs * share * (1 - share), 1e-9))
    return np.where(gradient > L1_START, value, 0.0)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents per bucket, as one row per range of buckets."""
    counts = np.zeros((2, 2 << BITS), np.int32)
    for batch in batches:
        for begin, end in slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(begin, end - begin)
            doc, bucket = bucket_sets(part.column("text").to_pylist())
            toxic = part.column("toxic").to_numpy()[doc] == 1
            counts[0] += np.bincount(bucket, minlength=2 << BITS).astype(np.int32)
            counts[1] += np.bincount(bucket[toxic], minlength=2 << BITS).astype(np.int32)
    for at in range(0, 2 << BITS, RANGE):
        yield pa.RecordBatch.from_arrays(
            [pa.array([at // RANGE]), *(pa.array([zlib.compress(c[at : at + RANGE].tobytes(), 1)]) for c in counts)],
            names=["range", "docs", "toxic"],
        )


def _candidate_buckets(share: float):
    def run(rows: pa.Table) -> pa.Table:
        docs, toxic = (
            sum(np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in rows[c].to_pylist())
            for c in ("docs", "toxic"))
        value = _stands_out(docs, toxic, share)
        found = np.flatnonzero(value >= STAND_OUT)
        return pa.table({"bucket": found + rows["range"][0].as_py() * RANGE, "value": value[found]})

    return run


def _featured(texts: DataFrame, buckets: np.ndarray) -> DataFrame:
    """``order, shard, toxic`` and the features in the candidate buckets; the lowest bit is the level."""
    sent = texts.sparkSession.sparkContext.broadcast(buckets)  # at most CANDIDATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.zeros(2 << BITS, bool)
        chosen[sent.value] = True
        levels = chosen.reshape(2, -1)
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                doc, value, dense = feature_sets(part.column("text").to_pylist(), levels.any(axis=0))
                bucket = (value >> _BUCKET).astype(np.int64)
                present, dense = levels[0][bucket], levels[1][bucket] & dense
                doc = np.concatenate([doc[present], doc[dense]])
                value = np.concatenate([value[present], value[dense] | _LEVEL]).view(np.int64)
                order = np.lexsort((value, doc))
                offsets = np.searchsorted(doc[order], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("order", "shard", "toxic")),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[order]))],
                    names=["order", "shard", "toxic", "features"],
                )

    return texts.select("order", "shard", "toxic", "text").mapInArrow(
        run, "order long, shard int, toxic int, features array<long>")


def _round(sent, bound: float, growth: float):
    """What a shard changes in one pass, for the coordinates that it touches."""

    def run(rows: pa.Table) -> pa.Table:
        z, n, chosen = sent.value
        rows = rows.combine_chunks().sort_by("order")
        sets = []
        for features in rows["features"].to_pylist():
            features = np.asarray(features, np.int64)
            at = np.minimum(np.searchsorted(chosen, features), len(chosen) - 1)
            sets.append(at[chosen[at] == features])
        new_z, new_n = z.copy(), n.copy()
        online_pass(sets, rows["toxic"].to_numpy(), new_z, new_n, bound, growth)
        touched = np.flatnonzero(new_n != n)
        return pa.table({"at": touched, "dz": (new_z - z)[touched], "dn": (new_n - n)[touched]})

    return run


def _rounds(sample: DataFrame, chosen: np.ndarray, count: int, bound: float, growth: float,
            per_shard: float, odds: float) -> np.ndarray:
    """Weights of the ``chosen`` features and the intercept after some rounds from the start, in which
    the intercept is the log odds of label 1."""
    z, n = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    n[-1] = 100.0
    z[-1] = -odds * ((BETA + np.sqrt(n[-1])) / ALPHA + L2)
    for _ in range(count):
        sent = sample.sparkSession.sparkContext.broadcast((z, n, chosen))  # at most 3 * CANDIDATES numbers
        changes = sample.groupBy("shard").applyInArrow(_round(sent, bound, growth), "at long, dz double, dn double")
        # Rounded, so that the order of the additions can't show.
        summed = changes.groupBy("at").agg(
            F.round(F.sum(F.col("dz") / SHARDS), 9).alias("dz"),
            F.round(F.sum(F.col("dn") / SHARDS), 9).alias("dn"),
        ).toPandas()
        sent.destroy()
        z[summed["at"]] += summed["dz"].to_numpy()
        n[summed["at"]] += summed["dn"].to_numpy()
        bound += growth * per_shard
    limit = np.full(len(z), bound)
    limit[-1] = 0.0
    return weights_of(z, n, limit)


def _candidates(texts: DataFrame, share: float) -> tuple[DataFrame, np.ndarray]:
    """The sample with its candidate features, and which these are, ascending."""
    counted = texts.select("text", "toxic").coalesce(2 * SHARDS).mapInArrow(
        _bucket_counts, "range long, docs binary, toxic binary")
    buckets = counted.groupBy("range").applyInArrow(_candidate_buckets(share), "bucket long, value double")
    buckets = buckets.orderBy(F.desc("value"), "bucket").limit(CANDIDATES).toPandas()["bucket"].to_numpy(np.int64)
    sample = stored(_featured(texts, buckets), "toxicity")
    counts = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("toxic").alias("toxic"))
    gradient = F.abs(F.col("toxic") - F.col("docs") * share)
    value = gradient / F.sqrt(F.col("docs") * (share * (1 - share)))
    found = (
        counts.where((gradient > L1_START) & (value >= STAND_OUT))
        .orderBy(value.desc(), "feature").limit(CANDIDATES).toPandas()
    )
    return sample, np.sort(found["feature"].to_numpy(np.int64))


def train(
    docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN
) -> Model:
    """Fits on documents ``doc_id, text`` and labels ``doc_id, toxic`` (both training rows only)."""
    texts, share = _sample(docs, labels, toxic, clean)
    texts = stored(texts.select("order", "shard", "toxic", "text"), "toxicity-texts")
    rows, ones = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chance = min(max(ones / rows if 0 < ones < rows else share, 1e-9), 1 - 1e-9)
    odds = float(np.log(chance / (1 - chance)))
    nothing = Model(np.zeros(0, np.uint64), np.zeros((0, 2)), odds)
    if not 0 < ones < rows:
        return nothing
    sample, chosen = _candidates(texts, chance)
    if not len(chosen):
        return nothing
    first = _rounds(sample, chosen, ROUNDS, L1_START, L1_GROWTH / rows**0.5, rows / SHARDS, odds)
    chosen = chosen[first[:-1] != 0]
    if not len(chosen):
        return nothing
    weight = _rounds(sample, chosen, REFITS, 0.0, 0.0, rows / SHARDS, odds)
    key = chosen.view(np.uint64)
    features = np.unique(key & ~_LEVEL)
    weights = np.zeros((len(features), 2))
    weights[np.searchsorted(features, key & ~_LEVEL), (key & _LEVEL).astype(int)] = weight[:-1]
    return Model(features, weights, float(weight[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` and ``predicted``."""
    made = ("score", "predicted")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some dozens of weights, at most CANDIDATES
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        wanted = fitted.wanted()
        for batch in batches:
            for begin, end in slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                found = score_texts(part.column(at).to_pylist(), fitted, wanted)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.float64()),
                     pa.array((found >= THRESHOLD).astype(np.int32))],
                    names=[*part.schema.names, *made],
                )

    schema = with_fields(docs, score=T.DoubleType(), predicted=T.IntegerType())
    return docs.mapInArrow(run, schema)
