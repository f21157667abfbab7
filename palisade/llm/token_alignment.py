"""Which tokens of two tokenizers cover the same bytes of a text, and how often over the corpus.

A is a byte-level BPE of the ``tokenizers`` library over blank + text, B a SentencePiece model over
the text (it adds the blank itself). Both sequences of tokens tile the same bytes, so each token is an
interval of bytes, and groups come from interval coalescing: all A and B intervals are sorted by
their start, the ends are accumulated to a running maximum, and a group breaks where a start reaches
that maximum. Within a group every A token overlaps the same stretch as every B token; all A-B pairs
of it are links, spelled out by distinct ids with their multiplicity, so a long run without a common
border costs the product of its different tokens, not of its occurrences.

Neither tokenizer joins bytes across a single blank between two visible characters, so a text falls
into segments there, and a worker aligns a segment once and keeps the result (``KEPT_BYTES`` bound
that memory; it starts anew beyond). Everything of a document is a sum
over its segments, or their groups in turn.

Counts: the first pass writes each document's distinct pairs; exploded and counted with a partial
aggregation they give every pair's number of documents, and its largest value per A token. The second
pass joins the counts back. The ``COMMON`` most frequent pairs, a fixed number, are broadcast, which
takes every hot pair out of the shuffle; all other pairs are joined by shuffling.

Defined cases: null and empty texts, and texts whose A or B tokens don't spell blank + text (as the
mark U+2581 in a text does), have no tokens: zeros and an empty digest. Strings of special tokens in
a text are plain text. Very long texts are taken whole. Rows are separate documents, also with equal
ids, null ids or equal texts; ties of the largest count all count as best. An empty table gives an
empty result. Other columns of the input are not used.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import slices
from palisade.session import stored

#: Fixed value: the splitter of byte-level vocabularies.
SPLITTER = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pair of ids is one number: A << SHIFT | B.
SHIFT = 20
#: Pairs whose counts are broadcast (16 bytes each).
COMMON = 1 << 19
#: Bytes of a slice of texts, and of the results that a worker keeps.
SLICE_BYTES, KEPT_BYTES = 500_000, 128 << 20

#: Before a blank between two characters that no reader takes for white space. Both tokenizers cut here.
_CUT = re.compile(r"(?<=[^\s▁])(?= [^\s▁])")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: visible Latin-1 letters stand
    for themselves, the other bytes take the letters from U+0100 on in turn."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The group of each interval; the intervals come sorted by start."""
    reached = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] >= reached[:-1]
    return np.cumsum(new) - 1


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    first = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return first, np.diff(first, append=len(sorted_keys))


def group_links(group: np.ndarray, ids: np.ndarray, is_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs of each group: group, A id, B id, and how many links they stand for."""
    sides = []
    for side in (~is_b, is_b):
        key = np.sort(group[side] << 32 | ids[side])
        first, times = _runs(key)
        sides.append((key[first] >> 32, key[first] & 0xFFFFFFFF, times))
    (group_a, a, times_a), (group_b, b, times_b) = sides
    # Every A entry meets the entries of B in its group, which stand side by side.
    begin = np.searchsorted(group_b, group_a)
    width = np.searchsorted(group_b, group_a, side="right") - begin
    left = np.repeat(np.arange(len(a)), width)
    right = np.repeat(begin - np.cumsum(width) + width, width) + np.arange(width.sum())
    return group_a[left], a[left], b[right], times_a[left] * times_b[right]


def merged(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (owner, pair), ascending, with their times added up. Fewer than 2**22 owners."""
    key = owner << 2 * SHIFT | pair
    order = np.argsort(key)
    key, times = key[order], times[order]
    first, _ = _runs(key)
    times = np.add.reduceat(times, first) if len(first) else times
    return key[first] >> 2 * SHIFT, key[first] & ((1 << 2 * SHIFT) - 1), times


class Aligner:
    """Aligns texts in a worker; short segments met before are remembered."""

    def __init__(self, path_a: str, path_b: str, kept_bytes: int = KEPT_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters, size = byte_letters(), self.a.get_vocab_size()
        spelled = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [
            bytes(map(letters.__getitem__, spelled[i])) if set(spelled.get(i, "?é\0")) <= letters.keys()
            else spelled.get(i, "").encode() for i in range(size)
        ]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.ranked = _ranked(path_a, self.bytes_a)
        self.kept_bytes = kept_bytes
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.shown: list[str] = []
        # Per segment: A tokens, B tokens, groups, links, distinct pairs, and whether it counts.
        self.numbers = np.zeros((1024, 6), np.int64)
        self.begin = np.zeros(1024, np.int64)
        self.pairs, self.times = np.zeros(4096, np.int64), np.zeros(4096, np.int64)
        self.filled, self.held = 0, 0

    def _room(self, name: str, needed: int) -> np.ndarray:
        old = getattr(self, name)
        if needed > len(old):
            grown = np.zeros((max(needed, 2 * len(old)), *old.shape[1:]), old.dtype)
            grown[: len(old)] = old
            setattr(self, name, grown)
        return getattr(self, name)

    def learn(self, segments: list[str]) -> None:
        """Aligns new segments, all in one set of arrays, and files the results."""
        if self.ranked:
            ids_a = list(map(self.ranked.encode_ordinary, segments))
        else:
            ids_a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] for s in segments], num_threads=1)
        good = self._spelled(segments, ids_a, ids_b)
        for k in np.flatnonzero(~good):
            ids_a[k], ids_b[k] = [], []
        count = len(segments)
        n_a = np.fromiter(map(len, ids_a), np.int64, count)
        n_b = np.fromiter(map(len, ids_b), np.int64, count)
        ids = np.fromiter(chain(chain.from_iterable(ids_a), chain.from_iterable(ids_b)), np.int64)
        is_b = np.arange(len(ids)) >= n_a.sum()
        size = np.where(is_b, self.size_b[np.where(is_b, ids, 0)], self.size_a[np.where(is_b, 0, ids)])
        owner = np.concatenate([np.repeat(np.arange(count), n_a), np.repeat(np.arange(count), n_b)])
        # Both sides tile the same bytes of all good segments one after the other.
        end = np.concatenate([np.cumsum(size[~is_b]), np.cumsum(size[is_b])])
        start = end - size
        order = np.argsort(start << 1 | is_b, kind="stable")  # by start, A first
        ids, is_b, owner = ids[order], is_b[order], owner[order]
        group = coalesce(start[order], end[order])
        owner_of = owner[np.flatnonzero(np.diff(group, prepend=-1))]
        of, a, b, times = group_links(group, ids, is_b)
        of = owner_of[of] if len(of) else of
        links = np.bincount(of, times, minlength=count).astype(np.int64)
        # A pair may link in several groups of a segment.
        of, pair, times = merged(of, a << SHIFT | b, times)
        distinct = np.bincount(of, minlength=count)
        have = len(self.shown)
        numbers, begin = self._room("numbers", have + count), self._room("begin", have + count)
        numbers[have : have + count] = np.stack(
            [n_a, n_b, np.bincount(owner_of, minlength=count), links, distinct, good], axis=1)
        begin[have : have + count] = self.filled + np.cumsum(distinct) - distinct
        stop = self.filled + len(pair)
        self._room("pairs", stop)[self.filled : stop] = pair
        self._room("times", stop)[self.filled : stop] = times
        self.filled = stop
        self.shown += _shown(group, ids, is_b, owner_of, count)
        self.place.update(zip(segments, range(have, have + count)))
        self.held += sum(map(len, segments)) + 200 * count + 16 * len(pair)

    def _spelled(self, segments: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> np.ndarray:
        """Whether the tokens of both sides spell each segment."""
        raw = [s.encode() for s in segments]
        return np.array([
            spell(map(bytes_a, a)) == r and spell(map(bytes_b, b)) == r
            for spell, bytes_a, bytes_b in [(b"".join, self.bytes_a.__getitem__, self.bytes_b.__getitem__)]
            for a, b, r in zip(ids_a, ids_b, raw)
        ], bool)

    def texts(self, texts: list[str | None]) -> list[np.ndarray | list]:
        """Per text: A tokens, B tokens, groups, links, digest, its distinct pairs and their links."""
        cut = [_CUT.split(f" {t}") if t else [] for t in texts]
        if self.held > self.kept_bytes:
            self.forget()
        new = [s for s in set(chain.from_iterable(cut)) if s not in self.place]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64)
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(texts)))
        bad = np.zeros(len(texts), bool)
        bad[doc[self.numbers[at, 5] == 0]] = True
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        sums = [
            np.bincount(doc, self.numbers[at, k], minlength=len(texts)).astype(np.int64) for k in range(4)
        ]
        cuts = np.searchsorted(doc, np.arange(1, len(texts)))
        digests = [
            hashlib.sha256(";".join(map(self.shown.__getitem__, part)).encode()).hexdigest() if len(part) else ""
            for part in np.split(at, cuts)
        ][: len(texts)]
        # Distinct segments of a text first, then distinct pairs.
        key, count = np.unique(doc << 32 | at, return_counts=True)
        doc, at = key >> 32, key & 0xFFFFFFFF
        width = self.numbers[at, 4]
        which = np.repeat(self.begin[at] - np.cumsum(width) + width, width) + np.arange(width.sum())
        doc, pair, times = np.repeat(doc, width), self.pairs[which], self.times[which] * np.repeat(count, width)
        doc, pair, times = merged(doc, pair, times)
        offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
        return [*sums, digests, _lists(pair, offsets), _lists(times, offsets)]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _shown(group, ids, is_b, owner_of, count: int) -> list[str]:
    """``a1,a2|b1`` of the groups of each segment, joined by semicolons."""
    out = [""] * count
    if not len(group):
        return out
    order = np.argsort(group << 1 | is_b, kind="stable")  # A before B, both in turn
    group, side, owner = group[order], is_b[order], owner_of[group[order]]
    # What follows each token: another one of its side, the other side, a group, or a segment.
    after = np.full(len(group), 3)
    after[:-1] = np.where(
        owner[1:] != owner[:-1], 3, np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
    parts = [""] * (2 * len(group))
    parts[::2] = map(str, ids[order].tolist())
    parts[1::2] = map(",|;\n".__getitem__, after.tolist())
    for k, text in zip(owner[after == 3].tolist(), "".join(parts).split("\n")):
        out[k] = text
    return out


def _ranked(path: str, spelled: list[bytes]):
    """The same encoder in the ``tiktoken`` library, which takes ranks for merges and is faster on short
    texts. None where the file isn't that: its ids have to be single bytes first, then what its merges
    make, in turn, and its splitter the usual one."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splitter = spec["model"], spec["pre_tokenizer"] or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    letters = byte_letters()
    made = [bytes(letters[c] for c in a + b) if set(a + b) <= letters.keys() else None for a, b in merges]
    usual = (
        model["type"] == "BPE" and spec["normalizer"] is None and splitter.get("type") == "ByteLevel"
        and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
        and not model.get("dropout") and spelled[256 : 256 + len(made)] == made
        and sorted(spelled[:256]) == [bytes([b]) for b in range(256)]
    )
    if not usual:
        return None
    ranks = {t: i for i, t in enumerate(spelled[: 256 + len(made)])}
    return tiktoken.Encoding("aligned", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner; it outlives a task."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs``: its numbers, digest, distinct ``pairs`` and the ``times`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for begin, end in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, aligner.texts(part.column(1).to_pylist()))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        " pairs array<long>, times array<long>",
    )


def align(docs: DataFrame, path_a: str, path_b: str, common: int = COMMON) -> DataFrame:
    """One row per document with its alignment and what the corpus says of its links."""
    rows = stored(
        aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = stored(
        rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")),
        "pair-counts",
    )
    # One row per A token that occurs, so at most its vocabulary.
    best = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("docs").alias("best"))
    known = counts.withColumn("a", F.shiftright("pair", SHIFT)).join(F.broadcast(best), "a").select(
        "pair", "docs", (F.col("docs") == F.col("best")).alias("is_best"))
    frequent = known.orderBy(F.desc("docs"), "pair").limit(common)
    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = (
        F.sum(F.col("times") * F.col("docs")).alias("count_sum"),
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
    )
    # Frequent pairs on the map side; the others have fewer documents than each of these.
    hot = linked.join(F.broadcast(frequent), "pair").groupBy("row").agg(*sums)
    rest = known.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
    cold = linked.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rest, "pair")
    total = hot.unionByName(cold.groupBy("row").agg(*sums)).groupBy("row").agg(
        F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("long")
    return rows.join(total, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
