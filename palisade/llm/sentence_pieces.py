"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut wherever two characters stand side by side in no piece, so before blanks as well; no
piece reaches across such a cut. The lattice of a segment has an edge for every substring that is a
piece: all substrings up to the longest piece are spelled out as hashes and equi-joined to the table
of pieces, and the edges are grouped by segment and end position and folded from left to right.

Two folds, as there are two kinds of model:

* unigram model: an edge extends the best sum of scores (Viterbi); on a tie the longer piece wins.
* merge model (``BPE``): sums of its scores, which are merge ranks, would give other ids than the
  model does. Here an edge extends a prefix exactly if merging would leave the prefix's last piece
  and the edge's piece side by side; then just one path reaches each position, and it is the one
  that merging gives. Whether two pieces stay apart is found by undoing their merges along the
  common border, and is kept per pair.

Characters without a piece become byte pieces. ``encode`` works in Arrow batches: new segments of a
slice of texts form one set of arrays, so memory is bounded by the slice, nothing is shuffled,
and only the piece table (as large as the model) is sent to tasks. ``encode_words`` is the same
lattice as a DataFrame plan, with explode, join, groupBy and the higher-order ``aggregate``, for
tables of words and unigram models.

Defined cases: a null text gives null ids, an empty one no ids; a text of blanks only is encoded as
runs of blanks; decoding gives the text back except that the mark U+2581 comes back as a blank.
Columns of the input are kept; a column with the name of an output column is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import BASE, letter_hashes, powers, segment_hashes, slices, with_fields

#: Fixed values of the format: the mark for a blank, kinds of pieces and of models.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: An unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bytes per slice of texts, characters of new segments whose lattice is held at once, and segments
#: (about 50 bytes each) that a worker remembers.
SLICE_BYTES = 1_000_000
LATTICE_CHARACTERS = 32_000
KEPT_SEGMENTS = 400_000

@dataclass
class Pieces:
    """A model's pieces as arrays indexed by id; ``left``/``right``: what a piece was merged from."""

    kind: int
    text: list[str]
    score: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def longest(self) -> int:
        return max((len(t) for t, n in zip(self.text, self.normal) if n), default=1)


def load_pieces(path: str, kind: int | None = None) -> Pieces:
    """Reads a model file (on the driver)."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return pieces_of(
        [(p.piece, p.score, p.type) for p in model.pieces], kind or model.trainer_spec.model_type
    )


def pieces_of(rows: list[tuple[str, float, int]], kind: int) -> Pieces:
    text = [r[0] for r in rows]
    score = np.array([r[1] for r in rows], np.float64)
    types = np.array([r[2] for r in rows])
    normal = np.isin(types, (NORMAL, USER))
    byte_ids = np.full(256, -1, np.int32)
    for i in np.flatnonzero(types == BYTE):
        byte_ids[int(text[i][1:-1], 16)] = i
    size = len(rows)
    rank = np.full(size, -1, np.int64)
    own = np.arange(size, dtype=np.int32)
    pieces = Pieces(kind, text, score, normal, byte_ids, rank, own.copy(), own.copy())
    if kind == BPE:
        merged = [i for i in np.flatnonzero(normal) if len(text[i]) > 1]
        merged.sort(key=lambda i: (-score[i], i))
        rank[merged] = np.arange(len(merged))
        ids = {text[i]: int(i) for i in np.flatnonzero(normal)}
        for i in merged:
            parts = _last_merge(text[i], ids, rank)
            if parts is None:
                pieces.normal[i] = False  # merging never makes this piece
            else:
                pieces.left[i], pieces.right[i] = parts
    return pieces


def _last_merge(word: str, ids: dict[str, int], rank: np.ndarray) -> tuple[int, int] | None:
    parts = list(word)
    while len(parts) > 2:
        options = [
            (rank[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids
        ]
        if not options:
            return None
        _, k = min(options)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    known = len(parts) == 2 and all(p in ids for p in parts)
    return (ids[parts[0]], ids[parts[1]]) if known else None


class _Lookup:
    """Piece ids by 64-bit hash of their characters, and the pairs of characters inside pieces."""

    BITS = 20

    def __init__(self, pieces: Pieces) -> None:
        self.hash = np.zeros(len(pieces.text), np.uint64)
        self.length = np.array([len(t) for t in pieces.text], np.int64)
        self.power = powers(pieces.longest + 1)
        ids = np.flatnonzero(pieces.normal)
        self.inside = np.zeros(1 << 22, bool)
        for i in ids:
            codes = np.array([ord(c) for c in pieces.text[i]], np.uint64)
            with np.errstate(over="ignore"):
                self.hash[i] = (letter_hashes(codes) * self.power[: len(codes)][::-1]).sum(dtype=np.uint64)
            self.inside[_pair(codes[:-1], codes[1:])] = True
        order = ids[np.argsort(self.hash[ids], kind="stable")]
        self.ids, self.sorted = order.astype(np.int32), self.hash[order]
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        self.slots[self._slot(self.sorted)] = self.ids

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = self.slots[self._slot(hashes)]
        # A slot that another piece took: look the hash up in the sorted list.
        odd = np.flatnonzero((out >= 0) & (self.hash[out] != hashes))
        if len(odd):
            wanted = hashes[odd]
            at = np.minimum(np.searchsorted(self.sorted, wanted), len(self.sorted) - 1)
            out[odd] = np.where(self.sorted[at] == wanted, self.ids[at], -1)
        return out


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Slot of a pair of characters; another pair in the same slot only costs a cut."""
    with np.errstate(over="ignore"):
        mixed = (first.astype(np.uint64) << np.uint64(21) | second.astype(np.uint64)) * BASE
    return (mixed >> np.uint64(42)).astype(np.int64)


class _Apart:
    """Whether merging leaves two pieces side by side; remembers pairs."""

    BITS = 21

    def __init__(self, pieces: Pieces, lookup: _Lookup) -> None:
        self.p, self.lookup = pieces, lookup
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.values = np.zeros(1 << self.BITS, bool)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first.astype(np.int64) << 32 | second
        with np.errstate(over="ignore"):
            slot = ((key.astype(np.uint64) * BASE) >> np.uint64(64 - self.BITS)).astype(np.int64)
        known = self.keys[slot] == key
        out = self.values[slot]
        new = np.flatnonzero(~known)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            found = self._settle((pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32))
            out[new] = found[back]
            self.keys[slot[new]], self.values[slot[new]] = key[new], out[new]
        return out

    def _settle(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later merge of the two at their border; a border pair that would have merged
        before that merge shows that they don't stay apart."""
        p, look = self.p, self.lookup
        apart = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            with np.errstate(over="ignore"):
                joined = look(look.hash[x] * look.power[look.length[y]] + look.hash[y])
            merges = (joined >= 0) & (p.rank[joined] < limit[live])
            apart[live[merges]] = False
            rx, ry = p.rank[x], p.rank[y]
            undo_left = rx > ry
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, p.right[x], x)
            b[live] = np.where(undo_left, y, p.left[y])
            live = live[~merges & ((rx >= 0) | (ry >= 0))]
        return apart


class Encoder:
    """Encodes texts in a worker; segments met before are remembered by hash."""

    def __init__(self, pieces: Pieces, kept: int = KEPT_SEGMENTS) -> None:
        self.p, self.lookup, self.kept = pieces, _Lookup(pieces), kept
        self.apart = _Apart(pieces, self.lookup)
        self.longest = pieces.longest
        scores = pieces.score[pieces.normal]
        self.unknown_score = (scores.min() if len(scores) else 0.0) - UNKNOWN_PENALTY
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def segments(self, codes: np.ndarray, size: np.ndarray, at: np.ndarray):
        """Ids of the segments ``codes[at : at + size]``: all ids in turn, and each one's count."""
        order = np.argsort(-size, kind="stable")
        size, at = size[order], at[order]
        starts = np.concatenate([[0], np.cumsum(size)])
        codes = codes[np.repeat(at - starts[:-1], size) + np.arange(starts[-1])]
        piece = self._edges(codes, size, starts)
        back = self._fold(piece, size, starts[:-1])
        return self._ids(back, piece, codes, size, starts[:-1], order)

    def _edges(self, codes: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """piece[n - 1, i]: the piece of the n characters from i on, or -1."""
        total = len(codes)
        piece = np.full((self.longest, total), -1, np.int32)
        room = np.repeat(starts[1:], size) - np.arange(total)  # characters to the word's end
        letters = letter_hashes(codes.astype(np.uint64))
        at = np.arange(total)
        value = np.zeros(total, np.uint64)
        with np.errstate(over="ignore"):
            for n in range(self.longest):
                keep = room[at] > n
                at, value = at[keep], value[keep]
                if not len(at):
                    break
                value = value * BASE + letters[at + n]
                piece[n, at] = self.lookup(value)
        return piece

    def _fold(self, piece: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Length of the last edge of the path to each position after its word's first character."""
        total = piece.shape[1]
        back = np.zeros(total, np.int16)
        last = np.full(total, -1, np.int32)  # piece that ends here; -1 for an unknown character
        best = np.zeros(total)
        merge = self.p.kind == BPE
        steps = np.arange(self.longest)
        longest_word = int(size[0]) if len(size) else 0
        # Words are in order of falling length, so those that reach position j are a prefix.
        reach = np.searchsorted(-size, -np.arange(1, longest_word + 1), side="right")
        for j in range(1, longest_word + 1):
            words = starts[: reach[j - 1]]
            width = min(j, self.longest)
            begin = words[:, None] + (j - 1 - steps[None, :width])
            found = piece[steps[:width], begin]
            row, col = np.nonzero(found >= 0)
            p, n = found[row, col], col + 1
            end = words + (j - 1)
            back[end], last[end] = 1, np.where(found[:, 0] >= 0, found[:, 0], -1)
            inner = n < j
            before = words[row] + (j - n - 1)
            if merge:
                ok = np.ones(len(p), bool)
                check = np.flatnonzero(inner)
                prev = last[before[check]]
                known = prev >= 0
                ok[check[known]] = self.apart(prev[known], p[check[known]])
                row, p, n = row[ok], p[ok], n[ok]
                back[end[row]], last[end[row]] = n, p
            else:
                score = self.p.score[p] + np.where(inner, best[np.where(inner, before, 0)], 0.0)
                single = np.where(
                    found[:, 0] >= 0, -np.inf,
                    self.unknown_score + (best[end - 1] if j > 1 else 0.0),
                )
                ordered = np.lexsort((-n, -score, row))
                row, p, n, score = row[ordered], p[ordered], n[ordered], score[ordered]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                top = np.full(len(words), -np.inf)
                top[row[first]] = score[first]
                use = first[score[first] >= single[row[first]]]
                back[end[row[use]]], last[end[row[use]]] = n[use], p[use]
                best[end] = np.maximum(top, single)
        return back

    def _ids(self, back, piece, codes, size, starts, order) -> tuple[np.ndarray, np.ndarray]:
        """Walks back from the ends; unknown characters become the bytes of their UTF-8 form."""
        words, ids, ends = [], [], []
        live, end = np.arange(len(size)), size.copy()
        live = live[size > 0]
        while len(live):
            tail = starts[live] + end[live] - 1
            n = back[tail].astype(np.int64)
            found = piece[n - 1, tail - n + 1]
            words.append(live)
            ids.append(np.where(found >= 0, found, -1 - codes[tail].astype(np.int64)))
            ends.append(end[live])
            end[live] -= n
            live = live[end[live] > 0]
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        words, ids, ends = map(np.concatenate, (words, ids, ends))
        words = order[words]
        placed = np.lexsort((ends, words))
        words, ids = words[placed], ids[placed]
        if (ids < 0).any():
            words, ids = self._with_bytes(words, ids)
        return ids.astype(np.int32), np.bincount(words, minlength=len(size))

    def _with_bytes(self, words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = -1 - ids
        unknown = ids < 0
        long = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        times = np.where(unknown, long, 1)
        out, owner = np.repeat(ids, times), np.repeat(words, times)
        starts = np.concatenate([[0], np.cumsum(times)[:-1]])
        for at in np.flatnonzero(unknown):
            raw = chr(code[at]).encode("utf-8", "surrogatepass")
            out[starts[at] : starts[at] + len(raw)] = self.p.byte_ids[list(raw)]
        return owner, out

    def texts(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null stays null."""
        marked = [BLANK + t if t else "" for t in texts.to_pylist()]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").copy()
        codes[codes == 32] = ord(BLANK)
        if not len(codes):
            offsets = pa.array(np.zeros(len(texts) + 1), pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array([], pa.int32()), mask=texts.is_null())
        # No piece holds the two characters at a cut, so none reaches across.
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.lookup.inside[_pair(codes[:-1], codes[1:])]
        ends = np.cumsum(sizes)
        cut[ends[ends < len(codes)]] = True
        at = np.flatnonzero(cut)
        size = np.diff(at, append=len(codes))
        hashes = segment_hashes(codes, at, size)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        begin, count = self._remembered(unique, codes, size[first], at[first])

        begin, count = begin[back], count[back]
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.store[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        offsets = total[np.searchsorted(at, np.concatenate([[0], ends]))]
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(flat), mask=texts.is_null()
        )

    def _remembered(self, unique, codes, size, at) -> tuple[np.ndarray, np.ndarray]:
        """Where in the store the ids of each segment begin, and how many they are."""
        if len(self.known) > self.kept:
            self._forget()
        place = np.searchsorted(self.known, unique)
        old = np.zeros(len(unique), bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == unique[inside]
        new = np.flatnonzero(~old)
        if len(new):
            parts = [self.segments(codes, size[part], at[part]) for part in _portions(new, size[new])]
            count = np.concatenate([c for _, c in parts])
            begin = len(self.store) + np.cumsum(count) - count
            self.store = np.concatenate([self.store, *(ids for ids, _ in parts)])
            where = place[new]
            self.known = np.insert(self.known, where, unique[new])
            self.begin = np.insert(self.begin, where, begin)
            self.count = np.insert(self.count, where, count)
            place = np.searchsorted(self.known, unique)
        return self.begin[place], self.count[place]


def _portions(which: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """``which`` in portions of about LATTICE_CHARACTERS; a longer segment is one of its own."""
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // LATTICE_CHARACTERS)) + 1
    return np.split(which, cuts)


_ENCODERS: dict[str, Encoder] = {}


def _worker_encoder(key: str, sent) -> Encoder:
    """The worker's encoder for a broadcast model; it outlives a task."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(sent.value)
    return _ENCODERS[key]


def encode(
    docs: DataFrame, pieces: Pieces, text: str = "text", to: str = "ids"
) -> DataFrame:
    """Adds the piece ids of ``text`` as the column ``to``."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == to.lower()])
    sent = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the model
    at, key = docs.columns.index(text), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(key, sent)
        for batch in batches:
            for begin, end in slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                ids = encoder.texts(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, to])

    return docs.mapInArrow(run, with_fields(docs, **{to: T.ArrayType(T.IntegerType())}))


def _spellings(pieces: Pieces) -> list[bytes]:
    """What each id stands for; a byte piece for its byte."""
    raw = [t.encode() for t in pieces.text]
    for value, i in enumerate(pieces.byte_ids):
        if i >= 0:
            raw[i] = bytes([value])
    return raw


def _decoded(lists: pa.ListArray, spellings: pa.Array) -> pa.Array:
    """The texts that lists of ids stand for; null for null."""
    flat = spellings.take(lists.flatten())
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    whole = pc.binary_join(pa.ListArray.from_arrays(offsets, flat), b"")
    text = pc.replace_substring(whole.cast(pa.string()), BLANK, " ")
    text = pc.replace_substring_regex(text, r"\A ", "")  # the blank put before every text
    return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), text)


def decode(docs: DataFrame, pieces: Pieces, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for as the column ``to``; null for null."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == to.lower()])
    sent = docs.sparkSession.sparkContext.broadcast(_spellings(pieces))
    at = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings = pa.array(sent.value, pa.binary())
        for batch in batches:
            text = _decoded(batch.column(at), spellings)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, with_fields(docs, **{to: T.StringType()}))


def encode_and_decode(
    docs: DataFrame, pieces: Pieces, text: str = "text", to: str = "ids", back: str = "decoded"
) -> DataFrame:
    """Adds the piece ids and the text that they stand for, by one Python worker per task."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (to.lower(), back.lower())])
    context = docs.sparkSession.sparkContext
    sent, spelled = context.broadcast(pieces), context.broadcast(_spellings(pieces))  # as large as the model
    at, key = docs.columns.index(text), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, spellings = _worker_encoder(key, sent), pa.array(spelled.value, pa.binary())
        for batch in batches:
            for begin, end in slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                ids = encoder.texts(part.column(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, ids, _decoded(ids, spellings)], names=[*part.schema.names, to, back])

    return docs.mapInArrow(run, with_fields(docs, **{to: T.ArrayType(T.IntegerType()), back: T.StringType()}))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """``piece, id, score`` of the pieces that can be edges."""
    rows = [(pieces.text[i], int(i), float(pieces.score[i])) for i in np.flatnonzero(pieces.normal)]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """The unigram lattice as a plan: distinct ``word`` -> ``word, ids``, -1 for unknown characters.

    Words have to be whole (blanks as marks). After ``distinct`` the rows are already dealt by word,
    so grouping the edges needs no further shuffle.
    """
    longest = pieces.longest
    scores = pieces.score[pieces.normal]
    unknown = float(scores.min() if len(scores) else 0.0) - UNKNOWN_PENALTY
    table = F.broadcast(piece_table(words.sparkSession, pieces))  # as large as the model
    distinct = words.select("word").where(F.length("word") > 0).distinct()
    spelled = distinct.select(
        "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start")
    ).select(
        "word", "start",
        F.explode(
            F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))
        ).alias("n"),
    ).withColumn("piece", F.expr("substring(word, start, n)"))
    edges = (
        spelled.join(table, "piece", "left")
        .where(F.col("id").isNotNull() | (F.col("n") == 1))
        .select(
            "word",
            F.struct(
                (F.col("start") + F.col("n") - 1).alias("end"), (-F.col("n")).alias("n"),
                F.coalesce("id", F.lit(-1)).alias("id"),
                F.coalesce("score", F.lit(unknown)).alias("score"),
            ).alias("edge"),
        )
        .groupBy("word").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    )
    # State: scores[k] and paths[k] of the best way to position k; edges come ordered by their end.
    fold = """
        aggregate(edges,
          named_struct('score', array(0D), 'path', array(cast(array() as array<int>))),
          (s, e) -> if(size(s.score) <= e.end,
            named_struct(
              'score', array_append(s.score, s.score[e.end + e.n] + e.score),
              'path', array_append(s.path, array_append(s.path[e.end + e.n], e.id))),
            if(s.score[e.end + e.n] + e.score > s.score[e.end],
              named_struct(
                'score', concat(slice(s.score, 1, e.end), array(s.score[e.end + e.n] + e.score)),
                'path', concat(slice(s.path, 1, e.end), array(array_append(s.path[e.end + e.n], e.id)))),
              s)),
          s -> element_at(s.path, -1))
    """
    return edges.select("word", F.expr(fold).alias("ids"))
