"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, from hashes of its code point, so each letter of each
script has its own. A run of three letters is bound into one vector: the letters' vectors, rotated by
their place in the run, multiplied component by component. A text's profile bundles (adds) the
vectors of all its runs; a language's prototype bundles all texts that are marked with it. A text gets the language whose prototype has the largest cosine with its
profile; the cosine, at least 0, is the score.

Both passes work on counts of runs: a slice of texts is a matrix of counts times the vectors of the
runs that occur in it, some thousand runs at a time, so no profile is built letter by letter and a
long text of many different runs needs no more memory for their vectors than any other. Training
adds up whole numbers, so the prototypes do not depend on how rows are dealt. What tasks send is one vector per language, and
what is broadcast is the prototypes, whose number is that of the language labels.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if
nothing was learned; ties go to the first label in code-point order; documents with a null id are
learned from and are not held out; repeated rows count as often as they occur and get one answer; an
empty table learns nothing and gives an empty result; long texts are read whole; columns of the input
are kept, and one with the name of an output column is replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import BASE, MIX, codes_of, slices, with_fields

#: Components of a vector, letters per run, and seed of the letters' vectors.
DIMENSION, RUN, SEED = 1024, 3, 20_240_117
#: Bits of a letter's code point in a run's code, and distinct runs that are bound at once.
CODE_BITS, KINDS = 21, 4096
#: Distinct runs are found through a table of so many places, or by sorting.
TABLE = 1 << 22
#: Bytes and texts per slice.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Code point -> code point of its lower-case letter; 0 if it is no letter."""
    table = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            table[code] = ord(letter.lower()[0])
    return table


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """The vectors of letters, bits of hashes of their code points; 0 stands for the edge of a word."""
    words = np.arange(SEED, SEED + DIMENSION // 64, dtype=np.uint64) * MIX
    mixed = letters.astype(np.uint64)[:, None] * BASE + words
    for shift in (30, 27, 31):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * MIX
    bits = np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def _run_vectors(kinds: np.ndarray, dtype: type) -> np.ndarray:
    """Letters' vectors, rotated by their place in the run, times each other."""
    places = [kinds >> CODE_BITS * (RUN - 1 - i) & (1 << CODE_BITS) - 1 for i in range(RUN)]
    letters = np.unique(np.concatenate(places))
    vectors = letter_vectors(letters)
    bound = np.ones((len(kinds), DIMENSION), np.int8)
    for i, place in enumerate(places):
        bound *= np.roll(vectors, RUN - 1 - i, axis=1)[np.searchsorted(letters, place)]
    return bound.astype(dtype)


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and code of every run of letters, in order."""
    codes, size = codes_of([unicodedata.normalize("NFC", f" {t} ") if t else "  " for t in texts])
    letters = _alphabet()[codes].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    keep = np.ones(len(letters), bool)
    # One edge between words, and one on either side of a text.
    keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0) | (doc[1:] != doc[:-1])
    letters, doc = letters[keep], doc[keep]
    runs = letters[:-2] << 2 * CODE_BITS | letters[1:-1] << CODE_BITS | letters[2:]
    whole = (letters[1:-1] > 0) & (doc[:-2] == doc[2:])
    return doc[:-2][whole], runs[whole]


def _distinct(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse; without sorting if there are few kinds of letters."""
    parts = [(runs >> CODE_BITS * i & (1 << CODE_BITS) - 1).astype(np.int32) for i in reversed(range(RUN))]
    there = np.zeros(1 << CODE_BITS, bool)
    for part in parts:
        there[part] = True
    letters = np.flatnonzero(there)
    if len(letters) ** RUN > TABLE:
        return np.unique(runs, return_inverse=True)
    number = np.zeros(1 << CODE_BITS, np.int32)
    number[letters] = np.arange(len(letters))
    code = np.zeros(len(runs), np.int32)
    for part in parts:
        code = code * np.int32(len(letters)) + number[part]
    seen = np.zeros(len(letters) ** RUN, np.int32)
    seen[code] = 1
    found = np.flatnonzero(seen)
    seen[found] = np.arange(len(found))
    kinds = np.zeros(len(found), np.int64)
    for i in reversed(range(RUN)):
        kinds = kinds << CODE_BITS | letters[found // len(letters) ** i % len(letters)]
    return kinds, seen[code].astype(np.int64)


def profiles(texts: list[str], group: np.ndarray, groups: int, dtype: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """The bundled runs of each group of texts, and how many runs each group has.

    Distinct runs are taken ``KINDS`` at a time, so memory doesn't grow with how many there are.
    """
    doc, runs = _runs(texts)
    of = group[doc]
    kinds, place = _distinct(runs)
    bundle = np.zeros((groups, DIMENSION), dtype)
    if len(kinds) > KINDS:
        order = np.argsort(place, kind="stable")
        place, of = place[order], of[order]
    for begin in range(0, len(kinds), KINDS):
        part = kinds[begin : begin + KINDS]
        a, b = (0, len(place)) if len(kinds) <= KINDS else np.searchsorted(place, [begin, begin + KINDS])
        if b - a <= 4 * len(part) and groups > 8:  # nearly every run occurs once
            order = np.argsort(of[a:b], kind="stable")
            there, begins = np.unique(of[a:b][order], return_index=True)
            bundle[there] += np.add.reduceat(_run_vectors(part, dtype)[place[a:b][order] - begin], begins)
            continue
        counts = np.bincount(of[a:b] * len(part) + place[a:b] - begin, minlength=groups * len(part))
        bundle += counts.reshape(groups, len(part)).astype(dtype) @ _run_vectors(part, dtype)
    return bundle, np.bincount(of, minlength=groups)


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from ``text`` and ``lang``; rows without a label are left out."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for begin, end in slices(batch.column(0), SLICE_BYTES, SLICE_ROWS):
                part = batch.slice(begin, end - begin)
                labels = part.column(1).to_pylist()
                names = sorted(set(labels))
                group = np.array([names.index(label) for label in labels])
                bundle, runs = profiles(part.column(0).to_pylist(), group, len(names), np.float64)
                for name, vector, n in zip(names, bundle, runs):
                    if n:
                        sums[name] = sums.get(name, 0) + vector
        yield pa.RecordBatch.from_pydict(
            {"lang": list(sums), "profile": [v.astype(np.int64).tolist() for v in sums.values()]},
            schema=pa.schema([("lang", pa.string()), ("profile", pa.list_(pa.int64()))]),
        )

    sums = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("text", "lang")
        .mapInArrow(bundle, "lang string, profile array<long>")
        .select("lang", F.posexplode("profile"))
        .groupBy("lang", "pos").agg(F.sum("col").alias("value"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("profile"))
    )
    return {
        row["lang"]: np.array([p["value"] for p in row["profile"]], np.float64) for row in sums.collect()
    }


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """Adds ``lang_pred`` and ``score``."""
    made = ("lang_pred", "score")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    names = sorted(name for name, v in prototypes.items() if np.linalg.norm(v) > 0)
    matrix = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]) if names else None
    sent = docs.sparkSession.sparkContext.broadcast((names, matrix))  # languages x DIMENSION
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, unit = sent.value
        for batch in batches:
            for begin, end in slices(batch.column(at), SLICE_BYTES, SLICE_ROWS):
                part = batch.slice(begin, end - begin)
                found, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                profile, runs = profiles(part.column(at).to_pylist(), np.arange(part.num_rows), part.num_rows)
                if runs.any() and labels:
                    length = np.linalg.norm(profile, axis=1)
                    cosine = (profile @ unit.T.astype(np.float32)) / np.maximum(length, 1e-9)[:, None]
                    has = runs > 0
                    best = cosine.argmax(axis=1)
                    found = [labels[b] if h else UNKNOWN for b, h in zip(best, has)]
                    score = np.where(has, np.clip(cosine.max(axis=1), 0.0, 1.0), 0.0)
                columns = [*part.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *made])

    schema = with_fields(docs, lang_pred=T.StringType(), score=T.DoubleType())
    return docs.mapInArrow(run, schema)
