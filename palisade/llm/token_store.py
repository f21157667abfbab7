"""Token ids as Parquet lists that can be read by column, row group and page.

``write`` ranges documents by ``doc_id``, encodes them in Arrow batches and writes the lists with
Spark's Parquet writer: token ids with dictionary encoding (the vocabulary fits one dictionary
page), ids and counts with delta encoding, row groups and pages of a set size, and page indexes, so
that a filter on ``doc_id`` opens a few pages and metadata is read without touching tokens.
``read`` goes over the files again: offsets come from sums per file and a running sum inside a file.

Words that a blank or line feed separates never share a token in this vocabulary, so each worker keeps the ids of
words it has met. A new word of plain letters and marks goes to the library's model in the two parts
that the vocabulary's splitter makes of it, any other word to the library's ``encode``; a text that
holds a special token's string goes there whole.

Defined cases: a null or empty text has only the end id; null ``doc_id`` comes first; rows with an
equal ``doc_id`` follow each other, each with its own place; an empty table gives an empty store.
Input columns other than ``doc_id`` and ``text`` are not stored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Appended to every document.
END_ID = 2
#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
#: Words whose ids a worker keeps at once (about 200 bytes each); it starts anew beyond.
KEPT_WORDS = 400_000

_WRITER = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where no dictionary is used
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
_TOKENS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))]
)


#: Letters that lower-casing and composition treat one by one, and marks that split off in one run.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$#&*|]*)")


class _Memory(dict):
    """A dictionary that makes what it doesn't hold, and starts anew when it is full."""

    def __init__(self, make, kept: int) -> None:
        super().__init__()
        self.make, self.kept = make, kept

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(self) >= self.kept:
            self.clear()
        self[key] = made
        return made


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


@lru_cache(maxsize=1)
def _encoder(path: str, kept: int = KEPT_WORDS):
    """The worker's encoder; it outlives a task, so words are met once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    model, to_bytes = tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    end = _packed([END_ID])

    def library(text: str) -> bytes:
        return _packed(tokenizer.encode(text, add_special_tokens=False).ids)

    def part(text: str) -> bytes:
        """Ids of one piece that the vocabulary's splitter would hand to the model."""
        shown = text if text.isascii() else to_bytes.pre_tokenize_str(text)[0][0]
        return _packed([token.id for token in model.tokenize(shown)])

    def word(text: str) -> bytes:
        plain = _PLAIN.fullmatch(text)
        if not plain:
            return library(text)
        letters, marks = plain.groups()
        return parts[letters.lower()] + parts[marks] if marks else parts[letters.lower()]

    parts, known = _Memory(part, kept), _Memory(word, kept)

    def encode(texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        return [
            library(text) + end
            if any(s in text for s in special)
            else b"".join(map(known.__getitem__, text.replace("\n", " ").split(" "))) + end
            for text in texts
        ]

    return encode


def _token_batches(path: str, step: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = encode([t or "" for t in part.column(1).to_pylist()])
                sizes = np.fromiter((len(ids) // 4 for ids in lists), np.int64, len(lists))
                flat = np.frombuffer(b"".join(lists), "<i4")
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, flat)],
                    schema=_TOKENS,
                )

    return run


def write(docs: DataFrame, tokenizer_path: str, folder: str) -> None:
    """Writes the tokens of all documents to ``folder``, in ascending ``doc_id`` order."""
    # Ranges first: they are drawn from ids alone, while drawing them from tokens would encode twice.
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
    tokens = ranged.sortWithinPartitions("doc_id").mapInArrow(
        _token_batches(tokenizer_path), "doc_id long, n_tokens long, tokens array<int>"
    )
    writer = tokens.write
    for key, value in _WRITER.items():
        writer = writer.option(key, value)
    writer.parquet(folder)


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and token counts, without reading tokens."""
    return spark.read.schema("doc_id long, n_tokens long").parquet(folder)


_DIGEST = pa.schema([
    ("file", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
    ("ids_crc32", pa.int64()), ("at", pa.int64()),
])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and checksums from the lists as they were read."""
    for batch in batches:
        tokens = batch.column("tokens")
        offsets = tokens.offsets.to_numpy()
        flat = tokens.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file"), batch.column("doc_id"),
                pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()),
                batch.column("at"),
            ],
            schema=_DIGEST,
        )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    The files are ranges of ``doc_id``; ``start`` is the sum of the ranges before plus the sum of
    the rows before within the range.
    """
    stored = spark.read.schema("doc_id long, n_tokens long, tokens array<int>").parquet(folder)
    digests = stored.select(
        F.col("_metadata.file_name").alias("file"), "doc_id", "tokens",
        F.col("_metadata.row_index").alias("at"),
    ).mapInArrow(_digests, "file string, doc_id long, n_tokens long, ids_crc32 long, at long")
    per_file = (
        metadata(spark, folder)
        .groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.sum("n_tokens").alias("file_tokens"))
    )
    files = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select("file", F.coalesce(F.sum("file_tokens").over(files), F.lit(0)).alias("offset"))
    inside = (
        Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        digests.join(offsets, "file")
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .select("doc_id", "start", "n_tokens", "ids_crc32")
    )
