"""Token ids as binary files, each document compressed by itself with a shared dictionary.

A zstandard dictionary is trained on serialised id arrays: chunks of ``CHUNK`` ids of a bounded
sample of the documents. Every document (its ids and an end id, 16 bits each where the
vocabulary allows it, else 32) is one zstandard frame made with that dictionary, so that a short
one is small and can be read alone. Documents are sorted by id and written as records of about
``RECORD_BYTES``:

    8, 1      magic, and what every later byte is combined with by exclusive or
    32        SHA-256 of the dictionary
    4, 4      the file part and the record's number in it
    8         ids of the part before this record
    4, 4      bytes of an id, documents
    9 each    whether the document has an id, the id
    8 each    ids of the record before the document, and those of the record
    8 each    where its frame begins after the index, and the end of the last
    ...       frames

Numbers are little-endian. A record is one row of Spark's text source, with ``SEPARATOR`` as
the line end, so any file system that Spark reaches takes the files, a lost executor leaves
none behind, and files of any size are read in splits, a record at a time. The byte after the
magic is chosen so that no record holds the separator. Records of a later part hold later
documents: what a document starts at is the ids of earlier parts, of its part before its
record, and of its record before it. Records are checked against the dictionary's hash when
read, and only frames that are asked for are decompressed.

Defined results: a null or empty text is the end id alone; documents go by id, nulls first;
rows that repeat an id are documents of their own, the shorter text first.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logtable.llm.packing import WordTokenizer, by_bytes
from logtable.plans.staging import stage, staging_root

END_ID, LEVEL = 2, 3
#: The dictionary: its size, the documents of its sample, their chunks (ids each, how many).
DICTIONARY_BYTES, SAMPLE_DOCS, CHUNK, SAMPLE_CHUNKS = 64 << 10, 2000, 2048, 4000
RECORD_BYTES, SEPARATOR = 1 << 18, "\n--end of record--"
#: Bytes of text that are tokenised together, and words that a worker remembers.
TOGETHER, REMEMBERED = 4 << 20, 800_000
#: Parts whose starts are broadcast at most.
BROADCAST_PARTS = 1_000_000
MAGIC = b"IDFILES1"
HEAD = "<32sIIQII"


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Document(NamedTuple):
    doc_id: int | None
    start: int
    n_tokens: int
    ids: np.ndarray


def encoded(texts: pa.Array, tokenizer: str, end_id: int) -> Iterator[np.ndarray]:
    """The serialisable ids of each text, the end id included."""
    made = WordTokenizer.shared(tokenizer)
    made.remembered = REMEMBERED
    kind = id_type(max(len(made.ends_word), end_id + 1))
    for low, high in by_bytes(texts, TOGETHER):
        for ids in made.encode(texts.slice(low, high - low)):
            yield np.append(ids, np.uint32(end_id)).astype(kind)


def train(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for the ids of ``docs`` (doc_id, text), from ``SAMPLE_DOCS`` documents and
    ``SAMPLE_CHUNKS`` chunks of them, chosen by hash. Too few to train on are used as they are."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "of")), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in encoded(batch.column(0), tokenizer, end_id):
                cut = [ids[at : at + CHUNK].tobytes() for at in range(0, len(ids), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["chunk"])

    found = sample.select("text").mapInArrow(chunks, "chunk binary").orderBy(F.xxhash64("chunk"), "chunk").limit(SAMPLE_CHUNKS)
    samples = [bytes(r["chunk"]) for r in found.collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(dictionary)


def record(digest: bytes, part: int, number: int, start: int, width: int, ids: Sequence, sizes: Sequence, frames: Sequence[bytes]) -> bytes:
    before = np.append(0, np.cumsum(sizes)).astype("<u8")
    places = np.append(0, np.cumsum([len(f) for f in frames])).astype("<u8")
    known = np.array([i is not None for i in ids], "u1")
    numbers = np.array([i or 0 for i in ids], "<i8")
    head = struct.pack(HEAD, digest, part, number, start, width, len(ids))
    body = b"".join([head, known.tobytes(), numbers.tobytes(), before.tobytes(), places.tobytes(), *frames])
    for mask in range(256):
        made = MAGIC + bytes([mask]) + (_masked(body, mask) if mask else body)
        if SEPARATOR.encode() not in made:
            return made
    raise ValueError("a record that holds the separator under every mask")


def _masked(body: bytes, mask: int) -> bytes:
    return (np.frombuffer(body, np.uint8) ^ np.uint8(mask)).tobytes()


class Record(NamedTuple):
    """One record's head and index, without any frame read."""

    digest: bytes
    part: int
    number: int
    start: int
    width: int
    ids: list
    before: np.ndarray
    places: np.ndarray
    frames: memoryview

    @classmethod
    def of(cls, content: bytes) -> Record:
        mask = content[len(MAGIC)] if content[: len(MAGIC)] == MAGIC else None
        if mask is None:
            raise ValueError("not a record")
        body = content[len(MAGIC) + 1 :]
        body = memoryview(_masked(body, mask) if mask else body)
        digest, part, number, start, width, n = struct.unpack_from(HEAD, body)
        place, columns = struct.calcsize(HEAD), []
        for kind, count in (("u1", n), ("<i8", n), ("<u8", n + 1), ("<u8", n + 1)):
            columns.append(np.frombuffer(body, kind, count, place))
            place += columns[-1].nbytes
        known, numbers, before, places = columns
        if len(body) != place + int(places[-1]):
            raise ValueError("a record that is cut short")
        ids = [int(i) if k else None for i, k in zip(numbers, known)]
        return cls(digest, part, number, start, width, ids, before, places, body[place:])

    def document(self, i: int, reader: zstandard.ZstdDecompressor) -> Document:
        frame = self.frames[int(self.places[i]) : int(self.places[i + 1])]
        ids = np.frombuffer(reader.decompress(frame), f"<u{self.width}")
        return Document(self.ids[i], int(self.before[i]), int(self.before[i + 1] - self.before[i]), ids)


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
) -> None:
    """Write the ids of every text of ``docs`` to the folder ``path``."""
    spark = docs.sparkSession
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    dictionary = train(read, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(dictionary,)], "value binary").coalesce(1).write.parquet(f"{path}/dictionary")
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(dictionary) if dictionary else None)
        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids, sizes, frames, size, width = [], [], [], 0, 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([record(digest, part, number, start, width, ids, sizes, frames)], pa.binary())], ["value"])

        for batch in batches:
            for one, array in zip(batch.column(0).to_pylist(), encoded(batch.column(1), tokenizer, end_id)):
                if size >= RECORD_BYTES:
                    yield out()
                    number, start = number + 1, start + sum(sizes)
                    ids, sizes, frames, size = [], [], [], 0
                ids.append(one)
                sizes.append(len(array))
                frames.append(made.compress(array.tobytes()))
                size, width = size + len(frames[-1]), array.itemsize
        if ids:
            yield out()

    # Texts are sorted, not their ids: a range sort reads its input twice, and tokenising costs
    # more than reading. The last key only deals rows that are alike to several tasks.
    keys = [F.asc_nulls_first("doc_id"), F.char_length("text"), F.xxhash64("text"), F.monotonically_increasing_id()]
    values = read.orderBy(*keys).mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    values.write.option("lineSep", SEPARATOR).text(f"{path}/ids")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["value"])


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", SEPARATOR).text(f"{path}/ids").select(F.col("value").cast("binary").alias("record"))


def read_ids(spark: SparkSession, path: str, only: Iterable[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``ids`` (little-endian unsigned 32-bit,
    null without ``with_ids``) of the documents in the files of ``path``; with ``only``, of those
    ids, a short list: frames of others are not decompressed."""
    dictionary, wanted = _dictionary(spark, path), None if only is None else set(only)
    digest = hashlib.sha256(dictionary).digest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor(dict_data=_loaded(dictionary) if dictionary else None)
        names = ["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                found, rows = Record.of(content.as_py()), []
                if found.digest != digest:
                    raise ValueError("the record was made with another dictionary")
                for i, one in enumerate(found.ids):
                    if wanted is None or one in wanted:
                        document = found.document(i, reader)
                        ids = document.ids.astype("<u4").tobytes()
                        rows.append((found.part, one, found.start + document.start, document.n_tokens,
                                     zlib.crc32(ids), ids if with_ids else None))
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    schema = "part long, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    starts = part_starts(spark, path)
    few = starts.count() <= BROADCAST_PARTS
    found = _records(spark, path).mapInArrow(read, schema).join(F.broadcast(starts) if few else starts, "part")
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part`` and the ids of all parts ``before`` it: from the index of each record."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [Record.of(content.as_py()) for content in batch.column(0)]
                columns = [r.part for r in found], [int(r.before[-1]) for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["part", "n"])

    sums = _records(spark, path).mapInArrow(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    # One row for each sort partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return stage(sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))


def fresh_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/{uuid.uuid4().hex}"
