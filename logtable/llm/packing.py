"""Best-fit packing planned over a histogram of lengths.

Documents become token ids and an end id; only those longer than a sequence are cut, into
pieces of the full length and a rest. The number of pieces of each length (at most
``capacity`` numbers, whatever the size of the corpus) is all that the plan needs: longest
first, each length fills the sequences whose free room fits it best. Sequences of equal room
are handled together, so the plan is a list of ranges: pieces of one length with ranks a to
b go to consecutive sequences, so many in each, from a given offset on. Pieces then take
their slots by a join on length and rank; ranges are cut at every ``RANK_BLOCK`` ranks, so a
length that most pieces share is many small join keys.

Defined results: a null or empty text is the end id alone; rows that repeat are documents of
their own; ranks within a length go by doc_id and piece, nulls first.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from logtable.llm.common import release_memory
from logtable.plans.ordered import in_order
from logtable.plans.staging import stage

CAPACITY, END_ID = 4096, 1
RANK_BLOCK = 256
#: Words whose ids a Python worker remembers, and at a task's end keeps; it forgets all of them
#: when there are more.
REMEMBERED, KEPT = 300_000, 50_000
#: Bytes of text that are tokenised together.
TOGETHER = 4 << 20


class WordTokenizer:
    """Ids of a word tokenizer (BPE inside words, which end in ``</w>``).

    Words are split off here, in whole columns of texts, and each distinct one is tokenised
    once by the tokenizer. That holds for texts of ASCII and Latin-1 letters, digits,
    punctuation but for ``'``, and white space, where normalising means no more than
    lower-casing; any other text goes to the tokenizer whole.
    """

    PLAIN = r"\A[\t-\r -&(-~À-ÖØ-öø-ÿ]*\z"
    #: A digit, or a run of what is neither letter nor digit, is a word of its own.
    APART = r"([0-9]|[!-/:-@\[-`{-~]+)"
    SPECIAL = "<|"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends_word[number] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}
        #: Another number of words to remember.
        self.remembered = 0

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One for each Python worker, which runs many tasks."""
        kept = sys.modules.setdefault("_worker_tokenizers", types.ModuleType("_worker_tokenizers"))
        if path not in kept.__dict__:
            kept.__dict__[path] = cls(path)
        return kept.__dict__[path]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            ids = self._whole(" ".join(some))
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            data = ids.tobytes()
            if len(ends) == len(some) and ends[-1] == len(data):
                starts = [0, *ends[:-1].tolist()]
                self.known.update((word, data[a:b]) for word, a, b in zip(some, starts, ends.tolist()))
            else:
                self.known.update((word, self._whole(word).tobytes()) for word in some)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and end."""
        words = pc.ascii_split_whitespace(
            pc.replace_substring_regex(pc.utf8_lower(texts), pattern=self.APART, replacement=r" \1 "))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > (self.remembered or REMEMBERED):
            self.known = {"": b""}
            new = [w for w in distinct if w]
        if new:
            self._learn(new)
        parts = [self.known[w] for w in distinct]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids, codes = np.frombuffer(b"".join(parts), "<u4"), coded.indices.to_numpy()
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        firsts = (np.cumsum(sizes) - sizes)[codes]
        every = ids[np.repeat(firsts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        words_to = words.offsets.to_numpy() - words.offsets[0].as_py()
        return every, np.append(0, ends)[words_to]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        texts = pc.fill_null(texts, "")
        plain = pc.and_(pc.match_substring_regex(texts, self.PLAIN), pc.invert(pc.match_substring(texts, self.SPECIAL)))
        every, cuts = self._plain(texts.filter(plain))
        parts = iter([every[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
        return [next(parts) if p else self._whole(t.as_py()) for p, t in zip(plain.to_pylist(), texts)]


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a)


def token_pieces(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece, and its
    ``ids`` (binary, unsigned 32-bit) if asked for."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer.shared(tokenizer)
        for batch in batches:
            for low, high in by_bytes(batch.column(1), TOGETHER):
                some = batch.slice(low, high - low)
                rows, numbers, starts, lengths, sums, pieces = [], [], [], [], [], []
                for row, ids in enumerate(encoder.encode(some.column(1))):
                    data = ids.tobytes() + end
                    for number, start in enumerate(range(0, len(data), 4 * capacity)):
                        piece = data[start : start + 4 * capacity]
                        rows.append(row)
                        numbers.append(number)
                        starts.append(start // 4)
                        lengths.append(len(piece) // 4)
                        sums.append(zlib.crc32(piece))
                        if with_ids:
                            pieces.append(piece)
                columns = [
                    some.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(pieces, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        if len(encoder.known) > KEPT:
            encoder.known = {"": b""}
        release_memory()

    read = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return read.mapInArrow(cut, schema)


class Slots(NamedTuple):
    """Pieces of ``length`` ranked ``rank_from`` to ``rank_to`` (not itself) go to sequences
    from ``first`` on, ``each`` in one, the first of them at ``base``."""

    length: int
    rank_from: int
    rank_to: int
    first: int
    each: int
    base: int


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best fit, longest first, over the number of pieces of each length.

    ``free`` maps a room to runs of sequences that have it. Filling a sequence with as many
    equal pieces as fit is what best fit does, as each piece leaves it the tightest. Every
    length ends inside one run at most, so there are few runs, whatever the counts.
    """
    slots, free, rooms, opened = [], {}, [], 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                number = -(-left // (capacity // length))
                put(capacity, opened, number)
                opened += number
                continue
            room = rooms[at]
            first, number = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(at)
            each = room // length
            filled = min(number, left // each)
            if filled:
                slots.append(Slots(length, rank, rank + filled * each, first, each, capacity - room))
                rank, left = rank + filled * each, left - filled * each
                put(room - each * length, first, filled)
            if filled < number and left and left < each:
                slots.append(Slots(length, rank, rank + left, first + filled, left, capacity - room))
                put(room - left * length, first + filled, 1)
                filled, rank, left = filled + 1, rank + left, 0
            put(room, first + filled, number - filled)
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    pieces = stage(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for length in sorted(counts):
        before.append((length, total))
        total += counts[length]
    ranked = (
        in_order(pieces, [(F.col("length"), False), (F.col(doc_id), False), (F.col("piece"), False)], out="pos", first=0)
        # One row for each length: no more than the capacity.
        .join(F.broadcast(spark.createDataFrame(before, "length long, before long")), "length")
        .withColumn("rank", F.col("pos") - F.col("before"))
        .withColumn("block", F.expr(f"rank div {RANK_BLOCK}"))
    )
    plan = spark.createDataFrame(
        plan_slots(counts, capacity), "length long, rank_from long, rank_to long, first long, each long, base long"
    ).withColumn("block", F.explode(F.sequence(F.expr(f"rank_from div {RANK_BLOCK}"), F.expr(f"(rank_to - 1) div {RANK_BLOCK}"))))
    plan = plan.withColumnsRenamed({"length": "of_length", "block": "of_block"})
    taken = ranked.join(
        plan, (F.col("length") == F.col("of_length")) & (F.col("block") == F.col("of_block"))
        & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    place = F.col("rank") - F.col("rank_from")
    return taken.select(
        *pieces.columns,
        (F.col("first") + F.expr("(rank - rank_from) div each")).alias("sequence_id"),
        (F.col("base") + place % F.col("each") * F.col("length")).alias("offset"),
    )


def packed_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its ``ids`` (binary), from packed pieces that hold their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"]))).alias("ids")).select(
        "sequence_id", F.unhex("ids").alias("ids"))
