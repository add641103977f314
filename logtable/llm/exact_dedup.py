"""Exact dedup by counting quotient filters.

Texts are normalised (each run of white space becomes one space) and hashed to 64 bits.
Every partition of the hashes builds a counting quotient filter; filters are merged in a
tree, ``FAN_IN`` partitions at a time, by their sorted remainders, which loses nothing.
Only texts whose fingerprint was counted more than once are compared byte by byte: they
are grouped by the text itself, so two texts with one fingerprint stay apart.

Defined results: a null text counts as empty; of equal texts the smallest doc_id stays (of
rows that repeat it, one); every input row gives one row. A null doc_id sorts first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logtable.llm.common import SPACE, whole
from logtable.plans.staging import stage

#: Fingerprints that a merged filter holds on average, and filters that one merge takes.
FILTER_SIZE, FAN_IN = 1 << 16, 64
FILTER_ROWS = "level_group long, slice long, filter binary"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole(text), f"{SPACE}+", " ")


class QuotientFilter:
    """Fingerprints and their counts: sorted by quotient (the high bits), the remainders
    of a quotient stored side by side in order.

    ``occupied`` has a bit for each quotient, ``run_ends`` one for each slot that is the
    last of its quotient; together they give a remainder its quotient back. Counts over
    one are kept beside the slot numbers they belong to.
    """

    def __init__(self, base: int, quotient_bits: int, remainder_bits: int, remainders: np.ndarray,
                 occupied: np.ndarray, run_ends: np.ndarray, repeated: np.ndarray, counts: np.ndarray) -> None:
        self.base, self.quotient_bits, self.remainder_bits = base, quotient_bits, remainder_bits
        self.remainders, self.occupied, self.run_ends = remainders, occupied, run_ends
        self.repeated, self.counts = repeated, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, base: int, bits: int) -> QuotientFilter:
        """From sorted distinct fingerprints that agree above the lowest ``bits`` with ``base``."""
        quotient_bits = min(bits, max(1, math.ceil(math.log2(len(fingerprints) + 1))))
        remainder_bits = bits - quotient_bits
        low = fingerprints & np.uint64((1 << bits) - 1)
        quotients = (low >> np.uint64(remainder_bits)) if remainder_bits < 64 else np.zeros(len(low), np.uint64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients.astype(np.int64)] = True
        run_ends = np.append(quotients[1:] != quotients[:-1], True) if len(low) else np.zeros(0, bool)
        repeated = np.flatnonzero(counts > 1)
        return cls(base, quotient_bits, remainder_bits, low & np.uint64((1 << remainder_bits) - 1),
                   np.packbits(occupied), np.packbits(run_ends), repeated.astype(np.uint32), counts[repeated].astype(np.uint64))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        slots = len(self.remainders)
        present = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.quotient_bits)).astype(np.uint64)
        ends = np.unpackbits(self.run_ends, count=slots).astype(np.int64)
        run = np.cumsum(ends) - ends
        high = present[run] << np.uint64(self.remainder_bits) if slots else np.zeros(0, np.uint64)
        counts = np.ones(slots, np.uint64)
        counts[self.repeated] = self.counts
        return high | self.remainders | np.uint64(self.base), counts

    def to_bytes(self) -> bytes:
        width = 4 if self.remainder_bits <= 32 else 8
        head = np.array([self.base, self.quotient_bits, self.remainder_bits, len(self.remainders), len(self.repeated)], np.uint64)
        return b"".join(x.tobytes() for x in (
            head, self.remainders.astype(f"<u{width}"), self.repeated, self.counts, self.occupied, self.run_ends))

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        base, quotient_bits, remainder_bits, slots, repeated = map(int, np.frombuffer(data, np.uint64, 5))
        at, parts = 40, []
        for kind, size in ((f"<u{4 if remainder_bits <= 32 else 8}", slots), (np.uint32, repeated), (np.uint64, repeated),
                           (np.uint8, ((1 << quotient_bits) + 7) // 8), (np.uint8, (slots + 7) // 8)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        remainders, numbers, counts, occupied, run_ends = parts
        return cls(base, quotient_bits, remainder_bits, remainders.astype(np.uint64), occupied, run_ends, numbers, counts)


def counted(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order with their counts added up."""
    distinct, place = np.unique(fingerprints, return_inverse=True)
    total = np.zeros(len(distinct), np.uint64)
    np.add.at(total, place, counts)
    return distinct, total


def filter_slices(fingerprints: np.ndarray, counts: np.ndarray, slice_bits: int) -> Iterator[tuple[int, bytes]]:
    """One filter for each value of the highest ``slice_bits``."""
    bits = 64 - slice_bits
    slices = (fingerprints >> np.uint64(bits)).astype(np.int64) if slice_bits else np.zeros(len(fingerprints), np.int64)
    for cut in np.split(np.arange(len(slices)), np.flatnonzero(np.diff(slices)) + 1):
        if len(cut):
            number = int(slices[cut[0]])
            base = (number << bits) if slice_bits else 0
            yield number, QuotientFilter.build(fingerprints[cut], counts[cut], base, bits).to_bytes()


def _merged(filters: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    parts = [QuotientFilter.from_bytes(data).entries() for data in filters]
    return counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def repeated_fingerprints(hashes: DataFrame, rows: int) -> DataFrame:
    """``fp``: those that ``hashes`` (one column of 64-bit integers) holds more than once."""
    partitions = hashes.rdd.getNumPartitions()
    levels = max(1, math.ceil(math.log(max(partitions, 2), FAN_IN)))

    def bits(level: int) -> int:
        """Slices, as a power of two, of what one group of this level holds."""
        share = rows * min(1.0, FAN_IN**level / partitions)
        return max(0, math.ceil(math.log2(max(1.0, share / FILTER_SIZE))))

    first, last = bits(1), bits(levels)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() // FAN_IN
        found = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if found:
            every = np.concatenate(found)
            rows = list(filter_slices(*counted(every, np.ones(len(every), np.uint64)), first))
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * len(rows), pa.int64()), pa.array([n for n, _ in rows], pa.int64()),
                 pa.array([f for _, f in rows], pa.binary())], ["level_group", "slice", "filter"])

    filters = hashes.mapInArrow(build, FILTER_ROWS)
    for level in range(2, levels + 1):
        filters = filters.groupBy("level_group", "slice").applyInPandas(_merge_to(bits(level)), FILTER_ROWS)

    def above_one(group: pd.DataFrame) -> pd.DataFrame:
        fingerprints, counts = _merged(group["filter"])
        return pd.DataFrame({"fp": fingerprints[counts > 1].view(np.int64)})

    return filters.groupBy("level_group", "slice").applyInPandas(above_one, "fp long")


def _merge_to(slice_bits: int):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(filter_slices(*_merged(group["filter"]), slice_bits))
        above = int(group["level_group"].iloc[0]) // FAN_IN
        return pd.DataFrame({"level_group": [above] * len(rows), "slice": [n for n, _ in rows], "filter": [f for _, f in rows]})

    return merge


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), normalised(text).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    hashed = stage(texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")))
    repeated = stage(repeated_fingerprints(hashed.select("fp"), hashed.count()))
    # Byte verification: only texts whose fingerprint was counted twice, grouped by the text.
    same = (
        texts.join(repeated, "fp", "left_semi").groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("group_size"))
        .select("fp", F.sha2("norm", 256).alias("text_sha256"), "group_size")
    )
    first = (
        hashed.join(repeated, "fp", "left_semi").groupBy("fp", "text_sha256")
        .agg(F.min(F.struct("doc_id", "_row")).alias("_keep"))
    )
    groups = stage(same.join(first, ["fp", "text_sha256"]).filter("group_size > 1"))
    return hashed.join(groups, ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("_keep").isNull(), F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_keep._row") == F.col("_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
