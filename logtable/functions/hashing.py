"""Row identity: FNV-1a 64 over the normalised cells of a row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

from logtable.functions.text import cell, gfold, gtrim

# The FNV-1a 64-bit parameters.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211


def fnv1a_64(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash the byte runs ``data[offsets[i]:offsets[i + 1]]``, all rows at a time.

    Rows are taken longest first, so the rows that still have a byte at
    position ``k`` are always a prefix.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = offsets[:-1][order], lengths[order]
    state = np.full(len(order), FNV_OFFSET, dtype=np.uint64)
    prime = np.uint64(FNV_PRIME)
    longest = int(sizes[0]) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    for position, count in enumerate(active):
        head = state[:count]
        head ^= data[starts[:count] + position]
        head *= prime
    out = np.empty_like(state)
    out[order] = state
    return out


@F.arrow_udf(LongType())
def _hash_text(text: pa.Array) -> pa.Array:
    text = text.cast(pa.large_binary())
    _, offset_buffer, data_buffer = text.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.empty(0, np.uint8)
    return pa.array(fnv1a_64(data, offsets).view(np.int64))


def row_hash(columns: Sequence[str]) -> Column:
    """BIGINT identity of the row; equal rows share it.

    The cells are trimmed and folded by Spark; Python sees one text per row.
    """
    if not columns:
        return F.lit(FNV_OFFSET - 2**64)
    cells = [gfold(gtrim(cell(c))) for c in columns]
    return _hash_text(F.concat(F.concat_ws("\0", *cells), F.lit("\0")))


def _wide(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def unsigned(row_id: Column) -> Column:
    """The identity as unsigned decimal text, as sessions store it."""
    wide = row_id.cast("decimal(38,0)")
    return F.when(row_id < 0, wide + _wide(2**64)).otherwise(wide).cast("string")


def signed(text: Column) -> Column:
    """BIGINT identity from unsigned decimal text; NULL when it is not one."""
    value = F.when(text.rlike(r"^[0-9]+\z"), text.try_cast("decimal(38,0)"))
    wrapped = F.when(value >= _wide(2**63), value - _wide(2**64)).otherwise(value)
    return F.when(value < _wide(2**64), wrapped.cast("bigint"))
