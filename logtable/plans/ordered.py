"""Work that follows the order of the rows, without one task for all of them.

Every function works on blocks of neighbouring rows: a window inside each
block, plus one small table with a row per block that carries the result of
the blocks before (or after) it. Blocks hold at most ``BLOCK`` order values, so
no key, however frequent, can grow one. The table of blocks has one row per
``BLOCK`` rows of input, which is what its single-task window sees. It is joined
after the window, which leaves rows dealt and sorted by block, so they are sorted once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from logtable.plans.staging import stage

BLOCK = 1 << 17

# A table of splits is broadcast up to this many rows.
BROADCAST_ROWS = 1_000_000


# A sample of rows, or what is left of them, is put in order at once up to so many.
FEW_ROWS = 50_000

# A sort key and whether it descends.
Key = tuple[Column, bool]


def _keyed(df: DataFrame, keys: Sequence[Key]) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with each key as a column, so that a sort does not work it out again
    for every pair of rows it compares."""
    names = [f"_key{i}" for i in range(len(keys))]
    with_keys = df.withColumns({n: key for n, (key, _) in zip(names, keys)})
    order = [F.col(n).desc() if down else F.col(n).asc() for n, (_, down) in zip(names, keys)]
    return with_keys, order, names


def ordered(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """``df`` sorted by ``keys``."""
    with_keys, order, names = _keyed(df, keys)
    return with_keys.orderBy(*order).drop(*names)


def in_order(df: DataFrame, keys: Sequence[Key], out: str = "pos", first: int = 1) -> DataFrame:
    """Sort by ``keys``, which must be total, and number the rows from ``first``.

    The sorted rows are staged with the task that wrote them and their place in
    it. One count per task (a broadcast table with one row per sort partition)
    then turns that into a global position.
    """
    placed = stage(
        ordered(df, keys)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    starts = _starts(placed, ["_task"])
    return _renumbered(placed, F.broadcast(starts), ["_task"], out, first)


def first_in_order(df: DataFrame, keys: Sequence[Key], count: int, out: str = "pos") -> DataFrame:
    """The first ``count`` rows by ``keys``, which must be total, numbered from 1. Each task
    keeps that many rows; nothing else is sorted or moved."""
    with_keys, order, names = _keyed(df, keys)
    return with_keys.orderBy(*order).limit(count).withColumn(out, F.row_number().over(Window.orderBy(*order))).drop(*names)


def _before(names: Sequence[str], keys: Sequence[Key], bound: Row) -> Column:
    """Whether a row sorts before ``bound``: NULL comes first, or last where a key descends."""
    found = F.lit(False)
    for name, (_, down) in reversed(list(zip(names, keys))):
        value, column = bound[name], F.col(name)
        if value is None:
            less = column.isNotNull() if down else F.lit(False)
        else:
            less = F.coalesce(column > value, F.lit(False)) if down else F.coalesce(column < value, F.lit(True))
        found = less | (column.eqNullSafe(F.lit(value)) & found)
    return found


def ranked_between(
    df: DataFrame, keys: Sequence[Key], start: int, end: int, out: str = "pos", few: int = FEW_ROWS
) -> DataFrame:
    """The rows of ranks ``start`` to ``end`` (from 1) by ``keys``, which must be total.

    A sample of the rows brackets these ranks; exact counts before and inside the bracket say
    whether it holds them, and where it begins. Only the bracket is kept, and again a bracket of
    it, until ``few`` rows are left to put in order. A bracket that misses, or does not narrow
    down, is put in order as it is, so the result never depends on the sample.
    """
    rows, order, names = _keyed(df, keys)
    again, skipped, left = [(F.col(n), down) for n, (_, down) in zip(names, keys)], 0, rows.count()
    end = min(end, left)
    while left > few and end >= start:
        share = few / 2 / left
        picked = F.pmod(F.xxhash64(*names, F.lit(left)), F.lit(1 << 30)) < int(share * (1 << 30))
        sample = stage(rows.select(*names).filter(picked))
        # Six standard deviations of a rank in the sample.
        margin = 3 * math.ceil(math.sqrt(few / 2)) + 1
        low, high = int((start - skipped) * share) - margin, int((end - skipped) * share) + margin
        ranked = sample.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
        bounds = {row["_rank"]: row for row in ranked.filter(F.col("_rank").isin(low, high)).collect()}
        from_low = ~_before(names, again, bounds[low]) if low in bounds else F.lit(True)
        to_high = _before(names, again, bounds[high]) if high in bounds else F.lit(True)
        inside = stage(rows.filter(from_low & to_high))
        before = skipped + rows.filter(~from_low).count()
        size = inside.count()
        if not before < start <= end <= before + size or size > left * 3 // 4:
            break
        rows, skipped, left = inside, before, size
    if left <= few:
        placed = first_in_order(rows, again, max(end - skipped, 0), out)
    else:
        placed = in_order(rows, again, out)
    return placed.withColumn(out, F.col(out) + skipped).filter(F.col(out).between(start, end))


def place_scan(scanned: DataFrame) -> DataFrame:
    """Stage rows scanned from files so that they can be put in source order.

    ``scanned`` holds ``file`` and ``_start`` (where its split starts in the
    file); a split is read in order by one task.
    """
    return stage(scanned.withColumn("_place", F.monotonically_increasing_id()))


def number_placed(placed: DataFrame, out: str = "line_no", skip_first: bool = False) -> DataFrame:
    """Dense numbers in source order for placed rows.

    One row per split is joined back: broadcast if there are few enough splits,
    else by shuffle. ``skip_first`` leaves out, and does not count, the first
    row of each file.
    """
    group = ["file", "_start"]
    starts = _starts(placed, group)
    if skip_first:
        opens = F.row_number().over(Window.partitionBy("file").orderBy("_start")) == 1
        skipped = F.dense_rank().over(Window.orderBy("file"))
        starts = starts.withColumns({
            "_from": F.col("_from") + F.when(opens, 1).otherwise(0),
            "_before": F.col("_before") - skipped + F.when(opens, 1).otherwise(0),
        })
    starts = stage(starts)
    few = starts.count() <= BROADCAST_ROWS
    numbered = _renumbered(placed, F.broadcast(starts) if few else starts, group, out, 1, skip_first)
    return numbered.drop("_start")


def _starts(placed: DataFrame, group: list[str]) -> DataFrame:
    sizes = placed.groupBy(*group).agg(
        F.min("_place").alias("_from"), F.count(F.lit(1)).alias("_size")
    )
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *group, "_from", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )


def _renumbered(
    placed: DataFrame, starts: DataFrame, group: list[str], out: str, first: int,
    skip_first: bool = False,
) -> DataFrame:
    position = F.col("_before") + F.col("_place") - F.col("_from") + first
    kept = [c for c in placed.columns if c not in ("_task", "_place")]
    joined = placed.join(starts, group)
    if skip_first:
        joined = joined.filter(F.col("_place") >= F.col("_from"))
    return joined.select(*kept, position.alias(out))


def _blocked(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_block", F.expr(f"`{order}` div {BLOCK}"))


def running_last(
    df: DataFrame, order: str, value: Column, out: str, inclusive: bool = True
) -> DataFrame:
    """The last non-NULL ``value`` before each row, or at it when ``inclusive``."""
    blocked = _blocked(df.withColumn("_value", value), order)
    at = F.when(F.col("_value").isNotNull(), F.col(order))
    blocks = blocked.groupBy("_block").agg(F.max_by("_value", at).alias("_last"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("_block", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    walked = blocked.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).drop("_value")
    return walked.join(carried, "_block").withColumn(out, F.coalesce("_inside", "_carry")).drop("_block", "_carry", "_inside")


def running_last_of(
    df: DataFrame, group: str, order: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """The last non-NULL ``value`` of the same group before each row, or at it.

    ``order`` is unique in a group and neither it nor the group is NULL. Rows meet in blocks of
    ``block`` order values; a row a block and group carries over what the blocks before it
    leave, so a window never sees more of a group than a block, or a row for each block.
    """
    blocked = df.withColumns({"_block": F.expr(f"`{order}` div {block}"), "_value": value})
    at = F.when(F.col("_value").isNotNull(), F.col(order))
    blocks = blocked.groupBy(group, "_block").agg(F.max_by("_value", at).alias("_last"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(group, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carry"))
    joined = blocked.join(carried, [group, "_block"]).withColumn(out, found)
    return joined.select(*[c for c in df.columns if c != out], out)


def neighbours(df: DataFrame, order: str, value: Column, after: str, before: str) -> DataFrame:
    """The nearest non-NULL ``value`` after and before each row, not at it."""
    blocked = _blocked(df.withColumn("_value", value), order)
    at = F.when(F.col("_value").isNotNull(), F.col(order))
    blocks = blocked.groupBy("_block").agg(
        F.min_by("_value", at).alias("_first"), F.max_by("_value", at).alias("_last")
    )
    # Looking ahead is looking back in descending order: frames that only grow
    # are computed in one pass, frames that shrink would start over at every row.
    so_far = (Window.unboundedPreceding, -1)

    def nearest(column: str, window) -> Column:
        return F.last(column, ignorenulls=True).over(window.rowsBetween(*so_far))

    carried = blocks.select(
        "_block",
        nearest("_first", Window.orderBy(F.desc("_block"))).alias("_later"),
        nearest("_last", Window.orderBy("_block")).alias("_earlier"),
    )
    inside = Window.partitionBy("_block")
    found = blocked.join(carried, "_block").withColumns({
        after: F.coalesce(nearest("_value", inside.orderBy(F.desc(order))), F.col("_later")),
        before: F.coalesce(nearest("_value", inside.orderBy(order)), F.col("_earlier")),
    })
    return found.drop("_block", "_later", "_earlier", "_value")


def running_sum(df: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over each row and the rows before it."""
    blocked = _blocked(df.withColumn("_value", value), order)
    blocks = blocked.groupBy("_block").agg(F.sum("_value").alias("_summary"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "_block", F.coalesce(F.sum("_summary").over(before), F.lit(0)).alias("_carry")
    )
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    walked = blocked.withColumn("_inside", F.sum("_value").over(inside)).drop("_value")
    return walked.join(carried, "_block").withColumn(out, F.col("_inside") + F.col("_carry")).drop("_block", "_carry", "_inside")


def running(df: DataFrame, order: str, sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """Several at once, each up to and with its row: sums, and last non-NULL values."""
    named = {f"_value{i}": value for i, value in enumerate([*sums.values(), *lasts.values()])}
    blocked = _blocked(df.withColumns(named), order)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    of_block, carried, walked, found = [], [F.col("_block")], {}, {}
    for i, out in enumerate([*sums, *lasts]):
        value, carry = f"_value{i}", f"_carry{i}"
        if out in sums:
            of_block.append(F.sum(value).alias(value))
            carried.append(F.coalesce(F.sum(value).over(before), F.lit(0)).alias(carry))
            walked[f"_inside{i}"] = F.coalesce(F.sum(value).over(inside), F.lit(0))
            found[out] = F.col(f"_inside{i}") + F.col(carry)
        else:
            at = F.when(F.col(value).isNotNull(), F.col(order))
            of_block.append(F.max_by(value, at).alias(value))
            carried.append(F.last(value, ignorenulls=True).over(before).alias(carry))
            walked[f"_inside{i}"] = F.last(value, ignorenulls=True).over(inside)
            found[out] = F.coalesce(f"_inside{i}", carry)
    blocks = blocked.groupBy("_block").agg(*of_block).select(*carried)
    spare = ["_block", *walked, *[f"_carry{i}" for i in range(len(named))]]
    inner = blocked.withColumns(walked).drop(*named).filter("_block IS NOT NULL")
    return inner.join(blocks, "_block", "left").withColumns(found).drop(*spare)
