"""Device-information dumps: COPY blocks and INSERT statements."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logtable.functions.text import gfold, gtrim
from logtable.operators.rows import LINE_NO
from logtable.plans.ordered import running_last, running_sum
from logtable.plans.staging import stage
from logtable.sources.lines import read_lines

RAW = (
    "category", "id", "time", "field_name", "field_value", "field_value_lc", "agentid", "extra",
)

# How the parts of a dump announce themselves.
COPY_START = "copy public.devinfo"
COPY_SOURCE = "from stdin"
COPY_END = r"\."
INSERT_START = "insert into public.devinfo"

# What a line is read as: nothing, a COPY row, an INSERT before its VALUES, or
# tuples, outside or inside quotes.
OUT, COPY, HEAD, TUPLES, QUOTED = range(5)

# Neighbouring lines, or blocks of them, whose effects are put together at each level.
FAN = 1 << 16
STATES = 5

TOKEN = r"'(?:[^']++|'')*+'|[(),]|[^'(),]+"

# A quoted value; what stands before a tuple and, without brackets, in it; a value behind its
# comma. Possessive groups are matched by a loop, not by recursion.
QUOTE = r"'((?:[^']++|'')*+)'"
_Q = r"'(?:[^']++|'')*+'"
_BETWEEN, _WITHIN = rf"(?:[^'(]++|{_Q})*+", rf"(?:[^'()]++|{_Q})*+"
FLAT = rf"\A(?:{_BETWEEN}\({_WITHIN}\))*+{_BETWEEN}\z"
TUPLE = rf"\G{_BETWEEN}\(({_WITHIN})\)"
VALUE = rf"\G,((?:[^',]++|{_Q})*+)"


# --- COPY rows ----------------------------------------------------------------

def copy_unescape(col: Column, escapes: str = "doubled") -> Column:
    """Undo COPY escapes, left to right.

    ``doubled`` knows escapes written with two backslashes and lets single ones
    pass; ``postgres`` knows the single ones a server writes.
    """
    slash = "\\\\" if escapes == "doubled" else "\\"
    letters = {"t": "\t", "n": "\n", "r": "\r"}
    if escapes == "postgres":
        letters |= {"b": "\b", "f": "\f", "v": "\v"}

    def undo(part: Column) -> Column:
        for letter, char in letters.items():
            part = F.replace(part, F.lit(slash + letter), F.lit(char))
        return F.regexp_replace(part, r"\\(.)", "$1") if escapes == "postgres" else part

    parts = F.split(col, re.escape(slash * 2), -1)
    undone = F.array_join(F.transform(parts, undo), slash)
    return (
        F.when(col == slash + "N", "").when(F.contains(col, F.lit(slash)), undone).otherwise(col)
    )


def _copy_fields(value: Column, escapes: str) -> Column:
    fields = F.split(value, "\t", -1)
    undone = F.transform(fields, lambda field: copy_unescape(field, escapes))
    return F.when(F.contains(value, F.lit("\\")), undone).otherwise(fields)


# --- INSERT statements ----------------------------------------------------------

# An effect says, for each state a line or a block may start in, what it ends in, and what
# becomes of the depth of brackets: it is raised to ``-lowest`` at least (a bracket too many
# closes nothing) and moved by ``moved``, or counted afresh. So effects of neighbours combine
# in closed form, at any depth, and a block is read without knowing what stands before it.
EFFECT = "array<struct<state:int,moved:int,lowest:int,afresh:boolean>>"


def _effect_of(state, moved=0, lowest=0, afresh=True) -> Column:
    values = (state, moved, lowest, afresh)
    state, moved, lowest, afresh = (v if isinstance(v, Column) else F.lit(v) for v in values)
    return F.struct(
        state.cast("int").alias("state"), moved.cast("int").alias("moved"),
        lowest.cast("int").alias("lowest"), afresh.alias("afresh"),
    )


def _scan(text: Column, quoted: bool, afresh: bool) -> Column:
    """The effect of a piece of a VALUES list that starts inside or outside quotes."""
    outside = F.regexp_replace(F.concat(F.lit("'" if quoted else ""), text), "'[^']*'?", "")
    quotes = F.char_length(text) - F.char_length(F.replace(text, F.lit("'"), F.lit("")))
    ends_in = F.lit(TUPLES) + F.pmod(quotes + int(quoted), F.lit(2))
    brackets = F.regexp_replace(outside, "[^()]+", "")
    opened = F.char_length(F.replace(brackets, F.lit(")"), F.lit("")))
    moved = 2 * opened - F.char_length(brackets)
    walked = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, c: F.struct(
            (acc["at"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("at"),
            F.least(acc["low"], acc["at"] + F.when(c == ")", -1).otherwise(0)).alias("low"),
        ),
        lambda acc: acc["low"],
    )
    lowest = F.when(brackets.rlike(r"^(?:\(\))*+\(*+$"), 0).otherwise(walked)
    return F.when(F.contains(outside, F.lit(";")), _effect_of(OUT)).otherwise(
        _effect_of(ends_in, moved, lowest, F.lit(afresh)))


def _line_effect(value: Column, kind: Column) -> Column:
    at = F.instr(F.translate(value, "VALUES", "values"), "values")
    before, after = F.substring(value, F.lit(1), at - 1), F.substring(value, at + len("values"), F.char_length(value))
    ended = F.when(F.contains(value, F.lit(";")), _effect_of(OUT)).otherwise(_effect_of(HEAD))
    head = (
        F.when(at == 0, ended).when(F.contains(before, F.lit(";")), _effect_of(OUT))
        .otherwise(_scan(after, False, True))
    )
    return F.array(
        F.when(kind == "copy", _effect_of(COPY)).when(kind == "insert", head).otherwise(_effect_of(OUT)),
        F.when(kind == "end", _effect_of(OUT)).otherwise(_effect_of(COPY)),
        head,
        _scan(value, False, False),
        _scan(value, True, False),
    ).cast(EFFECT)


class _Effects(NamedTuple):
    """Effects of neighbours in order: each a matrix with a row per line (or block) and a column
    per state that it may start in."""

    state: np.ndarray
    moved: np.ndarray
    lowest: np.ndarray
    afresh: np.ndarray

    @classmethod
    def read(cls, flat: pa.Array) -> _Effects:
        values = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, STATES)
        return cls(*[values[:, i].copy() for i in range(4)])

    def rows(self) -> pa.Array:
        values = np.stack(self, axis=1).reshape(len(self.state), -1).astype(np.int64)
        return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.int64()))

    def part(self, low: int | None, high: int | None) -> _Effects:
        return _Effects(*[column[low:high] for column in self])

    def then(self, later: _Effects) -> _Effects:
        """What each does, and the one of ``later`` after it."""
        state, moved, lowest, afresh = [np.take_along_axis(column, self.state, 1) for column in later]
        new = afresh != 0
        return _Effects(
            state, moved + np.where(new, 0, self.moved),
            np.where(new, lowest, np.minimum(self.lowest, self.moved + lowest)), afresh | self.afresh)

    def through(self) -> _Effects:
        """What all up to each do together, by doubling."""
        done, width = self, 1
        while width < len(self.state):
            ahead = done.part(None, -width).then(done.part(width, None))
            done = _Effects(*[np.concatenate([old[:width], new]) for old, new in zip(done, ahead)])
            width *= 2
        return done

    def starts(self, state: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What each starts in, given what the first starts in."""
        through = self.through().part(None, -1)
        before = np.where(through.afresh[:, state] != 0, 0, depth)
        depths = through.moved[:, state] + np.maximum(before, -through.lowest[:, state])
        return np.append(state, through.state[:, state]), np.append(depth, depths)


def _by_block(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the rows of each block, in the order of ``at``. A block has ``FAN`` at most.

    Blocks are groups to Spark, so it keeps the rows of each together. Partitions alone would
    not do: a repartition by the key of the join below it is left out of the plan, and once
    that join turns into a broadcast, adaptive execution reads its shuffle map by map.
    """

    def whole(block: pa.Table) -> pa.Table:
        return work(block.sort_by("at"))

    return rows.filter("block IS NOT NULL").groupBy("block").applyInArrow(whole, schema)


def _effects_of_blocks(rows: DataFrame) -> DataFrame:
    """``at`` (the block) and the ``effect`` of all its rows together."""

    def together(table: pa.Table) -> pa.Table:
        through = _Effects.read(table.column("effect").combine_chunks()).through()
        return pa.Table.from_arrays([table.column("block").combine_chunks().slice(0, 1), through.part(-1, None).rows()], ["at", "effect"])

    return _by_block(rows.select("block", "at", "effect"), together, "at long, effect array<long>")


def _starts_in_blocks(rows: DataFrame) -> DataFrame:
    """``at``, ``state`` and ``depth`` that each row starts in, from those of its block."""

    def told(table: pa.Table) -> pa.Table:
        effects = _Effects.read(table.column("effect").combine_chunks())
        found = effects.starts(table.column("state")[0].as_py(), table.column("depth")[0].as_py())
        return pa.Table.from_arrays([table.column("at").combine_chunks(), *[pa.array(f, pa.int64()) for f in found]], ["at", "state", "depth"])

    return _by_block(rows.select("block", "at", "effect", "state", "depth"), told, "at long, state long, depth long")


def _kind(value: Column) -> Column:
    text = gfold(gtrim(value))
    return (
        F.when(text.startswith(COPY_START) & F.contains(text, F.lit(COPY_SOURCE)), "copy")
        .when(text.startswith(INSERT_START), "insert")
        .when(text == COPY_END, "end")
        .otherwise("")
    )


def _labelled(lines: DataFrame) -> DataFrame:
    """Every line with the state and the depth of brackets that it starts in.

    A quoted value may hold text that looks like the start or the end of something, so a
    line can only be read once it is known what it starts in. Effects alone are combined, in
    blocks of ``FAN`` neighbours, then in blocks of blocks, and starts handed down again; they
    are a few numbers each, however long the lines. Lines meet their starts by number.
    """
    effect = F.flatten(F.array(*[
        F.transform("_effect", lambda e: e[part].cast("long")) for part in ("state", "moved", "lowest", "afresh")]))
    at, block = F.col("at"), F.expr(f"at div {FAN}").alias("block")
    effects = lines.select(F.col(LINE_NO).alias("at"), _line_effect(F.col("value"), F.col("_kind")).alias("_effect"))
    levels = [stage(effects.select(at, block, effect.alias("effect")))]
    while not levels[-1].filter("block != 0").isEmpty():
        levels.append(stage(_effects_of_blocks(levels[-1]).withColumn("block", block)))
    starts = None
    for level in reversed(levels):
        if starts is None:
            given = level.withColumns({"state": F.lit(OUT).cast("long"), "depth": F.lit(0).cast("long")})
        else:
            given = level.join(starts.withColumnRenamed("at", "block"), "block")
        starts = _starts_in_blocks(given)
    starts = stage(starts)
    last = levels[0].join(starts, "at").orderBy(F.desc("at")).limit(1).select(
        F.element_at("effect", (F.col("state") + 1).cast("int")).alias("ends_in")).first()
    if last and last["ends_in"] >= HEAD:
        raise ValueError("unterminated INSERT statement")
    told = starts.select(F.col("at").alias(LINE_NO), F.col("state").alias("_before"), F.col("depth").alias("_depth"))
    return lines.join(told, LINE_NO)


def _flat_rows(text: Column) -> Column:
    """The tuples of eight values in a piece without brackets in brackets."""

    def values(inside: Column) -> Column:
        # Between quoted values stands at least a character, so the quotes left are pairs.
        bare = F.transform(F.regexp_extract_all(F.concat(F.lit(","), inside), F.lit(VALUE), F.lit(1)), lambda value: F.when(
            F.contains(value, F.lit("'")), F.replace(F.regexp_replace(value, QUOTE, "$1"), F.lit("''"), F.lit("'"))).otherwise(value))
        return F.transform(F.transform(bare, gtrim), lambda value: F.when(gfold(value) == "null", "").otherwise(value))

    tuples = F.transform(F.regexp_extract_all(text, F.lit(TUPLE), F.lit(1)), values)
    return F.filter(tuples, lambda fields: F.size(fields) == len(RAW))


def _tuple_rows(pieces: DataFrame) -> DataFrame:
    """``(line_no, rows)``: the tuples of eight values in pieces of VALUES lists.

    A piece without brackets in brackets is cut where it stands; only others are put in tokens.
    """
    flat = F.col("text").rlike(FLAT)
    cut = stage(pieces.select(
        LINE_NO, F.when(flat, _flat_rows(F.col("text"))).alias("rows"), F.when(~flat, F.col("text")).alias("text")))
    rows = cut.filter(F.size("rows") > 0).select(LINE_NO, "rows")
    deep = cut.filter("text IS NOT NULL").select(LINE_NO, "text")
    return rows if deep.isEmpty() else rows.unionByName(_token_rows(deep))


def _token_rows(pieces: DataFrame) -> DataFrame:
    """:func:`_tuple_rows` of pieces with brackets in brackets, or with too few.

    Tokens are numbered in their piece; running sums over them give the depth of brackets
    (which no bracket too many lowers) and number the tuples and the values.
    """
    tokens = pieces.select(LINE_NO, "text", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    whole = F.char_length(F.array_join("tokens", "")) == F.char_length("text")
    malformed = F.raise_error(F.lit("malformed INSERT VALUES")).cast("boolean")
    tokens = tokens.filter(F.when(whole, True).otherwise(malformed)).select(LINE_NO, F.posexplode("tokens").alias("at", "part"))
    order = Window.partitionBy(LINE_NO).orderBy("at")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    part, depth = F.col("part"), F.col("depth")
    summed = tokens.withColumn("sum", F.sum(F.when(part == "(", 1).when(part == ")", -1).otherwise(0)).over(so_far))
    deep = summed.withColumn("after", F.col("sum") - F.least(F.min("sum").over(so_far), F.lit(0)))
    deep = deep.withColumn("depth", F.lag("after", 1, 0).over(order))
    closes = part.isin(",", ")") & (depth == 1)
    numbered = deep.withColumns({
        "tuple": F.sum(((part == "(") & (depth == 0)).cast("int")).over(so_far),
        "number": F.coalesce(F.sum(closes.cast("int")).over(earlier), F.lit(0)),
        "open": F.last("after").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).filter(F.when(F.col("open") > 0, malformed).otherwise(depth > 0))
    text = F.when(part.startswith("'"), F.replace(F.substring(part, F.lit(2), F.char_length(part) - 2), F.lit("''"), F.lit("'")))
    text = F.when(part.isin("(", ",", ")"), "").otherwise(F.coalesce(text, part))
    values = numbered.groupBy(LINE_NO, "tuple", "number").agg(
        gtrim(F.array_join(F.sort_array(F.collect_list(F.struct("at", text.alias("text"))))["text"], "")).alias("value"))
    filled = F.when(gfold("value") == "null", "").otherwise(F.col("value"))
    tuples = values.groupBy(LINE_NO, "tuple").agg(
        F.sort_array(F.collect_list(F.struct("number", filled.alias("value"))))["value"].alias("fields"))
    eight = tuples.filter(F.size("fields") == len(RAW)).groupBy(LINE_NO)
    return eight.agg(F.sort_array(F.collect_list(F.struct("tuple", "fields")))["fields"].alias("rows"))


def _mixed_rows(lines: DataFrame, escapes: str) -> DataFrame:
    """``(line_no, rows)`` of a dump that holds INSERT statements.

    A statement may hold most of the dump, so it is never put together: its
    lines are joined only as far as a tuple runs on.
    """
    labelled = stage(_labelled(lines))
    before, kind = F.col("_before"), F.col("_kind")
    copied = labelled.filter((before == COPY) & (kind != "end")).select(
        LINE_NO, _copy_fields(F.col("value"), escapes).alias("fields")
    ).filter(F.size("fields") == len(RAW)).select(LINE_NO, F.array("fields").alias("rows"))
    starts = (before == OUT) & (kind == "insert")
    opens = starts | ((before == TUPLES) & (F.col("_depth") == 0))
    inserted = running_last(
        labelled.filter(starts | (before >= HEAD)), LINE_NO, F.when(opens, F.col(LINE_NO)), "_piece"
    )
    pieces = inserted.groupBy("_piece").agg(
        F.sort_array(F.collect_list(F.struct(LINE_NO, "value"))).alias("_lines"),
        F.bool_or(starts).alias("_headed"),
    ).select(F.col("_piece").alias(LINE_NO), F.array_join("_lines.value", "\n").alias("text"), "_headed")
    at = F.instr(gfold("text"), "values")
    values = F.substring(F.col("text"), at + len("values"), F.char_length("text"))
    tuples = _tuple_rows(pieces.filter(~F.col("_headed") | (at > 0)).select(
        LINE_NO, F.when(F.col("_headed"), values).otherwise(F.col("text")).alias("text")
    ))
    return copied.unionByName(tuples)


def _copy_rows(lines: DataFrame, escapes: str) -> DataFrame:
    """``(line_no, rows)`` of a dump of COPY blocks only."""
    opens = F.when(F.col("_kind").isin("copy", "end"), F.col("_kind") == "copy")
    inside = running_last(lines, LINE_NO, opens, "_inside", inclusive=False)
    return inside.filter(F.col("_inside") & (F.col("_kind") != "end")).select(
        LINE_NO, F.explode(F.array(_copy_fields(F.col("value"), escapes))).alias("fields")
    ).filter(F.size("fields") == len(RAW)).select(LINE_NO, F.array("fields").alias("rows"))


def parse_devinfo(lines: DataFrame, escapes: str = "doubled") -> DataFrame:
    """Numbered dump lines to the eight raw columns.

    ``line_no`` counts the rows in dump order from 1, whatever statements they come from.
    Rows without exactly eight fields are skipped; an empty lower-case value is filled in
    from the value. A dump without INSERT takes a shorter way to the same rows.
    """
    lines = lines.select(LINE_NO, "value", _kind(F.col("value")).alias("_kind"))
    has_insert = not lines.filter(F.col("_kind") == "insert").isEmpty()
    rows = _mixed_rows(lines, escapes) if has_insert else _copy_rows(lines, escapes)
    numbered = running_sum(stage(rows), LINE_NO, F.size("rows"), "_through")
    each = numbered.select((F.col("_through") - F.size("rows") + 1).alias("_first"), F.posexplode("rows").alias("at", "fields"))
    cells = each.select(
        (F.col("_first") + F.col("at")).alias(LINE_NO), *[F.col("fields")[i].alias(c) for i, c in enumerate(RAW)]
    )
    folded = F.when(F.col("field_value_lc") == "", gfold("field_value"))
    return cells.withColumn("field_value_lc", F.coalesce(folded, F.col("field_value_lc")))


def read_devinfo_dump(
    spark: SparkSession, path: str, escapes: str = "doubled"
) -> DataFrame:
    """Read dump files, plain or gzip; the text ends lines with LF only."""
    lines = read_lines(spark, path, sep="\n")
    return parse_devinfo(
        lines.withColumn("value", F.regexp_replace("value", r"\r\z", "")), escapes
    )
