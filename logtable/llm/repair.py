"""Repair of conversations by the cheapest edits, with the edits as an audit string.

A repaired conversation is empty, or an optional system turn and then user and assistant turns
in turn, ending with an assistant. Each row is Kept (free), Reroled to user or assistant (3) or
Deleted (4), and empty user or assistant turns are Inserted anywhere (3). Rows that are blank or
repeat an earlier role and text of their conversation must be deleted; truncated rows (they end
in none of ``.!?``) cost 3 more unless deleted. Among the cheapest, the ASCII-least string of
initials is the audit; it determines the repaired turns.

How it is worked out: rows are sorted by conversation and turn over all tasks, and staged. Each
becomes one letter (what its role begins with, and its fault), and runs of at most ``RUN`` rows
of a conversation become a text of such letters. The audit DP of :mod:`logtable.llm.trails` goes
through each run by itself, from every state it may start in, and gives the best audit and cost
to every state it may end in; then through the runs of each conversation, as steps in their own
right. So no task follows a long conversation row by row but the last one, which writes the
repaired turns as it reads them; it holds one row at a time.

Why runs may be solved apart: inserts are counted to the row behind them, so the audits of one
run all end with a row's own letter. Of two that differ, none begins the other, and whatever
follows, the first difference decides.

Defined results: null roles and texts count as one space; rows go by turn, nulls first, then
role, then text; a null conversation is one of its own; rows that repeat are duplicates; an
empty role has no initial and is never kept. Cells of one conversation's audit hold a letter
for each edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logtable.llm.common import SPACES
from logtable.llm.trails import Step, Trails, cheapest
from logtable.plans.staging import stage

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of one conversation that a task follows at once, at most.
RUN = 4096
#: What a role begins with; faults in the order in which they count.
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INSERTED = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: How many inserts end a conversation from each state: none after an assistant turn, or if there is nothing.
CLOSING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
ROLES = {"u": "user", "a": "assistant"}
#: What may stand for a row in an audit, in ASCII order; a label is a place in this list.
EDITS = sorted("I" * n + letter for n in range(3) for letter in "DKR")
FIRST_LETTER = ord("A")


def letter_of(initial: Column, fault: Column) -> Column:
    """One letter for a row: A to P."""
    role = F.coalesce(*[F.when(initial == one, F.lit(i)) for i, one in enumerate(INITIALS)], F.lit(len(INITIALS)))
    return F.char(F.lit(FIRST_LETTER) + 4 * fault + role)


def read_letter(letter: str) -> tuple[str, str]:
    """The initial ('' for any other) and the fault that a letter stands for."""
    fault, role = divmod(ord(letter) - FIRST_LETTER, 4)
    return (INITIALS + " ")[role].strip(), FAULTS[fault]


@cache
def ways(letter: str) -> tuple[Step, ...]:
    """The best way past a row from each state to each state."""
    initial, fault = read_letter(letter)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for old in range(STATES):
        state = old
        for inserts in range(3):
            before, cost = "I" * inserts, INSERT * inserts
            found = [(state, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault == "truncated" else 0
                found += [(NEXT.get((state, initial)), extra, "K")]
                found += [(NEXT.get((state, role)), extra + REROLE, "R") for role in ROLES]
            for new, own, edit in found:
                if new is not None:
                    way = (cost + own, before + edit)
                    best[old, new] = min(best.get((old, new), way), way)
            state = NEXT[state, INSERTED[state]]
    return tuple(Step(old, new, cost, EDITS.index(edit)) for (old, new), (cost, edit) in sorted(best.items()))


class Piece(NamedTuple):
    """The best audit of a run from state ``old`` to state ``new``. ``rank`` orders the run's audits."""

    old: int
    new: int
    cost: int
    rank: int
    audit: str


def pieces(letters: str, entries: Iterable[int]) -> list[Piece]:
    found = []
    for entry in entries:
        trails = Trails()
        for new, (cost, node) in sorted(cheapest(trails, map(ways, letters), entry).items()):
            labels, _ = trails.back(node)
            found.append((entry, new, cost, "".join([EDITS[label] for label in labels])))
    ranks = {audit: i for i, audit in enumerate(sorted({f[3] for f in found}))}
    return [Piece(old, new, cost, ranks[audit], audit) for old, new, cost, audit in found]


def best_route(runs: Iterable[list[Step]]) -> tuple[int, list[int], int]:
    """The cost of the best way through the runs of a conversation, the state after each run,
    and the inserts that end it."""
    trails = Trails()
    ends = [
        (cost + INSERT * CLOSING[state], node, CLOSING[state]) for state, (cost, node) in cheapest(trails, runs, NOTHING).items()]
    best = ends[0]
    for end in ends[1:]:
        if end[0] < best[0] or (end[0] == best[0] and trails.less(end[1], "I" * end[2], best[1], "I" * best[2])):
            best = end
    return best[0], trails.back(best[1])[1], best[2]


def replay(letters: str, audit: str, state: int) -> Iterator[tuple[str, str]]:
    """For each row of a run: initials inserted before it, and what it becomes: D, K, u or a."""
    edits, before = iter(audit), ""
    for letter in letters:
        before = ""
        while (edit := next(edits)) == "I":
            before += INSERTED[state]
            state = NEXT[state, before[-1]]
        if edit == "R":
            edit = INSERTED[state]
            state = NEXT[state, edit]
        elif edit == "K":
            state = NEXT[state, read_letter(letter)[0]]
        yield before, edit


def closing(state: int, inserts: int) -> str:
    """The initials of the turns that end a conversation."""
    out = ""
    for _ in range(inserts):
        out += INSERTED[state]
        state = NEXT[state, out[-1]]
    return out


class Repair(NamedTuple):
    """``conversations``: a row for each with gaps, blank, duplicate, truncated, illegal, cost
    and audit. ``turns``: the repaired turns, conv_id, place, role, text, and with the last turn
    of each conversation the ``digest`` of all of them (SHA-256 of ``role:text`` lines)."""

    conversations: DataFrame
    turns: DataFrame


def ordered_rows(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Staged rows with their order ``at``, their letter but for repeats, and their run's number."""
    read = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    placed = read.orderBy(*order).withColumn("at", F.monotonically_increasing_id())
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return stage(placed.withColumns({
        "initial": F.substring("role", 1, 1), "fault": fault, "run": F.expr(f"at div {RUN}"),
        "said": F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text"), 256)}))


def runs_of(rows: DataFrame) -> DataFrame:
    """A row for each run: conv_id, run, whether it is the conversation's first, its letters."""
    slim = rows.select("conv_id", "run", "at", "initial", "fault", "said")
    firsts = slim.groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first_said"))
    fault = F.when(F.col("fault") == 1, 1).when(F.col("first_said").isNull(), 2).otherwise(F.col("fault"))
    lettered = slim.join(firsts, "at", "left").select(
        "conv_id", "run", F.struct("at", letter_of(F.col("initial"), fault).alias("letter")).alias("row"))
    sorted_rows = F.array_sort(F.collect_list("row"))
    runs = lettered.groupBy("conv_id", "run").agg(F.array_join(F.transform(sorted_rows, lambda r: r["letter"]), "").alias("letters"))
    return runs.withColumn("opens", F.row_number().over(Window.partitionBy("conv_id").orderBy("run")) == 1)


def solved(runs: DataFrame) -> DataFrame:
    """``runs`` with the best audits from each state that they may start in to each state."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                pieces(letters.as_py(), (NOTHING,) if opens.as_py() else range(STATES))
                for letters, opens in zip(batch.column("letters"), batch.column("opens"))]
            columns = {
                "ways": pa.array([[v for p in some for v in p[:4]] for some in found], pa.list_(pa.int64())),
                "audits": pa.array([[p.audit for p in some] for some in found], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])

    schema = runs.withColumns({"ways": F.lit(None).cast("array<long>"), "audits": F.lit(None).cast("array<string>")}).schema
    return stage(runs.mapInArrow(solve, schema))


def routed(runs: DataFrame) -> DataFrame:
    """For each run of each conversation: its place among ``audits``, its first state, the turns
    that end the conversation (with the last run), and the conversation's cost (with the first)."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(conv, numbers, steps):
            cost, states, inserts = best_route(steps)
            old, out = NOTHING, []
            for i, (number, some, new) in enumerate(zip(numbers, steps, states)):
                place = next(j for j, s in enumerate(some) if (s.old, s.new) == (old, new))
                end = closing(new, inserts) if i == len(steps) - 1 else ""
                out.append((conv, number, place, old, end, cost if i == 0 else 0))
                old = new
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], ["conv_id", "run", "place", "state", "end", "cost"])

        kinds, held, numbers, steps = None, None, [], []
        for batch in batches:
            kinds = kinds or [batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
            for conv, run, flat in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "run", "ways")]):
                if steps and conv != held:
                    yield close(held, numbers, steps)
                    numbers, steps = [], []
                held = conv
                numbers.append(run)
                steps.append([Step(*flat[i : i + 4]) for i in range(0, len(flat), 4)])
        if steps:
            yield close(held, numbers, steps)

    dealt = runs.select("conv_id", "run", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "run")
    schema = runs.select(
        "conv_id", "run", F.lit(0).alias("place"), F.lit(0).alias("state"), F.lit("").alias("end"),
        F.lit(0).cast("long").alias("cost")).schema
    return dealt.mapInArrow(route, schema)


def counted(runs: DataFrame) -> DataFrame:
    """Each conversation's faults and adjacent initials that do not follow each other."""
    def letters_with(fault: str) -> str:
        return "".join(chr(FIRST_LETTER + 4 * FAULTS.index(fault) + i) for i in range(4))

    every = "".join(map(letters_with, FAULTS))
    plain = F.translate("letters", every, "suax" * len(FAULTS))
    before = Window.partitionBy("conv_id").orderBy("run")
    joined = runs.withColumn("plain", F.concat(F.coalesce(F.lag(F.right(plain, F.lit(1))).over(before), F.lit("")), plain))
    # Legal pairs overlap: each is marked by what its first letter is followed by.
    legal = F.regexp_count("plain", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    counts = {f: F.sum(F.char_length("letters") - F.char_length(F.translate("letters", letters_with(f), ""))) for f in FAULTS[1:]}
    return joined.groupBy("conv_id").agg(
        *[c.cast("long").alias(f) for f, c in counts.items()],
        F.sum(F.char_length("plain") - 1 - legal).cast("long").alias("illegal"))


def repaired_turns(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The repaired turns in order, written as their rows are read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"conv": None, "place": 0, "digest": hashlib.sha256(), "edits": iter(()), "end": "", "open": False}
        names = ["conv_id", "place", "role", "text", "digest"]

        def turn(out, role, text):
            line = f"{role}:{text}".encode()
            state["digest"].update((b"\n" if state["place"] else b"") + line)
            out.append([state["conv"], state["place"], role, text, None])
            state["place"] += 1

        def close(out):
            for initial in state["end"]:
                turn(out, ROLES[initial], "")
            if state["place"]:
                # The last turn may have gone out with an earlier batch, so the digest has a row of its own.
                out.append([state["conv"], state["place"], None, None, state["digest"].hexdigest()])

        def as_batch(out):
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, [kind, pa.int64(), pa.string(), pa.string(), pa.string()])], names)

        kind = None
        for batch in batches:
            kind, out = kind or batch.schema.field("conv_id").type, []
            for row in batch.to_pylist():
                if row["head"]:
                    if not state["open"] or row["conv_id"] != state["conv"]:
                        if state["open"]:
                            close(out)
                        state.update(conv=row["conv_id"], place=0, digest=hashlib.sha256(), open=True)
                    state.update(edits=replay(row["role"], row["text"], row["state"]), end=row["end"])
                    continue
                before, edit = next(state["edits"])
                for initial in before:
                    turn(out, ROLES[initial], "")
                if edit != "D":
                    turn(out, row["role"] if edit == "K" else ROLES[edit], row["text"])
            yield as_batch(out)
        if state["open"]:
            out = []
            close(out)
            yield as_batch(out)

    # A run's head comes before its rows: its letters and audit stand where role and text do.
    heads = chosen.select(
        "conv_id", "run", F.lit(True).alias("head"), F.lit(-1).cast("long").alias("at"), F.col("letters").alias("role"),
        F.col("audit").alias("text"), "state", "end")
    body = rows.select(
        "conv_id", "run", F.lit(False).alias("head"), "at", "role", "text", F.lit(None).cast("int").alias("state"),
        F.lit(None).cast("string").alias("end"))
    dealt = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "run", "at")
    schema = rows.select(
        "conv_id", F.lit(0).cast("long").alias("place"), "role", "text", F.lit("").alias("digest")).schema
    for field in schema.fields:
        field.nullable = True
    return dealt.mapInArrow(write, schema)


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The faults, the cheapest audit and the repaired turns of each conversation."""
    rows = ordered_rows(turns, conv_id, turn, role, text)
    runs = solved(runs_of(rows))
    route = stage(routed(runs))
    of = route.withColumnsRenamed({"conv_id": "of", "run": "of_run"})
    chosen = runs.join(of, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("run") == F.col("of_run"))).select(
        "conv_id", "run", "letters", F.col("audits")[F.col("place")].alias("audit"), "state", "end", "cost")
    chosen = stage(chosen)
    closed = F.concat("audit", F.repeat(F.lit("I"), F.char_length("end")))
    in_order = F.array_sort(F.collect_list(F.struct("run", closed.alias("audit"))))
    audits = chosen.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(in_order, lambda r: r["audit"]), "").alias("audit"))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    parts = [gaps, counted(runs), audits]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    return Repair(joined, repaired_turns(rows, chosen))
