r"""Chat formatting with Spark expressions only.

A conversation becomes one text. Adjacent turns of one role share a block::

    ### Assistant: first text<part/>second text</turn>\n

Inside roles and texts ``\``, ``#`` and ``<`` are written ``\s``, ``\h`` and ``\l`` (in roles
also ``:`` as ``\c`` and a line end as ``\n``), so no control string can occur in them and
each can be read back by plain splitting. The loss mask is a list of spans, in code points
of the formatted text, one for each turn of a role that is learnt.

Turns are formatted in runs of ``RUN`` turns, and a conversation only joins its runs, so
that a very long one is sorted and escaped by many tasks.

Defined results: a null role or text counts as empty; turns are ordered by number (null
first), then by role and text; rows that repeat are turns of their own; a null conversation
id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logtable.llm.common import whole

OPEN, NAME_END, PART, CLOSE = "### ", ": ", "<part/>", "</turn>\n"
#: In this order when writing, in the opposite order when reading.
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))
RUN = 256
#: Characters of the pieces that spans are cut from.
PIECE = 4096
LEARNT = "assistant"


def escaped(text: Column, escapes=ESCAPES) -> Column:
    for raw, safe in escapes:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    for raw, safe in reversed(escapes):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_chats(turns: DataFrame, learnt: str = LEARNT) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` (array of start and length) from rows of
    ``conv_id``, ``turn``, ``role``, ``text``."""
    rows = turns.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"))
    # Turn numbers are cut into runs; turns of one number are always in one run.
    rows = rows.withColumn("run", F.expr(f"turn div {RUN}"))
    runs = rows.groupBy("conv_id", "run").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # Adjacent turns of one role are merged: a turn opens a block if the one before has another role.
    def opens(i: Column) -> Column:
        return (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"])

    pieces = F.transform("turns", lambda t, i: F.struct(
        t["role"].alias("role"), opens(i).alias("opens"), escaped(t["text"]).alias("text")))
    runs = runs.select("conv_id", "run", pieces.alias("pieces"))
    parts = runs.select(
        "conv_id", "run",
        F.get("pieces", F.lit(0))["role"].alias("first_role"),
        F.element_at("pieces", -1)["role"].alias("last_role"),
        # What stands before each text; the first text's lead is settled when runs are joined.
        F.transform("pieces", lambda p, i: F.when(i == 0, "").otherwise(_lead(p["role"], p["opens"]))).alias("leads"),
        F.transform("pieces", lambda p: p["text"]).alias("texts"),
        F.transform("pieces", lambda p: p["role"] == learnt).alias("learnt"),
    )
    parts = parts.select(
        "conv_id", "run", "first_role", "last_role",
        F.array_join(F.zip_with("leads", "texts", lambda a, b: F.concat(a, b)), "").alias("body"),
        # Of each text: characters before it in the run, its own, and whether it is learnt.
        F.transform(
            F.aggregate(
                F.zip_with("leads", "texts", lambda a, b: F.struct(F.char_length(a).cast("long").alias("a"), F.char_length(b).cast("long").alias("b"))),
                F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
                lambda acc, x: F.struct(
                    (acc["at"] + x["a"] + x["b"]).alias("at"),
                    F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["a"]).alias("start"), x["b"].alias("length")))).alias("spans")),
                lambda acc: acc["spans"],
            ),
            lambda s, i: F.struct(s["start"].alias("start"), s["length"].alias("length"), F.get("learnt", i).alias("learnt")),
        ).alias("spans"),
    )
    # Joining runs: a window over the runs of a conversation, one row per RUN turns.
    order = Window.partitionBy("conv_id").orderBy("run")
    previous = F.lag("last_role").over(order)
    first = F.row_number().over(order) == 1
    lead = F.when(first, F.concat(F.lit(OPEN), escaped(F.col("first_role"), ROLE_ESCAPES), F.lit(NAME_END))).otherwise(
        _lead(F.col("first_role"), ~previous.eqNullSafe(F.col("first_role"))))
    joined = parts.withColumn("lead", lead).withColumn(
        "length", F.char_length("lead").cast("long") + F.char_length("body"))
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = joined.withColumn("before", before).select(
        "conv_id", "run", F.concat("lead", "body").alias("piece"),
        F.transform(
            F.filter("spans", lambda s: s["learnt"]),
            lambda s: F.struct((s["start"] + F.col("before") + F.char_length("lead")).alias("start"), s["length"].alias("length")),
        ).alias("spans"),
    )
    whole_chat = F.sort_array(F.collect_list(F.struct("run", "piece", "spans")))
    chats = placed.groupBy("conv_id").agg(whole_chat.alias("runs"))
    return chats.select(
        "conv_id",
        F.concat(F.array_join(F.transform("runs", lambda r: r["piece"]), ""), F.lit(CLOSE)).alias("formatted"),
        F.flatten(F.transform("runs", lambda r: r["spans"])).alias("loss_spans"),
    )


def _lead(role: Column, opens: Column) -> Column:
    block = F.concat(F.lit(CLOSE + OPEN), escaped(role, ROLE_ESCAPES), F.lit(NAME_END))
    return F.when(opens, block).otherwise(F.lit(PART))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask: what the ``spans`` cut out of ``formatted``, one after the other.

    Each span is cut out of the few pieces of ``PIECE`` characters that it meets, as cutting
    it out of the whole text would read that from its start for every span.
    """
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(pieces: Column, span: Column) -> Column:
        first = F.floor(span["start"] / PIECE).cast("int")
        last = F.floor((span["start"] + span["length"]) / PIECE).cast("int")
        met = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return unescaped(F.substr(met, (span["start"] % PIECE + 1).cast("int"), span["length"].cast("int")))

    # As variables of a function, the pieces are made once and not for every span.
    once = F.array(F.struct(pieces.alias("pieces"), spans.alias("spans")))
    texts = F.transform(once, lambda x: F.array_join(F.transform(x["spans"], lambda s: cut(x["pieces"], s)), ""))
    return F.element_at(texts, 1)


def read_chats(chats: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``turns`` (array of role and text), read from ``formatted`` alone,
    and ``loss``, the text that ``loss_spans`` mark in it."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")
    parsed = F.transform(blocks, lambda b: F.struct(
        unescaped(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), NAME_END, 1), ROLE_ESCAPES).alias("role"),
        F.split(F.substr(b, F.locate(NAME_END, b) + len(NAME_END)), PART, -1).alias("texts")))
    turns = F.flatten(F.transform(parsed, lambda b: F.transform(
        b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text")))))
    return chats.select("conv_id", "formatted", turns.alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
