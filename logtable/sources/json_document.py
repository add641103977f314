"""One JSON object of any size, read in splits.

A document is read as the pieces between its commas. Of each piece only effects are kept:
how many quotes it holds, and how it moves the depth of brackets if it starts outside or
inside a string. Running sums of these tell where each piece stands, so that commas between
members of the object, and between entries of its members, are known from commas in strings
and deeper down. Only the pieces of one entry are put together again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logtable.plans.ordered import running
from logtable.plans.staging import stage
from logtable.sources.lines import read_lines

HEAD = r'\A\s*\{?\s*"[^"]*"\s*:\s*'


class NotOneDocument(ValueError):
    """The text is not one whole JSON object."""


@dataclass(frozen=True)
class Document:
    """Entries ``(entry, member, depth, text)``, and by name each member's number and first entry."""

    entries: DataFrame
    members: dict[str, tuple[int, int]]

    def member(self, name: str) -> DataFrame:
        """``text`` of each entry of an array or object; none if it is absent, empty or null."""
        if name not in self.members:
            return self.entries.select("text").limit(0)
        number, first = self.members[name]
        headless = F.regexp_replace(F.regexp_replace("text", HEAD, ""), r"\A[\[{]", "")
        text = F.when(F.col("entry") == first, headless).otherwise(F.col("text"))
        # What closes the member, and the document behind it.
        text = (F.when(F.col("depth") == 2, text)
                .when(F.col("depth") == 1, F.regexp_replace(text, r"\s*[\]}]\s*\z", ""))
                .otherwise(F.regexp_replace(text, r"\s*[\]}]?\s*[\]}]\s*\z", "")))
        chosen = self.entries.filter(F.col("member") == number)
        return chosen.select(F.trim(text).alias("text")).filter("text NOT IN ('', 'null')")

    def small(self, *names: str) -> dict:
        """Members that a person writes, whole, as Python values."""
        numbers = [self.members[name][0] for name in names if name in self.members]
        texts = []
        for row in self.entries.filter(F.col("member").isin(numbers)).orderBy("entry").collect():
            text = row["text"].strip()
            text = text[1:] if row["entry"] == 0 else text
            texts.append(text[:-1] if row["depth"] == 0 else text)
        return json.loads(f"{{{','.join(texts)}}}")


def _count(text: Column, char: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(char), F.lit("")))


def _depth_change(text: Column) -> Column:
    """Of a text that starts outside strings: brackets opened less brackets closed."""
    bare = F.when(F.contains(text, F.lit('"')), F.regexp_replace(text, r'"[^"]*("|\z)', "")).otherwise(text)
    change = _count(bare, "[") + _count(bare, "{") - _count(bare, "]") - _count(bare, "}")
    return F.when(text.rlike(r"[\[\]{}]"), change).otherwise(0).cast("bigint")


def _placed_pieces(pieces: DataFrame) -> DataFrame:
    """For each piece, without its text: its member and entry, the depth at its end, and
    whether the comma after it ends the entry.

    A backslash never stands before a comma, so no piece starts within an escape.
    """
    escaped = F.contains("value", F.lit("\\"))
    clean = F.when(escaped, F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    texts, clean = pieces.select("line_no", clean.alias("_clean")), F.col("_clean")
    effects = stage(texts.select(
        "line_no",
        (_count(clean, '"') % 2).cast("bigint").alias("_quotes"),
        _depth_change(clean).alias("_outside"), _depth_change(F.concat(F.lit('"'), clean)).alias("_inside"),
    ))
    ends = pieces.groupBy("file").agg(F.max("line_no").alias("line_no")).select("line_no", F.lit(False).alias("_comma"))
    effects = effects.join(ends, "line_no", "left").withColumn("_comma", F.coalesce("_comma", F.lit(True)))
    # Staged, as the sums behind it read it twice.
    quoted = stage(running(effects, "line_no", {"_open": F.col("_quotes")}, {}))
    change = F.when((F.col("_open") - F.col("_quotes")) % 2 == 1, F.col("_inside")).otherwise(F.col("_outside"))
    deep = stage(running(quoted, "line_no", {"depth": change}, {}).select(
        "line_no", "depth", "_comma", (F.col("_open") % 2 == 1).alias("_in_text")))
    ends_entry = F.col("_comma") & ~F.col("_in_text") & (F.col("depth") <= 2)
    ends_member = ends_entry & (F.col("depth") == 1)
    counted = running(deep, "line_no", {
        "_entries": ends_entry.cast("bigint"), "_members": ends_member.cast("bigint")}, {})
    return stage(counted.select(
        "line_no", "depth", "_in_text", ends_entry.alias("_ends"),
        (F.col("_entries") - ends_entry.cast("bigint")).alias("entry"),
        (F.col("_members") - ends_member.cast("bigint")).alias("member"),
        F.when(F.col("_comma") & ~ends_entry, ",").otherwise("").alias("_glue"),
    ))


def read_json_document(spark: SparkSession, path: str) -> Document:
    """A JSON object from a file, or from a folder of files that are one document when they
    are read in the order of their names; none of them may end with a comma.

    White space and the order of members do not matter; of members of one name the last
    counts. A text that ends within a string or a bracket is refused.
    """
    pieces = read_lines(spark, path, sep=",")
    placed = _placed_pieces(pieces)
    last = placed.agg(F.max_by(F.struct("depth", "_in_text"), "line_no").alias("end")).first()["end"]
    if last is None or last["depth"] or last["_in_text"]:
        raise NotOneDocument(f"not one JSON document: {path}")
    parts = pieces.select("line_no", "value").join(placed, "line_no")
    # An entry is in one member. Its pieces are dealt out as they are, not as lists of one.
    gathered = parts.repartition("entry").groupBy("entry").agg(
        F.min("member").alias("member"),
        F.sort_array(F.collect_list(F.struct("line_no", "value", "_glue"))).alias("parts"),
        F.max_by("depth", "line_no").alias("depth"),
    )
    text = F.array_join(F.transform("parts", lambda part: F.concat(part["value"], part["_glue"])), "")
    entries = stage(gathered.select("entry", "member", "depth", text.alias("text")))
    firsts = entries.groupBy("member").agg(
        F.min("entry").alias("first"),
        F.min_by(F.regexp_extract("text", r'\A\s*\{?\s*"([^"]*)"\s*:', 1), "entry").alias("name"))
    named = firsts.groupBy("name").agg(F.max(F.struct("member", "first")).alias("at"))
    return Document(entries, {row["name"]: tuple(row["at"]) for row in named.collect()})
