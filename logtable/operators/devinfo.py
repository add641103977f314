"""Entity tables out of entity-attribute-value dumps."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from logtable.functions.text import WHITE_SPACE, cell, gfold, gtrim
from logtable.operators.filters import search_term
from logtable.operators.rows import LINE_NO
from logtable.plans.ordered import Key
from logtable.plans.staging import stage

ENTITY = ["category", "id"]

# The columns of the decoded table, and the words for yes and no.
DECODED = (
    "group_category", "category", "id", "field_name", "field_label", "value",
    "raw_value", "time", "agentid", "extra", "desc",
)
TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")


@dataclass(frozen=True)
class GroupRules:
    """How a category names its group; a human-sized configuration."""

    nosplit: tuple[str, ...] = ()
    exact: Mapping[str, str] = field(default_factory=dict)
    prefix: Mapping[str, str] = field(default_factory=lambda: {"sw_": "sw"})


def group_of(category: Column, rules: GroupRules) -> Column:
    """nosplit, else exact, else longest prefix, else the text before the first ``_``."""
    raw = gtrim(category)
    group = F.when(raw.isin(*[n.strip(WHITE_SPACE) for n in rules.nosplit]), raw)
    targets = {k.strip(WHITE_SPACE): v.strip(WHITE_SPACE) for k, v in rules.exact.items()}
    targets = {k: v for k, v in targets.items() if v}
    if targets:
        table = F.create_map(*[F.lit(part) for pair in targets.items() for part in pair])
        group = group.when(F.map_contains_key(table, raw), F.try_element_at(table, raw))
    prefixes = {k.strip(WHITE_SPACE): v.strip(WHITE_SPACE) for k, v in rules.prefix.items()}
    for prefix in sorted(filter(None, prefixes), key=lambda p: (-len(p.encode()), p)):
        group = group.when(raw.startswith(prefix), F.lit(prefixes[prefix]))
    return group.when(F.instr(raw, "_") > 1, F.substring_index(raw, "_", 1)).otherwise(raw)


def with_group(df: DataFrame, rules: GroupRules = GroupRules()) -> DataFrame:
    return df.withColumn("group_category", group_of(F.col("category"), rules))


def with_group_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`with_group` for any number of rules: a table of ``kind`` (nosplit, exact or prefix),
    ``key`` and ``target``.

    Distinct categories meet the rules by hash joins: whole for nosplit and exact rules, and each
    of their beginnings for prefixes, of which the longest wins. So a rule more costs a row, not
    a comparison for every row of ``df``. Of rules that repeat a key, the least target counts.
    """
    keyed = rules.select("kind", gtrim(cell("key")).alias("_key"), gtrim(cell("target")).alias("_target")).filter(
        (F.col("_key") != "") & ((F.col("kind") != "exact") | (F.col("_target") != "")))
    keyed = keyed.groupBy("kind", "_key").agg(F.min("_target").alias("_target"))
    raw = gtrim(F.col("category"))
    categories = df.select("category", raw.alias("_raw")).filter("category IS NOT NULL").distinct()
    starts = F.transform(F.sequence(F.lit(1), F.char_length("_raw")), lambda n: F.struct(
        F.lit("prefix").alias("kind"), F.substring("_raw", F.lit(1), n).alias("key")))
    whole = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col("_raw").alias("key")) for kind in ("nosplit", "exact")])
    looked_up = categories.filter("_raw != ''").select("category", "_raw", F.explode(F.concat(whole, starts)).alias("_try"))
    met = looked_up.select(
        "category", "_raw", F.col("_try.kind").alias("kind"), F.col("_try.key").alias("_key")).join(keyed, ["kind", "_key"])
    # The first of these in order: nosplit, exact, then the longest prefix.
    rank = F.when(F.col("kind") == "nosplit", -2).when(F.col("kind") == "exact", -1).otherwise(0)
    best = met.groupBy("category").agg(F.min(F.struct(
        rank.alias("rank"), (-F.char_length("_key")).alias("length"),
        F.when(F.col("kind") == "nosplit", F.col("_raw")).otherwise(F.col("_target")).alias("group"))).alias("_best"))
    found = best.select(F.col("category").alias("_category"), F.col("_best.group").alias("_group"))
    plain = F.when(F.instr(raw, "_") > 1, F.substring_index(raw, "_", 1)).otherwise(raw)
    joined = df.join(found, F.col("category") == F.col("_category"), "left")
    return joined.withColumn("group_category", F.coalesce("_group", plain)).drop("_category", "_group")


def _seen(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.min(LINE_NO).alias("seen"))


def _named(raw: DataFrame) -> DataFrame:
    return raw.filter((F.col("category") != "") & (F.col("id") != ""))


def list_groups(raw: DataFrame, rules: GroupRules = GroupRules()) -> DataFrame:
    """The distinct groups and where each is first seen."""
    return _seen(with_group(_seen(_named(raw), "category").withColumnRenamed("seen", LINE_NO), rules),
                 "group_category")


def list_categories(raw: DataFrame) -> DataFrame:
    """The distinct categories and where each is first seen."""
    return _seen(_named(raw), "category")


def _spread(raw: DataFrame) -> DataFrame:
    """The named rows, dealt out evenly by their numbers. The first of several cells is found by
    a sort, which holds the rows of a task: without this, all that one split of a file gives."""
    return _named(raw).hint("rebalance", LINE_NO)


def _first_filled(column: str) -> Column:
    return F.min(F.when(F.col(column) != "", F.struct(LINE_NO, column)))


def fold_entities(raw: DataFrame) -> DataFrame:
    """One row per entity: the first non-empty agent, time and extra, and where seen."""
    return _spread(raw).groupBy(*ENTITY).agg(
        F.min(LINE_NO).alias("seen"),
        *[
            F.coalesce(_first_filled(c)[c], F.lit("")).alias(c)
            for c in ("agentid", "time", "extra")
        ],
    )


def fold_fields(raw: DataFrame) -> DataFrame:
    """One row per entity and field: its first value and where it was first seen."""
    fields = _spread(raw).filter(F.col("field_name") != "")
    first = F.min(F.struct(LINE_NO, "field_value", "field_value_lc"))
    return fields.groupBy(*ENTITY, "field_name").agg(first.alias("f")).select(
        *ENTITY, "field_name", F.col(f"f.{LINE_NO}").alias("field_seen"),
        F.col("f.field_value").alias("raw_value"), F.col("f.field_value_lc").alias("raw_value_lc"),
    )


def fold(raw: DataFrame, rules: GroupRules = GroupRules()) -> DataFrame:
    """Fields with the attributes of their entity, in one pass over the rows.

    First one row per entity and field, combined inside each task, that also carries what
    the field's rows say about the entity. It is staged: one row per entity is made of it and
    joined back, so that adaptive execution can split an entity that owns most fields.
    """
    place = F.col(LINE_NO)
    kept = {c: F.min(F.when(F.col(c) != "", F.struct(place, F.col(c)))).alias(c) for c in ("agentid", "time", "extra")}
    first = F.min(F.struct(place, "field_value", "field_value_lc")).alias("f")
    fields = stage(_spread(raw).groupBy(*ENTITY, "field_name").agg(first, *kept.values()))
    entities = fields.groupBy(*ENTITY).agg(
        F.min(F.col("f")[LINE_NO]).alias("seen"), *[F.coalesce(F.min(c)[c], F.lit("")).alias(c) for c in kept])
    own = fields.filter(F.col("field_name") != "").select(
        *ENTITY, "field_name", F.col(f"f.{LINE_NO}").alias("field_seen"),
        F.col("f.field_value").alias("raw_value"), F.col("f.field_value_lc").alias("raw_value_lc"))
    return with_group(own.join(entities, ENTITY), rules)


def norm_bool(text: Column) -> Column:
    """``'true'`` or ``'false'`` for the usual words, else NULL."""
    word = gfold(gtrim(text))
    return F.when(word.isin(*TRUE_WORDS), "true").when(word.isin(*FALSE_WORDS), "false")


def decode_value(raw: Column, folded: Column, mapping: Column) -> Column:
    """Apply a field mapping: yes/no words, then enumeration, then unit, then format."""
    yes_no = F.when(mapping["bool_normalize"], norm_bool(folded))
    coded = F.coalesce(
        F.try_element_at(mapping["enum"], raw), F.try_element_at(mapping["enum"], folded)
    )
    value = F.coalesce(coded, yes_no, raw)
    unit = F.coalesce(mapping["unit"], F.lit(""))
    value = F.when((unit != "") & (value != ""), F.concat_ws(" ", value, unit)).otherwise(value)
    shape = F.coalesce(mapping["format"], F.lit(""))
    return F.when(shape != "", F.call_function("format_string", shape, value)).otherwise(value)


def apply_mappings(fields: DataFrame, mappings: DataFrame) -> DataFrame:
    """The decoded table. A mapping for (group, field) wins over (category, field).

    ``mappings`` comes from :func:`logtable.sources.config.field_mappings`, which
    marks it for broadcast if it is small enough.
    """
    by_group = mappings.select(
        F.col("scope").alias("group_category"), "field_name", F.col("mapping").alias("_by_group")
    )
    by_category = mappings.select(
        F.col("scope").alias("category"), "field_name", F.col("mapping").alias("_by_category")
    )
    found = (
        fields.join(by_group, ["group_category", "field_name"], "left")
        .join(by_category, ["category", "field_name"], "left")
        .withColumn("_mapping", F.coalesce("_by_group", "_by_category"))
    )
    mapping = F.col("_mapping")
    decoded = decode_value(F.col("raw_value"), F.col("raw_value_lc"), mapping)
    return (
        found.filter(~F.coalesce(mapping["hide"], F.lit(False)))
        .withColumns({
            "field_label": F.coalesce(
                F.nullif(mapping["label"], F.lit("")), F.col("field_name")
            ),
            "value": F.when(mapping.isNull(), F.col("raw_value")).otherwise(decoded),
            "desc": F.coalesce(mapping["desc"], F.lit("")),
        })
        .select(*DECODED, "seen", "field_seen")
    )


def devinfo_query(
    fields: DataFrame, group: str = "", category: str = "", id: str = "", search: str = ""
) -> DataFrame:
    """Folded fields by exact group, category and id, and by text in the value."""
    for column, wanted in (("group_category", group), ("category", category), ("id", id)):
        if wanted:
            fields = fields.filter(F.col(column) == wanted)
    term = search_term(search)
    return fields.filter(F.contains("raw_value_lc", F.lit(term))) if term else fields


def entity_order(by_id: bool = True) -> list[Key]:
    """Sort keys of a decoded table: (group, id, seen) or just seen, then field order."""
    first = ("group_category", "id") if by_id else ()
    return [(F.col(c), False) for c in (*first, "seen", "field_seen")]
