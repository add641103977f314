"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by a hash of their id) into a stream of words, which
is cut into blocks of equal length: ``block_words``, or less for a source that does not fill
its last block, so that a source of ten words is one block of ten. A source needs as many
slots of one block as come nearest to its target. Slot ``i`` takes the point
``frac(i * golden ratio)``, which falls into one source's part of the cumulative slots needed;
the k-th slot of a source takes its k-th block, going round after the last. So every stretch
of the mix holds the sources in their shares. The points give a source a few slots more or
less than it needs: those above are left out, those that lack follow behind. A block is taken
``MAX_PASSES`` times at most.

Defined results: sources come in code-point order, null last; sizes count words, a null or
empty text has none and is taken 0 times; rows that repeat are documents of their own. The
order of a source depends on ids and sizes alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logtable.llm.common import WORD, total_before, whole
from logtable.plans.ordered import Key, in_order
from logtable.plans.staging import stage

#: The golden ratio's fraction of 2**31, odd so that each value comes up once in 2**31 slots.
GOLDEN, POINTS = 1327217885, 1 << 31
MAX_PASSES = 3
#: Rows of one bucket of a shuffled source, and slots whose ranks one window finds.
BUCKET, CHUNK = 512, 4096
#: Cells that the whole of the slots is cut into, at least.
CELLS = 4096


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def _source_order() -> list[Key]:
    return [(F.col("source").isNull(), False), (F.col("source"), False)]


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = MAX_PASSES) -> DataFrame:
    """Per source its place ``n`` from 0, ``source_size``, ``weight`` and ``target``.

    Targets fill up like water: each is the smaller of its cap and of its weight times a
    level common to all, and they add up to all words. No window sees all sources.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = in_order(sums, _source_order(), "n", 0).withColumn("weight", F.get(cycle, F.col("n") % len(weights)).cast("long"))
    by_ratio = weighed.withColumn("ratio", cap * F.col("source_size") / F.col("weight")).withColumn("filled", cap * F.col("source_size"))
    ranked = in_order(by_ratio, [(F.col("ratio"), False), (F.col("n"), False)], "r", 0)
    ranked = stage(total_before(total_before(ranked, [], "r", "filled", "spent"), [], "r", "weight", "used"))
    words, every = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(words) - F.col("spent")) / (F.lit(every) - F.col("used"))
    # The level of the first source, by ratio, that it does not fill to its cap; it falls from there on.
    common = ranked.agg(F.max(F.when(level <= F.col("ratio"), level))).first()[0]
    full = F.lit(True) if common is None else F.col("ratio") < common
    return ranked.select(
        "n", "source", "source_size", "weight",
        F.when(full, F.col("source_size") * float(cap)).otherwise(F.col("weight") * F.lit(common).cast("double")).alias("target"))


def with_slots(targets: DataFrame, block_words: int, cap: int) -> DataFrame:
    """``targets`` with the length and number of a source's ``blocks``, and the ``slots`` it needs."""
    length = F.ceil(F.col("source_size") / F.ceil(F.col("source_size") / block_words))
    sized = targets.withColumn("length", F.when(F.col("source_size") > 0, length).otherwise(block_words).cast("long"))
    sized = sized.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    needed = F.floor(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1)) + 0.5).cast("long")
    return sized.withColumn("slots", F.least(needed, cap * F.col("blocks")))


def shuffled_streams(docs: DataFrame, n_docs: int) -> DataFrame:
    """``docs`` (source, doc_id, size) with ``start``: the words of its source before it, in
    the order of the md5 of its id. Buckets of that hash keep every window small."""
    buckets = max(1, n_docs // BUCKET)
    keyed = docs.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = keyed.withColumn(
        "bucket", F.expr(f"(cast(conv(substr(hash, 1, 7), 16, 10) as long) * {buckets}) div {1 << 28}")
    )
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    bases = total_before(sums, ["source"], "bucket", "words", "base").select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    # Rows that repeat id and size are told apart by nothing but their place.
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    return placed.join(bases, same).select("source", "doc_id", "size", (F.col("base") + F.col("before")).alias("start"))


def schedule(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """``(slot, source, rank)``: which source each slot takes, and how many slots of it came
    before; of each source as many as it needs, those that the points lack without a slot."""
    placed = stage(total_before(sources.select("n", "source", "slots"), [], "n", "slots", "low").filter("slots > 0"))
    total, n_sources = placed.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    # Points and shares meet in cells of equal width, few sources in each.
    cells = max(CELLS, n_sources)
    cell = lambda at: F.least(F.floor(at / float(max(total, 1)) * cells).cast("int"), F.lit(cells - 1))
    shares = placed.withColumn("high", F.col("low") + F.col("slots"))
    shares = shares.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    point = (F.col("id") % POINTS * GOLDEN % POINTS).cast("double") / POINTS * total
    numbered = spark.range(total).select(F.col("id").alias("slot"), point.alias("point"), F.expr(f"id div {CHUNK}").alias("chunk"))
    inside = (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))
    dealt = (
        numbered.withColumn("at", cell(F.col("point"))).join(shares, (F.col("at") == F.col("cell")) & inside)
        .select("slot", "chunk", "n"))
    counts = dealt.groupBy("n", "chunk").agg(F.count(F.lit(1)).alias("size"))
    bases = total_before(counts, ["n"], "chunk", "size", "base").select(F.col("n").alias("m"), F.col("chunk").alias("c"), "base")
    local = F.row_number().over(Window.partitionBy("n", "chunk").orderBy("slot")) - 1
    same = (F.col("n") == F.col("m")) & (F.col("chunk") == F.col("c"))
    ranked = dealt.withColumn("local", local).join(bases, same).select("slot", "n", (F.col("base") + F.col("local")).alias("rank"))
    of = placed.select(F.col("n").alias("m"), "source", F.col("slots").alias("needed"))
    kept = ranked.join(of, F.col("n") == F.col("m")).filter(F.col("rank") < F.col("needed")).select("slot", "source", "rank")
    found = counts.groupBy("n").agg(F.sum("size").alias("found"))
    lacking = of.join(found, F.col("n") == F.col("m"), "left").withColumn("found", F.coalesce("found", F.lit(0)))
    lacking = lacking.filter("found < needed").select(
        F.lit(None).cast("long").alias("slot"), "source", F.explode(F.sequence(F.col("found"), F.col("needed") - 1)).alias("rank"))
    return kept.unionByName(lacking)


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = (1, 2, 3), block_words: int = 128, max_passes: int = MAX_PASSES,
) -> DataFrame:
    """A row for each of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``
    and ``taken``, the words that the mix takes of it."""
    spark = docs.sparkSession
    sized = stage(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size")))
    n_docs = sized.count()
    sources = stage(with_slots(source_targets(sized, weights, max_passes), block_words, max_passes))
    of = sources.select(F.col("source").alias("s"), "source_size", "target", "length", "blocks")
    same = F.col("source").eqNullSafe(F.col("s"))
    taken_blocks = (
        schedule(spark, sources).join(of, same)
        .groupBy(F.col("source").alias("bs"), (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    streams = shuffled_streams(sized.filter("size > 0"), n_docs)
    pieces = streams.join(of.select("s", "length"), same).withColumn(
        "at", F.explode(F.sequence(F.expr("start div length"), F.expr("(start + size - 1) div length"))))
    overlap = (
        F.least(F.col("start") + F.col("size"), (F.col("at") + 1) * F.col("length"))
        - F.greatest(F.col("start"), F.col("at") * F.col("length"))
    )
    met = pieces.join(taken_blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("at") == F.col("block")), "left")
    taken = met.groupBy("source", "start", "doc_id", "size").agg(
        F.sum(overlap * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    none = sized.filter("size = 0").select("source", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return (
        taken.select("source", "doc_id", "size", "taken").unionByName(none).join(of, same)
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )
