"""Line dedup by levelled sorted runs of line hashes.

A store of runs holds, for each line hash, the number of documents that had it. A run is a
bucketed table, sorted by hash in each bucket. A new batch of documents merge-anti-joins the
runs that have already seen a line in enough documents (such a line needs no more counting)
and adds its own run at level 0. When a level has ``fan_out`` runs, they are merged into one
run of the next level. At the end the runs' counts are added up, and documents lose the
lines that were found in ``min_docs`` documents or more.

Defined results: a null or empty text is one empty line; a line's key is the line without
white space at its ends, A-Z lower-cased; empty keys are never counted; a line counts once
per document: rows that repeat an id are one document in this, rows without an id one each.
Keys are compared by 64-bit hash:
the chance that a line shares the hash of one of a million frequent lines is under 1e-13.
All columns are kept, also those with the names used here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logtable.llm.common import SPACES, ascii_lower, whole
from logtable.plans.staging import stage, staging_root


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Levelled runs of ``(h, n)``: a line hash and the documents it was found in.

    Joins use the buckets of a run. Sums read the files plainly: a union of bucketed tables
    counts as partitioned by their buckets in Spark 4.1.2, though its partitions are not put
    together, so a key may come out once per table.
    """

    def __init__(self, spark: SparkSession, closed_at: int, fan_out: int = 2, buckets: int | None = None) -> None:
        self.spark, self.closed_at, self.fan_out = spark, closed_at, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _path(self, name: str) -> str:
        return f"{staging_root(self.spark)}/{name}"

    def _write(self, counts: DataFrame) -> str:
        name = f"line_runs_{uuid.uuid4().hex}"
        (
            counts.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h")
            .option("path", self._path(name)).saveAsTable(name)
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: a row ``h`` for each document and distinct line of it."""
        counts = batch.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            counts = counts.join(run.filter(F.col("n") >= self.closed_at).hint("merge"), "h", "left_anti")
        self.levels[0].append(self._write(counts))
        self._compact()

    def _compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) >= self.fan_out:
                merged = self._write(self._sum(names))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                for name in names:
                    self.spark.sql(f"DROP TABLE {name}")
                self.levels[level] = []

    def _sum(self, names: list[str]) -> DataFrame:
        every = self.spark.read.schema("h long, n long").parquet(*[self._path(name) for name in names])
        return every.groupBy("h").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """``h`` of the lines found in ``closed_at`` documents or more."""
        return self._sum([name for level in self.levels for name in level]).filter(F.col("n") >= self.closed_at).select("h")

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = [[]]


def drop_frequent_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1,
    batches: int = 4, fan_out: int = 2,
) -> DataFrame:
    """A row for each of ``docs``: ``doc`` (the row), ``kept`` (its text without the frequent
    lines), ``n_lines`` before, and ``n_dropped``."""
    lines = F.split(whole(text), "\n", -1)
    # An empty key is no line that can be dropped: its hash is null.
    hashes = F.transform(lines, lambda line: F.when(F.char_length(line_key(line)) >= min_chars, F.xxhash64(line_key(line))))
    hashed = stage(docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(whole(text)).alias("digest"), hashes.alias("hashes"),
        F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.when(F.col(f"`{doc_id}`").isNull(), whole(text))), F.lit(batches)).alias("batch"),
    ))
    store = LineRuns(docs.sparkSession, min_docs, fan_out)
    repeated = stage(hashed.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                     .select(F.col("id").alias("repeated")))
    repeats, same_id = not repeated.isEmpty(), F.col("id") == F.col("repeated")
    try:
        for batch in range(batches):
            rows = hashed.filter(F.col("batch") == batch).select("id", F.array_distinct("hashes").alias("hashes"))
            found = (rows.join(repeated, same_id, "left_anti") if repeats else rows).select(F.explode("hashes").alias("h"))
            if repeats:
                # All rows of an id are in one batch.
                once = rows.join(repeated, same_id, "left_semi").select("id", F.explode("hashes").alias("h")).distinct()
                found = found.unionByName(once.select("h"))
            store.add(found.filter("h IS NOT NULL"))
        frequent = stage(store.frequent())
    finally:
        store.drop()
    # Rows that repeat an id and a text drop the same lines, so one row of them is enough.
    hits = (
        hashed.select("id", "digest", F.posexplode("hashes").alias("at", "h")).join(frequent, "h")
        .groupBy("id", "digest").agg(F.collect_set("at").alias("dropped"))
        .withColumnsRenamed({"id": "hit_id", "digest": "hit_digest"})
    )
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    some = F.array_join(F.transform(kept_at, lambda i: F.get("lines", i)), "\n")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{doc_id}`").alias("id"),
        whole(text).alias("text"), F.xxhash64(whole(text)).alias("digest"), lines.alias("lines"),
    )
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))
    return rows.join(hits, same, "left").select(
        "doc",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(some).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
