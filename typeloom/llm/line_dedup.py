"""Line dedup over levelled sorted runs of line hashes.

A line's key is hashed to 128 bits. A run is a table of (hash, number of documents), bucketed
and sorted by hash, all runs in the same buckets: Spark knows this and joins runs by merging
them, bucket with bucket, without a shuffle or a sort. ``LineRuns.add`` takes a batch of
documents: its distinct hashes, counted, are sorted once, merge-anti-joined with the hashes
that the runs have as settled (found in ``min_docs`` documents) and added as a run of level 0.
When a level holds ``fanout`` runs they are compacted into one of the next level, counts added,
again bucket with bucket; with the default settings, before the last of three batches.
Frequent keys are those whose counts over all runs reach ``min_docs``.

Lines of frequent keys are dropped in every document: (document, hash) rows meet the
frequent hashes in a semi-join that Spark may split where a hash is very common (partial
counts before the shuffle keep runs free of that skew), and each document's own set of
dropped hashes is merge-joined to it. In the semi-join, Spark broadcasts the frequent hashes if they
are below the session's spark.sql.autoBroadcastJoinThreshold; nothing is collected.

Defined cases: null and empty texts are one empty line; empty keys (fewer than ``min_chars``
code points) are never dropped. A document whose lines are all dropped keeps an empty text.
Every row is a document of its own, whatever its doc_id: ten equal rows, or ten rows of one
doc_id that share a line, make that line frequent. A null doc_id is a value. A very long text
is one row like any other. An empty table gives no rows. Other columns stay as they are,
whatever their names; of the columns that are added, one that is there already is replaced.

With ``copies_once``, documents whose non-empty keys are the same in the same order (exact
copies among them) count as one document, so that a document isn't emptied by its own copies.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import BLANKS, ascii_lower, bind, discard, free_name, remove, scratch, stored, whole_text

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 3
FANOUT = 2
ADDED = ("line_dedup_n_lines", "line_dedup_n_dropped")
#: Rows of keys in a bucket, about (24 bytes each), and the most buckets that Spark takes.
BUCKET_ROWS = 4_000_000
MAX_BUCKETS = 100_000


def line_keys(text: Column) -> Column:
    """Keys of the lines of ``text``: edges stripped of ASCII white space, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def key_hash(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes (the second one starts from another seed)."""
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


@contextmanager
def sorted_scans(spark: SparkSession):
    """Within, Spark takes the order of a bucket of one file for granted, as it is written sorted."""
    setting = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


class LineRuns:
    """Sorted runs of (h1, h2, n) by level: bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.buckets, self.min_docs, self.fanout = spark, buckets, min_docs, fanout
        self.levels: list[list[str]] = []
        self.places: dict[str, str] = {}

    def _written(self, counts: DataFrame) -> str:
        name = f"typeloom_line_run_{uuid.uuid4().hex}"
        self.places[name] = scratch(self.spark, "line-run")
        counts.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.places[name]).saveAsTable(name)
        return name

    def _dropped(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.places.pop(name))

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _merged(self, names: list[str]) -> str:
        """One run for several, which are dropped: two at a time, merged bucket with bucket, counts added."""
        waiting = list(names)
        while len(waiting) > 1:
            a, b, *waiting = waiting
            other = self.spark.table(b).withColumnRenamed("n", "m")
            both = self.spark.table(a).join(other.hint("merge"), ["h1", "h2"], "full_outer")
            counts = F.coalesce("n", F.lit(0).cast("long")) + F.coalesce("m", F.lit(0).cast("long"))
            waiting.append(self._written(both.select("h1", "h2", counts.alias("n"))))
            self._dropped([a, b])
        return waiting[0]

    def unsettled(self, fresh: str) -> DataFrame:
        """The sorted run ``fresh`` without the hashes that the other runs have as settled."""
        out = self.spark.table(fresh)
        for name in self.runs():
            settled = self.spark.table(name).where(F.col("n") >= self.min_docs).select("h1", "h2")
            out = out.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        return out

    def add(self, keys: DataFrame) -> None:
        """``keys``: h1, h2, a row for each document and distinct key of the batch."""
        with sorted_scans(self.spark):
            fresh = self._written(keys.groupBy("h1", "h2").agg(F.count("*").alias("n")).repartition(self.buckets, "h1", "h2"))
            if self.runs():
                run = self._written(self.unsettled(fresh))
                self._dropped([fresh])
            else:
                run = fresh
            self._put(run, 0)

    def _put(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._merged(full), level + 1)

    def frequent(self) -> DataFrame:
        """h1, h2 of the keys found in ``min_docs`` documents or more; all runs are compacted into one."""
        with sorted_scans(self.spark):
            self.levels = [[self._merged(self.runs())]]
        return self.spark.table(self.levels[0][0]).where(F.col("n") >= self.min_docs).select("h1", "h2")

    def close(self) -> None:
        """Drop all runs; what was read from them has to be stored before."""
        self._dropped(self.runs())
        self.levels = []


def frequent_keys(hashed: DataFrame, min_docs: int, batches: int, copy: list[str]) -> DataFrame:
    """h1, h2 of frequent keys, stored; ``hashed`` has a row for each document and distinct key, and its batch."""
    spark = hashed.sparkSession
    buckets = min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, hashed.count() // BUCKET_ROWS))
    runs = LineRuns(spark, buckets, min_docs)
    for k in range(batches):
        batch = hashed.where(F.col("batch") == k).select("h1", "h2", *copy)
        runs.add((batch.distinct() if copy else batch).select("h1", "h2"))
    out = stored(runs.frequent(), "line-frequent")
    runs.close()
    return out


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, copies_once: bool = False, added: tuple[str, str] = ADDED) -> DataFrame:
    """All columns of ``docs``, ``text`` without the dropped lines, and the numbers of lines and of dropped ones under the names ``added``."""
    spark = docs.sparkSession
    long_keys = F.filter(line_keys(whole_text(docs)), lambda x: F.length(x) >= min_chars)
    if copies_once:
        t1, t2 = key_hash(F.col("keys"))
        keyed = docs.select(docs["doc_id"].alias("d"), long_keys.alias("keys")).select("d", t1.alias("t1"), t2.alias("t2"), F.explode(F.array_distinct("keys")).alias("key"))
    else:
        keyed = docs.select(docs["doc_id"].alias("d"), F.explode(F.array_distinct(long_keys)).alias("key"))
    copy = ["t1", "t2"] if copies_once else []
    h1, h2 = key_hash(F.col("key"))
    # Copies fall into one batch, as they have to meet to be counted once.
    batch = F.pmod(F.xxhash64(*(copy or ["d"])), F.lit(batches)).cast("int")
    at = scratch(spark, "line-keys")
    keyed.select("d", *copy, h1.alias("h1"), h2.alias("h2"), batch.alias("batch")).write.partitionBy("batch").parquet(at)
    kinds = [f"d {dict(docs.dtypes)['doc_id']}", *[f"{c} long" for c in (*copy, "h1", "h2")], "batch int"]
    hashed = spark.read.schema(", ".join(kinds)).parquet(at)
    frequent = frequent_keys(hashed, min_docs, batches, copy)
    hits = hashed.join(frequent, ["h1", "h2"], "left_semi")
    own, gone = free_name("line_dedup_id", docs), free_name("line_dedup_gone", docs)
    dropped = stored(hits.groupBy("d").agg(F.collect_set("h1").alias(gone)).withColumnRenamed("d", own), "line-dropped")
    discard(frequent)
    remove(spark, at)
    joined = docs.join(dropped.hint("merge"), docs["doc_id"].eqNullSafe(dropped[own]), "left")
    return _without(joined, docs, dropped[gone], min_chars, added)


def _without(joined: DataFrame, docs: DataFrame, gone: Column, min_chars: int, added: tuple[str, str]) -> DataFrame:
    text = whole_text(docs)
    lines = F.split(text, "\n")

    def kept(v: Column) -> Column:
        pairs = F.arrays_zip(v["lines"].alias("line"), v["keys"].alias("key"))
        short = lambda p: F.length(p["key"]) < min_chars
        stay = lambda p: short(p) | ~F.array_contains(v["gone"], F.xxhash64(p["key"]))
        return F.transform(F.filter(pairs, stay), lambda p: p["line"])

    def digest(v: Column) -> Column:
        n_lines = F.size(v["lines"])
        return F.struct(
            F.array_join(v["left"], "\n").alias("text"),
            n_lines.cast("long").alias("n_lines"),
            (n_lines - F.size(v["left"])).cast("long").alias("n_dropped"),
        )

    parts = F.struct(lines.alias("lines"), line_keys(text).alias("keys"), gone.alias("gone"))
    left = F.when(gone.isNull(), lines).otherwise(bind(parts, kept))
    found = bind(F.struct(lines.alias("lines"), left.alias("left")), digest)
    name = free_name("line_dedup", docs)
    out = joined.select(*[docs[f"`{c}`"] for c in docs.columns], found.alias(name))
    stay = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    counts = [F.col(f"{name}.{of}").alias(a) for of, a in zip(("n_lines", "n_dropped"), added, strict=True)]
    return out.select(*[F.col(f"{name}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in stay], *counts)
