"""Extraction end to end: from events, responses and questions to the long table of registered features, and its sinks.

One plan computes every chosen feature: the spine of human-typed groups is joined with the rhythm
features, code facts and a reading of the prose are added where the response type has them, and
the columns are exploded to rows. Parts that no chosen feature needs aren't built.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom import config
from typeloom.functions import code as C
from typeloom.functions import language as N
from typeloom.functions import prose as P
from typeloom.operators import groups as G
from typeloom.operators import reshape as R
from typeloom.operators import sequences as S
from typeloom.operators import timing as TM
from typeloom.plans import registry
from typeloom.sources import typing_logs as L

LONG = [*G.KEY, "tier", "feature", "value"]
IDENTITY = ["dataset", *G.KEY, "scenario", "label"]


@dataclass(frozen=True)
class Extraction:
    """``long`` has a row for each kept group and chosen feature of its type; the rest are small reports."""

    long: DataFrame
    dropped: DataFrame
    short: DataFrame
    errors: DataFrame
    features: list[registry.Feature]
    settings: dict


def _rhythm(spine: DataFrame, typed: DataFrame, settings: dict) -> DataFrame:
    return spine.join(S.tier1(L.key_events(typed), L.mouse_events(typed), L.cursor_events(typed), G.KEY, config.knobs(settings)), G.KEY, "left")


def _code(spine: DataFrame, settings: dict) -> DataFrame:
    unit = str(config.value(settings, "tier2.indentation.canonical_unit"))
    of_code = spine.withColumn("code_text", F.when(F.col("r_t") == "code", F.col("text")))
    told = C.without_boilerplate(C.with_facts(of_code, "code_text", unit=unit), F.col("prompt"))
    return told.select(*spine.columns, F.col("facts.error").alias("code_error"), *[c.alias(f"code_{n}") for n, c in C.code_features(prompt=F.col("prompt")).items()])


def _language(spine: DataFrame, toolkit, settings: dict) -> DataFrame:
    text = F.when(F.col("r_t") == "explanation", F.col("text"))
    rules = config.value(settings, "tier2.text")
    read = spine.withColumn("reading", toolkit.read(text))
    found = N.language_features(F.col("reading"), toolkit, bool(rules.get("lowercase", True)), bool(rules.get("strip_punctuation", True)))
    return read.select(*spine.columns, found.alias("language"))


def extract(events: DataFrame, responses: DataFrame, questions: DataFrame | None, settings: dict = config.DEFAULTS, only: Collection[str] | None = None, without: Collection[str] | None = None, toolkit=None) -> Extraction:
    """The chosen features (all, only some, or all but some) of every human-typed group.

    An error before anything is read: unknown or no features, settings that lack a key, features of
    the prose without a toolkit, or part-of-speech ratios without a tagger.
    """
    features = registry.chosen(only, without)
    if lacking := config.missing(settings, registry.required_keys(features)):
        raise config.ConfigError(f"settings lack {', '.join(lacking)}")
    sources = {f.source for f in features}
    blind = [f.name for f in features if f.source == "language" and (toolkit is None or (f.column in registry.TAGGED and not toolkit.tagged))]
    if blind:
        raise ValueError(f"these features need a language toolkit or its tagger: {', '.join(blind)}")

    every = G.groups(events, responses, questions)
    typed = G.human_typed(events)
    spine = G.groups(typed, G.human_typed(responses), questions)  # before texts are dealt out, not after: it goes by KEY alone
    prompt = F.lit(None).cast("string").alias("prompt") if questions is None else "prompt"
    wide = spine.select(*G.KEY, "text", prompt)
    if "rhythm" in sources:
        wide = _rhythm(wide, typed, settings)
    if "code" in sources:
        wide = _code(wide, settings)
    if "lines" in sources:
        wide = wide.withColumn("lines", F.when(F.col("r_t") == "code", P.registered_lines(F.col("text"))))
    if "language" in sources:
        wide = _language(wide, toolkit, settings)

    place = {"rhythm": "{}", "code": "code_{}", "lines": "lines.{}", "language": "language.{}"}

    def cells(r_t: str) -> Column:
        own = [f for f in features if f.r_t == r_t]
        value = lambda f: F.col(place[f.source].format(f.column)).cast("double")
        rows = [F.struct(F.lit(f.tier).alias("tier"), F.lit(f.name).alias("feature"), value(f).alias("value")) for f in own]
        return F.array(*rows).cast("array<struct<tier: string, feature: string, value: double>>")

    error = F.col("code_error") if "code" in sources else F.lit(None).cast("string")
    long = wide.select(*G.KEY, error.alias("error"), F.explode(F.when(F.col("r_t") == "code", cells("code")).otherwise(cells("explanation"))).alias("x"))
    from_code = [f.name for f in features if f.source == "code"]
    failed = F.count_if(F.col("error").isNotNull() & F.col("feature").isin(*from_code)) if from_code else F.lit(0).cast("long")
    rows = long.select(*G.KEY, "x.tier", "x.feature", F.col("x.value").alias("value"), "error")
    errors = rows.groupBy("feature").agg(F.count("*").alias("n"), failed.alias("n_errors")).where("n_errors > 0")
    floor = int(config.value(settings, registry.SANITY))
    downs = S.keydown_stream(L.key_events(typed), config.knobs(settings)).groupBy(G.KEY).agg(F.count("*").alias("n_keydowns"))
    return Extraction(rows.select(LONG), G.dropped_counts(every), G.short_counts(spine, downs, floor), errors, features, settings)


def from_logs(spark: SparkSession, root: str, **choice) -> tuple[Extraction, L.Logs]:
    """``extract`` over raw logs; release the logs when the tables are written."""
    logs = L.load(spark, root)
    return extract(logs.events, logs.responses, logs.questions, **choice), logs


def identified(df: DataFrame, dataset: str) -> DataFrame:
    """Adds dataset, scenario and label."""
    scenario = F.element_at(F.create_map(*[F.lit(x) for kv in L.SCENARIOS.items() for x in kv]), F.col("session"))
    return df.withColumn("dataset", F.lit(dataset)).withColumn("scenario", scenario).withColumn("label", F.col("session") - 1)


def wide_table(long: DataFrame, dataset: str, names: list[str]) -> DataFrame:
    """A row for each group, a column for each feature; groups with NULLs only stay."""
    return identified(R.wide(long, G.KEY, names), dataset).select(*IDENTITY, *names)


def question_table(long: DataFrame, dataset: str, names: list[str]) -> DataFrame:
    """A row for each question: code and explanation side by side (their features' names differ)."""
    joint = R.wide(long, ["user", "session", "q_id", "version"], names)
    return identified(joint, dataset).select("dataset", "user", "session", "scenario", "label", "q_id", "version", *sorted(names))


def quality_table(long: DataFrame) -> DataFrame:
    counted = long.groupBy("r_t", "feature").agg(F.count("*").alias("observations"), F.count("value").alias("valid"))
    return counted.withColumn("missing", F.col("observations") - F.col("valid"))


def coverage_table(sessions: DataFrame) -> DataFrame:
    """session, scenario, complete_participants; 0 where no participant has the session."""
    spark = sessions.sparkSession
    dim = spark.createDataFrame(list(L.SCENARIOS.items()), "session int, scenario string")
    return R.coverage(sessions, dim, "session", "user").join(dim, "session").select("session", "scenario", F.col("n_users").alias("complete_participants"))


def timing_long(events: DataFrame, bigrams: Iterable[str] = TM.BIGRAMS) -> DataFrame:
    """KEY, feature, value of the timing family over human-typed groups: values that exist only."""
    typed = L.key_events(G.human_typed(events))
    return TM.long_features(TM.summarize(TM.collect(typed, G.KEY, bigrams), G.KEY), G.KEY)


def timing_table(spine: DataFrame, timing: DataFrame, dataset: str, names: list[str]) -> DataFrame:
    """The export: a row for each group of ``spine``, the same columns for every cohort."""
    return identified(spine.select(G.KEY).join(R.wide(timing, G.KEY, names), G.KEY, "left"), dataset).select(*IDENTITY, *names)


def combined(features: DataFrame, timing: DataFrame) -> DataFrame:
    """Both families side by side, joined by the whole identity of a group."""
    return R.combine(features, timing, IDENTITY)


class Publication:
    """Tables written beside their place and moved into it together, so that a failure leaves what was there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.staged = f"{self.folder}.staged-{uuid.uuid4().hex}"
        self.names: list[str] = []
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, folder: str, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name else folder)

    def table(self, name: str, df: DataFrame) -> None:
        df.write.option("header", True).csv(f"{self.staged}/{name}")
        self.names.append(name)

    def note(self, name: str, content: dict) -> None:
        out = self._fs.create(self._path(self.staged, name), True)
        out.write(bytearray(json.dumps(content, indent=2, ensure_ascii=False).encode()))
        out.close()
        self.names.append(name)

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind is None:
            self._fs.mkdirs(self._path(self.folder))
            for name in self.names:
                self._fs.delete(self._path(self.folder, name), True)
                if not self._fs.rename(self._path(self.staged, name), self._path(self.folder, name)):
                    raise OSError(f"can't move {name} into {self.folder}")
        self._fs.delete(self._path(self.staged), True)


def _by_version(counts: DataFrame, n: str) -> dict[str, int]:
    return {f"s{r.session}/v{r.version}": r[n] for r in counts.orderBy("session", "version").collect()}  # a row a session and version


def publish(spark: SparkSession, found: Extraction, sessions: DataFrame, folder: str, dataset: str, settings_digest: str | None = None) -> dict:
    """Write all tables of a cohort; nothing is replaced if a feature failed or no row came out. Returns the metadata."""
    failed = {r.feature: r.n_errors for r in found.errors.collect()}  # names of features
    if failed:
        raise RuntimeError(f"features failed, nothing is published: {failed}")
    names = [f.name for f in found.features]
    long = found.long.persist()
    try:
        n = long.count()
        if not n:
            raise ValueError(f"no group of {dataset} has any of the chosen features")
        by_group, by_question = wide_table(long, dataset, names), question_table(long, dataset, names)
        about = {
            "dataset": dataset, "groups": by_group.count(), "questions": by_question.count(), "feature_count": len(names), "long_rows": n, "feature_errors": failed,
            "config_sha256": settings_digest, "config": found.settings, "dropped_groups": _by_version(found.dropped, "n_dropped"), "short_groups": _by_version(found.short, "n_short"),
            "human_version_rule": "version 1 in session 1, version 2 in the others", "preprocessing": "none: values as computed",
        }
        with Publication(spark, folder) as out:
            out.table("features.csv", long)
            out.table("features_wide.csv", by_group)
            out.table("features_questions.csv", by_question)
            out.table("feature_catalog.csv", registry.catalog(spark, found.features).coalesce(1))
            out.table("feature_quality.csv", quality_table(long))
            out.table("coverage.csv", coverage_table(sessions))
            out.note("extraction_metadata.json", about)
    finally:
        long.unpersist()
    return about


def publish_timing(spark: SparkSession, spine: DataFrame, timing: DataFrame, folder: str, dataset: str, bigrams: Iterable[str] = TM.BIGRAMS) -> dict:
    """Write the timing family's export, catalog, quality and metadata."""
    tokens = list(bigrams)
    names = TM.feature_names(spark, tokens)
    n = spine.count()
    if not n:
        raise ValueError(f"no human-typed group in {dataset}")
    valid = timing.groupBy("feature").agg(F.count("value").alias("valid"))
    catalog = TM.catalog(spark, tokens)
    quality = catalog.join(valid, "feature", "left").select("feature", F.coalesce("valid", F.lit(0)).alias("valid"), (F.lit(n) - F.coalesce("valid", F.lit(0))).alias("missing"))
    about = {
        "groups": n, "features": len(names), "bigrams": tokens, "timing_limits_ms": [TM.LOW, TM.HIGH], "iqr_multiplier": TM.FENCES, "std_ddof": 0,
        "pairing": "first in, first out by physical code; no repeats", "rukd": "latest matched release of a letter or space to the keydown", "boundaries": G.KEY,
    }
    with Publication(spark, folder) as out:
        out.table("features_timing.csv", timing_table(spine, timing, dataset, names))
        out.table("timing_feature_catalog.csv", catalog.orderBy("place").coalesce(1))
        out.table("timing_feature_quality.csv", quality)
        out.note("timing_metadata.json", about)
    return about
