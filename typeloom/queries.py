"""Registered queries of the analytics operators over the driver's tables, and SQL to check them by.

The tables have no typing logs, so ``events`` stands in: a user's events are a group,
``signup`` is a keydown whose code is props.k, ``purchase`` the keyup, ``error`` a
Backspace keydown, ``click`` a mouse move, ``view`` a cursor move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions import code as C
from typeloom.functions import language as N
from typeloom.functions import prose as P
from typeloom.functions.stats import percentile_ratio, variation
from typeloom.operators import analysis as A
from typeloom.operators import reshape as R
from typeloom.operators import sequences as S
from typeloom.operators import timing as TM
from typeloom.plans import evaluation as E
from typeloom.plans import extraction as X
from typeloom.plans import registry

USER = ["user_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def mapped(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000D")
    return table(spark, sf, "events").select("user_id", ms.alias("ts"), F.col("event_id").alias("seq"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def keys(spark: SparkSession, sf: str) -> DataFrame:
    e = mapped(spark, sf).where(F.col("event_type").isin("signup", "purchase", "error"))
    back = F.col("event_type") == "error"
    letter = F.chr(F.lit(97) + F.col("k") % 26)
    return e.select("user_id", "ts", "seq", F.when(back, "Backspace").otherwise(letter).alias("key"), F.when(back, "Backspace").otherwise(F.concat(F.lit("Key"), (F.col("k") % 3).cast("string"))).alias("code"), F.when(F.col("event_type") == "purchase", "keyup").otherwise("keydown").alias("phase"), F.lit(False).alias("repeat"))


def mouse(spark: SparkSession, sf: str) -> DataFrame:
    return mapped(spark, sf).where("event_type = 'click'").select("user_id", "ts", "seq", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


def cursor(spark: SparkSession, sf: str) -> DataFrame:
    return mapped(spark, sf).where("event_type = 'view'").select("user_id", "ts", "seq", (F.col("k") % 3).alias("line"), (F.col("k") % 4).alias("ch"))


def rhythm_minimum_slice(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    iki = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "seq"))
    return mapped(spark, sf).withColumn("iki", iki).groupBy("user_id").agg(F.count("*").alias("n"), variation(F.col("iki")).alias("kit_cv"), percentile_ratio(F.col("iki"), 0.9, 0.5).alias("kit_p90_p50"))


def fifo_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.key_pairs(keys(spark, sf), USER).select("user_id", "code", "key", "down_ts", "up_ts")


def tier1_features(spark: SparkSession, sf: str) -> DataFrame:
    return S.tier1(keys(spark, sf), mouse(spark, sf), cursor(spark, sf), USER)


def loose_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with capitals and without some codes; hours count as ms, as the events are hours apart."""
    n = F.ascii("key") % 7
    capital = F.when((F.length("key") == 1) & (F.ascii("key") % 5 == 0), F.upper("key")).otherwise(F.col("key"))
    code = F.when(n == 3, F.lit(None)).when(n == 4, F.lit("")).otherwise(F.col("code"))
    return keys(spark, sf).select("user_id", (F.col("ts") / 3_600_000).alias("ts"), "seq", capital.alias("key"), code.alias("code"), "phase", "repeat")


def timing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return TM.summarize(TM.collect(loose_keys(spark, sf), USER), USER).select("user_id", "family", "token", "mean", "std", "range", "max", "median")


def timing_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return TM.catalog(spark)


def replayed_text(spark: SparkSession, sf: str) -> DataFrame:
    """Keystrokes at made-up carets."""
    placed = keys(spark, sf).withColumn("line", (F.col("seq") % 3).cast("int")).withColumn("ch", (F.col("seq") % 5).cast("int"))
    return S.replay(placed, USER)


def typed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw logs have them: users answer one question in one session, half of them with code."""
    key = F.to_json(F.struct("key", "code", F.col("phase").alias("key_event_phase"), "repeat"))
    each = [
        keys(spark, sf).select("user_id", "ts", "seq", F.lit("key").alias("event_type"), key.alias("data")),
        mouse(spark, sf).select("user_id", "ts", "seq", F.lit("mouse").alias("event_type"), F.to_json(F.struct("x", "y")).alias("data")),
        cursor(spark, sf).select("user_id", "ts", "seq", F.lit("cursor").alias("event_type"), F.to_json(F.struct("line", "ch")).alias("data")),
    ]
    return answered(each[0].unionByName(each[1]).unionByName(each[2]))


def answered(df: DataFrame) -> DataFrame:
    """Group keys for a table with user_id."""
    session = (F.col("user_id") % 5 + 1).cast("int")
    r_t = F.when(F.col("user_id") % 2 == 0, "code").otherwise("explanation")
    return df.select("*", F.col("user_id").cast("string").alias("user"), session.alias("session"), F.lit(1).alias("q_id"), r_t.alias("r_t"), F.when(session == 1, 1).otherwise(2).alias("version")).drop("user_id")


EXTRACTED = ("comment_density", "blank_line_ratio", "comment_to_code_ratio", "ttr", "hapax_ratio", "word_entropy", "non_stopword_ratio", "sentence_length_cv")


def extracted_long(spark: SparkSession, sf: str) -> DataFrame:
    """The long table of features over events and documents as answers; those that SQL can tell too."""
    texts = answered(table(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), "text")).withColumn("entry_pos", F.lit(0)).withColumn("field_pos", F.lit(0)).withColumn("source_field", F.col("r_t"))
    typed = texts.where(F.col("text").isNotNull())
    pasted = typed.where("session > 1").withColumn("version", F.lit(1))  # dropped, as nobody typed it
    only = [f.name for f in registry.features() if f.tier == "tier1" or f.column in EXTRACTED]
    toolkit = N.PlainToolkit(stopwords=("the", "of", "and", "to", "in"))
    return X.extract(typed_events(spark, sf), typed.unionByName(pasted), None, only=only, toolkit=toolkit).long


def text_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("t"))


def prose_features(spark: SparkSession, sf: str) -> DataFrame:
    return text_of(spark, sf).select("doc_id", P.word_features(F.col("t")).alias("x")).select("doc_id", "x.*")


def line_features(spark: SparkSession, sf: str) -> DataFrame:
    return text_of(spark, sf).select("doc_id", P.line_features(F.col("t")).alias("x")).select("doc_id", "x.*")


def registered_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", P.registered_lines(F.col("text")).alias("x")).select("doc_id", "x.*")


def plain_language(spark: SparkSession, sf: str) -> DataFrame:
    """Features of prose with the toolkit of patterns; no tagger, so no parts of speech."""
    toolkit = N.PlainToolkit(stopwords=("the", "of", "and", "to", "in"))
    read = table(spark, sf, "conversations").select("conv_id", "turn", toolkit.read(F.col("text")).alias("r"))
    told = read.select("conv_id", "turn", N.language_features(F.col("r"), toolkit).alias("x")).select("conv_id", "turn", "x.*")
    return told.select("conv_id", "turn", *EXTRACTED[3:])


def question_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means over the answers of a participant: here, over the documents of a source."""
    t = F.col("t")
    return P.question_means(text_of(spark, sf), ["source"], average_lines_per_question=F.size(P.lines(t)), average_sentences_per_question=F.size(P.sentences(t)))


def _distribution(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return text_of(spark, sf).select("doc_id", F.explode(P.distribution(F.col("t"), kind)).alias("x")).select("doc_id", "x.item", "x.share")

    return query


def code_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Token and tree features; the tables have no code, so conversations stand in (most aren't valid code)."""
    text = F.col("text")
    df = C.without_boilerplate(C.with_facts(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text"), text)
    named = C.code_features(prompt=text) | C.lexical_features(text)
    return df.select("conv_id", "turn", *[c.alias(n) for n, c in named.items()])


def prompt_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    names = C.prompt_names(F.coalesce("html", F.lit("")))
    return table(spark, sf, "pages").select("page_id", F.explode(names).alias("name"))


def misspelled_words(spark: SparkSession, sf: str) -> DataFrame:
    said = lambda df, c: df.select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    return C.misspelled(table(spark, sf, "conversations"), ["conv_id", "turn"], F.col("text"), said(table(spark, sf, "documents"), "text"))


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def measures(spark: SparkSession, sf: str) -> DataFrame:
    """Long form: feature, value, label (return flag) of line items."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in MEASURES])).alias("x")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"), cells).select("l_orderkey", "l_linenumber", "label", "x.*")


def part_measures(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in ("p_size", "p_retailprice")])).alias("x")
    return table(spark, sf, "part").select("p_partkey", cells).select("p_partkey", "x.*")


def wide_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return R.wide(part_measures(spark, sf), ["p_partkey"], ["p_size", "p_retailprice"])


def wide_lossy(spark: SparkSession, sf: str) -> DataFrame:
    known = part_measures(spark, sf).withColumn("value", F.when((F.col("value") > 25) & (F.col("value") != 1000), F.col("value")))
    return R.wide_lossy(known, ["p_partkey"], ("p_retailprice",))


def feature_quality(spark: SparkSession, sf: str) -> DataFrame:
    return R.quality(measures(spark, sf).withColumn("value", F.when(F.col("value") > 0.05, F.col("value"))))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return R.coverage(table(spark, sf, "customer"), table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "c_custkey")


def combine_families(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    b = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top_price"))
    return R.combine(a, b, ["o_custkey"])


def cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    return A.cohens_d(measures(spark, sf), "label", "N")


def largest_d(spark: SparkSession, sf: str) -> DataFrame:
    return A.largest_d(cohens_d(spark, sf))


def effect_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    effects = one_vs_rest_d(spark, sf).withColumnRenamed("label", "scenario")
    return A.heatmap(effects, "d", ["A", "N", "R"], top=3)


def rank_within(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), "p_brand", F.when(F.col("p_size") > 5, F.col("p_size")).alias("score"))
    return A.ranked_within(scores, "score", ["p_brand"])


def importance_report(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("score"), (F.col("p_partkey") % 4).alias("fold"))
    supplied = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"), (F.col("l_linenumber") % 3).alias("fold"))
    measures = {"scores": part.select("feature", "score"), "folds": A.selection_stability(supplied)}
    return A.importance_report(part.select("feature"), measures, {"score": "score_rank"}, "score")


def version_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Keydowns against lengths of answers: here, events of a user against the documents of that number."""
    downs = keys(spark, sf).where("phase = 'keydown'").groupBy("user_id", (F.col("user_id") % 3).alias("version")).agg(F.count("*").alias("n_keydowns"))
    lengths = text_of(spark, sf).select(F.col("doc_id").alias("user_id"), F.col("lang").alias("field"), F.length("t").alias("length"))
    return A.version_mapping(downs, lengths, ["version"])


def one_vs_rest_d(spark: SparkSession, sf: str) -> DataFrame:
    return A.one_vs_rest_d(measures(spark, sf), "label")


def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    cells = F.explode(F.array(F.struct(F.lit("n_chars").alias("feature"), F.col("n_chars").cast("double").alias("value")), F.struct(F.lit("upper").alias("feature"), P.class_ratio(F.coalesce("text", F.lit("")), r"\p{Lu}").alias("value")))).alias("x")
    return A.mutual_information(d.select("quality", cells).select("quality", "x.*"), "quality")


def correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return A.correlations(table(spark, sf, "lineitem"), list(MEASURES))


def spearman_rho(spark: SparkSession, sf: str) -> DataFrame:
    return A.spearman(table(spark, sf, "part"), "p_size", "p_retailprice")


def feature_ranks(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("score"))
    return A.ranked(scores, "score")


def rank_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("feature"), F.rank().over(_over("s_acctbal")).alias("a"), F.rank().over(_over("s_name")).alias("b"))
    return A.disagreements(s, "a", "b", 10)


def _over(c: str):
    from pyspark.sql import Window

    return Window.orderBy(F.desc(c))


def shared_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words found in at least half of the sources of a language."""
    words = text_of(spark, sf).select("lang", "source", F.explode(P.words(F.col("t"))).alias("word"))
    return A.shared_by_users(words, ["lang"], "source", "word", 0.5)


def boilerplate_share(spark: SparkSession, sf: str) -> DataFrame:
    words = text_of(spark, sf).select("lang", "source", F.explode(P.words(F.col("t"))).alias("word"))
    return A.boilerplate_share(words, ["lang"], "source", "word", 0.9)


def length_correlation(spark: SparkSession, sf: str) -> DataFrame:
    d = text_of(spark, sf).select("lang", F.length("t").alias("n"), F.size(P.words(F.col("t"))).alias("w"))
    return d.groupBy("lang").agg(F.avg("w").alias("mean_words"), F.corr("n", "w").alias("r"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select(F.col("quality").alias("y_true"), (F.col("n_chars") > 1000).cast("int").alias("y_pred"))


def error_rates(spark: SparkSession, sf: str) -> DataFrame:
    return E.error_rates(predictions(spark, sf))


def condition_far(spark: SparkSession, sf: str) -> DataFrame:
    return E.condition_far(predictions(spark, sf))


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(predictions(spark, sf))


def f1_scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.f1_scores(predictions(spark, sf))


def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", "quality")
    return E.stratified_group_folds(d, "source", "quality", 5)


def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("score"))
    return E.fold_summary(d, ["o_orderpriority"], ["score"], folds=4)


def summed_confusion(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "orders").groupBy("o_orderpriority", "o_custkey", F.col("o_orderstatus").alias("y_true"), F.substring("o_orderpriority", 1, 1).alias("y_pred")).agg(F.count("*").alias("n"))
    return E.summed_confusion(cells, ["o_orderpriority"])


def queries() -> dict:
    own = (
        rhythm_minimum_slice, fifo_pairs, tier1_features, timing_summary, timing_catalog, replayed_text, extracted_long,
        prose_features, line_features, registered_lines, plain_language, question_means, code_facts, prompt_identifiers, misspelled_words,
        wide_pivot, wide_lossy, feature_quality, coverage, combine_families,
        cohens_d, largest_d, one_vs_rest_d, effect_heatmap, mutual_information, correlation_pairs, spearman_rho, feature_ranks, rank_within, rank_disagreements, importance_report,
        shared_words, boilerplate_share, length_correlation, version_mapping,
        error_rates, condition_far, confusion, f1_scores, group_folds, fold_summary, summed_confusion,
    )
    return {f.__name__: f for f in own} | {f"{k}_distribution": _distribution(k) for k in ("letter", "special", "punctuation", "word_length", "function_word")}


# Pairing as a queue, event by event, in a recursive query: not the running counts that the engine uses.
PAIRED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, queue ORDER BY ts, seq) AS i FROM {keys}),
steps AS (SELECT user_id, queue, 0::BIGINT AS i, []::BIGINT[] AS pending, NULL::BIGINT AS matched FROM (SELECT DISTINCT user_id, queue FROM numbered)
  UNION ALL SELECT n.user_id, n.queue, n.i, CASE WHEN n.phase = 'keydown' THEN list_append(s.pending, n.seq) ELSE s.pending[2:] END, CASE WHEN n.phase = 'keyup' THEN s.pending[1] END
  FROM steps s JOIN numbered n ON n.user_id = s.user_id AND n.queue = s.queue AND n.i = s.i + 1),
ups AS (SELECT s.matched, n.ts AS up_ts, n.seq AS up_seq FROM steps s JOIN numbered n ON n.user_id = s.user_id AND n.queue = s.queue AND n.i = s.i WHERE s.matched IS NOT NULL)"""

EVENTS = """m AS (SELECT user_id, epoch_us(ts) / 1000.0 AS ts, event_id AS seq, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
keys AS (SELECT user_id, ts, seq, CASE WHEN event_type = 'error' THEN 'Backspace' ELSE chr(97 + k % 26) END AS key,
  CASE WHEN event_type = 'error' THEN 'Backspace' ELSE 'Key' || (k % 3) END AS code, CASE WHEN event_type = 'purchase' THEN 'keyup' ELSE 'keydown' END AS phase FROM m WHERE event_type IN ('signup', 'purchase', 'error'))"""

MAPPED = f"""{EVENTS},
queued AS (SELECT *, code AS queue FROM keys WHERE code IS NOT NULL),
{PAIRED.format(keys="queued")},
pairs AS (SELECT d.user_id, d.code, d.key, d.ts AS down_ts, d.seq AS down_seq, up_ts, up_seq FROM queued d LEFT JOIN ups ON ups.matched = d.seq WHERE d.phase = 'keydown')"""

TIER1 = f"""WITH RECURSIVE {MAPPED},
t AS (SELECT *, down_ts - lag(down_ts) OVER w AS iki, up_ts - down_ts AS hold, lead(down_ts) OVER w - up_ts AS rkdt FROM pairs WINDOW w AS (PARTITION BY user_id ORDER BY down_ts, up_ts IS NULL, up_ts, up_seq, down_seq)),
g AS (SELECT user_id, median(iki) AS med, min(iki) AS lo, max(iki) AS hi FROM t GROUP BY user_id),
b AS (SELECT t.*, med, lo, hi, CASE WHEN hi = lo THEN 0 ELSE least(floor((iki - lo) / (hi - lo) * 10), 9) END AS bin, sum(CASE WHEN iki >= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY down_ts, down_seq ROWS UNBOUNDED PRECEDING) AS burst FROM t JOIN g USING (user_id)),
h AS (SELECT user_id, -sum(p * log2(p)) AS e FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM b WHERE iki IS NOT NULL GROUP BY user_id, bin) GROUP BY user_id),
r AS (SELECT user_id,
  CASE WHEN count(iki) >= 2 THEN stddev_samp(iki) / nullif(avg(iki), 0) END AS kit_cv,
  CASE WHEN count(iki) >= 2 THEN quantile_cont(iki, 0.9) / nullif(quantile_cont(iki, 0.5), 0) END AS kit_p90_p50, CASE WHEN count(iki) >= 2 THEN quantile_cont(iki, 0.5) / nullif(quantile_cont(iki, 0.1), 0) END AS kit_p50_p10,
  CASE WHEN any_value(med) <> 0 THEN count(*) FILTER (WHERE iki > 2 * med) / nullif(count(iki), 0)::DOUBLE END AS kit_long_pause_fraction,
  CASE WHEN any_value(med) <> 0 THEN coalesce(sum(iki) FILTER (WHERE iki > 2 * med), 0) / nullif(max(down_ts) - min(down_ts), 0) END AS kit_pause_time_fraction,
  CASE WHEN count(iki) >= 2 THEN 1 END AS two,
  CASE WHEN count(hold) >= 2 THEN stddev_samp(hold) / nullif(avg(hold), 0) END AS kht_cv,
  CASE WHEN count(hold) >= 2 THEN quantile_cont(hold, 0.9) / nullif(quantile_cont(hold, 0.5), 0) END AS kht_p90_p50, CASE WHEN count(hold) >= 2 THEN quantile_cont(hold, 0.5) / nullif(quantile_cont(hold, 0.1), 0) END AS kht_p50_p10,
  CASE WHEN count(rkdt) >= 2 THEN stddev_samp(rkdt) / nullif(avg(rkdt), 0) END AS rkdt_cv, count(*) AS n_pairs, max(burst) + 1 AS n_bursts FROM b GROUP BY user_id),
s AS (SELECT *, key = 'Backspace' AS del, length(key) = 1 AS ins, coalesce(lag(key = 'Backspace') OVER w, false) AS bef, lead(key = 'Backspace') OVER w AS aft FROM keys WHERE phase = 'keydown' WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)),
v AS (SELECT user_id, count(*) AS n_stream, count(*) FILTER (WHERE del) / nullif(count(*) FILTER (WHERE del OR ins), 0)::DOUBLE AS revision_delete_ratio, 100.0 * count(*) FILTER (WHERE del AND NOT bef) / count(*) AS revision_deletion_episodes_per_100_keys,
  count(*) FILTER (WHERE ins AND aft) / nullif(count(*) FILTER (WHERE ins AND aft IS NOT NULL), 0)::DOUBLE AS revision_immediate_correction_rate FROM s GROUP BY user_id),
mo AS (SELECT user_id, count(*) AS n_moves, CASE WHEN count(*) >= 2 THEN sum(sqrt(dx * dx + dy * dy)) END AS path FROM (SELECT user_id, value - lag(value) OVER w AS dx, k - lag(k) OVER w AS dy FROM m WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)) GROUP BY user_id),
cu AS (SELECT user_id, count(*) FILTER (WHERE NOT lin) / nullif(count(lin), 0)::DOUBLE AS cursor_jump_rate FROM (SELECT user_id, ((k % 3 = lag(k % 3) OVER w) AND (k % 4 = lag(k % 4) OVER w + 1)) OR ((k % 3 = lag(k % 3) OVER w + 1) AND k % 4 = 0) AS lin FROM m WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)) GROUP BY user_id),
spine AS (SELECT DISTINCT user_id FROM m)
SELECT user_id, kit_cv, kit_p90_p50, kit_p50_p10, kit_long_pause_fraction, kit_pause_time_fraction, CASE WHEN two = 1 THEN coalesce(e, 0) END AS kit_pause_entropy, kht_cv, kht_p90_p50, kht_p50_p10, rkdt_cv, revision_delete_ratio, revision_deletion_episodes_per_100_keys, revision_immediate_correction_rate,
  100.0 * n_bursts / n_stream AS burst_bursts_per_100_keys, n_pairs / n_bursts::DOUBLE / n_stream AS burst_relative_burst_length, 100.0 * coalesce(n_moves, 0) / n_stream AS mouse_moves_per_100_keys, 100.0 * path / n_stream AS mouse_path_length, cursor_jump_rate
FROM spine LEFT JOIN r USING (user_id) LEFT JOIN h USING (user_id) LEFT JOIN v USING (user_id) LEFT JOIN mo USING (user_id) LEFT JOIN cu USING (user_id)"""

TIMING = f"""WITH RECURSIVE {EVENTS},
spelt AS (SELECT user_id, ts / 3600000 AS ts, seq, lower(key) AS k, phase, CASE WHEN ascii(key) % 7 IN (3, 4) THEN NULL ELSE code END AS code FROM keys),
queued AS (SELECT *, coalesce(code, k) AS queue FROM spelt),
{PAIRED.format(keys="queued")},
released AS (SELECT u.user_id, u.ts, u.seq, d.k AS down_key, d.ts AS down_ts FROM ups JOIN queued u ON u.seq = ups.up_seq JOIN queued d ON d.seq = ups.matched),
e AS (SELECT q.user_id, q.ts, q.seq, q.k, q.phase, r.down_key FROM queued q LEFT JOIN released r USING (seq)),
l AS (SELECT *, last_value(CASE WHEN phase = 'keydown' AND length(k) = 1 THEN {{'k': k, 'ts': ts}} END IGNORE NULLS) OVER w AS pd, last_value(CASE WHEN length(down_key) = 1 THEN {{'k': down_key, 'ts': ts}} END IGNORE NULLS) OVER w AS pu FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT user_id, 'kht' AS family, down_key AS token, ts - down_ts AS value FROM released WHERE ts >= down_ts
  UNION ALL SELECT user_id, 'kit', pd.k || '->' || k, ts - pd.ts FROM l WHERE phase = 'keydown' AND length(k) = 1 AND pd IS NOT NULL
  UNION ALL SELECT user_id, 'rukd', pu.k || '->' || k, ts - pu.ts FROM l WHERE phase = 'keydown' AND length(k) = 1 AND pu IS NOT NULL),
y AS (SELECT *, quantile_cont(value, 0.25) OVER z AS q1, quantile_cont(value, 0.75) OVER z AS q3 FROM x WHERE value BETWEEN 50 AND 5000 WINDOW z AS (PARTITION BY user_id, family, token))
SELECT user_id, family, token, avg(value) AS mean, stddev_pop(value) AS std, max(value) - min(value) AS range, max(value) AS max, median(value) AS median FROM y WHERE value BETWEEN q1 - 2 * (q3 - q1) AND q3 + 2 * (q3 - q1) GROUP BY user_id, family, token"""

WORDS = "w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:''[a-z]+)?') AS w FROM documents)"
SENTENCES = "list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"
PROSE = f"""WITH {WORDS},
c AS (SELECT doc_id, count(*) AS n_distinct, count(*) FILTER (WHERE n = 1) AS n_once, sum(n * n) AS squares, -sum(n / tot * log2(n / tot)) AS e FROM (SELECT doc_id, word, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS tot FROM (SELECT doc_id, unnest(w) AS word FROM w) GROUP BY doc_id, word) GROUP BY doc_id),
f AS (SELECT *, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS letters, {SENTENCES} AS s, length(t) AS chars FROM w)
SELECT doc_id, n AS total_word_count, coalesce(len(list_filter(w, lambda x: length(x) < 4)) / nullif(n, 0)::DOUBLE, 0) AS short_word_ratio, coalesce(letters / nullif(chars, 0)::DOUBLE, 0) AS word_character_ratio, coalesce(letters / nullif(n, 0)::DOUBLE, 0) AS average_word_length,
  coalesce(n_distinct / n::DOUBLE, 0) AS word_diversity, coalesce(n_once / n::DOUBLE, 0) AS hapax_ratio, coalesce(e, 0) AS word_entropy, coalesce(10000.0 * (squares - n) / (n::DOUBLE * n), 0) AS yules_k, len(s) AS total_sentence_count,
  coalesce(list_sum(list_transform(s, lambda x: length(x))) / nullif(len(s), 0)::DOUBLE, 0) AS average_sentence_length_characters, coalesce(n / nullif(len(s), 0)::DOUBLE, 0) AS average_sentence_length_words, chars AS total_characters,
  coalesce(len(regexp_extract_all(t, '\\p{{L}}')) / nullif(chars, 0)::DOUBLE, 0) AS alphabetic_character_ratio, coalesce(len(regexp_extract_all(t, '\\p{{Lu}}')) / nullif(chars, 0)::DOUBLE, 0) AS uppercase_character_ratio, coalesce(len(regexp_extract_all(t, '\\p{{Nd}}')) / nullif(chars, 0)::DOUBLE, 0) AS digit_character_ratio
FROM f LEFT JOIN c USING (doc_id)"""

BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
KINDS = rf"""l AS (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '{BREAK}') AS a FROM documents),
b AS (SELECT doc_id, t, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM l),
k AS (SELECT doc_id, t, a, len(a) AS n, list_transform(a, lambda x: regexp_replace(x, '^[\s\pZ\x0b\x1c-\x1f\x{{85}}]+', '')) AS s FROM b),
c AS (SELECT doc_id, t, a, n, len(list_filter(s, lambda x: x = '')) AS blank, len(list_filter(s, lambda x: starts_with(x, '#'))) AS comment FROM k)"""
LINES = f"""WITH {KINDS}
SELECT doc_id, n AS total_line_count, blank AS blank_line_count, comment AS pure_comment_line_count, coalesce(blank / nullif(n, 0)::DOUBLE, 0) AS blank_line_ratio, coalesce(comment / nullif(n, 0)::DOUBLE, 0) AS comment_line_ratio,
  comment / nullif(n - blank - comment, 0)::DOUBLE AS comment_to_code_ratio, length(replace(t, '    ', chr(9))) AS total_characters, len(regexp_extract_all(t, ' {{4}}')) AS four_space_tab_count, len(regexp_extract_all(t, '\\t| {{4}}')) AS tab_count,
  coalesce(len(regexp_extract_all(t, '\\t| {{4}}')) / nullif(length(replace(t, '    ', chr(9))), 0)::DOUBLE, 0) AS tab_character_ratio,
  coalesce(list_sum(list_transform(a, lambda x: length(regexp_replace(x, ' {{4}}', chr(9), 'g')))) / nullif(n, 0)::DOUBLE, 0) AS average_line_length_characters FROM c"""
REGISTERED_LINES = "comment / nullif(n, 0)::DOUBLE AS comment_density, blank / nullif(n, 0)::DOUBLE AS blank_line_ratio, comment / nullif(n - blank - comment, 0)::DOUBLE AS comment_to_code_ratio"


def _language_sql(table: str, keys: str) -> str:
    """Features of the toolkit of patterns over a table with ``keys`` and text."""
    marks = r"""!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"""
    word = r"[A-Za-z0-9'']+|[^A-Za-z0-9''\s]"
    return rf"""r AS (SELECT {keys}, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{word}'), lambda x: trim(lower(x), '{marks}')), lambda x: x <> '') AS w,
  list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?]*[^.!?\s][^.!?]*[.!?]*'), lambda x: len(regexp_extract_all(x, '{word}'))) AS sl FROM {table}),
wc AS (SELECT {keys}, count(*) AS d, count(*) FILTER (WHERE c = 1) AS one, -sum(c / tot * log2(c / tot)) AS e FROM (SELECT {keys}, x, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY {keys})::DOUBLE AS tot FROM (SELECT {keys}, unnest(w) AS x FROM r) GROUP BY {keys}, x) GROUP BY {keys}),
lang AS (SELECT {keys}, d / nullif(len(w), 0)::DOUBLE AS ttr, one / nullif(d, 0)::DOUBLE AS hapax_ratio, e AS word_entropy, len(list_filter(w, lambda x: x NOT IN ('the', 'of', 'and', 'to', 'in'))) / nullif(len(w), 0)::DOUBLE AS non_stopword_ratio,
  CASE WHEN len(sl) >= 2 THEN list_aggregate(sl, 'stddev_samp') / nullif(list_avg(sl), 0) END AS sentence_length_cv FROM r LEFT JOIN wc USING ({keys}))"""


LANGUAGE = f"WITH {_language_sql('conversations', 'conv_id, turn')} SELECT * FROM lang"
TIER1_NAMES = ", ".join(S.TIER1)
#: Answers are documents; a user's answer is typed in one session, code or explanation by the user's number.
EXTRACTED_SQL = f"""WITH tier AS ({TIER1}),
g AS (SELECT user_id FROM tier UNION SELECT doc_id FROM documents WHERE text IS NOT NULL),
{KINDS}, lines AS (SELECT doc_id, {REGISTERED_LINES} FROM c),
{_language_sql('documents', 'doc_id')},
wide AS (SELECT g.user_id, tier.* EXCLUDE (user_id), lines.* EXCLUDE (doc_id), lang.* EXCLUDE (doc_id) FROM g LEFT JOIN tier USING (user_id) LEFT JOIN lines ON lines.doc_id = g.user_id LEFT JOIN lang ON lang.doc_id = g.user_id),
long AS (SELECT user_id, unnest({[*S.TIER1, *EXTRACTED]}) AS name, unnest([{', '.join(f'{n}::DOUBLE' for n in (*S.TIER1, *EXTRACTED))}]) AS value FROM wide),
named AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'code' ELSE 'explanation' END AS r_t, name, value, list_position({list(S.TIER1)}, name) IS NOT NULL AS rhythm, list_position({list(EXTRACTED[:3])}, name) IS NOT NULL AS of_code FROM long)
SELECT user_id::VARCHAR AS user, (user_id % 5 + 1)::INT AS session, 1 AS q_id, r_t, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 2 END AS version,
  CASE WHEN rhythm THEN 'tier1' WHEN name IN ('blank_line_ratio', 'comment_to_code_ratio') THEN 'tier3' ELSE 'tier2' END AS tier,
  CASE WHEN rhythm THEN 'tier1_' || r_t || '_' WHEN name IN ('blank_line_ratio', 'comment_to_code_ratio') THEN 'tier3_llm_' WHEN of_code THEN 'tier2_code_' ELSE 'tier2_explanation_' END || name AS feature, value
FROM named WHERE rhythm OR of_code = (r_t = 'code')"""


def _quoted(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _distribution_sql(items, count: str, total: str) -> str:
    return f"WITH {WORDS} SELECT doc_id, item, coalesce(({count}) / nullif({total}, 0)::DOUBLE, 0) AS share FROM (SELECT *, unnest({_quoted(items)}) AS item FROM w)"


LONG = "WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS label, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)"
COHEN = f"{LONG}, g AS (SELECT feature, label, avg(value) AS mean, var_samp(value) AS v FROM x GROUP BY 1, 2) SELECT a.feature, a.label, (a.mean - b.mean) / nullif(sqrt((a.v + b.v) / 2), 0) AS d FROM g a JOIN g b ON a.feature = b.feature AND b.label = 'N' WHERE a.label <> 'N'"
ONE_VS_REST = f"{LONG}, y AS (SELECT x.feature, x.value, l.label, x.label = l.label AS own FROM x JOIN (SELECT DISTINCT label FROM x) l ON true), g AS (SELECT feature, label, count(*) FILTER (WHERE own) AS n, avg(value) FILTER (WHERE own) AS mo, avg(value) FILTER (WHERE NOT own) AS mr, var_samp(value) FILTER (WHERE own) AS vo, var_samp(value) FILTER (WHERE NOT own) AS vr, count(*) AS t FROM y GROUP BY 1, 2) SELECT feature, label, (mo - mr) / nullif(sqrt(((n - 1) * vo + (t - n - 1) * vr) / (t - 2)), 0) AS d FROM g"
PREDICTED = "p AS (SELECT quality AS y_true, CAST(n_chars > 1000 AS INT) AS y_pred FROM labels JOIN documents USING (doc_id))"


PROMPTED = rf"""WITH f AS (SELECT page_id, unnest(list_distinct(list_concat(regexp_extract_all(h, '{C.SNAKE}'), list_concat(regexp_extract_all(h, '{C.CALLED}', 1), regexp_extract_all(h, '{C.ASSIGNED.replace("=(?!=)", "=(?:[^=]|$)")}', 1))))) AS name FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
SELECT page_id, name FROM f WHERE name NOT IN (SELECT unnest({_quoted(sorted(C.RESERVED | C.BUILTINS))}))"""


def oracle_sql() -> dict[str, str]:
    return {
        "rhythm_minimum_slice": f"WITH {EVENTS} SELECT user_id, count(*) AS n, stddev_samp(iki) / nullif(avg(iki), 0) AS kit_cv, CASE WHEN count(iki) >= 2 THEN quantile_cont(iki, 0.9) / nullif(quantile_cont(iki, 0.5), 0) END AS kit_p90_p50 FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) AS iki FROM m) GROUP BY user_id",
        "fifo_pairs": f"WITH RECURSIVE {MAPPED} SELECT user_id, code, key, down_ts, up_ts FROM pairs",
        "tier1_features": TIER1,
        "timing_summary": TIMING,
        "timing_catalog": """WITH l AS (SELECT CASE WHEN i = 26 THEN ' ' ELSE chr(97 + i::INT) END AS k, i FROM range(27) r(i)),
            b AS (SELECT a.k || '->' || z.k AS token, a.i * 27 + z.i AS i FROM l a, l z),
            t AS (SELECT 'kht' AS family, k AS token, i FROM l UNION ALL VALUES ('kht', 'backspace', 27), ('kht', 'shift', 28) UNION ALL SELECT 'kit', token, 29 + i FROM b UNION ALL SELECT 'rukd', token, 758 + i FROM b),
            s AS (SELECT unnest(['mean', 'std', 'cv', 'range', 'max', 'median']) AS stat, unnest(range(6)) AS j)
            SELECT family || '_' || replace(token, ' ', 'space') || '_' || stat AS feature, family, token, stat, (i * 6 + j)::BIGINT AS place FROM t, s""",
        "extracted_long": EXTRACTED_SQL,
        "registered_lines": f"WITH {KINDS} SELECT doc_id, {REGISTERED_LINES} FROM c",
        "plain_language": LANGUAGE,
        "question_means": f"WITH {KINDS} SELECT d.source, avg(n)::DOUBLE AS average_lines_per_question, avg(len({SENTENCES}))::DOUBLE AS average_sentences_per_question FROM c JOIN documents d USING (doc_id) GROUP BY 1",
        "prompt_identifiers": PROMPTED,
        "prose_features": PROSE,
        "line_features": LINES,
        "letter_distribution": _distribution_sql("abcdefghijklmnopqrstuvwxyz", "length(t) - length(replace(lower(t), item, ''))", "length(t)"),
        "special_distribution": _distribution_sql(P.SPECIAL_CHARACTERS, "length(t) - length(replace(t, item, ''))", "length(t)"),
        "punctuation_distribution": _distribution_sql(P.PUNCTUATION, "length(t) - length(replace(t, item, ''))", "length(t)"),
        "word_length_distribution": _distribution_sql([str(k) for k in range(1, 21)], "len(list_filter(w, lambda x: length(x)::VARCHAR = item))", "len(w)"),
        "function_word_distribution": _distribution_sql(P.FUNCTION_WORDS, "len(list_filter(w, lambda x: x = item))", "len(w)"),
        "misspelled_words": "WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), s AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations), n AS (SELECT conv_id, turn, count(*) AS n FROM s WHERE word NOT IN (SELECT word FROM d WHERE word IS NOT NULL) GROUP BY conv_id, turn) SELECT DISTINCT c.conv_id, c.turn, coalesce(n, 0) AS n_misspelled FROM conversations c LEFT JOIN n USING (conv_id, turn)",
        "wide_pivot": "SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part",
        "wide_lossy": "SELECT p_partkey, p_size::DOUBLE AS p_size FROM part WHERE p_size > 25",
        "feature_quality": f"{LONG} SELECT feature, count(*) AS n, count(*) FILTER (WHERE value > 0.05) AS n_known, count(*) FILTER (WHERE NOT value > 0.05) AS n_missing FROM x GROUP BY feature",
        "coverage": "SELECT n_nationkey AS c_nationkey, count(DISTINCT c_custkey) AS n_users FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1",
        "combine_families": "SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders GROUP BY 1",
        "cohens_d": COHEN,
        "largest_d": f"SELECT feature, max(abs(d)) AS d_max FROM ({COHEN}) GROUP BY 1",
        "one_vs_rest_d": ONE_VS_REST,
        "effect_heatmap": f"WITH e AS ({ONE_VS_REST}) SELECT feature, any_value(d) FILTER (WHERE label = 'A') AS A, any_value(d) FILTER (WHERE label = 'N') AS N, any_value(d) FILTER (WHERE label = 'R') AS R FROM e GROUP BY 1 ORDER BY max(abs(d)) DESC NULLS LAST, feature LIMIT 3",
        "rank_within": "WITH p AS (SELECT p_partkey AS feature, p_brand, CASE WHEN p_size > 5 THEN p_size END AS score FROM part) SELECT *, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY p_brand ORDER BY score DESC NULLS LAST) END AS rank FROM p",
        "importance_report": "WITH p AS (SELECT p_partkey AS feature, CASE WHEN p_size > 5 THEN p_size END AS score FROM part), f AS (SELECT l_partkey AS feature, count(DISTINCT l_linenumber % 3) AS n_folds FROM lineitem GROUP BY 1) SELECT p.feature, score, n_folds, rank() OVER (ORDER BY score DESC NULLS LAST) AS score_rank FROM p LEFT JOIN f USING (feature)",
        "version_mapping": f"WITH {EVENTS}, d AS (SELECT user_id, user_id % 3 AS version, count(*) AS n FROM keys WHERE phase = 'keydown' GROUP BY 1, 2), x AS (SELECT version, lang AS field, n, length(coalesce(text, '')) AS length FROM d JOIN documents ON doc_id = user_id) SELECT version, field, count(*) AS n, avg(x.n) AS mean_keydowns, CASE WHEN count(*) >= 2 AND isfinite(corr(x.n, length)) THEN corr(x.n, length) END AS r FROM x GROUP BY 1, 2",
        "boilerplate_share": "WITH s AS (SELECT lang, source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:''[a-z]+)?')) AS word FROM documents), u AS (SELECT lang, count(DISTINCT source) AS users, count(*) AS tot FROM s GROUP BY 1), i AS (SELECT s.lang, word, count(*) AS n FROM s JOIN u USING (lang) GROUP BY 1, 2 HAVING count(DISTINCT source) >= 0.9 * any_value(users)) SELECT lang, count(n) AS n_items, any_value(users) AS users, coalesce(sum(n / tot::DOUBLE), 0) AS occurrence_share FROM u LEFT JOIN i USING (lang) WHERE users > 1 GROUP BY lang",
        "condition_far": f"WITH {PREDICTED} SELECT y_true, avg(CAST(y_pred = 0 AS DOUBLE)) AS far FROM p WHERE y_true <> 0 GROUP BY 1",
        "summed_confusion": "SELECT o_orderpriority, o_orderstatus AS y_true, left(o_orderpriority, 1) AS y_pred, count(*) AS n FROM orders GROUP BY 1, 2, 3",
        "correlation_pairs": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]),
        "spearman_rho": "SELECT corr(x, y) AS rho FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS y FROM part)",
        "feature_ranks": "SELECT p_partkey AS feature, CASE WHEN p_size > 5 THEN p_size END AS score, rank() OVER (ORDER BY CASE WHEN p_size > 5 THEN p_size END DESC NULLS LAST) AS rank FROM part",
        "rank_disagreements": "WITH s AS (SELECT s_suppkey AS feature, rank() OVER (ORDER BY s_acctbal DESC) AS a, rank() OVER (ORDER BY s_name DESC) AS b FROM supplier) SELECT *, abs(a - b) AS difference FROM s ORDER BY difference DESC, feature LIMIT 10",
        "shared_words": "WITH s AS (SELECT lang, source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:''[a-z]+)?')) AS word FROM documents), u AS (SELECT lang, count(DISTINCT source) AS users, count(*) AS tot FROM s GROUP BY 1) SELECT s.lang, word, count(DISTINCT source) AS n_users, any_value(users) AS users, count(*) / any_value(tot)::DOUBLE AS occurrence_share FROM s JOIN u USING (lang) GROUP BY 1, 2 HAVING count(DISTINCT source) >= 0.5 * any_value(users)",
        "length_correlation": f"WITH {WORDS} SELECT lang, avg(len(w)) AS mean_words, corr(length(t), len(w)) AS r FROM w JOIN documents USING (doc_id) GROUP BY 1",
        "error_rates": f"WITH {PREDICTED} SELECT count(*) FILTER (WHERE y_true = 0 AND y_pred <> 0) / nullif(count(*) FILTER (WHERE y_true = 0), 0)::DOUBLE AS frr, count(*) FILTER (WHERE y_true <> 0 AND y_pred = 0) / nullif(count(*) FILTER (WHERE y_true <> 0), 0)::DOUBLE AS far, avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy FROM p",
        "confusion": f"WITH {PREDICTED} SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY 1, 2",
        "f1_scores": f"WITH {PREDICTED}, y AS (SELECT DISTINCT unnest([y_true, y_pred]) AS y FROM p), g AS (SELECT y, count(*) FILTER (WHERE y_true = y) AS t, 2.0 * count(*) FILTER (WHERE y_true = y AND y_pred = y) / (count(*) FILTER (WHERE y_true = y) + count(*) FILTER (WHERE y_pred = y)) AS f FROM p, y GROUP BY y) SELECT avg(f) AS macro_f1, sum(f * t) / sum(t) AS weighted_f1 FROM g",
        "fold_summary": "SELECT o_orderpriority, count(*) < 4 AS partial, count(*) AS n_folds, avg(score) AS score_mean, stddev_pop(score) AS score_std FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2) GROUP BY 1",
    }
