"""Relevance of features: effect sizes, mutual information, correlation, ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of one feature that one task may hold, for the estimator of mutual information.
MI_ROWS = 5_000_000
#: Ranges of values that ranks are computed in.
RANGES = 256


def cohens_d(long: DataFrame, label: str, base) -> DataFrame:
    """feature, label, d of each label against ``base``: mean difference over sqrt of the mean of both variances (ddof 1)."""
    m = long.where(F.col("value").isNotNull()).groupBy("feature", label).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    b = m.where(F.col(label) == F.lit(base)).select("feature", F.col("mean").alias("bm"), F.col("var").alias("bv"))
    others = m.where(F.col(label) != F.lit(base)).join(b, "feature")
    return others.select("feature", label, F.try_divide(F.col("mean") - F.col("bm"), F.nullif(F.sqrt((F.col("var") + F.col("bv")) / 2), F.lit(0.0))).alias("d"))


def one_vs_rest_d(long: DataFrame, label: str) -> DataFrame:
    """feature, label, d of a label against all others, standard deviations pooled by size; NULL below two on a side."""
    v = F.col("value")
    own = long.where(v.isNotNull()).groupBy("feature", label).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("var"))
    # Sums of squares about the means, so that totals minus own parts stay exact enough.
    whole = Window.partitionBy("feature")
    x = own.withColumn("all_n", F.sum("n").over(whole)).withColumn("all_sum", F.sum(F.col("n") * F.col("mean")).over(whole))
    x = x.withColumn("all_squares", F.sum(F.col("n") * (F.col("var") + F.col("mean") * F.col("mean"))).over(whole))
    rn = F.col("all_n") - F.col("n")
    rm = F.try_divide(F.col("all_sum") - F.col("n") * F.col("mean"), rn)
    rq = F.col("all_squares") - F.col("n") * (F.col("var") + F.col("mean") * F.col("mean"))
    ss = F.col("n") * F.col("var") + F.greatest(rq - rn * rm * rm, F.lit(0.0))
    pooled = F.sqrt(F.try_divide(ss, F.col("all_n") - 2))
    return x.select("feature", label, F.when((F.col("n") >= 2) & (rn >= 2), F.try_divide(F.col("mean") - rm, F.nullif(pooled, F.lit(0.0)))).alias("d"))


def digamma(x: np.ndarray) -> np.ndarray:
    x, shift = np.asarray(x, dtype=float).copy(), 0.0
    for _ in range(6):
        shift = shift - 1.0 / x
        x = x + 1.0
    inv = 1.0 / (x * x)
    return shift + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def knn_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information (nats) of a continuous and a discrete variable by nearest neighbours (Ross 2014)."""
    x, y = np.asarray(x, dtype=float), np.asarray(y)
    labels, inverse, sizes = np.unique(y, return_inverse=True, return_counts=True)
    use = sizes[inverse] > 1
    if use.sum() < 2 or np.ptp(x) == 0:
        return 0.0
    x, y, inverse = x[use], y[use], inverse[use]
    radius, near = np.empty(len(x)), np.empty(len(x))
    for c in np.unique(inverse):
        at = np.flatnonzero(inverse == c)
        own, kk = np.sort(x[at]), min(k, len(at) - 1)
        rank = np.argsort(np.argsort(x[at], kind="stable"), kind="stable")
        reach = np.full(len(at), np.inf)
        for left in range(kk + 1):  # the k nearest are a run of neighbours that holds the point
            lo, hi = rank - left, rank + kk - left
            ok = (lo >= 0) & (hi < len(at))
            d = np.maximum(own[rank] - own[np.clip(lo, 0, None)], own[np.clip(hi, None, len(at) - 1)] - own[rank])
            reach = np.where(ok, np.minimum(reach, d), reach)
        radius[at], near[at] = reach, kk
    every = np.sort(x)
    high, low = np.searchsorted(every, x + radius, side="left"), np.searchsorted(every, x - radius, side="right")
    # Only what is nearer than the radius counts; sums are rounded, so the edges are settled by differences.
    while (over := (high > 0) & (every[high - 1] - x >= np.maximum(radius, np.nextafter(0, 1)))).any():
        high = high - over
    while (under := (low < len(every)) & (x - every[np.minimum(low, len(every) - 1)] >= np.maximum(radius, np.nextafter(0, 1)))).any():
        low = low + under
    m = np.maximum(high - low, 1)
    sizes = np.bincount(inverse)[inverse]
    value = digamma(np.array([len(x)]))[0] + digamma(near).mean() - digamma(sizes).mean() - digamma(m).mean()
    return max(0.0, float(value))


def mutual_information(long: DataFrame, label: str, k: int = 3, by: tuple[str, ...] = ("feature",), most: int = MI_ROWS) -> DataFrame:
    """``by`` (a feature), mi: NULL values are left out feature by feature.

    The estimator needs a feature's values in one place: (value, label) pairs of one feature are one
    task's, at most ``most`` of them, which is checked; more is an error, never a sample.
    """
    import pandas as pd

    keys = [f"{c} {dict(long.dtypes)[c]}" for c in by]

    def score(name, pdf):
        x = pdf["value"].to_numpy(dtype=float)
        return pd.DataFrame([[*name, knn_information(x / (x.std() or 1.0), pdf[label].to_numpy(), k)]])

    known = long.where(F.col("value").isNotNull()).select(*by, "value", label)
    sizes = known.groupBy(*by).agg(F.count("*").alias("n_values"))
    fits = F.when(F.col("n_values") > most, F.raise_error(F.concat(F.to_json(F.struct(*by)), F.lit(f" has more than {most} values")))).otherwise(F.lit(True))
    checked = known.join(sizes.where(fits).select(*by), list(by), "left_semi")
    return checked.groupBy(*by).applyInPandas(score, ", ".join([*keys, "mi double"]))


def median_filled(long: DataFrame) -> DataFrame:
    """NULL values replaced by their feature's median, for scores that take none."""
    return long.withColumn("value", F.coalesce("value", F.percentile("value", F.lit(0.5)).over(Window.partitionBy("feature"))))


def ranked(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """Descending rank over a table of features, ties get the least, NULL last."""
    return df.withColumn(name, F.rank().over(Window.orderBy(F.desc_nulls_last(score))))


def ranked_within(df: DataFrame, score: str, by: list[str], name: str = "rank") -> DataFrame:
    """Descending rank within groups, ties get the least; NULL stays NULL."""
    return df.withColumn(name, F.when(F.col(score).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(score)))))


def correlations(wide: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of every pair of columns over the rows that have both, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = wide.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias("r")) for a, b in pairs]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.a", "x.b", F.nanvl("x.r", F.lit(None)).alias("r"))


def redundancy_groups(pairs: DataFrame, limit: float = 0.9) -> list[list[str]]:
    """Groups of features joined by |r| >= limit, largest first; the features are few (one row a pair)."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in pairs.where(F.abs("r") >= limit).orderBy("a", "b").collect():
        parent[find(r.b)] = find(r.a)
    out: dict[str, list[str]] = {}
    for x in sorted(parent):
        out.setdefault(find(x), []).append(x)
    return sorted((g for g in out.values() if len(g) > 1), key=lambda g: (-len(g), g))


def average_ranks(df: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """value, rank: the average rank of each distinct value of a numeric column.

    Values are dealt to ranges between approximate quantiles, so that no task sees all of them;
    the ranks are exact: the rows of the ranges before, and of the lesser values within the range.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    cuts = [i / ranges for i in range(1, ranges)]
    edges = sorted(set(df.approxQuantile(column, cuts, 1 / (4 * ranges)))) if cuts else []  # fewer than ``ranges`` numbers
    dealt = counts.withColumn("range", F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e <= F.col("value"))))
    lower = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("lesser", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(before), "range")
    return placed.select("value", (F.col("before") + F.col("lesser") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row rho over complete pairs of numbers, average ranks."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    of = lambda c: average_ranks(both, c).select(F.col("value").alias(c), F.col("rank").alias(f"rank_{c}"))
    return both.join(of("a"), "a").join(of("b"), "b").agg(F.corr("rank_a", "rank_b").alias("rho"))


def disagreements(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """The ``n`` features whose ranks differ most."""
    return df.withColumn("difference", F.abs(F.col(a) - F.col(b))).orderBy(F.desc("difference"), "feature").limit(n)


def largest_d(effects: DataFrame) -> DataFrame:
    """feature, d_max: the largest absolute effect over all conditions."""
    return effects.groupBy("feature").agg(F.max(F.abs("d")).alias("d_max"))


def shared_by_users(occurrences: DataFrame, by: list[str], user: str, item: str, share: float) -> DataFrame:
    """by, item, n_users, users, occurrence_share of items that at least ``share`` of a group's users have.

    occurrence_share is the part of all the group's occurrences that are this item's.
    """
    counted = occurrences.groupBy(*by, item, user).agg(F.count("*").alias("n"))
    of_item = counted.groupBy(*by, item).agg(F.count("*").alias("n_users"), F.sum("n").alias("n"))
    whole = occurrences.groupBy(*by).agg(F.countDistinct(user).alias("users"), F.count("*").alias("all"))
    kept = of_item.join(whole, by).where(F.col("n_users") >= share * F.col("users"))
    return kept.select(*by, item, "n_users", "users", (F.col("n") / F.col("all")).alias("occurrence_share"))


def boilerplate_share(occurrences: DataFrame, by: list[str], user: str, item: str, share: float) -> DataFrame:
    """by, n_items, users, occurrence_share: all widely shared items of a group together; groups of one user are left out."""
    shared = shared_by_users(occurrences, by, user, item, share)
    groups = occurrences.groupBy(*by).agg(F.countDistinct(user).alias("users")).where("users > 1")
    sums = shared.groupBy(*by).agg(F.count("*").alias("n_items"), F.sum("occurrence_share").alias("occurrence_share"))
    return groups.join(sums, by, "left").select(*by, F.coalesce("n_items", F.lit(0)).alias("n_items"), "users", F.coalesce("occurrence_share", F.lit(0.0)).alias("occurrence_share"))


def version_mapping(keydowns: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """by, field, n, mean_keydowns, r: how the keydowns of a group follow the length of a response field.

    ``keydowns``: question keys, the columns of ``by``, n_keydowns; ``lengths``: question keys, field, length.
    """
    shared = [c for c in keydowns.columns if c in lengths.columns]
    pairs = keydowns.join(lengths, shared)
    r = F.when(F.count("*") >= 2, F.nanvl(F.corr("n_keydowns", "length"), F.lit(None)))
    return pairs.groupBy(*by, "field").agg(F.count("*").alias("n"), F.avg("n_keydowns").alias("mean_keydowns"), r.alias("r"))


def scenario_scores(long: DataFrame, dataset: str, scenarios: dict[int, str], k: int = 3) -> DataFrame:
    """One row for each response type, scenario and feature: effect, information and rank of the scenario against all others.

    Columns: dataset, r_t, session, scenario, feature, mi, d, n_scenario, n_rest, missing_scenario,
    missing_rest, status, mi_rank. Infinite and NaN values count as missing. An error: a needed
    column isn't there, or, when it is computed, a session is unknown or an observation repeated.
    """
    lacking = sorted({"user", "session", "q_id", "r_t", "version", "feature", "value"} - set(long.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    unknown = F.raise_error(F.concat(F.lit("unknown session "), F.col("session").cast("string")))
    known = long.where(F.when(F.col("session").isin(*scenarios), F.lit(True)).otherwise(unknown))
    typed = known.where(F.when(F.col("session") == 1, F.col("version") == 1).otherwise(F.col("version") == 2))
    keys = ["user", "session", "q_id", "r_t", "feature"]
    once = typed.groupBy(*keys).agg(F.count("*").alias("n"), F.first("value").alias("value"))
    twice = F.raise_error(F.concat(F.lit("repeated observation "), F.to_json(F.struct(*keys))))
    v = F.nanvl("value", F.lit(None))
    finite = F.when(F.abs(v) < float("inf"), v)
    values = once.select(*keys, F.when(F.col("n") > 1, twice).otherwise(finite).alias("value"))
    # Every feature of a response type has a row for every group of that type, as a wide table would have.
    groups = values.select("user", "session", "q_id", "r_t").distinct().groupBy("r_t", "session").agg(F.count("*").alias("groups"))
    rows = long.sparkSession.createDataFrame([(int(s), name) for s, name in scenarios.items()], "s int, scenario string")
    sided = values.join(F.broadcast(rows)).withColumn("own", (F.col("session") == F.col("s")).cast("int"))
    own, rest, x = F.col("own") == 1, F.col("own") == 0, F.col("value")
    of = lambda f, side: f(F.when(side, x))
    at = ["r_t", "feature", "s", "scenario"]
    stats = sided.groupBy(*at).agg(
        of(F.count, own).alias("n_scenario"), of(F.count, rest).alias("n_rest"), of(F.avg, own).alias("m1"), of(F.avg, rest).alias("m0"),
        of(F.var_samp, own).alias("v1"), of(F.var_samp, rest).alias("v0"), F.min("value").alias("low"), F.max("value").alias("high"),
    )
    totals = groups.join(F.broadcast(rows)).groupBy("r_t", "s").agg(
        F.sum(F.when(F.col("session") == F.col("s"), F.col("groups")).otherwise(0)).alias("g1"), F.sum(F.when(F.col("session") != F.col("s"), F.col("groups")).otherwise(0)).alias("g0")
    )
    mi = mutual_information(sided, "own", k, ("r_t", "feature", "s"))
    n1, n0 = F.col("n_scenario"), F.col("n_rest")
    enough = (n1 >= 2) & (n0 >= 2)
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / (n1 + n0 - 2))
    status = F.when(~enough, "insufficient_observations").when(F.col("low") == F.col("high"), "constant").otherwise("ok")
    joined = stats.join(totals, ["r_t", "s"]).join(mi, ["r_t", "feature", "s"], "left")
    out = joined.select(
        F.lit(dataset).alias("dataset"), "r_t", F.col("s").alias("session"), "scenario", "feature",
        F.when(enough, F.when(F.col("low") == F.col("high"), 0.0).otherwise(F.col("mi"))).alias("mi"),
        F.when(enough & (pooled > 0), (F.col("m1") - F.col("m0")) / pooled).alias("d"),
        "n_scenario", "n_rest", (F.col("g1") - n1).alias("missing_scenario"), (F.col("g0") - n0).alias("missing_rest"), status.alias("status"),
    )
    return ranked_within(out, "mi", ["dataset", "r_t", "scenario"], "mi_rank")


def heatmap(scores: DataFrame, metric: str, scenarios: list[str], top: int = 20) -> DataFrame:
    """feature and a column for each scenario, the largest absolute values first; ``top`` rows, 0 for all."""
    matrix = scores.groupBy("feature").pivot("scenario", scenarios).agg(F.first(metric))
    most = F.greatest(*[F.abs(F.col(f"`{c}`")) for c in scenarios]) if len(scenarios) > 1 else F.abs(F.col(f"`{scenarios[0]}`"))
    ordered = matrix.orderBy(F.desc_nulls_last(most), "feature")
    return ordered.limit(top) if top else ordered


def selection_stability(selected: DataFrame) -> DataFrame:
    """feature, n_folds: in how many folds a feature was chosen; ``selected`` has fold and feature."""
    return selected.groupBy("feature").agg(F.countDistinct("fold").alias("n_folds"))


def importance_report(features: DataFrame, measures: dict[str, DataFrame], ranks: dict[str, str], order: str) -> DataFrame:
    """All measures side by side, a row for each feature, best first (NULL last).

    ``measures``: tables with feature and further columns, by name; ``ranks``: name of a rank by the column it ranks.
    """
    out = features.select("feature")
    for df in measures.values():
        out = out.join(df, "feature", "left")
    for score, name in ranks.items():
        out = ranked(out, score, name)
    return out.orderBy(F.desc_nulls_last(order), "feature")
