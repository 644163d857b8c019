"""Evaluation plans: participant-disjoint folds, error rates, fold summaries, importance, classifiers, search."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Participants that may come to the driver to be dealt to folds.
MAX_GROUPS = 1_000_000
#: Rows among which a column's values change places.
SHUFFLED_TOGETHER = 100_000


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, most: int = MAX_GROUPS) -> DataFrame:
    """``df`` with a fold for each row; a group is in one fold, and label counts are kept level.

    Counts by (group, label) come to the driver: a table of participants, at most ``most`` rows of it, or
    an error. Groups with the most uneven counts are placed first, each where the spread of label
    shares stays least.
    """
    rows = df.groupBy(group, label).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups and labels; folds are for participants")
    counts: dict = {}
    for r in rows:
        counts.setdefault(r[group], {})[r[label]] = r["count"]
    labels = {y for c in counts.values() for y in c}
    total = {y: sum(c.get(y, 0) for c in counts.values()) for y in labels}
    held = [dict.fromkeys(labels, 0) for _ in range(k)]

    def spread(fold: int, own: dict) -> tuple:
        after = [[(h[y] + (own.get(y, 0) if i == fold else 0)) / total[y] for i, h in enumerate(held)] for y in labels]
        return sum(sum((x - 1 / k) ** 2 for x in row) for row in after), sum(held[fold].values()), fold

    placed = []
    for g, own in sorted(counts.items(), key=lambda e: (-max(e[1].values()), str(e[0]))):
        best = min(range(k), key=lambda fold: spread(fold, own))
        for y, n in own.items():
            held[best][y] += n
        placed.append((g, best))
    at = df.sparkSession.createDataFrame(placed, f"{group} {dict(df.dtypes)[group]}, fold int") if placed else df.select(group).limit(0).withColumn("fold", F.lit(0))
    return df.join(at, group)


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, labels: list[int]) -> list[list[int]]:
    """Counts by true (rows) and predicted label; a label that isn't listed is an error."""
    found = {(r.y_true, r.y_pred): r.n for r in confusion(predictions).collect()}  # a row a pair of labels
    strange = sorted({y for pair in found for y in pair} - set(labels))
    if strange:
        raise ValueError(f"labels {strange} aren't listed")
    return [[found.get((t, p), 0) for p in labels] for t in labels]


def error_rates(predictions: DataFrame, genuine: int = 0) -> DataFrame:
    """One row: frr (genuine ones refused), far (others accepted), accuracy; NULL at zero denominators."""
    own, accepted = F.col("y_true") == genuine, F.col("y_pred") == genuine
    share = lambda hit, of: F.try_divide(F.count_if(hit).cast("double"), F.count_if(of).cast("double"))
    right = F.col("y_true") == F.col("y_pred")
    return predictions.agg(share(own & ~accepted, own).alias("frr"), share(~own & accepted, ~own).alias("far"), share(right, F.lit(True)).alias("accuracy"))


def condition_far(predictions: DataFrame, genuine: int = 0) -> DataFrame:
    """y_true, far of each condition that isn't genuine."""
    return predictions.where(F.col("y_true") != genuine).groupBy("y_true").agg(F.avg((F.col("y_pred") == genuine).cast("double")).alias("far"))


def rates_of_matrix(matrix: list[list[int]], labels: list[int], genuine: int = 0) -> dict:
    """far, frr and, with more than two labels, far_by_condition of a confusion matrix; None at zero denominators."""
    if len(matrix) != len(labels) or any(len(row) != len(labels) for row in matrix):
        raise ValueError("the matrix must have a row and a column for each label")
    if genuine not in labels or len(set(labels)) < len(labels):
        raise ValueError(f"labels must be unique and have {genuine}")
    own = labels.index(genuine)
    share = lambda n, of: n / of if of else None
    others = {y: row for y, row in zip(labels, matrix, strict=True) if y != genuine}
    out = {
        "frr": share(sum(matrix[own]) - matrix[own][own], sum(matrix[own])),
        "far": share(sum(row[own] for row in others.values()), sum(map(sum, others.values()))),
    }
    if len(labels) > 2:
        out["far_by_condition"] = {str(y): share(row[own], sum(row)) for y, row in others.items()}
    return out


def f1_scores(predictions: DataFrame) -> DataFrame:
    """One row: macro and weighted F1 over the labels that occur."""
    side = lambda label, t, p: F.struct(F.col(label).alias("y"), F.lit(t).alias("t"), F.lit(p).alias("p"))
    both = F.explode(F.array(side("y_true", 1, 0), side("y_pred", 0, 1)))
    sides = predictions.select(both.alias("s"), (F.col("y_true") == F.col("y_pred")).alias("hit"))
    per = sides.groupBy("s.y").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum(F.when(F.col("hit") & (F.col("s.t") == 1), 1).otherwise(0)).alias("tp"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0))
    return per.agg(F.avg(f1).alias("macro_f1"), F.try_divide(F.sum(f1 * F.col("t")), F.sum("t")).alias("weighted_f1"))


def fold_summary(results: DataFrame, by: list[str], metrics: list[str], folds: int | None = None) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds, NULLs left out; partial if folds are missing."""
    stats = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    out = results.groupBy(*by).agg(F.count("*").alias("n_folds"), *stats)
    return out if folds is None else out.withColumn("partial", F.col("n_folds") < folds)


def summed_confusion(matrices: DataFrame, by: list[str]) -> DataFrame:
    """``by``, y_true, y_pred, n over all folds; ``matrices`` has a row for each fold and cell."""
    return matrices.groupBy(*by, "y_true", "y_pred").agg(F.sum("n").alias("n"))


def select_top_share(scores: DataFrame, share: float = 0.5) -> DataFrame:
    """The best max(1, floor(p * share)) features by mi, over a table of p features."""
    if not 0 < share <= 1:
        raise ValueError("the share of features must be above 0 and at most 1")
    x = scores.withColumn("k", F.row_number().over(Window.orderBy(F.desc_nulls_last("mi"), "feature"))).withColumn("p", F.count("*").over(Window.partitionBy()))
    return x.where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("p") * share))).drop("k", "p")


def balanced_weight(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Adds a weight that gives all labels the same sum."""
    n = df.groupBy(label).agg(F.count("*").alias("own"))
    whole = n.agg(F.sum("own").alias("all"), F.count("*").alias("kinds"))
    return df.join(F.broadcast(n.crossJoin(whole).select(label, (F.col("all") / (F.col("kinds") * F.col("own"))).alias(name))), label)


def classifier(kind: str, features: list[str], n_labels: int = 2, weight: str | None = None, **params):
    """Median imputation, min-max scaling and a Spark ML classifier in one pipeline.

    Kinds: ``svm`` (linear, one against the rest), ``svm_poly`` (the same over polynomial
    expansions; ``degree``), ``mlp``, ``forest``, ``boosted``. ``boosted`` keeps missing values apart: each feature
    has a second column that says whether it was there, as the trees take no missing values.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml.feature import Imputer, MinMaxScaler, PolynomialExpansion, SQLTransformer, VectorAssembler

    filled = [f"{f}_filled" for f in features]
    stages = [Imputer(strategy="median", relativeError=1e-6, inputCols=features, outputCols=filled)]
    inputs = list(filled)
    if kind == "boosted":
        there = [f"{f}_there" for f in features]
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST(`{f}` IS NOT NULL AS DOUBLE) AS `{t}`" for f, t in zip(features, there, strict=True)) + " FROM __THIS__"))
        inputs += there
    stages += [VectorAssembler(inputCols=inputs, outputCol="assembled"), MinMaxScaler(inputCol="assembled", outputCol="scaled")]
    column = "scaled"
    if kind == "svm_poly":
        stages.append(PolynomialExpansion(degree=params.pop("degree", 3), inputCol="scaled", outputCol="expanded"))
        column = "expanded"
    own = {"labelCol": "label", "featuresCol": column} | ({"weightCol": weight} if weight and kind != "mlp" else {})
    if kind in ("svm", "svm_poly"):
        last = C.OneVsRest(classifier=C.LinearSVC(**params), **own)
    elif kind == "mlp":
        hidden = params.pop("hidden", [16])
        last = C.MultilayerPerceptronClassifier(layers=[len(inputs), *hidden, n_labels], **params, **own)
    elif kind == "boosted":
        boosted = C.GBTClassifier(**params, **(own if n_labels == 2 else {}))
        last = boosted if n_labels == 2 else C.OneVsRest(classifier=boosted, **own)
    elif kind == "forest":
        last = C.RandomForestClassifier(**params, **own)
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    return Pipeline(stages=[*stages, last])


def encoded(df: DataFrame, labels: list, label: str = "label") -> DataFrame:
    """``label`` as 0, 1, ... in the order of ``labels``; others become NULL."""
    return df.withColumn(label, _mapped(F.col(label), labels, [float(i) for i in range(len(labels))]))


def decoded(df: DataFrame, labels: list, column: str = "prediction") -> DataFrame:
    return df.withColumn(column, _mapped(F.col(column), [float(i) for i in range(len(labels))], labels))


def _mapped(value: Column, keys: list, values: list) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in zip(keys, values, strict=True) for x in kv]), value)


def shuffled(df: DataFrame, column: str, seed: int, n_rows: int) -> DataFrame:
    """``df`` with the values of a column in another order: rows are dealt at random to buckets of about
    SHUFFLED_TOGETHER, and in each of them the values change places by a seeded hash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    buckets = max(1, n_rows // SHUFFLED_TOGETHER)
    marked = df.withColumn("shuffle_hash", F.xxhash64(F.lit(seed), F.to_json(whole))).withColumn("shuffle_bucket", F.pmod("shuffle_hash", F.lit(buckets)))
    order = lambda by: Window.partitionBy("shuffle_bucket").orderBy(by, F.to_json(whole))
    placed = marked.withColumn("shuffle_place", F.row_number().over(order(F.col("shuffle_hash"))))
    values = marked.select("shuffle_bucket", F.row_number().over(order(F.xxhash64(F.lit(seed + 1), F.col("shuffle_hash")))).alias("shuffle_place"), F.col(f"`{column}`").alias("shuffle_value"))
    joined = placed.join(values, ["shuffle_bucket", "shuffle_place"])
    return joined.select(*[F.col("shuffle_value").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def permutation_importance(model, test: DataFrame, features: list[str], repeats: int = 10, seed: int = 0) -> DataFrame:
    """feature, importance: mean loss of macro F1 when a feature's values change places."""

    def macro(df: DataFrame) -> float:
        told = model.transform(df).select(F.col("label").cast("double").alias("y_true"), F.col("prediction").alias("y_pred"))
        return f1_scores(told).first().macro_f1

    test = test.persist()
    try:
        n, whole = test.count(), macro(test)
        lost = [(f, sum(whole - macro(shuffled(test, f, seed + 7 * i, n)) for i in range(repeats)) / repeats) for f in features]
    finally:
        test.unpersist()
    return test.sparkSession.createDataFrame(lost, "feature string, importance double")


def importance_over_folds(importances: DataFrame) -> DataFrame:
    """feature, importance_mean, importance_std, importance_n_folds over the folds that chose a feature."""
    return importances.groupBy("feature").agg(F.avg("importance").alias("importance_mean"), F.stddev_samp("importance").alias("importance_std"), F.count("importance").alias("importance_n_folds"))


def genetic_search(space: dict[str, list], score, population: int = 10, generations: int = 3, cross: float = 0.5, mutate: float = 0.2, each: float = 0.2, tournament: int = 3, seed: int = 0) -> tuple[dict, float]:
    """Best genome of a small search on the driver: tournaments, two-point crossover, uniform mutation; scores are remembered."""
    rng, names, seen = random.Random(seed), sorted(space), {}

    def value(g: tuple) -> float:
        if g not in seen:
            seen[g] = score(dict(zip(names, g, strict=True)))
        return seen[g]

    now = [tuple(rng.choice(space[n]) for n in names) for _ in range(population)]
    for g in now:
        value(g)
    for _ in range(generations):
        chosen = [max((rng.choice(now) for _ in range(tournament)), key=value) for _ in now]
        for i in range(1, len(chosen), 2):
            if rng.random() < cross and len(names) > 1:
                a, b = sorted(rng.sample(range(len(names) + 1), 2))
                x, y = chosen[i - 1], chosen[i]
                chosen[i - 1], chosen[i] = x[:a] + y[a:b] + x[b:], y[:a] + x[a:b] + y[b:]
        now = [tuple(rng.choice(space[n]) if rng.random() < each else v for n, v in zip(names, g, strict=True)) if rng.random() < mutate else g for g in chosen]
        for g in now:
            value(g)
    best = max(seen, key=seen.get)
    return dict(zip(names, best, strict=True)), seen[best]
