"""Training over folds: choose features, search parameters, fit, evaluate, and keep each fold's results.

A fold's results are a small JSON file; a fold that has one is skipped unless forced. Files go through Spark's
file systems, so a run's folder may be on any of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from statistics import fmean, pstdev

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.operators import analysis as A
from typeloom.plans import evaluation as E

#: Labels by task.
LABELS = {"binary": [0, 1], "multiclass": [0, 1, 2, 3, 4]}
#: Search spaces by classifier.
SPACES: dict[str, dict[str, list]] = {
    "svm": {"regParam": [0.001, 0.01, 0.1, 1.0], "maxIter": [50, 100]},
    "svm_poly": {"regParam": [0.001, 0.01, 0.1], "degree": [2, 3]},
    "mlp": {"hidden": [[8], [16], [32], [16, 8]], "maxIter": [50, 100, 200]},
    "forest": {"numTrees": [20, 50, 100], "maxDepth": [3, 5, 8]},
    "boosted": {"maxDepth": [3, 4, 5, 6], "stepSize": [0.05, 0.1, 0.2, 0.3], "maxIter": [10, 20, 40], "subsamplingRate": [0.6, 0.8, 1.0]},
}


@dataclass(frozen=True)
class Budget:
    population: int = 50
    generations: int = 10
    splits: int = 5

    @classmethod
    def quick(cls) -> Budget:
        """Only to see that everything runs."""
        return cls(population=4, generations=1, splits=2)


class Folder:
    """Small text files in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, content: dict) -> None:
        half = self._at(f"_{name}")
        out = self._fs.create(half, True)
        out.write(bytearray(json.dumps(content, indent=2).encode()))
        out.close()
        self._fs.delete(self._at(name), False)
        self._fs.rename(half, self._at(name))


@dataclass
class Run:
    """What a fold's training needs. ``params``: taken over from another run instead of searching."""

    kind: str
    task: str
    features: list[str]
    share: float = 0.5
    budget: Budget = field(default_factory=Budget)
    seed: int = 42
    params: dict | None = None

    def ranking(self, train: DataFrame) -> DataFrame:
        """feature, mi over the training rows, medians in place of missing values."""
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in self.features])).alias("x")
        return A.mutual_information(A.median_filled(train.select("label", cells).select("label", "x.*")), "label")

    def fitted(self, train: DataFrame, chosen: list[str], params: dict, labels: list):
        weighted = E.balanced_weight(E.encoded(train, labels))
        weight = "weight" if self.kind.startswith("svm") else None
        return E.classifier(self.kind, chosen, len(labels), weight, **params).fit(weighted)

    def predicted(self, model, test: DataFrame, labels: list) -> DataFrame:
        return E.decoded(model.transform(test), labels).select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))

    def searched(self, train: DataFrame, chosen: list[str], labels: list) -> tuple[dict, float]:
        """Best parameters by mean accuracy over participant-disjoint splits of the training rows."""
        split = E.stratified_group_folds(train, "user_id", "label", self.budget.splits).persist()

        def score(params: dict) -> float:
            seen = []
            for k in range(self.budget.splits):
                model = self.fitted(split.where(F.col("fold") != k), chosen, params, labels)
                told = self.predicted(model, split.where(F.col("fold") == k), labels)
                seen.append(E.error_rates(told).first().accuracy)
            return fmean(x for x in seen if x is not None)

        try:
            return E.genetic_search(SPACES[self.kind], score, self.budget.population, self.budget.generations, seed=self.seed)
        finally:
            split.unpersist()

    def __call__(self, train: DataFrame, test: DataFrame) -> tuple[dict, object]:
        """Results and the fitted model; ``train`` and ``test`` have label, user_id and the features."""
        labels = [r.label for r in train.select("label").distinct().orderBy("label").collect()]
        ranking = self.ranking(train)
        chosen = [r.feature for r in E.select_top_share(ranking, self.share).orderBy(F.desc("mi"), "feature").collect()]
        params, found = (self.params, None) if self.params is not None else self.searched(train, chosen, labels)
        model = self.fitted(train, chosen, params, labels)
        told = self.predicted(model, test, labels).persist()
        scores, matrix = E.f1_scores(told).first(), E.confusion_matrix(told, LABELS[self.task])
        results = {
            "n_train": train.count(), "n_test": told.count(), "features": len(self.features), "selected_features": chosen, "feature_share": self.share, "seed": self.seed,
            "best_params": params, "cv_accuracy": found, "test_accuracy": E.error_rates(told).first().accuracy, "test_macro_f1": scores.macro_f1, "test_weighted_f1": scores.weighted_f1,
            "confusion_matrix": matrix, "labels": LABELS[self.task],
        }
        told.unpersist()
        return results | E.rates_of_matrix(matrix, LABELS[self.task]), model


def results_path(root: str, task: str, kind: str, fold: int) -> str:
    return f"{root.rstrip('/')}/{task}/{kind}/fold{fold}"


def train_folds(df: DataFrame, run: Run, root: str, folds: Iterable[int] | None = None, k: int = 5, force: bool = False, keep_model: Callable[[object, str], None] | None = None) -> list[int]:
    """Train the folds that have no results yet (or all, if forced); ``df`` has label, user_id and the features. Returns those that ran."""
    spark, ran = df.sparkSession, []
    dealt = E.stratified_group_folds(df, "user_id", "label", k).persist()
    try:
        for fold in range(1, k + 1) if folds is None else folds:
            at = results_path(root, run.task, run.kind, fold)
            folder = Folder(spark, at)
            if folder.has("results.json") and not force:
                continue
            own = F.col("fold") == fold - 1
            results, model = run(dealt.where(~own).drop("fold"), dealt.where(own).drop("fold"))
            if keep_model:
                keep_model(model, at)
            folder.write("results.json", results | {"fold": fold})
            ran.append(fold)
    finally:
        dealt.unpersist()
    return ran


def backfilled(results: dict, task: str) -> dict:
    """Results with error rates, worked out from the stored matrix where they are missing."""
    if "far" in results or "confusion_matrix" not in results:
        return results
    labels = [int(y) for y in results.get("labels") or LABELS[task]]
    if 0 not in labels:
        return results
    return results | {"labels": labels} | E.rates_of_matrix(results["confusion_matrix"], labels)


def collected(spark: SparkSession, root: str, task: str, kind: str, k: int = 5) -> list[dict]:
    """The results of the folds that are done; files without error rates are completed."""
    found = []
    for fold in range(1, k + 1):
        folder = Folder(spark, results_path(root, task, kind, fold))
        if folder.has("results.json"):
            stored = folder.read("results.json")
            whole = backfilled(stored, task)
            if whole is not stored:
                folder.write("results.json", whole)
            found.append(whole)
    return found


def summary(results: list[dict], k: int = 5) -> dict | None:
    """Mean and population deviation of each measure over the folds that have it, summed matrix, rates by condition."""
    if not results:
        return None

    def level(values: Iterable[float | None]) -> dict:
        known = [v for v in values if v is not None]
        return {"mean": fmean(known), "std": pstdev(known)} if known else {"mean": None, "std": None}

    measures = {"accuracy": "test_accuracy", "macro_f1": "test_macro_f1", "weighted_f1": "test_weighted_f1", "far": "far", "frr": "frr"}
    conditions = sorted({c for r in results for c in r.get("far_by_condition", {})}, key=int)
    matrices = [r["confusion_matrix"] for r in results]
    return {
        "n_folds": len(results),
        "partial": len(results) < k,
        **{name: level(r.get(key) for r in results) | {"per_fold": [r.get(key) for r in results]} for name, key in measures.items()},
        "summed_confusion_matrix": [[sum(cells) for cells in zip(*rows, strict=True)] for rows in zip(*matrices, strict=True)],
        "far_by_condition": {c: level(r.get("far_by_condition", {}).get(c) for r in results) for c in conditions},
    }
