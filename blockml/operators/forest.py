"""Random forest."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier as MLForest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockml.operators.base import Classifier, classes_of
from blockml.operators.local import LocalModel
from blockml.session import shared_path


class RandomForestClassifier(Classifier):
    """One forest over all rows, grown level by level on histograms of binned features. Trees grow to
    depth 30, the library's limit, unless ``max_depth`` says less."""

    def __init__(self, n_estimators: int = 10, criterion: str = "gini", max_depth: int = 30, min_samples_leaf: int = 1, max_features: str = "sqrt", seed: int = 0, x: str = "X", y: str = "y"):
        self.n_estimators, self.criterion, self.max_depth, self.min_samples_leaf = n_estimators, criterion, max_depth, min_samples_leaf
        self.max_features, self.seed, self.x, self.y = max_features, seed, x, y

    def fit(self, df: DataFrame, classes: list | None = None) -> RandomForestClassifier:
        self.classes_ = sorted(classes) if classes is not None else classes_of(df, self.y)
        labels = F.array(*map(F.lit, self.classes_))
        rows = df.select(array_to_vector(F.col(self.x).cast("array<double>")).alias("features"), (F.array_position(labels, F.col(self.y)) - 1).cast("double").alias("label"))
        grow = MLForest(numTrees=self.n_estimators, impurity=self.criterion, maxDepth=self.max_depth, minInstancesPerNode=self.min_samples_leaf, featureSubsetStrategy=self.max_features, seed=self.seed)
        self._model = grow.fit(rows)
        self.n_trees_ = self._model.getNumTrees
        return self

    @property
    def trees(self) -> list[dict]:
        """Each tree as lists by node: children (-1 in a leaf), feature, threshold, and class counts."""
        path = shared_path(SparkSession.getActiveSession(), "forest")
        self._model.save(path)
        rows = SparkSession.getActiveSession().read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
        out: list[dict] = [{k: [] for k in ("left", "right", "feature", "threshold", "stats")} for _ in range(self.n_trees_)]
        for r in rows:
            tree, split = out[r["treeID"]], r["split"]
            inner = r["leftChild"] >= 0
            tree["left"].append(r["leftChild"] if inner else -1)
            tree["right"].append(r["rightChild"] if inner else -1)
            tree["feature"].append(split["featureIndex"] if inner else 0)
            tree["threshold"].append(split["leftCategoriesOrThreshold"][0] if inner else 0.0)
            tree["stats"].append(list(r["impurityStats"]))
        return out

    def to_local(self) -> LocalModel:
        got = super().to_local()
        got["trees_"] = self.trees
        return got

    def predict(self, df: DataFrame) -> DataFrame:
        labels = F.array(*map(F.lit, self.classes_))
        with_features = df.withColumn("__features", array_to_vector(F.col(self.x).cast("array<double>")))
        got = self._model.setFeaturesCol("__features").setPredictionCol("__at").setRawPredictionCol("").setProbabilityCol("").transform(with_features)
        return got.withColumn("prediction", F.get(labels, F.col("__at").cast("int"))).drop("__features", "__at")
