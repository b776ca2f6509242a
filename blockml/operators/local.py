"""What a model learnt, on the driver: plain values that predict for local arrays and go to and from JSON."""

from __future__ import annotations

import json

import numpy as np


class LocalModel(dict):
    """Learnt values by name; ``kind`` is the estimator's class and ``params`` are its parameters."""

    def __init__(self, kind: str, params: dict, learnt: dict):
        super().__init__(learnt)
        self.kind, self.params = kind, params

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Scores by class, or for one class of two."""
        x = np.asarray(x, float)
        if self.kind == "GaussianNB":
            v = np.maximum(self["sigma_"], self.params["var_floor"])
            far = (((x[:, None, :] - self["theta_"]) ** 2) / v).sum(2)
            return np.log(self["class_prior_"]) - 0.5 * (np.log(2 * np.pi * v).sum(1) + far)
        if self.kind in ("MultinomialNB", "BernoulliNB"):
            return self._discrete(x)
        return x @ np.asarray(self["coef_"]).T + self["intercept_"]

    def _discrete(self, x: np.ndarray) -> np.ndarray:
        table, alpha = self["feature_count_"], self.params["alpha"]
        at, counts = np.asarray(table["feature"], int), np.array(list(map(list, table["counts"])), float)
        x = x[:, at]
        if self.kind == "MultinomialNB":
            return x @ np.log((counts + alpha) / (counts.sum(0) + alpha * len(counts))) + self["class_log_prior_"]
        if self.params["binarize"] is not None:
            x = (x > self.params["binarize"]).astype(float)
        p = (counts + alpha) / (np.asarray(self["class_count_"]) + 2 * alpha)
        return x @ (np.log(p) - np.log(1 - p)) + np.log(1 - p).sum(0) + self["class_log_prior_"]

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if self.kind == "LinearRegression":
            return x @ np.asarray(self["coef_"]) + self["intercept_"]
        if self.kind == "KMeans":
            return ((x[:, None, :] - np.asarray(self["cluster_centers_"])) ** 2).sum(2).argmin(1)
        classes = np.asarray(self["classes_"])
        if self.kind == "RandomForestClassifier":
            return classes[sum(_votes(tree, x, len(classes)) for tree in self["trees_"]).argmax(1)]
        s = self.decision(x)
        return classes[(s[:, 0] > 0).astype(int) if s.shape[1] == 1 else s.argmax(1)]

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        s = self.decision(x)
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def transform(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if self.kind == "StandardScaler":
            x = x - self["mean_"] if self.params["with_mean"] else x
            return x / self["scale_"] if self.params["with_std"] else x
        if self.kind == "VarianceThreshold":
            return x[:, np.asarray(self["variances_"]) > self.params["threshold"]]
        if self.kind == "TruncatedSVD":
            return x @ np.asarray(self["components_"]).T
        raise TypeError(f"a local {self.kind} does not transform")

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"class": self.kind, "params": self.params, "learnt": self}, f, default=_plain)


def load(path: str) -> LocalModel:
    """What ``save`` wrote."""
    with open(path) as f:
        got = json.load(f)
    arrays = {k: np.array(v) if isinstance(v, list) and k not in ("trees_", "grid_scores_") else v for k, v in got["learnt"].items()}
    return LocalModel(got["class"], got["params"], arrays)


def _plain(v):
    return v.tolist() if isinstance(v, np.ndarray) else v.item() if isinstance(v, np.generic) else str(v)


def _votes(tree: dict, x: np.ndarray, classes: int) -> np.ndarray:
    """Class shares of the leaf that each row comes to; ``tree`` holds lists by node."""
    at = np.zeros(len(x), int)
    left, right, feature, threshold = (np.asarray(tree[k]) for k in ("left", "right", "feature", "threshold"))
    while (inner := np.flatnonzero(left[at] >= 0)).size:
        n = at[inner]
        at[inner] = np.where(x[inner, feature[n]] <= threshold[n], left[n], right[n])
    stats = np.asarray(tree["stats"], float)[at]
    return stats / np.maximum(stats.sum(1, keepdims=True), 1e-300)
