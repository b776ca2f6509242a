"""Pipelines, unions, folds and grid search."""

from __future__ import annotations

import itertools
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockml.operators.base import Estimator, positions


class _Composite(Estimator):
    """Parts by name; ``name__parameter`` addresses a part's parameter."""

    def _parts(self) -> list:
        raise NotImplementedError

    def get_params(self, deep: bool = True) -> dict:
        out = super().get_params()
        if deep:
            for name, part in self._parts():
                out[name] = part
                out |= {f"{name}__{k}": v for k, v in part.get_params().items()}
        return out

    def set_params(self, **params):
        parts = dict(self._parts())
        for k, v in params.items():
            name, sep, rest = k.partition("__")
            if sep and name in parts:
                parts[name].set_params(**{rest: v})
            else:
                super().set_params(**{k: v})
        return self

    def to_local(self) -> dict:
        return {name: part.to_local() for name, part in self._parts()}


class Pipeline(_Composite):
    """Steps (name, estimator): all but the last transform. ``fit`` leaves its input as it was."""

    def __init__(self, steps: list):
        names = [n for n, _ in steps]
        if len(set(names)) != len(names):
            raise ValueError(f"names occur twice: {names}")
        self.steps = steps

    def _parts(self):
        return self.steps

    def clone(self) -> Pipeline:
        return Pipeline([(n, s.clone()) for n, s in self.steps])

    def _through(self, df, fit: bool, params: dict):
        for name, step in self.steps[:-1]:
            if fit:
                step.fit(df, **{k.partition("__")[2]: v for k, v in params.items() if k.partition("__")[0] == name})
            df = step.transform(df)
        return df

    def fit(self, df, **params) -> Pipeline:
        name, last = self.steps[-1]
        last.fit(self._through(df, True, params), **{k.partition("__")[2]: v for k, v in params.items() if k.partition("__")[0] == name})
        return self

    def transform(self, df):
        return self.steps[-1][1].transform(self._through(df, False, {}))

    def predict(self, df) -> DataFrame:
        return self.steps[-1][1].predict(self._through(df, False, {}))

    def score(self, df) -> float:
        return self.steps[-1][1].score(self._through(df, False, {}))


class FeatureUnion(_Composite):
    """Features of several long-form transformers side by side: each one's are numbered after
    those before it, times its weight. Parts are fitted in ``n_jobs`` threads."""

    def __init__(self, transformers: list, weights: dict[str, float] | None = None, n_jobs: int = 1):
        self.transformers, self.weights, self.n_jobs = transformers, weights, n_jobs

    def _parts(self):
        return self.transformers

    def clone(self) -> FeatureUnion:
        return FeatureUnion([(n, t.clone()) for n, t in self.transformers], self.weights, self.n_jobs)

    def fit(self, df: DataFrame) -> FeatureUnion:
        _threads(self.n_jobs, [lambda t=t: t.fit(df) for _, t in self.transformers])
        self._number()
        return self

    def _number(self) -> None:
        widths = [t.n_features if hasattr(t, "n_features") else t.vocabulary_.count() for _, t in self.transformers]
        self.offsets_ = np.concatenate([[0], np.cumsum(widths)]).astype(int)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        parts = _threads(self.n_jobs, [lambda t=t: t.fit_transform(df) for _, t in self.transformers])
        self._number()
        return self._joined(parts)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._joined([t.transform(df) for _, t in self.transformers])

    def _joined(self, parts: list[DataFrame]) -> DataFrame:
        out = None
        for (name, _), part, offset in zip(self.transformers, parts, self.offsets_):
            weight = float((self.weights or {}).get(name, 1.0))
            part = part.withColumns({"feature": F.col("feature") + int(offset), "value": F.col("value").cast("double") * weight})
            out = part if out is None else out.unionByName(part)
        return out


def make_union(*transformers: Estimator, **options) -> FeatureUnion:
    """A union whose parts are named for their classes."""
    names = [type(t).__name__.lower() for t in transformers]
    numbered = [n if names.count(n) == 1 else f"{n}-{names[:i].count(n) + 1}" for i, n in enumerate(names)]
    return FeatureUnion(list(zip(numbered, transformers)), **options)


def _threads(n_jobs: int, calls: list) -> list:
    if n_jobs == 1:
        return [c() for c in calls]
    with ThreadPoolExecutor(n_jobs) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(c)) for c in calls]]


def with_fold(df: DataFrame, n_folds: int = 3, key: str = "row_id", name: str = "fold", block: str | None = None) -> DataFrame:
    """Consecutive folds in key order; the first n mod k folds have a row more. With ``block``, a column,
    folds are of whole blocks in their order instead."""
    if block is not None:
        return df.join(with_fold(df.select(block).distinct(), n_folds, block, name), block)
    n = df.count()
    if not 2 <= n_folds <= n:
        raise ValueError(f"{n_folds} folds of {n} rows")
    small, more = divmod(n, n_folds)
    cut = more * (small + 1)
    fold = F.when(F.col("pos") < cut, F.floor(F.col("pos") / (small + 1))).otherwise(more + F.floor((F.col("pos") - cut) / small))
    return positions(df, key).withColumn(name, fold.cast("int")).drop("pos")


def parameter_grid(grid: dict | list) -> list[dict]:
    """All combinations, names in sorted order, the last varying fastest."""
    out = []
    for g in [grid] if isinstance(grid, dict) else grid:
        names = sorted(g)
        out += [dict(zip(names, values)) for values in itertools.product(*(g[n] for n in names))]
    return out


class GridSearchCV(Estimator):
    """Scores every combination on every fold, in ``n_jobs`` threads; the best mean wins, the
    first of equal ones. ``split(data, fold, test)`` gives the rows inside or outside a fold; by
    default ``data`` is a DataFrame with a column ``fold``."""

    def __init__(self, estimator: Estimator, grid: dict | list, n_folds: int = 3, iid: bool = True, refit: bool = True, n_jobs: int = 1, error_score="raise", key: str = "row_id", split=None, scorer=None, block: str | None = None):
        self.estimator, self.grid, self.n_folds, self.iid, self.refit = estimator, grid, n_folds, iid, refit
        self.n_jobs, self.error_score, self.key, self.split, self.scorer, self.block = n_jobs, error_score, key, split, scorer, block

    def fit(self, data) -> GridSearchCV:
        split = self.split
        if split is None:
            folded = with_fold(data, self.n_folds, self.key, block=self.block)
            split = lambda _, k, test: folded.where(F.col("fold") == k if test else F.col("fold") != k).drop("fold")
        first = lambda d: d[1] if isinstance(d, tuple) else d
        combos = parameter_grid(self.grid)
        sizes = [first(split(data, k, True)).count() for k in range(self.n_folds)]

        self.seconds_ = {}  # (combination, fold) -> seconds of the fit and of the score

        def one(params: dict, k: int) -> float:
            began = time.perf_counter()
            try:
                model = self.estimator.clone().set_params(**params).fit(split(data, k, False))
                fitted = time.perf_counter()
                got = self.scorer(model, split(data, k, True)) if self.scorer else model.score(split(data, k, True))
                if not isinstance(got, (int, float)):
                    raise ValueError(f"a score must be a number; got {got!r}")
                self.seconds_[combos.index(params), k] = (fitted - began, time.perf_counter() - fitted)
                return float(got)
            except Exception:
                if self.error_score == "raise":
                    raise
                return float(self.error_score)

        scores = _threads(self.n_jobs, [lambda p=p, k=k: one(p, k) for p in combos for k in range(self.n_folds)])
        by = np.array(scores).reshape(len(combos), self.n_folds)
        mean = by @ np.array(sizes) / sum(sizes) if self.iid else by.mean(axis=1)
        self.grid_scores_ = [(p, float(m), s.tolist()) for p, m, s in zip(combos, mean, by)]
        at = int(np.argmax(mean))
        self.best_params_, self.best_score_ = combos[at], float(mean[at])
        if self.refit:
            self.best_estimator_ = self.estimator.clone().set_params(**self.best_params_).fit(data)
        return self

    def predict(self, data) -> DataFrame:
        return self.best_estimator_.predict(data)

    def score(self, data) -> float:
        return self.best_estimator_.score(data)

    def to_local(self) -> dict:
        return {"best_params_": self.best_params_, "best_score_": self.best_score_, "grid_scores_": self.grid_scores_}
