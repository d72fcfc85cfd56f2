"""Model search: parameter spaces, cross-validation on a fold column, grid / random / adaptive.

A trial is one parameter set scored on every fold; its fits and predictions are Spark jobs, a few
of which run side by side. Only scores come back to the driver.

All jobs of a trial carry its tag and run in a scheduler pool of their own (pools share the executors
evenly where the session sets ``spark.scheduler.mode=FAIR``). When a fold fails, or runs beyond the time
limit, the jobs of its other folds are cancelled by the tag, and what is not yet begun is left out.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import threading
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise
from tallyloom.operators.evaluate import average_metrics, confusion
from tallyloom.operators.models import Classifier, effective, param_space
from tallyloom.operators.prep import balance_data
from tallyloom.operators.selection import SELECTOR_SPACES, build_selector

TRIALS_SCHEMA = ("stage string, trial int, params map<string,string>, fold_scores array<double>, "
                 "mean_score double, status string, seconds double")


# ---------------------------------------------------------------- parameter spaces

def space_values(spec) -> list:
    """Values of one parameter: a list, {'values'}, {'range','type'}, an interval tuple, a scalar.

    An interval (low, high, 'log-uniform') is cut in equal ratios.
    """
    if isinstance(spec, dict):
        if "values" in spec:
            return list(spec["values"])
        if "range" in spec:
            return _interval(*spec["range"], whole=spec.get("type") == "int")
        return [spec]
    if isinstance(spec, tuple) and spec[2:] == ("log-uniform",):
        return [spec[0] * (spec[1] / spec[0]) ** (i / 4) for i in range(5)]
    if isinstance(spec, tuple):
        return _interval(spec[0], spec[1], whole=isinstance(spec[0], int))
    return list(spec) if isinstance(spec, list) else [spec]


def _interval(start, end, whole: bool) -> list:
    if whole:
        return list(range(start, end + 1))
    return [start + (end - start) * i / 4 for i in range(5)]


def expand(space: dict | list, prefix: str = "") -> list[dict]:
    """All parameter sets of a space; a list of spaces is the union of their grids."""
    out = []
    for part in space if isinstance(space, list) else [space]:
        names = list(part)
        for values in itertools.product(*[space_values(part[n]) for n in names]):
            out.append({f"{prefix}{n}": v for n, v in zip(names, values)})
    return out


def candidates(model: str, selector: str = "none", program: str = "base",
               space: dict | list | None = None, selector_space: dict | None = None) -> list[dict]:
    """Every combination of classifier and selector parameters.

    Parameters without effect on the model are folded away, so that no fit is repeated under another name.
    """
    left, seen = [], set()
    for p in expand(param_space(model, program) if space is None else space):
        p = effective(model, p)
        if (name := json.dumps(p, sort_keys=True, default=str)) not in seen:
            seen.add(name)
            left.append({f"classifier__{k}": v for k, v in p.items()})
    right = expand(SELECTOR_SPACES[selector] if selector_space is None else selector_space, "selector__")
    return [{**a, **b} for a, b in itertools.product(left, right)]


def _digest(params: dict, seed: int | str) -> str:
    return hashlib.md5(f"{json.dumps(params, sort_keys=True, default=str)}-{seed}".encode()).hexdigest()


def shuffled(found: Sequence[dict], seed: int | str = 42) -> list[dict]:
    return sorted(found, key=lambda p: _digest(p, seed))


# ---------------------------------------------------------------- stage pipelines

def _part(params: dict, prefix: str) -> dict:
    return {k[len(prefix):]: v for k, v in params.items() if k.startswith(prefix)}


def create_pipeline(model: str, selector: str = "none", params: dict | None = None,
                    features: str = "features", label: str = "label", seed: int = 42,
                    before: Sequence = ()) -> Pipeline:
    """Optional selector, then classifier, fitted as one unit so that selection never sees
    held-out rows."""
    params = dict(params or {})
    chosen = build_selector(selector, _part(params, "selector__"), features, label)
    use = features if chosen is None else "selected"
    stages = [*before, *([chosen] if chosen is not None else []),
              Classifier(model, _part(params, "classifier__"), use, label, seed)]
    return Pipeline(stages=stages)


@dataclass
class Trial:
    trial: int
    params: dict
    fold_scores: list[float | None]
    seconds: float
    error: str | None = None

    @property
    def mean_score(self) -> float | None:
        if self.error or any(s is None for s in self.fold_scores):
            return None
        return sum(self.fold_scores) / len(self.fold_scores)


@dataclass
class SearchResult:
    stage: str
    trials: list[Trial]
    best_params: dict | None = None
    best_score: float = -math.inf
    model: PipelineModel | None = field(default=None, repr=False)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.stage, t.trial, {k: str(v) for k, v in t.params.items()},
                 [None if s is None else float(s) for s in t.fold_scores],
                 t.mean_score, "failed" if t.mean_score is None else "ok", float(t.seconds))
                for t in self.trials]
        return spark.createDataFrame(rows, TRIALS_SCHEMA)


@dataclass
class SearchSettings:
    """``balance`` oversamples inside each training fold (needs ``key``); None leaves rows alone."""
    folds: int = 5
    fold: str = "fold"
    features: str = "features"
    label: str = "label"
    key: str = "row_id"
    metric: str = "balanced_accuracy"
    parallelism: int = 4
    balance: str | float | None = None
    seed: int = 42
    trial_seconds: float | None = None   # longest that one fold of a trial may run; beyond it the trial has failed


def balanced(df: DataFrame, s: SearchSettings) -> DataFrame:
    """Training rows plus their synthetic ones, back in (key as text, features, label) form."""
    if s.balance is None:
        return df
    plain = df.select(F.col(s.key), F.col(s.label), vector_to_array(s.features).alias("_vec"))
    grown = balance_data(plain, s.key, "_vec", s.label, s.balance, seed=s.seed, name_rows=True)
    return materialise(grown.select(F.col("key").alias(s.key), F.col("label").alias(s.label),
                                    array_to_vector("vec").alias(s.features)), "balanced")


def score(predicted: DataFrame, label: str = "label", metric: str = "balanced_accuracy") -> float:
    return average_metrics(confusion(predicted, label=label)).first()[metric]


class _Trials:
    """What has become of each trial; cancels the Spark jobs of those that failed or take too long."""

    def __init__(self, spark: SparkSession, n: int, limit: float | None):
        self.sc, self.limit = spark.sparkContext, limit
        name = uuid.uuid4().hex
        self.tags = [f"trial-{name}-{i}" for i in range(n)]
        self.errors: list[str | None] = [None] * n
        self.running: list[dict[int, float]] = [{} for _ in range(n)]     # thread -> when its fold began
        self.lock, self.over = threading.Lock(), threading.Event()
        self.watcher = threading.Thread(target=self._watch, daemon=True)

    def __enter__(self) -> "_Trials":
        self.watcher.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.watcher.join()

    def fail(self, i: int, error: str) -> None:
        """The first error of a trial is its result."""
        with self.lock:
            self.errors[i] = self.errors[i] or error
        self.sc.cancelJobsWithTag(self.tags[i])

    def _watch(self) -> None:
        while not self.over.wait(0.2):
            for i, folds in enumerate(self.running):
                with self.lock:
                    first = min(folds.values(), default=None)
                if first is None:
                    continue
                if self.errors[i]:                          # a fold between two jobs has started another one
                    self.sc.cancelJobsWithTag(self.tags[i])
                elif self.limit is not None and time.monotonic() - first > self.limit:
                    self.fail(i, f"over the time limit of {self.limit:g} s")

    def run(self, i: int, work):
        """``work()`` under the trial's tag and pool, or None if the trial has failed or fails now."""
        with self.lock:
            if self.errors[i]:
                return None
            self.running[i][threading.get_ident()] = time.monotonic()
        self.sc.addJobTag(self.tags[i])
        self.sc.setLocalProperty("spark.scheduler.pool", self.tags[i])
        try:
            return work()
        except Exception as e:      # noqa: BLE001 - any failure of a trial counts as its result
            self.fail(i, f"{type(e).__name__}: {e}"[:300])
            return None
        finally:
            self.sc.removeJobTag(self.tags[i])
            self.sc.setLocalProperty("spark.scheduler.pool", None)
            with self.lock:
                self.running[i].pop(threading.get_ident())


def cross_validate(df: DataFrame, make, params_list: Sequence[dict], s: SearchSettings,
                   first_trial: int = 0) -> list[Trial]:
    """Score every parameter set on every fold. A failing fit fails its trial, not the search."""
    grown = {f: (balanced(df.where(F.col(s.fold) != f), s) if s.balance is not None
                 else df.where(F.col(s.fold) != f)) for f in range(s.folds)}
    state = _Trials(df.sparkSession, len(params_list), s.trial_seconds)

    def one(job: tuple[int, int]) -> tuple[int, int, float | None, float]:
        i, f = job
        start = time.monotonic()

        def work() -> float:
            model = make(params_list[i]).fit(grown[f])
            return score(model.transform(df.where(F.col(s.fold) == f)), s.label, s.metric)
        value = state.run(i, work)
        return i, f, value, time.monotonic() - start

    jobs = [(i, f) for i in range(len(params_list)) for f in range(s.folds)]
    with state, ThreadPoolExecutor(max_workers=s.parallelism) as pool:
        # wrapped once per job: the jobs of one wrapper would share their tags
        running = [pool.submit(inheritable_thread_target(df.sparkSession)(one), job) for job in jobs]
        done = [r.result() for r in running]
    trials = []
    for i, p in enumerate(params_list):
        mine = sorted((d for d in done if d[0] == i), key=lambda d: d[1])
        trials.append(Trial(first_trial + i, p, [d[2] for d in mine], sum(d[3] for d in mine), state.errors[i]))
    return trials


def _finish(stage: str, df: DataFrame, make, trials: list[Trial], s: SearchSettings,
            refit: bool) -> SearchResult:
    good = [t for t in trials if t.mean_score is not None]
    out = SearchResult(stage, trials)
    if good:
        best = min(good, key=lambda t: (-t.mean_score, t.trial))
        out.best_params, out.best_score = best.params, best.mean_score
        if refit:
            out.model = make(best.params).fit(balanced(df, s))
    return out


def search_grid(stage: str, df: DataFrame, make, found: Sequence[dict],
                s: SearchSettings = SearchSettings(), refit: bool = True) -> SearchResult:
    """Every candidate."""
    return _finish(stage, df, make, cross_validate(df, make, list(found), s), s, refit)


def search_random(stage: str, df: DataFrame, make, found: Sequence[dict], n_iter: int = 50,
                  s: SearchSettings = SearchSettings(), refit: bool = True) -> SearchResult:
    """``n_iter`` candidates drawn by seeded shuffle."""
    drawn = shuffled(found, s.seed)[:n_iter]
    return _finish(stage, df, make, cross_validate(df, make, drawn, s), s, refit)


def promising(found: Sequence[dict], done: Sequence[Trial], n: int, seed: int | str,
              top: float = 0.25) -> list[dict]:
    """Draw unseen candidates, favouring parameter values frequent among the best trials."""
    seen = {json.dumps(t.params, sort_keys=True, default=str) for t in done}
    open_ = [p for p in found if json.dumps(p, sort_keys=True, default=str) not in seen]
    ranked = sorted(done, key=lambda t: (-(t.mean_score if t.mean_score is not None else -math.inf), t.trial))
    n_good = max(math.ceil(len(ranked) * top), 1)
    tallies: dict[tuple[str, str], list[int]] = {}
    for place, t in enumerate(ranked):
        for k, v in t.params.items():
            tallies.setdefault((k, str(v)), [0, 0])[0 if place < n_good else 1] += 1

    def key(p: dict) -> float:
        weight = 1.0
        for k, v in p.items():
            good, bad = tallies.get((k, str(v)), (0, 0))
            weight *= (good + 1) / (bad + 1)
        u = (int(_digest(p, seed)[:8], 16) + 1) / 4294967297.0
        return math.log(u) / weight
    return sorted(open_, key=lambda p: (-key(p), _digest(p, seed)))[:n]


def search_adaptive(stage: str, df: DataFrame, make, found: Sequence[dict], n_iter: int = 50,
                    batch: int = 8, s: SearchSettings = SearchSettings(), refit: bool = True
                    ) -> SearchResult:
    """Batches of candidates; later batches are drawn from what scored best so far."""
    trials: list[Trial] = []
    while len(trials) < min(n_iter, len(found)):
        size = min(batch, n_iter - len(trials))
        drawn = (shuffled(found, s.seed)[:size] if not trials
                 else promising(found, trials, size, f"{s.seed}-{len(trials)}"))
        if not drawn:
            break
        trials += cross_validate(df, make, drawn, s, len(trials))
    return _finish(stage, df, make, trials, s, refit)


# Names of the search kinds; unknown names mean the adaptive search.
SEARCHES = ["grid", "random", "optuna"]


def run_search(kind: str, stage: str, df: DataFrame, make, found: Sequence[dict],
               n_iter: int = 50, s: SearchSettings = SearchSettings(), refit: bool = True
               ) -> SearchResult:
    if kind == "grid":
        return search_grid(stage, df, make, found, s, refit)
    if kind == "random":
        return search_random(stage, df, make, found, n_iter, s, refit)
    return search_adaptive(stage, df, make, found, n_iter, s=s, refit=refit)
