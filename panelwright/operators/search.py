"""Hyper-parameter spaces, search and leaderboards; trials are a small frame, objectives any callable."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid_values(spec) -> list:
    """The values of a parameter in a grid: a list as it is, a range of floats as five equal steps, a range of ints whole."""
    if isinstance(spec, list):
        return spec
    lo, hi = spec[1:] if spec[0] == "log" else spec
    return list(range(lo, hi + 1)) if isinstance(lo, int) and isinstance(hi, int) else [lo + (hi - lo) * i / 4 for i in range(5)]


def grid(space: dict) -> list[dict]:
    """All combinations of a space as random_points takes it."""
    space = {k: grid_values(v) for k, v in space.items()}
    return [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]


def grid_frame(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """The grid as rows, one column a parameter."""
    df = spark.range(1).select()
    for name, values in space.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def _u(seed: int, trial: int, name: str) -> float:
    return (int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def random_points(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``space``: name -> list of choices, (lo, hi) floats or ints, or ("log", lo, hi)."""

    def draw(spec, u: float):
        if isinstance(spec, list):
            return spec[int(u * len(spec))]
        if spec[0] == "log":
            return math.exp(math.log(spec[1]) + u * (math.log(spec[2]) - math.log(spec[1])))
        lo, hi = spec
        return lo + int(u * (hi - lo + 1)) if isinstance(lo, int) and isinstance(hi, int) else lo + u * (hi - lo)

    return [{k: draw(s, _u(seed, i, k)) for k, s in space.items()} for i in range(n)]


def search(points: list[dict], objective: Callable[[dict], float], maximise: bool = True) -> list[tuple[dict, float]]:
    """Trials from best to worst."""
    return sorted(((p, objective(p)) for p in points), key=lambda t: -t[1] if maximise else t[1])


def successive_halving(points: list[dict], objective: Callable[[dict, int], float], budget: int, eta: int = 3, maximise: bool = True, max_budget: int | None = None) -> list[tuple[dict, float]]:
    """The best 1 / eta of each round go on with eta times the budget, while several are left and the budget is within ``max_budget``.

    Returns the trials of all rounds from best to worst; of equal ones the later stands first.
    """
    trials: list[tuple[dict, float]] = []
    while points and (max_budget is None or budget <= max_budget):
        done = search(points, lambda p, b=budget: objective(p, b), maximise)
        trials = done + trials
        if len(done) == 1:
            break
        points, budget = [p for p, _ in done[: max(1, len(done) // eta)]], budget * eta
    return sorted(trials, key=lambda t: -t[1] if maximise else t[1])


def leaderboard(trials: DataFrame, k: int = 10, maximise: bool = True) -> DataFrame:
    """The k best of (trial_id, score)."""
    return trials.orderBy(F.desc("score") if maximise else F.asc("score"), "trial_id").limit(k)


TRIALS = "trial_id int, params string, budget int, fold int, score double, started double, ended double, error string"


def _trial(spark: SparkSession, trial_id: int, point: dict, budget: int, fold: int, run: Callable[[], float]) -> Callable[[], tuple]:
    """A call that runs one trial's Spark jobs from a thread of its own and gives its row; a failure is a row too."""

    def call() -> tuple:
        began = time.time()
        score, error = None, None
        try:
            score = float(run())
        except Exception as e:  # noqa: BLE001  the table of trials tells
            error = f"{type(e).__name__}: {e}"[:500]
        return trial_id, json.dumps(point, sort_keys=True), budget, fold, score, began, time.time(), error

    return inheritable_thread_target(spark)(call)


def search_folds(spark: SparkSession, points: list[dict], folds: DataFrame, score: Callable[[dict, DataFrame, DataFrame], float], parallelism: int = 4) -> DataFrame:
    """A row for each trial and fold (``TRIALS``): ``score`` (parameters, training rows, test rows) over ``folds`` (rows with fold and part).

    At most ``parallelism`` fits run at a time, each of them Spark jobs that share the cluster. Failed ones have an error and no score.
    """
    numbers = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    part = lambda f, p: folds.where((F.col("fold") == f) & (F.col("part") == p)).drop("fold", "part")
    with ThreadPoolExecutor(parallelism) as pool:
        todo = [pool.submit(_trial(spark, i, p, 1, f, lambda p=p, f=f: score(p, part(f, "train"), part(f, "test")))) for i, p in enumerate(points) for f in numbers]
        return spark.createDataFrame([t.result() for t in todo], TRIALS)


def mean_scores(trials: DataFrame) -> DataFrame:
    """(trial_id, params, score, folds, failed): the mean over folds at a trial's largest budget; null if a fold failed."""
    most = trials.groupBy("trial_id").agg(F.max("budget").alias("_b"))
    last = trials.join(most, "trial_id").where(F.col("budget") == F.col("_b"))
    failed = F.count(F.when(F.col("error").isNotNull(), 1))
    return last.groupBy("trial_id", "params").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("folds"), failed.alias("failed")).withColumn("score", F.when(F.col("failed") == 0, F.col("score")))


def halving(spark: SparkSession, points: list[dict], objective: Callable[[dict, int], float], budget: int, eta: int = 3, maximise: bool = True, max_budget: int | None = None, parallelism: int = 4) -> DataFrame:
    """Successive halving whose trials go on as soon as it is certain that they do: the rows of ``TRIALS``, the same at any parallelism.

    A round of n trials sends n // eta (one at least) on, with eta times the budget. One whose score is known goes on once
    fewer than these many others are better or still unknown, so nobody waits for the slowest trial of a round. A failed trial
    is the worst of its round, ties go to the smaller trial_id.
    """
    sizes, budgets = [len(points)], [budget]
    while sizes[-1] > 1 and (max_budget is None or budgets[-1] * eta <= max_budget):
        sizes.append(max(1, sizes[-1] // eta))
        budgets.append(budgets[-1] * eta)
    known: list[dict[int, tuple]] = [{} for _ in sizes]
    sent: list[set[int]] = [set() for _ in sizes]
    rows, running = [], {}
    with ThreadPoolExecutor(parallelism) as pool:

        def start(level: int, trial: int) -> None:
            call = _trial(spark, trial, points[trial], budgets[level], 0, lambda: objective(points[trial], budgets[level]))
            running[pool.submit(call)] = (level, trial)

        for i in range(len(points)):
            start(0, i)
        while running:
            done: set[Future] = wait(running, return_when=FIRST_COMPLETED).done
            for f in done:
                level, trial = running.pop(f)
                row = f.result()
                rows.append(row)
                score = row[4] if row[4] is not None and not math.isnan(row[4]) else -math.inf if maximise else math.inf
                known[level][trial] = (-score if maximise else score, trial)
                if level + 1 == len(sizes):
                    continue
                open_places = sizes[level] - len(known[level])
                for place, (_, t) in enumerate(sorted(known[level].values())):
                    if place + open_places < sizes[level + 1] and t not in sent[level]:
                        sent[level].add(t)
                        start(level + 1, t)
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[2], r[0])), TRIALS)
