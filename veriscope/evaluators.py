"""The registry of evaluators: relations of a run in, score rows out."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import metrics as M
from .operators import runs as U


@dataclass
class Run:
    """What an evaluator may look at; predictions are (question_id, question, answer, gold, answerable, question_type)."""

    run_id: int
    predictions: DataFrame
    ranking: DataFrame | None = None
    gold: DataFrame | None = None
    facts: DataFrame | None = None
    passages: DataFrame | None = None
    completions: dict[str, DataFrame] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)
    judge: str | None = None
    generator: str | None = None


@dataclass(frozen=True)
class Evaluator:
    name: str
    needs: tuple[str, ...]
    evaluate: Callable[[Run], DataFrame]
    judged: bool = False


_KNOWN: dict[str, Evaluator] = {}
_MISSING: dict[str, str] = {}


def register(name: str, needs: tuple[str, ...] = (), judged: bool = False) -> Callable:
    def add(f: Callable[[Run], DataFrame]) -> Callable[[Run], DataFrame]:
        _KNOWN[name] = Evaluator(name, needs, f, judged)
        return f

    return add


def available() -> tuple[list[str], dict[str, str]]:
    """Evaluators, and those that cannot run here with the reason."""
    return sorted(_KNOWN), dict(_MISSING)


def get(name: str) -> Evaluator:
    if name not in _KNOWN:
        raise KeyError(f"unknown evaluator {name}" + (f": {_MISSING[name]}" if name in _MISSING else ""))
    return _KNOWN[name]


def optional(name: str, module: str) -> None:
    """Note an evaluator whose library may be missing; that is never fatal."""
    import importlib.util

    if importlib.util.find_spec(module) is None:
        _MISSING[name] = f"needs {module}"


def check(evaluator: Evaluator, run: Run) -> tuple[list[str], list[str]]:
    """(what is missing, warnings)."""
    blocking = [n for n in evaluator.needs if getattr(run, n, None) is None and n not in run.completions]
    doubts = ["the judge is the generator"] if evaluator.judged and run.judge and run.judge == run.generator else []
    return blocking, doubts


@register("native.ir", ("ranking", "gold"))
def _ir(run: Run) -> DataFrame:
    ks = M.usable_ks(M.document_hits(run.ranking, run.gold), run.options.get("ks", [1, 3, 5, 10]))
    return M.ir_metrics(run.ranking, run.gold, ks)


@register("native.answer")
def _answer(run: Run) -> DataFrame:
    return M.answer_metrics(run.predictions)


def _with_means(rows: DataFrame, named: dict[str, str], *more: DataFrame) -> DataFrame:
    """Score rows and, without a question, the means of some of their metrics, and ``more`` aggregates (metric, value, ...)."""
    for part in (U.run_means(rows, named), *more):
        rows = rows.unionByName(part.select(F.lit(None).cast(rows.schema["question_id"].dataType).alias("question_id"), "metric", F.col("value").cast("double").alias("value")))
    return rows


@register("native.nuggets", ("facts", "passages"))
def _nuggets(run: Run) -> DataFrame:
    """Lexical support, or with the option ``nugget_mode=judge`` the completions ``nuggets`` (question_id, fact_id, supported)."""
    if run.options.get("nugget_mode") == "judge":
        if "nuggets" not in run.completions:
            raise ValueError("nugget_mode=judge needs the judge's replies: see runner.judge_nuggets")
        support = run.completions["nuggets"]
    else:
        support = M.nugget_support(run.facts, run.passages, run.options.get("nugget_threshold", run.options.get("threshold", 0.6)))
    return _with_means(M.nugget_recall(support), {"nugget_recall": "mean_nugget_recall", "nugget_full_coverage": "mean_nugget_full_coverage"})


@register("native.erag", ("utilities",), judged=True)
def _erag(run: Run) -> DataFrame:
    rows = run.completions["utilities"]
    return _with_means(M.erag(rows), {"erag_ndcg": "mean_erag_ndcg", "erag_best_utility": "mean_erag_best_utility"}, U.utility_by_rank(rows))


@register("native.claims", ("verdicts",), judged=True)
def _claims(run: Run) -> DataFrame:
    named = {m: f"mean_{m}" for m in ("claim_precision", "context_utilization", "claim_recall")}
    return _with_means(M.claim_metrics(run.completions["verdicts"]), named)


optional("ragas", "ragas")
optional("deepeval", "deepeval")


def evaluate(run: Run, names: list[str], judge: str | None = None) -> DataFrame:
    """Score rows (run_id, question_id, evaluator, metric, value) of all evaluators; a judge of its own is part of the evaluator's name.

    Doubts (see :func:`check`) are given as warnings.
    """
    out = None
    for name in names:
        e = get(name)
        missing, doubts = check(e, run)
        if missing:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        for doubt in doubts:
            warnings.warn(f"{name}: {doubt}", stacklevel=2)
        label = f"{name}@{judge}" if judge and e.judged else name
        rows = e.evaluate(run).select(F.lit(run.run_id).cast("long").alias("run_id"), "question_id", F.lit(label).alias("evaluator"), "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
