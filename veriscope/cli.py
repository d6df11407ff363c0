"""Command line: ``python -m veriscope.cli COMMAND --help``.

A store folder (``--store``) holds datasets, indexes, runs and scores.  No
model server is called here: completions come from a Parquet file
(``--completions``: prompt_id, text, prompt_tokens, completion_tokens).
"""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluators, queries, queries_runs, runner
from .operators import compare, runs, sampling
from .operators.stats import REPLICATES
from .plans import config as conf
from .plans.models import Canned, probe
from .schemas import ANNOTATIONS, CONFIGS, INDEXES, RUNS, SCORES
from .session import session
from .sources import loaders
from .sources.store import Store

DATASETS = "name string, source string"


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of the driver's entry, where it can be imported, or else those of the core."""
    if importlib.util.find_spec("__spark_entry__"):
        return importlib.import_module("__spark_entry__").queries()
    return {**queries.QUERIES, **queries_runs.Q.QUERIES}


def _show(frame: DataFrame, out: str | None = None, explain: bool = False) -> None:
    if explain:
        frame.explain("formatted")
    elif out:
        frame.write.mode("overwrite").parquet(out)
    else:
        frame.show(50, truncate=80)


def _scores(store: Store) -> DataFrame:
    return store.read("scores", SCORES)


def load_dataset(store: Store, name: str, paths: list[str], sample: int, seed: int = 42) -> None:
    """Load a dataset into the store; a stratified sample of its questions is the split ``eval``."""
    made = loaders.get_loader(name)(store.spark, *paths)
    asked = made.questions
    picked = sampling.stratified_sample(asked.select("external_id", "question_type"), sample, "question_type", "external_id", seed)
    asked = sampling.split(asked, picked, "external_id").select(
        F.lit(made.name).alias("dataset"), F.xxhash64(F.lit(made.name), "external_id").alias("question_id"), "external_id", "question", "answer", "question_type", "gold_evidence", "split"
    )
    docs = made.documents
    meta = F.col("metadata") if "metadata" in docs.columns else F.lit(None).cast("map<string, string>")
    store.upsert("datasets", store.spark.createDataFrame([(made.name, ",".join(paths))], DATASETS))
    store.upsert("documents", docs.select(F.lit(made.name).alias("dataset"), "external_id", "title", "body", meta.alias("metadata")))
    store.upsert("questions", asked)


def _of(store: Store, table: str, dataset: str) -> DataFrame:
    rows = store.read(table)
    if rows is None:
        raise SystemExit(f"the store has no {table}: load a dataset first")
    return rows.where(F.col("dataset") == dataset)


def dataset_stats(store: Store) -> DataFrame:
    names = store.read("datasets", DATASETS).select(F.col("name").alias("dataset"))
    asked = store.read("questions")
    asked = asked.select("dataset", "split", (F.size("gold_evidence") == 0).alias("unanswerable")) if asked is not None else names.selectExpr("dataset", "'' AS split", "false AS unanswerable").limit(0)
    docs = store.read("documents")
    return runs.dataset_counts(names, docs if docs is not None else names.limit(0), asked, store.read("indexes", INDEXES))


def doctor(store: Store | None) -> list[tuple[str, bool, str]]:
    """(what, whether it works, what it says) of the session, optional libraries and the store."""
    spark = store.spark if store else session()
    out = [("spark", *probe(lambda: f"{spark.version}, {spark.range(10).count()} rows counted"))]
    for lib in ("yaml", "ahocorasick", "tokenizers"):
        out.append((lib, *probe(lambda lib=lib: importlib.import_module(lib).__name__)))
    if store:
        out.append(("store", *probe(lambda: f"{store.read('runs', RUNS).count()} runs in {store.root}")))
    return out


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="veriscope")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, store: bool = True, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if store:
            p.add_argument("--store", required=name != "doctor")
        for key, kind in options.items():
            p.add_argument("--" + key.replace("_", "-"), **kind)
        return p

    text, whole = {"default": None}, {"type": int, "default": None}
    command("doctor")
    command("queries", store=False)
    command("query", "name", store=False, data={"required": True}, out=text, explain={"action": "store_true"})
    command("loaders", store=False)
    command("evaluators", store=False)
    command("config", "file", store=False)
    command("matrix", "file", store=False)
    command("load", "dataset", sample={"type": int, "default": 200}).add_argument("paths", nargs="+")
    command("stats")
    command("index", "file", dataset={"required": True}, force={"action": "store_true"})
    command("run", "file", dataset={"required": True}, completions={"required": True}, limit=whole, label={"default": ""})
    command("runs", limit={"type": int, "default": 20}, status=text)
    command("eval", "run_id", evaluators={"default": "native.ir,native.answer,native.nuggets"}, judge=text, option={"action": "append", "default": []})
    command("show", "run_id")
    command("compare", "a", "b")
    command("report", metrics={"required": True})
    command("calibrate", "run_id", annotator={"required": True}, metric={"required": True})
    command("leaderboard", "metric", dataset=text, limit=whole)
    command("drill", "run_id", metrics={"required": True})
    command("curve", "file", dataset={"required": True}, ks={"default": "5,10,20"}, limit=whole, out=text)
    command("curves", "a", "b", dataset={"required": True}, ks={"default": "5,10,20"}, limit=whole)
    return parser


def _listing(store: Store, limit: int | None, status: str | None, dataset: str | None = None) -> DataFrame:
    rows = runs.listing(store.read("runs", RUNS), store.read("configs", CONFIGS))
    return runs.newest(rows if dataset is None else rows.where(F.col("dataset") == dataset), limit or 1000, status)


def main(argv: list[str] | None = None) -> int:  # noqa: PLR0915 - one branch a command
    args = _parser().parse_args(argv)
    name = args.command
    if name == "queries":
        print("\n".join(sorted(all_queries())))
    elif name == "query":
        _show(all_queries()[args.name](session(), args.data), args.out, args.explain)
    elif name == "loaders":
        print("\n".join(loaders.available()))
    elif name == "evaluators":
        there, missing = evaluators.available()
        print("\n".join([*there, *(f"{k} ({v})" for k, v in missing.items())]))
    elif name == "config":
        for c in conf.load(args.file):
            print(json.dumps({"name": c.name, "hash": c.hash(), "index": c.index_hash(), "warnings": c.warnings()}))
    elif name == "matrix":
        found = conf.load(args.file)
        print(json.dumps({"configurations": len(found), "indexes": len({c.index_hash() for c in found})}))
    else:
        store = Store(session(), args.store) if args.store else None
        return _stored(args, store)
    return 0


def _stored(args: argparse.Namespace, store: Store | None) -> int:
    """Commands over a store."""
    name = args.command
    if name == "doctor":
        found = doctor(store)
        print("\n".join(f"{'ok' if ok else 'FAILS'}  {what}: {said}" for what, ok, said in found))
        return 0 if all(ok for _, ok, _ in found) else 1
    if name == "load":
        load_dataset(store, args.dataset, args.paths, args.sample)
        _show(dataset_stats(store))
    elif name == "stats":
        _show(dataset_stats(store))
    elif name == "index":
        for c in conf.load(args.file):
            index_id, chunks, reused = runner.build_index(store, c, args.dataset, _of(store, "documents", args.dataset).drop("dataset"), force=args.force)
            print(f"{c.name}: {index_id}, {chunks.count()} chunks, {'there already' if reused else 'built'}")
    elif name == "run":
        provider = Canned(store.spark.read.parquet(args.completions))
        for c in conf.load(args.file):
            run_id = runner.run_campaign(store, c, args.dataset, _of(store, "documents", args.dataset).drop("dataset"), store.read("questions"), provider, limit=args.limit, label=args.label)
            print(f"{c.name}: run {run_id}")
    elif name == "runs":
        _show(_listing(store, args.limit, args.status))
    elif name == "eval":
        options = dict(conf.option(o) for o in args.option)
        run_id = int(args.run_id)
        run = runner.load_run(store, run_id, store.read("questions").drop("dataset", "split"), options, args.judge)
        for r in runner.evaluate_run(store, run, args.evaluators.split(","), args.judge):
            print(json.dumps(r.__dict__))
    elif name == "show":
        _show(runs.summarize(_scores(store).where(F.col("run_id") == int(args.run_id)), REPLICATES))
    elif name == "compare":
        _show(compare.compare_all(_scores(store), int(args.a), int(args.b), REPLICATES))
    elif name == "report":
        _show(compare.report(_scores(store).where("question_id is not null"), args.metrics.split(",")))
    elif name == "calibrate":
        mine = F.col("run_id") == int(args.run_id)
        human = store.read("annotations", ANNOTATIONS).where(mine & (F.col("annotator") == args.annotator) & (F.col("metric") == args.metric))
        _show(runs.by_kappa(compare.calibrate(_scores(store).where(mine & F.col("question_id").isNotNull()), human.select("question_id", "value"))))
    elif name == "leaderboard":
        some = _listing(store, args.limit, "completed", args.dataset).select("run_id")
        _show(compare.leaderboard(_scores(store).where("question_id is not null").join(some, "run_id", "left_semi"), args.metric, REPLICATES))
    elif name == "drill":
        run_id = int(args.run_id)
        rows = runner.load_run(store, run_id, store.read("questions").drop("dataset", "split")).predictions.drop("contexts", "gold_evidence")
        _show(runs.drill_down(rows, _scores(store).where(F.col("run_id") == run_id), args.metrics.split(",")))
    elif name in ("curve", "curves"):
        ks = [int(k) for k in args.ks.split(",")]
        docs, asked = _of(store, "documents", args.dataset).drop("dataset"), store.read("questions")
        files = [args.file] if name == "curve" else [args.a, args.b]
        made = [runner.curve(store, conf.load(f)[0], args.dataset, docs, asked, ks, limit=args.limit) for f in files]
        if name == "curves":
            _show(runs.compare_curves(*made, REPLICATES))
        else:
            means = runs.curve_means(made[0], REPLICATES)
            _show(means) if not args.out else runs.curve_json(means).write.mode("overwrite").text(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
