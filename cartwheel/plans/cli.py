"""Command line: ``python -m cartwheel.plans.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from cartwheel.plans import config


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("cartwheel").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cartwheel")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, help: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help)
        for a in args:
            p.add_argument(a)
        return p

    add("diagnostics", help="versions of the software in use")
    add("check-config", "config", help="validate a configuration file")
    add("preprocess", "source", "destination", help="session JSON lines to an event table").add_argument("--max-sessions", type=int)
    p = add("split", "events", "destination", "cutoff", help="global split at a time")
    p.add_argument("--label-end", type=int)
    p = add("prepare-validation", "events", "destination", help="both validation windows")
    p.add_argument("--days", type=int, default=7)
    p.add_argument("--strategy", default="official_random_event")
    for name in ("build-covisitation", "build-covisitation-suite"):
        p = add(name, "events", "destination", help="one matrix, or all of a profile")
        p.add_argument("--profile", default="public_v575")
        p.add_argument("--rule", default="carts_orders")
        p.add_argument("--max-neighbors", type=int, default=40)
        p.add_argument("--max-events", type=int)
    add("build-matrix-store", "matrix", "destination", help="a matrix bucketed by source for lookups").add_argument("--buckets", type=int, default=64)
    p = add("materialize-candidates", "contexts", "matrices", "events", "destination", help="feature rows of candidates")
    p.add_argument("--labels")
    p.add_argument("--retention", type=int)
    p = add("train-rankers", "rows", "destination", help="a ranker per target")
    p.add_argument("--rounds", type=int, default=20)
    p = add("run-validation", "source", "folder", help="the validation pipeline")
    p.add_argument("--config")
    p.add_argument("--max-sessions", type=int)
    p.add_argument("--allow-low-score", action="store_true")
    p.add_argument("--no-progress", action="store_true")
    p = add("run", "train", "test", "sample", "folder", help="train, infer and write a submission")
    p.add_argument("--config")
    p.add_argument("--no-progress", action="store_true")
    add("smoke", help="three sessions end to end")
    return top


def _config(path: str | None) -> config.Config:
    return config.load(path) if path else config.Config()


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "check-config":
        print(json.dumps(config.load(a.config).as_dict(), indent=2))
        return 0
    if a.command == "diagnostics":
        import pyspark

        print(json.dumps({"python": sys.version.split()[0], "pyspark": pyspark.__version__}))
        return 0
    from cartwheel import schemas
    from cartwheel.operators import covisit, features, matrix_store, ranker, sampling, split
    from cartwheel.operators.popularity import popularity
    from cartwheel.plans import artifacts, pipeline
    from cartwheel.sources import sessions, store

    spark = _session()
    progress = artifacts.silent if getattr(a, "no_progress", True) else artifacts.console
    if a.command == "preprocess":
        raw = sessions.read_sessions(spark, a.source, a.max_sessions)
        sessions.write_events(sessions.flatten(raw), a.destination)
        print(json.dumps(sessions.counts(raw).first().asDict()))
    elif a.command in ("split", "prepare-validation"):
        events = sessions.read_events(spark, a.events)
        views = {"": split.global_view(events, int(a.cutoff), a.label_end)} if a.command == "split" else split.two_windows(events, a.days, strategy=a.strategy)
        for name, view in views.items():
            for part in view._fields:
                getattr(view, part).write.parquet("/".join(x for x in (a.destination, name, part) if x))
    elif a.command == "build-covisitation":
        rule = next(r for r in covisit.rules(a.profile) if r.name == a.rule)
        covisit.matrix(sessions.read_events(spark, a.events), rule, a.max_neighbors, a.max_events).write.parquet(a.destination)
    elif a.command == "build-covisitation-suite":
        for name, matrix in covisit.suite(sessions.read_events(spark, a.events), a.profile, a.max_neighbors, a.max_events).items():
            matrix.write.parquet(f"{a.destination}/{name}")
    elif a.command == "build-matrix-store":
        print(json.dumps(matrix_store.build(spark.read.parquet(a.matrix), a.destination, a.buckets)))
    elif a.command == "materialize-candidates":
        matrices = {name: spark.read.parquet(f"{a.matrices}/{name}") for name in store.folders(spark, a.matrices)}
        labels = spark.read.parquet(a.labels) if a.labels else None
        popular = popularity(sessions.read_events(spark, a.events))
        features.materialize(sessions.read_events(spark, a.contexts), matrices, popular, labels, retention=a.retention).write.partitionBy("target").parquet(a.destination)
    elif a.command == "train-rankers":
        rows = spark.read.parquet(a.rows)
        for target in schemas.TYPES:
            own = sampling.positive_groups(rows.where(rows["target"] == target))
            if not own.isEmpty():
                ranker.train(own, a.rounds).save(f"{a.destination}/{target}")
    elif a.command == "run-validation":
        print(json.dumps(pipeline.run_validation(spark, a.source, a.folder, _config(a.config), a.max_sessions, a.allow_low_score, progress)))
    elif a.command == "run":
        print(json.dumps(pipeline.run_full(spark, a.train, a.test, a.sample, a.folder, _config(a.config), progress=progress)))
    else:
        print(json.dumps(pipeline.run_smoke(spark)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
