"""The two pipelines: temporal validation, and training to submission.

Every stage writes Parquet and a manifest under the run's folder, which may be in any
store that Spark reads, and is read again when the run is repeated with the same
specification; the specification holds names, sizes and times of the input's files.
Candidate rows are written in parts by session, and a part that was written to its end is
kept when a run goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel import schemas
from cartwheel.operators import covisit, features, metrics, ranker, sampling, split, submission
from cartwheel.operators.popularity import popularity
from cartwheel.plans.artifacts import Run, save_report, silent
from cartwheel.plans.config import Config
from cartwheel.sources import sessions, store

WINDOWS = ("ranker_train", "local_validation")
#: Candidates kept for validation and for inference.
VALIDATION_RANKS, INFERENCE_RANKS = 150, 120
#: Sessions of a part of candidate rows, about; rounds without gain that end ranker training.
PART_SESSIONS, PATIENCE = 2_000_000, 30


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _ingest(spark: SparkSession, run: Run, name: str, source: str, max_sessions: int | None = None) -> str:
    def make(folder: str) -> dict[str, Any]:
        raw = sessions.read_sessions(spark, source, max_sessions)
        _save(sessions.flatten(raw), f"{folder}/events")
        return sessions.counts(raw).first().asDict()

    return f"{run.stage(name, make)[0]}/events"


def _matrices(spark: SparkSession, run: Run, name: str, events: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    def make(folder: str) -> dict[str, Any]:
        table = covisit.suite_table(events, cfg.covisitation.profile, cfg.covisitation.max_neighbors, cfg.covisitation.max_events_per_session)
        table.write.mode("overwrite").option("compression", "zstd").partitionBy("rule").parquet(f"{folder}/matrices")
        _save(popularity(events, max(1, cfg.candidates.popularity_budget)), f"{folder}/popularity")
        popular = _load(spark, f"{folder}/popularity").orderBy("target", "rank").collect()
        save_report(spark, f"{folder}/popularity.json", {t: [r["aid"] for r in popular if r["target"] == t] for t in schemas.TYPES})
        return {"rules": [r.name for r in covisit.rules(cfg.covisitation.profile)]}

    folder, _ = run.stage(name, make)
    schema = "source_aid int, target_aid int, weight double, rank long, rule string"  # a rule may have no pair at all
    table = spark.read.schema(schema).parquet(f"{folder}/matrices")
    return {**covisit.matrices_of(table, cfg.covisitation.profile), "popularity": _load(spark, f"{folder}/popularity")}


def write_parts(rows_of: Callable[[DataFrame], DataFrame], contexts: DataFrame, folder: str, parts: int) -> tuple[int, int]:
    """Rows of the sessions of each part, in a folder each; (parts written, parts found finished).

    A part counts as finished by the marker that Spark's commit leaves, so one that a lost
    run left half written is written anew.
    """
    spark, made, found = contexts.sparkSession, 0, 0
    for k in range(parts):
        path = f"{folder}/part={k}"
        if store.finished(spark, path):
            found += 1
            continue
        own = contexts if parts == 1 else contexts.where(F.pmod(F.xxhash64("session"), F.lit(parts)) == k)
        _save(rows_of(own), path)
        made += 1
    return made, found


def _rows(spark: SparkSession, run: Run, name: str, contexts: DataFrame, matrices: dict[str, DataFrame], labels: DataFrame | None, retention: int, cfg: Config) -> DataFrame:
    own = dict(matrices)
    popular = own.pop("popularity")
    options = {}
    if cfg.covisitation.profile == "legacy_five":
        options = {"history_budget": cfg.candidates.history_budget, "covisit_budget": cfg.candidates.covisitation_budget, "max_events": cfg.covisitation.max_events_per_session}

    def make(folder: str) -> dict[str, Any]:
        parts = -(-contexts.select("session").distinct().count() // PART_SESSIONS) or 1

        def rows_of(part: DataFrame) -> DataFrame:
            mine = labels if labels is None or parts == 1 else labels.join(part.select("session").distinct(), "session", "left_semi")
            return features.materialize(part, own, popular, mine, cfg.candidates.total_budget, retention, **options)

        write_parts(rows_of, contexts, f"{folder}/rows", parts)
        return {"rows": _load(spark, f"{folder}/rows").count(), "parts": parts}

    folder, _ = run.stage(name, make)
    return _load(spark, f"{folder}/rows").drop("part")


def check_quality(report: dict[str, float], cfg: Config, allow_low_score: bool = False) -> None:
    v = cfg.validation
    if v.strategy != "official_random_event" or not v.enforce_quality_gate or allow_low_score:
        return
    if report["rules_recall_at_20"] < v.minimum_rules_recall_at_20 or report["candidate_recall_at_100"] < v.minimum_candidate_recall_at_100:
        raise ValueError(f"candidates are below the quality gate: {report}")


def publication_strategy(report: dict[str, float], wanted: str) -> str:
    """``refit`` as asked; else the model if it scored at least as well as the rules."""
    if wanted == "refit":
        return "refit"
    return "validated" if report["ranker_recall_at_20"] >= report["rules_recall_at_20"] else "rules"


def _train(rows: DataFrame, target: str, cfg: Config, rate: float | None = None, validation: DataFrame | None = None) -> ranker.Ranker | None:
    r = cfg.ranking
    own = sampling.positive_groups(sampling.read_target(rows, target, r.training_candidate_limit, r.training_query_limit, True, rate, cfg.project.seed))
    if own.isEmpty():
        return None
    return ranker.train(own, r.rounds, r.max_depth, r.learning_rate, cfg.project.seed, "session", validation, PATIENCE)


def run_validation(spark: SparkSession, source: str, folder: str, cfg: Config | None = None, max_sessions: int | None = None, allow_low_score: bool = False, progress: Callable[[str, str, float], None] = silent, rank: bool = True) -> dict[str, Any]:
    """Views of two windows, their matrices and candidates, the report, and (with ``rank``) rankers."""
    cfg = cfg or Config()
    run = Run(spark, folder, {"kind": "validation", "source": str(source), "files": sessions.fingerprint(spark, source), "max_sessions": max_sessions, "config": cfg.as_dict()}, progress)
    events = _load(spark, _ingest(spark, run, "preprocess", source, max_sessions))

    def views(folder: str) -> dict[str, Any]:
        v = cfg.validation
        if v.strategy == "legacy_global_cutoff" and v.cutoff_timestamp_ms and v.training_cutoff_timestamp_ms:
            made = {"ranker_train": split.global_view(events, v.training_cutoff_timestamp_ms, v.cutoff_timestamp_ms), "local_validation": split.global_view(events, v.cutoff_timestamp_ms)}
        else:
            made = split.two_windows(events, v.days, v.seed, v.strategy)
        for name, view in made.items():
            for part in view._fields:
                _save(getattr(view, part), f"{folder}/{name}/{part}")
        return {}

    where, _ = run.stage("views", views)
    rows, labels = {}, {}
    for name, retention in zip(WINDOWS, (cfg.ranking.training_candidate_limit, max(cfg.ranking.validation_candidate_limit, VALIDATION_RANKS)), strict=True):
        part = {p: _load(spark, f"{where}/{name}/{p}") for p in split.View._fields}
        labels[name] = part["labels"]
        matrices = _matrices(spark, run, f"matrices_{name}", part["matrix_events"], cfg)
        rows[name] = _rows(spark, run, f"candidates_{name}", part["query_contexts"], matrices, part["labels"], retention, cfg)
    valid, truth = rows["local_validation"], labels["local_validation"]

    def evaluate(folder: str) -> dict[str, Any]:
        rules = metrics.recall(submission.rules_predictions(valid).withColumnRenamed("target", "type"), truth).collect()
        found = metrics.weighted_recall(valid, truth, 100).first()[0]
        listed = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  a few rows a target
        save_report(
            spark,
            f"{folder}/candidates.json",
            {"rules": [r.asDict() for r in rules], "cutoffs": listed(metrics.recall_at(valid, truth)), "weighted_recall_at_100": found, "sources": listed(metrics.recall_by_source(valid, truth)), "lengths": listed(metrics.recall_by_length(valid, truth)), "ranks": listed(metrics.rank_histogram(valid))},
        )
        return {"rules_recall_at_20": sum(r["weighted"] for r in rules), "candidate_recall_at_100": found}

    _, report = run.stage("evaluation", evaluate)
    check_quality(report, cfg, allow_low_score)

    def rankers(folder: str) -> dict[str, Any]:
        r, made, total, own_metrics = cfg.ranking, [], 0.0, {}
        for target in schemas.TYPES:
            own = sampling.read_target(valid, target, r.validation_candidate_limit, r.validation_query_limit, False, seed=cfg.project.seed, keep_positives=False)
            model = _train(rows["ranker_train"], target, cfg, getattr(r, f"{target}_negative_sample_rate"), own)
            if model is None:
                continue
            model.save(f"{folder}/{target}")
            made.append(target)
            _save(submission.score_predictions(model.score(own)), f"{folder}/predictions/target={target}")
            top = _load(spark, f"{folder}/predictions/target={target}").withColumn("type", F.lit(target))
            asked = truth.where(F.col("type") == target).join(own.select("session").distinct(), "session", "left_semi")
            scored = next(x for x in metrics.recall(top, asked).collect() if x["type"] == target)
            total += scored["weighted"]
            own_metrics[target] = {"recall_at_20": scored["recall"], "ndcg_at_20": model.history, "rounds": len(model.trees)}
        save_report(spark, f"{folder}/metrics.json", {"weighted_recall_at_20": total, "targets": own_metrics})
        return {"models": made, "ranker_recall_at_20": total}

    trained = run.stage("rankers", rankers)[1] if rank else {}
    return {**report, **trained, "reused": run.reused, "made": run.made, "folder": folder}


def run_full(spark: SparkSession, train: str, test: str, sample: str, folder: str, cfg: Config | None = None, allow_low_score: bool = True, progress: Callable[[str, str, float], None] = silent) -> dict[str, Any]:
    """Validation, then matrices over train and test history, test candidates and a submission."""
    cfg = cfg or Config()
    report = run_validation(spark, train, f"{folder}/validation", cfg, None, allow_low_score, progress)
    files = [sessions.fingerprint(spark, x) for x in (train, test, sample)]
    run = Run(spark, f"{folder}/full", {"kind": "full", "train": str(train), "test": str(test), "sample": str(sample), "files": files, "config": cfg.as_dict()}, progress)
    strategy = publication_strategy(report, cfg.ranking.model_strategy)
    contexts = _load(spark, _ingest(spark, run, "preprocess_test", test))
    history = sessions.concatenate(_load(spark, f"{folder}/validation/preprocess/events"), contexts)
    matrices = _matrices(spark, run, "matrices", history, cfg)
    rows = _rows(spark, run, "candidates", contexts, matrices, None, INFERENCE_RANKS, cfg)

    def predict(out: str) -> dict[str, Any]:
        for target in schemas.TYPES:
            path = f"{out}/predictions/target={target}"
            if store.finished(spark, path):  # left by a run that ended later
                continue
            own = rows.where(F.col("target") == target)
            model = None
            if strategy == "validated" and target in report["models"]:
                model = ranker.Ranker.load(spark, f"{folder}/validation/rankers/{target}")
            elif strategy == "refit":
                windows = [_load(spark, f"{folder}/validation/candidates_{w}/rows").select(*rows.columns) for w in WINDOWS]
                union = sampling.refit_union(windows, target, cfg.ranking.training_candidate_limit, cfg.ranking.training_query_limit)
                if not union.isEmpty():
                    model = ranker.train(union, cfg.ranking.rounds, cfg.ranking.max_depth, cfg.ranking.learning_rate, cfg.project.seed, "query_group")
            made = submission.score_predictions(model.score(own)) if model else submission.rules_predictions(own)
            _save(made.drop("target"), path)
        return {"strategy": strategy}

    predicted, _ = run.stage("predictions", predict)

    def submit(out: str) -> dict[str, Any]:
        asked = submission.read_queries(spark.read.option("header", True).csv(sample))
        done = submission.submission(asked.select("session", "target"), _load(spark, f"{predicted}/predictions"), matrices["popularity"])
        keyed = done.join(asked.select(F.concat_ws("_", F.col("session").cast("string"), "target").alias("session_type"), "pos"), "session_type")
        submission.write_csv(keyed, f"{out}/submission")
        return {"rows": keyed.count()}

    where, result = run.stage("submission", submit)
    return {**report, "strategy": strategy, "rows": result["rows"], "submission": f"{where}/submission", "stages_reused": run.reused}


def run_smoke(spark: SparkSession) -> dict[str, Any]:
    """Three made-up sessions from split to submission; the matrix sees all events on purpose."""
    rows = [(1, 10, 100, "clicks", 0), (1, 20, 300, "clicks", 1), (2, 10, 110, "clicks", 0), (2, 30, 310, "orders", 1), (3, 11, 120, "clicks", 0), (3, 20, 320, "carts", 1)]
    from cartwheel.operators import candidates as cand

    events = spark.createDataFrame(rows, schemas.EVENTS)
    contexts, labels = split.split_global(events, 250)
    matrix = covisit.matrix(events, covisit.Rule("smoke", forward=True), 20, None)
    overall = events.groupBy("aid").agg(F.count(F.lit(1)).alias("n"))
    popular = popularity(events, 20)
    fused = cand.fuse(cand.baseline_inputs(contexts, matrix, popular), 20)
    targets = spark.createDataFrame([(t,) for t in schemas.TYPES], "target string")
    found = fused.crossJoin(F.broadcast(targets))
    top = submission.rules_predictions(found)
    score = metrics.recall(top.withColumnRenamed("target", "type"), labels).agg(F.sum("weighted")).first()[0]
    queries = contexts.select("session").distinct().crossJoin(F.broadcast(targets))
    return {"weighted_recall_at_20": score, "submission_rows": submission.submission(queries, top, popular).count(), "items": overall.count()}
