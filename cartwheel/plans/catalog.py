"""Every query of the engine by name, with its DuckDB equivalent."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel import schemas
from cartwheel.operators import candidates as cand
from cartwheel.operators import covisit, features, metrics, order, sampling, split, submission, vectors
from cartwheel.operators.popularity import popularity
from cartwheel.plans import oracles
from cartwheel.sources import sessions

Query = Callable[[SparkSession, str], DataFrame]
NEIGHBOURS = 20

#: Stage tables that queries share, by application, folder and name: the pipelines write
#: these between stages; here they are persisted (lost blocks are computed again).
_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def _kept(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _KEPT:
        _KEPT[key] = make().persist()
    elif not _KEPT[key].storageLevel.useMemory:  # the session's cache was cleared meanwhile
        _KEPT[key].persist()
    return _KEPT[key]


def forget() -> None:
    """Drop all shared stage tables."""
    for df in _KEPT.values():
        df.unpersist()
    _KEPT.clear()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return sessions.synthetic(spark, d)


def _users(spark: SparkSession, d: str) -> DataFrame:
    return sessions.synthetic(spark, d, "user")


def _cut(events: DataFrame) -> tuple[int, int]:
    last = split.max_ts(events)
    return last - 7 * schemas.DAY_MS, last


def _official(spark: SparkSession, d: str) -> split.View:
    events = _events(spark, d)
    return split.official_view(events, *_cut(events))


def _view(spark: SparkSession, d: str) -> split.View:
    def make() -> DataFrame:
        events = _events(spark, d)
        return split.official_roles(events, *_cut(events))

    return split.view_of(_kept(spark, d, "roles", make))


def _suite(spark: SparkSession, d: str, profile: str) -> dict[str, DataFrame]:
    table = _kept(spark, d, profile, lambda: covisit.suite_table(_view(spark, d).matrix_events, profile, NEIGHBOURS))
    return covisit.matrices_of(table, profile)


def _popular(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d, "popularity", lambda: popularity(_view(spark, d).matrix_events))


def stage_inputs(spark: SparkSession, d: str) -> tuple[split.View, dict[str, DataFrame], DataFrame]:
    """Views, matrices and popularity, computed and kept: what candidate generation reads."""
    view, matrices, popular = _view(spark, d), _suite(spark, d, "public_v575"), _popular(spark, d)
    for df in (*view, *matrices.values(), popular):
        df.count()
    return view, matrices, popular


def _global(spark: SparkSession, d: str) -> split.View:
    events = _events(spark, d)
    return split.global_view(events, _cut(events)[0])


def _rule(name: str) -> covisit.Rule:
    legacy = name.startswith("legacy_")
    found = [r for r in (covisit.LEGACY if legacy else covisit.PUBLIC + covisit.LEGACY) if r.name == name.removeprefix("legacy_")]
    return found[0]


def _matrix(name: str, source: Callable = _events) -> Query:
    return lambda spark, d: covisit.matrix(source(spark, d), _rule(name), NEIGHBOURS)


def _candidates(profile: str, target: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        view = _view(spark, d)
        matrices = _suite(spark, d, profile)
        options = {"history_budget": 50, "covisit_budget": 180, "max_events": 30} if profile == "legacy_five" else {}
        return _listed(cand.candidates(view.query_contexts, matrices, _popular(spark, d), target, 250, **options))

    return run


def _listed(fused: DataFrame) -> DataFrame:
    return fused.select("session", "aid", "score", "best_rank", F.col("evidence.source").alias("sources"), "candidate_rank")


def _baseline(spark: SparkSession, d: str) -> DataFrame:
    view = _view(spark, d)
    matrix = _suite(spark, d, "public_v575")["carts_orders"]
    return cand.fuse(cand.baseline_inputs(view.query_contexts, matrix, _popular(spark, d)), 50)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    rows = _baseline(spark, d).select("session", "aid", F.explode("evidence").alias("e"), "candidate_rank")
    return rows.select("session", "aid", "e.source", "e.score", "e.rank", "candidate_rank")


def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, split.View]:
    view = _view(spark, d)

    def make() -> DataFrame:
        return features.materialize(view.query_contexts, _suite(spark, d, "public_v575"), _popular(spark, d), view.labels, 250, 120)

    return _kept(spark, d, "rows", make), view


def _features(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d)[0]


def _on_rows(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows, view = _rows(spark, d)
        return fn(rows, view.labels)

    return run


_ROW = ("session", "target", "aid", "label", "candidate_rank")


def _on_sample(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: fn(_features(spark, d)).select(*_ROW)


def _recall(spark: SparkSession, d: str) -> DataFrame:
    rows, view = _rows(spark, d)
    top = submission.rules_predictions(rows).withColumnRenamed("target", "type")
    return metrics.recall(top, view.labels)


def _submission(spark: SparkSession, d: str) -> DataFrame:
    rows, view = _rows(spark, d)
    targets = spark.createDataFrame([(t,) for t in schemas.TYPES], "target string")
    queries = view.query_contexts.select("session").distinct().crossJoin(F.broadcast(targets))
    return submission.submission(queries, submission.rules_predictions(rows), _popular(spark, d))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a machine's own only where it is the whole cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cartwheel-catalog-")
        atexit.register(shutil.rmtree, folder, True)
        shared = f"file://{folder}"
    return f"{shared.rstrip('/')}/catalog/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: plans over it end at its files."""
    path = _scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Sessions written as JSON lines, read again and flattened."""
    path = _scratch(spark, "sessions")
    sessions.nest(_events(spark, d)).write.json(path)
    return sessions.flatten(sessions.read_sessions(spark, path)).drop("pos")


def _windows(field: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = split.two_windows(_events(spark, d))
        first, second = (getattr(made[w], field).withColumn("win", F.lit(w)) for w in ("ranker_train", "local_validation"))
        return first.unionByName(second)

    return run


def _jsonl_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 records of a source of several files."""
    path = _scratch(spark, "sessions")
    sessions.nest(_events(spark, d)).repartitionByRange(12, "session").sortWithinPartitions("session").write.json(path)
    return sessions.flatten(sessions.read_sessions(spark, path, 100)).drop("pos")


def _submission_csv(spark: SparkSession, d: str) -> DataFrame:
    """From a sample's rows to a submission's, through files."""
    rows, view = _rows(spark, d)
    wanted = view.query_contexts.select("session").distinct().withColumn("target", F.explode(F.array(*[F.lit(t) for t in schemas.TYPES])))
    sample, out = _scratch(spark, "sample"), _scratch(spark, "submission")
    wanted.select(F.concat_ws("_", F.col("session").cast("string"), "target").alias("session_type"), F.lit("1").alias("labels")).write.option("header", True).csv(sample)
    asked = submission.read_queries(spark.read.option("header", True).csv(sample))
    submission.write_csv(submission.submission(asked.select("session", "target"), submission.rules_predictions(rows), _popular(spark, d)), out)
    return spark.read.option("header", True).csv(out)


def _events_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "events")
    sessions.write_events(_events(spark, d), path)
    return sessions.read_events(spark, path)


def _matrix_sink(spark: SparkSession, d: str) -> DataFrame:
    """All matrices of a profile written by rule, and one of them read."""
    path = _scratch(spark, "matrices")
    covisit.suite_table(_view(spark, d).matrix_events, "public_v575", NEIGHBOURS).write.partitionBy("rule").parquet(path)
    return covisit.matrices_of(spark.read.parquet(path), "public_v575")["carts_orders"]


def _candidate_parts(spark: SparkSession, d: str) -> DataFrame:
    """Candidate rows written in three parts by session, as the pipelines write them."""
    from cartwheel.plans.pipeline import write_parts

    view, matrices, popular = _view(spark, d), _suite(spark, d, "public_v575"), _popular(spark, d)
    path = _scratch(spark, "rows")

    def rows_of(part: DataFrame) -> DataFrame:
        labels = view.labels.join(part.select("session").distinct(), "session", "left_semi")
        return features.materialize(part, matrices, popular, labels, 250, 120).select(*_ROW)

    write_parts(rows_of, view.query_contexts, path, 3)
    return spark.read.parquet(path).drop("part")


def _by_score(spark: SparkSession, d: str) -> DataFrame:
    """The best 20 by a score: here that of fusion, written by target and read."""
    path = _scratch(spark, "predictions")
    scored = _features(spark, d).select("session", "target", "aid", F.col("candidate_score").alias("score"))
    submission.score_predictions(scored).write.partitionBy("target").parquet(path)
    return spark.read.parquet(path)


def _means(spark: SparkSession, d: str) -> DataFrame:
    """One step of k-means from the first eight vectors."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    book = [[float(x) for x in r["embedding"]] for r in rows.where("vec_id < 8").orderBy("vec_id").collect()]
    means = vectors.centroid_means(rows, [], book)
    return means.select("code", F.posexplode("mean").alias("d", "x")).select("code", "d", F.round("x", 6).alias("x"))


def _gates(spark: SparkSession, d: str) -> DataFrame:
    """What both gates decide on a grid of reports."""
    from cartwheel.plans import pipeline
    from cartwheel.plans.config import Config

    out = []
    for rules in (0.50, 0.54, 0.60):
        for found in (0.60, 0.62, 0.70):
            report = {"rules_recall_at_20": rules, "candidate_recall_at_100": found, "ranker_recall_at_20": found - 0.1}
            try:
                pipeline.check_quality(report, Config())
                passed = True
            except ValueError:
                passed = False
            out.append((rules, found, passed, pipeline.publication_strategy(report, "validated")))
    return spark.createDataFrame(out, "rules double, found double, passed boolean, strategy string")


def _smoke(spark: SparkSession, d: str) -> DataFrame:
    from cartwheel.plans.pipeline import run_smoke

    got = run_smoke(spark)
    return spark.createDataFrame([(round(got["weighted_recall_at_20"], 9), got["submission_rows"], got["items"])], "weighted_recall double, submission_rows long, items long")


def _validation(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the rules from the validation pipeline's report: JSON lines to JSON."""
    import json

    from cartwheel.plans import pipeline
    from cartwheel.plans.config import Config
    from cartwheel.sources import store

    source, folder = _scratch(spark, "train"), _scratch(spark, "run")
    sessions.nest(_events(spark, d)).write.json(source)
    # Event ids break ties of time as places in the file do: records keep their order.
    cfg = Config(covisitation={"max_neighbors": NEIGHBOURS}, validation={"enforce_quality_gate": False})
    pipeline.run_validation(spark, source, folder, cfg, rank=False)
    report = json.loads(store.read_text(spark, f"{folder}/evaluation/candidates.json"))
    return spark.createDataFrame([(r["type"], r["hits"], r["denominator"], r["recall"], r["weighted"]) for r in report["rules"]], "type string, hits long, denominator long, recall double, weighted double")


def _prefix(spark: SparkSession, d: str) -> DataFrame:
    """The feature of a prefix of 100 sessions, here by session id."""
    events = _events(spark, d)
    first = events.select("session").distinct().orderBy("session").limit(100)
    return events.join(first, "session", "left_semi")


def _ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.counts(sessions.nest(_events(spark, d)))


def _flatten(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d)


def _known(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    cut = _cut(events)[0]
    return split.known_items(events, (cut, cut - 7 * schemas.DAY_MS))


def _ramp(spark: SparkSession, d: str) -> DataFrame:
    rule = replace(_rule("clicks_all_to_all"), ramp=(1_704_067_200.0, 1_706_659_200.0, 1.0, 4.0))
    return covisit.matrix(_events(spark, d), rule, NEIGHBOURS)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    own = order.indexed(order.tail(_events(spark, d), 30))
    return covisit.pairs(own, _rule("carts_orders"), 30)


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    view = _view(spark, d)
    return covisit.neighbours(_suite(spark, d, "public_v575")["carts_orders"], view.query_contexts)


def _knn(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.nearest(rows, queries, 10).withColumn("similarity", F.round("similarity", 9))


def _rq(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    first = [[float(x) for x in r["embedding"]] for r in rows.where("vec_id < 16").orderBy("vec_id").collect()]
    coded = vectors.encode(rows, [first[:8], first[8:]])
    return coded.select("vec_id", F.col("codes")[0].alias("code1"), F.col("codes")[1].alias("code2"))


def _rq_trained(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return vectors.encode(rows, vectors.train_quantizer(rows, levels=2, clusters=8, iterations=3))


def _refit(spark: SparkSession, d: str) -> DataFrame:
    """Training rows of both validation windows, each with matrices and popularity of its own."""
    parts = []
    for view in split.two_windows(_events(spark, d)).values():
        matrices = covisit.suite(view.matrix_events, "public_v575", NEIGHBOURS)
        parts.append(features.materialize(view.query_contexts, matrices, popularity(view.matrix_events), view.labels, 250, 120, ("carts",)))
    return sampling.refit_union(parts, "carts", 80, None).select("query_group", "session", "aid", "label", "candidate_rank")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """A ranker for each target, two rounds each, and its best 20 of all candidate lists.

    A plan over a persisted table repeats, on the driver, the plans of all tables below it, and
    training plans dozens of times; so stage tables are written here, as the pipelines do.
    """
    from cartwheel.operators import ranker

    events = _events(spark, d)
    view = split.view_of(_written(spark, split.official_roles(events, *_cut(events)), "roles"))
    table = _written(spark, covisit.suite_table(view.matrix_events, "public_v575", NEIGHBOURS), "matrices")
    popular = _written(spark, popularity(view.matrix_events), "popularity")
    matrices = covisit.matrices_of(table, "public_v575")
    rows = _written(spark, features.materialize(view.query_contexts, matrices, popular, view.labels, 250, 120), "rows")
    tops = []
    for target in schemas.TYPES:
        own = rows.where(F.col("target") == target)
        good = sampling.positive_groups(sampling.read_target(own, target, 80, None, True, 0.25))
        model = ranker.train(good, rounds=2, max_depth=3)
        tops.append(submission.score_predictions(model.score(own)))
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    from cartwheel.operators.sequences import prepare

    return prepare(_users(spark, d), 12)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "events_flatten": _flatten,
        "events_retail": sessions.retail,
        "ingest_counts": _ingest_counts,
        "session_prefix_limit": _prefix,
        "events_union": lambda s, d: sessions.concatenate(_events(s, d), _users(s, d)),
        "jsonl_flatten": _jsonl,
        "jsonl_prefix_limit": _jsonl_prefix,
        "two_windows_contexts": _windows("query_contexts"),
        "two_windows_labels": _windows("labels"),
        "events_parquet": _events_parquet,
        "matrix_sink": _matrix_sink,
        "candidate_parts": _candidate_parts,
        "top20_by_score": _by_score,
        "group_sizes": lambda s, d: sampling.group_sizes(_features(s, d).where("target = 'orders'")),
        "centroid_means": _means,
        "gates": _gates,
        "smoke": _smoke,
        "validation_report": _validation,
        "max_ts": lambda s, d: _events(s, d).agg(F.max("ts").alias("max_ts")),
        "known_aids": _known,
        "event_index": lambda s, d: order.indexed(_events(s, d)),
        "event_index_retail": lambda s, d: order.indexed(sessions.retail(s, d)),
        "tail_n": lambda s, d: order.tail(_users(s, d), 30),
        "recency_rank": lambda s, d: order.recency(_users(s, d)),
        "split_global_contexts": lambda s, d: _global(s, d).query_contexts,
        "split_global_labels": lambda s, d: _global(s, d).labels,
        "split_official_contexts": lambda s, d: _official(s, d).query_contexts,
        "split_official_labels": lambda s, d: _official(s, d).labels,
        "views_matrix_events": lambda s, d: _official(s, d).matrix_events,
        "covis_pairs_dedup": _pairs,
        **{f"covis_{r}": _matrix(r) for r in oracles.RULES},
        "covis_ramp_2024": _ramp,
        "covis_user_carts_orders": _matrix("carts_orders", _users),
        "covis_retail_buy_to_buy": _matrix("buy_to_buy", sessions.retail),
        "neighbor_lookup": _lookup,
        "popularity_by_target": _popular,
        "history_scores": lambda s, d: cand.history_ranks(_users(s, d), "orders"),
        "cand_baseline": lambda s, d: _listed(_baseline(s, d)),
        **{f"cand_public_{t}": _candidates("public_v575", t) for t in schemas.TYPES},
        **{f"cand_legacy_{t}": _candidates("legacy_five", t) for t in schemas.TYPES},
        "fuse_rrf": _fused,
        "feat_session": lambda s, d: features.session_features(_view(s, d).query_contexts),
        "feat_session_aid": lambda s, d: features.item_features(_view(s, d).query_contexts),
        "feat_evidence": lambda s, d: _evidence(_features(s, d)),
        "feature_matrix": _features,
        "candidates_labeled_retained": lambda s, d: _features(s, d).select(*_ROW),
        "recall_at_20": _recall,
        "cand_recall_cutoffs": _on_rows(metrics.recall_at),
        "cand_recall_weighted": _on_rows(lambda r, y: metrics.weighted_recall(r, y, 100)),
        "cand_recall_sources": _on_rows(metrics.recall_by_source),
        "cand_recall_length_buckets": _on_rows(metrics.recall_by_length),
        "cand_rank_hist": _on_rows(lambda r, y: metrics.rank_histogram(r)),
        "sample_queries": _on_sample(lambda r: sampling.read_target(r, "orders", 80, 50)),
        "sample_negatives": _on_sample(lambda r: sampling.read_target(r, "clicks", 80, None, rate=0.05)),
        "positive_groups": _on_sample(lambda r: sampling.positive_groups(r.where("target = 'carts'"))),
        "refit_union": _refit,
        "rules_top20": lambda s, d: submission.rules_predictions(_features(s, d)),
        "submission_rows": _submission,
        "submission_csv": _submission_csv,
        "knn_cosine": _knn,
        "sequence_prep": _sequences,
        "rq_encode": _rq,
        "rq_trained": _rq_trained,
        "ranker_score_top20": _ranked,
    }
    return out


def _evidence(rows: DataFrame) -> DataFrame:
    return rows.select("session", "target", "aid", *[c for c in rows.columns if c.startswith("source_")])


def oracle_sql() -> dict[str, str]:
    return oracles.queries()
