"""Ranker, configuration, artefacts, pipelines, streaming and the entry points."""

from __future__ import annotations

import itertools
import json
import math
import random

import pytest

import __spark_entry__
from cartwheel import schemas
from cartwheel.operators import ranker
from cartwheel.plans import artifacts, cli, config, pipeline
from cartwheel.sources import sessions
from cartwheel.streaming import ingest


def test_ranker_learns_saves_and_checks_its_features(spark, tmp_path):
    rows = spark.createDataFrame([(s, "clicks", a, int(a == 1), 2.0 if a == 1 else 0.1 * a) for s in range(6) for a in (1, 2, 3)], "session long, target string, aid int, label int, x double")
    model = ranker.train(rows, rounds=2, max_depth=2)
    got = {(r["session"], r["aid"]): r["score"] for r in model.score(rows).collect()}
    assert all(got[s, 1] > got[s, 2] for s in range(6))
    model.save(str(tmp_path / "m"))
    again = ranker.Ranker.load(spark, str(tmp_path / "m"))
    assert {(r["session"], r["aid"]): r["score"] for r in again.score(rows).collect()} == got
    with pytest.raises(ValueError):
        model.score(rows.withColumnRenamed("x", "y"))


def test_config_extends_and_forbids_unknown_keys(tmp_path):
    (tmp_path / "base.yaml").write_text("validation:\n  days: 3\nranking:\n  rounds: 4\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\nranking:\n  max_depth: 2\n")
    got = config.load(tmp_path / "own.yaml")
    assert (got.validation.days, got.ranking.rounds, got.ranking.max_depth) == (3, 4, 2)
    (tmp_path / "bad.yaml").write_text("unknown: 1\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "bad.yaml")


@pytest.mark.parametrize("bad", [{"other": {}}, {"ranking": {"rounds": 0}}, {"ranking": {"other": 1}}, {"validation": {"days": "a"}}, {"validation": {"enforce_quality_gate": 1}}, {"covisitation": {"profile": "x"}}, {"covisitation": {"max_events_per_session": 1}}, {"validation": {"strategy": "legacy_global_cutoff", "training_cutoff_timestamp_ms": 2, "cutoff_timestamp_ms": 2}}, {"ranking": 3}])
def test_config_names_what_is_wrong(bad):
    with pytest.raises(ValueError):
        config.Config(**bad)


def test_config_accepts_settings_without_effect():
    got = config.Config(project={"data_dir": "d"}, covisitation={"partitions": 2, "max_events_per_session": None}, neural={"batch_size": 3}, ranking={"device": "cpu", "learning_rate": 1})
    assert got.covisitation.max_events_per_session is None and got.ranking.learning_rate == 1 and "device" not in got.as_dict()["ranking"]


def test_artifacts(spark, tmp_path, capsys):
    assert artifacts.stable_hash({"a": 1, "b": 2}) == artifacts.stable_hash({"b": 2, "a": 1})
    calls = []
    for _ in range(2):
        run = artifacts.Run(spark, str(tmp_path / "r"), {"x": 1}, artifacts.console)
        assert run.stage("s", lambda folder: calls.append(folder) or {"n": 1})[1] == {"n": 1}
    assert len(calls) == 1 and run.reused == ["s"]
    assert [line.split()[:2] for line in capsys.readouterr().err.splitlines()] == [["s", "done"], ["s", "reused"]]
    with pytest.raises(ValueError):
        artifacts.Run(spark, str(tmp_path / "r"), {"x": 2})


def test_source_fingerprint_follows_the_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("x")
    first = sessions.fingerprint(spark, str(tmp_path / "in"))
    assert first == sessions.fingerprint(spark, str(tmp_path / "in"))
    (tmp_path / "in" / "a.jsonl").write_text("yy")
    assert first != sessions.fingerprint(spark, str(tmp_path / "in"))


def test_parts_go_on_after_a_lost_run(spark, tmp_path):
    rows = spark.createDataFrame([(s, 10 + s) for s in range(1, 41)], "session long, aid int")
    folder, seen = str(tmp_path / "rows"), []

    def failing(part):
        seen.append(part)
        if len(seen) == 3:
            raise RuntimeError("lost")
        return part

    with pytest.raises(RuntimeError):
        pipeline.write_parts(failing, rows, folder, 4)
    (tmp_path / "rows" / "part=2").mkdir()
    (tmp_path / "rows" / "part=2" / "part-00000.parquet").write_text("torn")
    assert pipeline.write_parts(lambda part: part, rows, folder, 4) == (2, 2)
    assert sorted(tuple(r) for r in spark.read.parquet(folder).drop("part").collect()) == sorted(tuple(r) for r in rows.collect())


def _direct_gradients(group):
    """Pairwise gradients of one list of (aid, label, score), by definition."""
    order = sorted(group, key=lambda r: (-r[2], r[0]))
    gain = {r[0]: 1 / math.log2(k + 2) for k, r in enumerate(order)}
    ideal = sum(1 / math.log2(k + 2) for k in range(sum(r[1] > 0 for r in group)))
    out = {r[0]: [0.0, 0.0] for r in group}
    for p, q in itertools.product([r for r in group if r[1] > 0], [r for r in group if r[1] <= 0]):
        rho, change = 1 / (1 + math.exp(p[2] - q[2])), abs(gain[p[0]] - gain[q[0]]) / ideal
        for aid, sign in ((p[0], 1), (q[0], -1)):
            out[aid][0] += sign * rho * change
            out[aid][1] += rho * (1 - rho) * change
    return out


def test_ranker_gradients_and_ndcg_equal_their_definitions(spark):
    rng = random.Random(6)
    groups = {s: [(a, int(rng.random() < 0.3), rng.choice([0.0, 0.5, rng.random()])) for a in range(rng.randint(2, 9))] for s in range(8)}
    rows = spark.createDataFrame([(s, *r) for s, g in groups.items() for r in g], "session long, aid int, label int, score double")
    got = {(r["session"], r["aid"]): (r["g"], r["h"]) for r in ranker.gradients(rows, "session").collect()}
    want = {(s, a): tuple(v) for s, g in groups.items() if len({x[1] for x in g}) == 2 for a, v in _direct_gradients(g).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    values = []
    for g in groups.values():
        order = sorted(g, key=lambda r: (-r[2], r[0]))[:3]
        n = min(3, sum(r[1] for r in g))
        values.append(sum(r[1] / math.log2(k + 2) for k, r in enumerate(order)) / sum(1 / math.log2(k + 2) for k in range(n)) if n else 1.0)
    assert ranker.ndcg(rows, k=3) == pytest.approx(sum(values) / len(values))


def test_ranker_stops_early_and_checks_groups(spark):
    kind = "session long, target string, aid int, label int, x double, noise double"
    rows = spark.createDataFrame([(s, "clicks", a, int(a == 1), float(a == 1), 0.0) for s in range(6) for a in (1, 2, 3)], kind)
    model = ranker.train(rows, rounds=8, max_depth=2, validation=rows, patience=2)
    assert model.history == [1.0, 1.0, 1.0] and len(model.trees) == 1
    with pytest.raises(ValueError):
        ranker.train(rows.unionByName(rows), rounds=1)
    with pytest.raises(ValueError):
        ranker.train(rows, rounds=1, validation=rows.drop("noise"))


def test_gates():
    assert pipeline.publication_strategy({"rules_recall_at_20": 0.56, "ranker_recall_at_20": 0.05}, "validated") == "rules"
    assert pipeline.publication_strategy({"rules_recall_at_20": 0.56, "ranker_recall_at_20": 0.57}, "validated") == "validated"
    assert pipeline.publication_strategy({}, "refit") == "refit"
    with pytest.raises(ValueError):
        pipeline.check_quality({"rules_recall_at_20": 0.1, "candidate_recall_at_100": 0.9}, config.Config())


def test_smoke(spark):
    got = pipeline.run_smoke(spark)
    assert got["weighted_recall_at_20"] == pytest.approx(1.0) and got["submission_rows"] == 9


def _jsonl(path, rows):
    path.write_text("".join(json.dumps({"session": s, "events": [{"aid": a, "ts": t, "type": k} for a, t, k in es]}) + "\n" for s, es in rows))


def test_full_run_twice(spark, tmp_path):
    cycle = [(20, "clicks"), (30, "carts"), (40, "orders")]
    _jsonl(tmp_path / "train.jsonl", [(s, [(cycle[k % 3][0], 100 + 50 * k + s, cycle[k % 3][1]) for k in range(9)]) for s in range(1, 5)])
    _jsonl(tmp_path / "test.jsonl", [(100, [(20, 1000, "clicks")])])
    (tmp_path / "sample.csv").write_text("session_type,labels\n" + "".join(f"100_{t},1\n" for t in schemas.TYPES))
    cfg = config.Config(validation={"strategy": "legacy_global_cutoff", "training_cutoff_timestamp_ms": 250, "cutoff_timestamp_ms": 350, "enforce_quality_gate": False}, ranking={"rounds": 1, "max_depth": 2})
    run = lambda: pipeline.run_full(spark, str(tmp_path / "train.jsonl"), str(tmp_path / "test.jsonl"), str(tmp_path / "sample.csv"), str(tmp_path / "out"), cfg)
    first = run()
    lines = spark.read.text(first["submission"]).collect()
    assert [r["value"].split(",")[0] for r in lines] == ["session_type", "100_clicks", "100_carts", "100_orders"]
    second = run()
    assert second["made"] == [] and "submission" in second["stages_reused"]
    assert spark.read.text(second["submission"]).collect() == lines
    report = json.loads((tmp_path / "out/validation/evaluation/candidates.json").read_text())
    assert {r["type"] for r in report["rules"]} == set(schemas.TYPES) and report["cutoffs"] and report["sources"]
    assert "weighted_recall_at_20" in json.loads((tmp_path / "out/validation/rankers/metrics.json").read_text())
    _jsonl(tmp_path / "train.jsonl", [(1, [(20, 100, "clicks"), (30, 300, "orders"), (20, 400, "clicks")])])
    with pytest.raises(ValueError):  # another input under the same name
        run()


def test_stream_appends_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _jsonl(tmp_path / "in" / "a.json", [(1, [(10, 100, "clicks"), (11, 200, "orders")])])
    query = ingest.append_events(ingest.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()
    assert [(r["session"], r["aid"], r["type"]) for r in got] == [(1, 10, "clicks"), (1, 11, "orders")]


def test_cli_checks_a_configuration(tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("validation:\n  days: 2\n")
    assert cli.main(["check-config", str(tmp_path / "c.yaml")]) == 0
    assert json.loads(capsys.readouterr().out)["validation"]["days"] == 2


def test_every_oracle_has_a_query():
    from cartwheel.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_ranker_query_plans_stay_small_and_lists_whole(spark):
    d, store = "/root/testdata/sf0.001", spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    got = __spark_entry__.queries()["ranker_score_top20"](spark, d).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = store.executionsList(first, 1000)
    # Trained on persisted tables, a plan held all tables below it for each time that it read them.
    assert max(store.planGraph(made.apply(i).executionId()).allNodes().size() for i in range(made.size())) < 400
    lists, found = {}, {}
    for r in __spark_entry__.queries()["feature_matrix"](spark, d).select("session", "target", "aid").collect():
        lists.setdefault((r["session"], r["target"]), set()).add(r["aid"])
    for r in got:
        found.setdefault((r["session"], r["target"]), {})[r["aid"]] = r["rank"]
    assert found.keys() == lists.keys() and lists
    for key, ranks in found.items():
        assert ranks.keys() <= lists[key] and sorted(ranks.values()) == list(range(1, min(20, len(lists[key])) + 1))
