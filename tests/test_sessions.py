"""Ingest, order and splits on small sessions with hand-computed results."""

from __future__ import annotations

import json
import random

import pytest

from cartwheel import schemas
from cartwheel.operators import order, split
from cartwheel.sources import sessions

KIND = {"C": "clicks", "A": "carts", "O": "orders"}


def events(spark, *rows):
    """(session, aid, ts, kind) in file order."""
    return spark.createDataFrame([(s, a, t, KIND[k], i) for i, (s, a, t, k) in enumerate(rows)], schemas.EVENTS)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def write_json(tmp_path, *rows):
    path = tmp_path / "sessions.jsonl"
    path.write_text("".join(json.dumps({"session": s, "events": [{"aid": a, "ts": t, "type": k} for a, t, k in es]}) + "\n" for s, es in rows))
    return str(path)


def test_ingest_counts_order_and_limit(spark, tmp_path):
    path = write_json(tmp_path, (7, [(1, 100, "clicks"), (2, 200, "carts")]), (8, []), (9, [(3, 300, "orders")]))
    raw = sessions.read_sessions(spark, path)
    assert sessions.counts(raw).first().asDict() == {"sessions": 3, "events": 3}
    flat = sessions.flatten(raw).orderBy("pos").collect()
    assert [r["aid"] for r in flat] == [1, 2, 3]
    first = sessions.read_sessions(spark, path, 2)
    assert sessions.counts(first).first().asDict() == {"sessions": 2, "events": 2}


def test_lines_follow_file_names_and_places(spark, tmp_path):
    rng, want = random.Random(1), []
    for k in range(13):
        rows = [(100 * k + i, [{"aid": len(want) + i, "ts": 1, "type": "clicks"}]) for i in range(rng.randint(1, 60))]
        (tmp_path / f"part-{k:02d}.jsonl").write_text("".join(json.dumps({"session": s, "events": e}) + "\n" for s, e in rows))
        want += [e[0]["aid"] for _, e in rows]
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        raw = sessions.read_sessions(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 13
        assert [r["line"] for r in raw.orderBy("line").collect()] == list(range(len(want)))
        assert [r["aid"] for r in sessions.flatten(raw).orderBy("pos").collect()] == want
        assert sorted(r["session"] for r in sessions.read_sessions(spark, str(tmp_path), 20).collect()) == sorted(r["session"] for r in raw.orderBy("line").limit(20).collect())
        twice = sessions.concatenate(sessions.flatten(raw), sessions.flatten(raw))
        assert [r["aid"] for r in twice.orderBy("pos").collect()] == want + want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_unknown_type_and_malformed_line_raise(spark, tmp_path):
    path = write_json(tmp_path, (7, [(1, 100, "views")]))
    with pytest.raises(Exception, match="unknown event type"):
        sessions.flatten(sessions.read_sessions(spark, path)).collect()
    (tmp_path / "bad.jsonl").write_text('{"session": 1, "events": [{"aid": 99999999999, "ts": 1, "type": "clicks"}]}\n')
    with pytest.raises(Exception):
        sessions.flatten(sessions.read_sessions(spark, str(tmp_path / "bad.jsonl"))).collect()


def test_union_keeps_table_order(spark):
    both = sessions.concatenate(events(spark, (1, 10, 100, "C")), events(spark, (2, 20, 200, "A")))
    assert [(r["session"], r["aid"]) for r in both.orderBy("pos").collect()] == [(1, 10), (2, 20)]


def test_nest_is_the_inverse_of_flatten(spark):
    own = events(spark, (1, 10, 300, "C"), (1, 11, 100, "A"), (2, 12, 50, "O"))
    nested = {r["session"]: [e["aid"] for e in r["events"]] for r in sessions.nest(own).collect()}
    assert nested == {1: [10, 11], 2: [12]}


def test_time_order_breaks_ties_by_place_and_tail_follows_the_file(spark):
    own = events(spark, (1, 10, 200, "C"), (1, 11, 100, "C"), (1, 12, 100, "C"))
    assert [r["aid"] for r in order.indexed(own).orderBy("i").collect()] == [11, 12, 10]
    assert pairs(order.tail(own, 2), "aid") == [(11,), (12,)]
    assert {r["aid"]: r["rank"] for r in order.recency(own).collect()} == {10: 1, 12: 2, 11: 3}


def test_global_split(spark):
    own = events(spark, (1, 10, 100, "C"), (1, 20, 300, "C"), (1, 21, 400, "C"), (1, 30, 500, "O"), (1, 30, 600, "O"))
    context, labels = split.split_global(own, 250)
    assert pairs(context, "aid") == [(10,)]
    assert pairs(labels, "type", "aid") == [("clicks", 20), ("orders", 30)]
    assert pairs(split.split_global(own, 250, 450)[1], "type", "aid") == [("clicks", 20)]
    with pytest.raises(ValueError):
        split.split_global(own, 250, 250)


def test_official_split_at_a_length(spark):
    from pyspark.sql import functions as F

    own = events(spark, (1, 10, 100, "C"), (1, 20, 200, "A"), (1, 30, 300, "C"), (1, 20, 400, "A"), (1, 40, 500, "O"), (1, 40, 600, "O"))
    context, labels = split.split_at(own, F.lit(2))
    assert pairs(context, "aid") == [(10,), (20,)]
    assert pairs(labels, "type", "aid") == [("carts", 20), ("clicks", 30), ("orders", 40)]
    short = events(spark, (1, 10, 100, "C"), (1, 20, 200, "A"))
    with pytest.raises(Exception, match="between 1 and 1"):
        split.split_at(short, F.lit(2))[0].collect()


def test_official_view_drops_unknown_items(spark):
    own = events(spark, (1, 10, 10, "C"), (1, 20, 20, "A"), (1, 30, 120, "O"), (2, 10, 110, "C"), (2, 999, 120, "C"), (2, 20, 130, "A"), (3, 10, 210, "C"), (3, 20, 220, "O"))
    view = split.official_view(own, 100, 200)
    assert {r["session"] for r in view.query_contexts.collect()} == {2}
    assert {r["session"] for r in view.matrix_events.collect()} == {1, 2}
    assert {r["session"] for r in view.labels.collect()} == {2}
    assert 999 not in {r["aid"] for r in view.matrix_events.collect()} | {r["aid"] for r in view.labels.collect()}


def test_global_view_needs_context_and_label(spark):
    own = events(spark, (1, 10, 100, "C"), (1, 20, 300, "C"), (1, 21, 400, "C"), (1, 30, 500, "O"), (2, 11, 150, "C"))
    view = split.global_view(own, 250, 450)
    assert {r["session"] for r in view.matrix_events.collect()} == {1, 2}
    assert pairs(view.query_contexts, "session", "aid", "ts") == [(1, 10, 100)]
    assert pairs(view.labels, "session", "type", "aid") == [(1, "clicks", 20)]


def test_empty_events(spark):
    empty = spark.createDataFrame([], schemas.EVENTS)
    with pytest.raises(ValueError):
        split.max_ts(empty)
    assert split.split_global(empty, 5)[1].count() == 0
