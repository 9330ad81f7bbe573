"""Co-visitation, candidates, features, metrics and submission by hand-computed cases."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_sessions import events

from cartwheel import schemas
from cartwheel.operators import candidates as cand
from cartwheel.operators import covisit, features, matrix_store, metrics, sampling, sequences, submission, vectors
from cartwheel.operators.popularity import popularity

T0 = 1_659_304_800_000


def matrix_of(spark, **rows):
    """Matrices from name=[(source, target, rank)]."""
    return {n: spark.createDataFrame([(s, t, 1.0, r) for s, t, r in v], "source_aid int, target_aid int, weight double, rank long") for n, v in rows.items()}


def popular(spark, *aids):
    return spark.createDataFrame([(t, a, r + 1) for t in schemas.TYPES for r, a in enumerate(aids)], "target string, aid int, rank long")


def ranked(df):
    return [r["aid"] for r in df.orderBy("candidate_rank").collect()]


def test_public_pairs(spark):
    own = covisit.indexed(events(spark, (1, 10, T0, "C"), (1, 20, T0 + 1000, "A"), (1, 20, T0 + 2000, "A"), (1, 30, T0 + 3000, "O")))
    by = {r.name: covisit.pairs(own, r) for r in covisit.PUBLIC}
    found = {n: sorted((r["source_aid"], r["target_aid"], r["w"] / 1e9) for r in df.collect()) for n, df in by.items()}
    assert [x[:2] for x in found["clicks_all_to_all"]] == [(10, 20), (10, 30), (20, 10), (20, 30), (30, 10), (30, 20)]
    assert found["clicks_all_to_all"][0][2] == 1.0 < found["clicks_all_to_all"][-1][2]
    assert found["carts_orders"] == [(10, 20, 6.0), (10, 30, 3.0), (20, 30, 3.0), (30, 20, 6.0)]
    assert found["buy_to_buy"] == [(20, 30, 1.0), (30, 20, 1.0)]


def test_matrix_by_hand(spark):
    own = events(spark, (1, 10, 100, "C"), (1, 20, 200, "C"), (1, 30, 300, "O"), (2, 10, 400, "C"), (2, 20, 500, "C"))
    got = covisit.matrix(own, covisit.Rule("r", reach=29, forward=True), 2, None).collect()
    assert sorted((r["source_aid"], r["target_aid"], r["weight"], r["rank"]) for r in got) == [(10, 20, 2.0, 1), (10, 30, 1.0, 2), (20, 30, 1.0, 1)]


@pytest.mark.parametrize("rule", [covisit.Rule("a", reach=2), covisit.Rule("b", reach=3, forward=True, once=True), covisit.Rule("c", reach=29, once=True, target_weights={"carts": 6.0}), covisit.Rule("d", reach=5, half_life=2.0)])
def test_pairs_equal_nested_loops_on_unsorted_and_tied_times(spark, rule):
    rng = random.Random(4)
    rows = [(s, rng.randint(1, 6), rng.randint(0, 12) * 500, rng.choice("CAO")) for s in range(6) for _ in range(rng.randint(1, 14))]
    got = {(r["source_aid"], r["target_aid"]): r["w"] for r in covisit.pairs(covisit.indexed(events(spark, *rows)), rule).groupBy("source_aid", "target_aid").sum("w").withColumnRenamed("sum(w)", "w").collect()}
    want: dict = {}
    kinds = {"C": "clicks", "A": "carts", "O": "orders"}
    for s in range(6):
        own = [(t, p, a, kinds[k]) for p, (x, a, t, k) in enumerate(rows) if x == s]
        own.sort(key=lambda e: e[:2])
        seen = set()
        for i, j in itertools.product(range(len(own)), repeat=2):
            (t1, _, a, _), (t2, _, b, k) = own[i], own[j]
            near = i < j <= i + rule.reach if rule.forward else 0 < abs(i - j) <= rule.reach
            if not near or a == b or abs(t1 - t2) > rule.seconds * 1000 or (rule.once and (a, b) in seen):
                continue
            seen.add((a, b))
            w = rule.target_weights.get(k, 1.0) * (0.5 ** (abs(t2 - t1) / 1000 / rule.half_life) if rule.half_life else 1.0)
            want[a, b] = want.get((a, b), 0) + int(w * 1e9 + 0.5)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 2 for k in want)


def test_unknown_profile():
    with pytest.raises(ValueError):
        covisit.rules("other")


def test_fusion(spark):
    rows = spark.createDataFrame([(1, 1, "history", 1.0, 1), (1, 1, "covisit", 2.0, 2), (1, 2, "popular", 0.1, 1)], "session long, aid int, source string, score double, rank long")
    got = cand.fuse(rows, 1).collect()
    assert [r["aid"] for r in got] == [1]
    assert [(e["source"], e["score"], e["rank"]) for e in got[0]["evidence"]] == [("covisit", 2.0, 2), ("history", 1.0, 1)]
    with pytest.raises(ValueError):
        cand.fuse(rows, 0)


def test_public_order(spark):
    own = events(spark, (1, 10, 0, "C"), (1, 20, 1, "C"))
    matrices = matrix_of(spark, clicks_all_to_all=[(10, 30, 1), (10, 50, 2), (20, 30, 1), (20, 50, 2)])
    got = cand.candidates(own, matrices, popular(spark, 40), "clicks", 5)
    assert ranked(got) == [20, 10, 30, 50, 40]
    assert [r["score"] for r in got.orderBy("candidate_rank").collect()][0] == pytest.approx(5 + 1 / 61)


def test_legacy_sources_and_budgets(spark):
    own = events(spark, (1, 10, 0, "C"))
    matrices = matrix_of(spark, adjacent_clicks=[(10, 20, 1)], time_decay=[(10, 30, 1)], all_to_buy=[(10, 40, 1)], buy_to_buy=[(10, 50, 1)], recent_trend=[(10, 60, 1)])
    assert set(ranked(cand.candidates(own, matrices, popular(spark), "clicks", 10))) == {10, 20, 30}
    assert set(ranked(cand.candidates(own, matrices, popular(spark), "orders", 10))) == {10, 30, 40, 50, 60}
    two = matrix_of(spark, adjacent_clicks=[(10, 20, 1), (10, 21, 2)], time_decay=[(10, 30, 1), (10, 31, 2)])
    assert set(ranked(cand.candidates(own, two, popular(spark), "clicks", 10, history_budget=0, covisit_budget=2))) == {20, 30}


def test_legacy_order_decides_who_gets_the_remainder(spark):
    assert cand.LEGACY_SEEDS["orders"] == ("carts_orders", "buy_to_buy", "time_decay", "all_to_buy", "recent_trend")
    own = events(spark, (1, 10, 0, "C"))
    near = lambda base: [(10, base + k, k + 1) for k in range(60)]
    names = ("carts_orders", "buy_to_buy", "time_decay", "all_to_buy", "recent_trend")
    for given, budget in ((names[1:], 181), (names, 182)):
        matrices = matrix_of(spark, **{n: near(100 * (k + 1)) for k, n in enumerate(given)})
        rows = cand.legacy_inputs(own, matrices, popular(spark), ("orders",), covisit_budget=budget)
        counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
        assert counts == {"history": 1, **{n: q for n, q in zip(given, cand.quotas(budget, len(given)), strict=True)}}
        assert counts[given[0]] == budget // len(given) + 1


@pytest.mark.parametrize("given", ["clicks_all_to_all", "adjacent_clicks"])
def test_targets_without_a_matrix_keep_history_and_popularity(spark, given):
    own = events(spark, (1, 10, 0, "C"))
    matrices = matrix_of(spark, **{given: [(10, 20, 1)]})
    assert set(ranked(cand.candidates(own, matrices, popular(spark, 40), "carts", 10))) == {10, 40}
    assert set(ranked(cand.candidates(own, matrices, popular(spark, 40), "clicks", 10))) == {10, 20, 40}


def test_whole_sessions_and_blocks_make_the_same_pairs(spark):
    rng = random.Random(9)
    own = covisit.indexed(events(spark, *[(s, rng.randint(1, 9), rng.randint(0, 40) * 500, rng.choice("CAO")) for s in range(5) for _ in range(30)]))
    for rule in (*covisit.PUBLIC, *covisit.LEGACY):
        each = [sorted(tuple(sorted(r.asDict().items())) for r in covisit.pairs(own, rule, n).collect()) for n in (30, None)]
        assert each[0] == each[1] and each[0]


def test_negatives_are_drawn_at_their_rate(spark):
    rows = spark.range(200_000).selectExpr("id div 100 AS session", "cast(id % 100 AS int) AS aid", "0 AS label")
    for rate in (0.05, 0.25, 0.4):
        got = sampling.sample_negatives(rows, rate).count() / 200_000
        assert abs(got - rate) < 4 * (rate * (1 - rate) / 200_000) ** 0.5
    few = sampling.sample_negatives(rows, 0.25).groupBy("session").count().agg({"count": "stddev"}).first()[0]
    assert 3.5 < few < 5.2  # like independent draws of 100 at 0.25: 4.33


def test_query_tiles_equal_the_broadcast(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    a, b = (sorted(tuple(r) for r in vectors.nearest(rows, asked, 4, limit).collect()) for limit in (1 << 20, 100))
    assert a == b and len(a) == 48


def test_trained_quantizer_equals_plain_k_means(spark):
    rng = random.Random(3)
    points = [[rng.random() for _ in range(3)] for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<double>")
    books = vectors.train_quantizer(rows, levels=2, clusters=4, iterations=3)
    gap = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c, strict=True))
    left = points
    for level, book in enumerate(books):
        order = [r["vec_id"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(2026 + level)), "vec_id").limit(4).collect()]
        plain = [left[i] for i in order]
        for _ in range(3):
            code = [min(range(4), key=lambda k: (gap(x, plain[k]), k)) for x in left]
            for k in set(code):
                own = [x for x, c in zip(left, code, strict=True) if c == k]
                plain[k] = [sum(d) / len(own) for d in zip(*own, strict=True)]
        assert all(a == pytest.approx(b) for a, b in zip(book, plain, strict=True))
        code = [min(range(4), key=lambda k: (gap(x, book[k]), k)) for x in left]
        left = [[p - q for p, q in zip(x, book[c], strict=True)] for x, c in zip(left, code, strict=True)]
        if level == 1:
            got = {r["vec_id"]: r["codes"][1] for r in vectors.encode(rows, books).collect()}
            assert got == dict(enumerate(code))


def test_matrix_store_looks_items_up(spark):
    matrix = spark.createDataFrame([(10, 20, 2.0, 1), (10, 30, 1.0, 2), (20, 30, 1.0, 1)], "source_aid int, target_aid int, weight double, rank long")
    spark.sql("DROP TABLE IF EXISTS test_store")
    assert matrix_store.build(matrix, "test_store", 4) == {"partitions": 4, "source_aids": 2, "neighbors": 3}
    assert matrix_store.neighbours(spark, "test_store", 10) == [(20, 2.0, 1), (30, 1.0, 2)]
    assert matrix_store.neighbours(spark, "test_store", 999) == []
    assert matrix_store.lookup(spark, "test_store", spark.createDataFrame([(20,), (20,), (7,)], "aid int")).count() == 1
    with pytest.raises(ValueError):
        matrix_store.build(matrix, "test_store", 4)
    spark.sql("DROP TABLE test_store")


def test_retriever_contract(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])], "aid int, item_vector array<double>")
    own = sequences.prepare(events(spark, (1, 1, 0, "C"), (1, 1, 1, "C"), (2, 2, 0, "C"), (2, 1, 1, "C")), 4)
    model = sequences.MeanRetriever(items)
    got = {(r["session"], r["rank"]): (r["aid"], round(r["score"], 6)) for r in sequences.retrieve(model, own, "clicks", 2).collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (3, 0.707107), (2, 1): (3, 1.0), (2, 2): (1, 0.707107)}
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "session long, aid int")
    assert {r["session"]: round(r["score"], 6) for r in sequences.score(model.encode(own, "clicks"), pairs, model.item_vectors()).collect()} == {1: 0.0, 2: 1.0}


def test_baseline(spark):
    own = events(spark, (1, 1, 0, "C"))
    near = spark.createDataFrame([(1, 2, 4.0, 1)], "source_aid int, target_aid int, weight double, rank long")
    assert set(ranked(cand.fuse(cand.baseline_inputs(own, near, popular(spark, 3)), 3))) == {1, 2, 3}


def test_popularity_fills_up(spark):
    own = events(spark, (1, 10, 1, "C"), (1, 10, 2, "C"), (1, 11, 3, "C"), (2, 12, 4, "O"))
    got = {t: [r["aid"] for r in popularity(own, 2).where(f"target = '{t}'").orderBy("rank").collect()] for t in schemas.TYPES}
    assert got == {"clicks": [10, 11], "carts": [10, 11], "orders": [12, 10]}


def test_features_labels_and_retention(spark):
    own = events(spark, (1, 10, 100, "C"), (1, 10, 200, "A"))
    fused = cand.fuse(spark.createDataFrame([(1, 10, "history", 2.0, 1), (1, 11, "popularity", 0.1, 2)], "session long, aid int, source string, score double, rank long"), 5)
    labels = spark.createDataFrame([(1, "orders", 11)], schemas.LABELS)
    rows = features.retain(features.label(fused, labels, "orders"), 1)
    got = {r["aid"]: r for r in features.build(rows, own).collect()}
    assert got[10]["aid_frequency"] == 2 and got[10]["aid_clicks_count"] == 1 and got[10]["aid_carts_count"] == 1
    assert got[10]["aid_recency_events"] == 0 and got[10]["source_history_score"] == 2.0 and got[10]["source_all_to_buy_present"] == 0
    assert got[11]["label"] == 1 and got[11]["candidate_rank"] == 2 and got[11]["aid_recency_events"] == 2 and got[11]["aid_time_recency_ms"] == 100
    assert len(features.feature_names(features.build(rows, own))) == 48
    with pytest.raises(ValueError):
        features.check_contract(features.build(rows, own), ["other"])


def test_weighted_recall(spark):
    truth = spark.createDataFrame([(1, "clicks", 10), (1, "carts", 20), (1, "carts", 21), (1, "orders", 30), (1, "orders", 31), (2, "orders", 40)], schemas.LABELS)
    top = spark.createDataFrame([(1, "clicks", 10, 1), (1, "clicks", 10, 2), (1, "carts", 20, 1), (1, "orders", 30, 1), (1, "orders", 999, 2), (2, "orders", 999, 1)], "session long, type string, aid int, rank long")
    got = {r["type"]: r["recall"] for r in metrics.recall(top, truth).collect()}
    assert got == {"clicks": 1.0, "carts": 0.5, "orders": pytest.approx(1 / 3)}
    assert metrics.recall(top, truth).selectExpr("sum(weighted) w").first()["w"] == pytest.approx(0.45)
    with pytest.raises(ValueError):
        metrics.recall(top, truth, 21)


def test_sampling_is_repeatable(spark):
    rows = spark.createDataFrame([(s, "clicks", a, int(a == 1), a) for s in range(10) for a in (1, 2)], "session long, target string, aid int, label int, candidate_rank long")
    take = lambda seed: sorted(tuple(r) for r in sampling.read_target(rows, "clicks", 2, 3, rate=0.01, seed=seed).collect())
    assert take(7) == take(7) and {r[0] for r in take(7)} != {r[0] for r in take(8)}
    assert len({r[0] for r in take(7) if r[3]}) == 3
    assert sampling.refit_union([rows, rows], "clicks", 2, None).select("query_group").distinct().count() == 20


def test_submission(spark):
    queries = spark.createDataFrame([(10, t) for t in schemas.TYPES], "session long, target string")
    top = spark.createDataFrame([(10, "clicks", 1, 1), (10, "clicks", 1, 2), (10, "clicks", 2, 3)], "session long, target string, aid int, rank long")
    got = {r["session_type"]: r["labels"] for r in submission.submission(queries, top, popular(spark, 2, 3)).collect()}
    assert got == {"10_clicks": "1 2 3", "10_carts": "2 3", "10_orders": "2 3"}
    with pytest.raises(Exception, match="no labels"):
        submission.submission(queries, top, popular(spark)).collect()
    with pytest.raises(ValueError):
        submission.read_queries(spark.createDataFrame([("10_clicks", "1")], "session_type string, labels string"))


def test_rules_predictions(spark):
    rows = spark.createDataFrame([(10, "clicks", 100 + r, r) for r in range(1, 22)], "session long, target string, aid int, candidate_rank long")
    got = submission.rules_predictions(rows).orderBy("rank").collect()
    assert [r["aid"] for r in got] == list(range(101, 121))


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [0.9, 0.1])], "query_id long, embedding array<float>")
    assert [r["vec_id"] for r in vectors.nearest(rows, asked, 2).orderBy("rank").collect()] == [0, 1]
    four = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [1.0, 1.0]), (3, [0.9, 1.0])], "vec_id long, embedding array<float>")
    books = [vectors.train_quantizer(four, 2, 2, 3) for _ in range(2)]
    assert books[0] == books[1]
    codes = {r["vec_id"]: r["codes"][0] for r in vectors.encode(four, books[0]).collect()}
    assert codes[0] == codes[1] != codes[2] == codes[3]
    with pytest.raises(ValueError):
        vectors.train_quantizer(four, 1, 5)
