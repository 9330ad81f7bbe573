"""DuckDB SQL for the catalog's queries, put together from named common table expressions."""

from __future__ import annotations

import re

DAYS7 = 7 * 86_400_000


def _event_source(session: str) -> str:
    return f"""SELECT {session} AS session, CAST(json_extract(props, '$.k') AS INTEGER) AS aid, epoch_us(ts) // 1000 AS ts,
  CASE event_type WHEN 'signup' THEN 'carts' WHEN 'purchase' THEN 'orders' ELSE 'clicks' END AS type, event_id AS pos
  FROM events WHERE event_type <> 'error'"""


def _fx(x: str, unit: str = "1e12") -> str:
    return f"CAST(floor(({x}) * {unit} + 0.5) AS BIGINT)"


def _hash(key: str, seed: int) -> str:
    a = f"((({key}) % 2147483647) * 1103515245 + {12345 + seed * 1_013_904_223}) % 2147483648"
    turn = lambda x, n: f"list_transform([{x}], lambda h: xor(h, h >> {n}) * 73244475 % 2147483648)[1]"
    last = turn(turn(a, 16), 15)
    return f"list_transform([{last}], lambda h: xor(h, h >> 16))[1]"


def _pairs(own: str, sources: str, targets: str, reach: int, seconds: int, weight: str = "1.0", forward: bool = False) -> str:
    near = f"b.i > a.i AND b.i <= a.i + {reach}" if forward else f"a.i <> b.i AND abs(a.i - b.i) <= {reach}"
    return f"""SELECT a.session, a.aid AS s, b.aid AS t, a.i, b.i AS j, {_fx(weight, '1e9')} AS w FROM {own} a JOIN {own} b
  ON a.session = b.session AND a.aid <> b.aid AND {near} AND abs(b.ts - a.ts) <= {seconds} * 1000
  AND a.type IN ({sources}) AND b.type IN ({targets})"""


def _once(pairs: str) -> str:
    return f"SELECT session, s, t, arg_min(w, i * 1000000 + j) AS w FROM ({pairs}) GROUP BY session, s, t"


def _top(pairs: str, k: int = 20) -> str:
    return f"""SELECT s AS source_aid, t AS target_aid, sum(w)::BIGINT / 1e9 AS weight, row_number() OVER (PARTITION BY s ORDER BY sum(w) DESC, t) AS rank
  FROM ({pairs}) GROUP BY s, t QUALIFY rank <= {k}"""


ALL, BUY, CLICK = "'clicks', 'carts', 'orders'", "'carts', 'orders'", "'clicks'"
DECAY = "pow(0.5, abs(b.ts - a.ts) / 1000.0 / {})"


def _ramp(begin: str, end: str) -> str:
    return f"1.0 + 3.0 * least(1.0, greatest(0.0, (a.ts / 1000.0 - {begin}) / ({end} - {begin})))"


def rule_pairs(name: str, own: str) -> str:
    return {
        "clicks_all_to_all": _once(_pairs(own, ALL, ALL, 29, 86400, _ramp("1659304800.0", "1662328791.0"))),
        "carts_orders": _once(_pairs(own, ALL, BUY, 29, 86400, "CASE b.type WHEN 'carts' THEN 6.0 ELSE 3.0 END")),
        "buy_to_buy": _once(_pairs(own, BUY, BUY, 29, 1209600)),
        "adjacent_clicks": _pairs(own, CLICK, CLICK, 1, 86400, forward=True),
        "time_decay": _pairs(own, ALL, ALL, 6, 86400, DECAY.format(3600.0)),
        "all_to_buy": _pairs(own, ALL, BUY, 6, 7200, DECAY.format(3600.0), True),
        "legacy_buy_to_buy": _pairs(own, BUY, BUY, 3, 86400, DECAY.format(7200.0)),
        "recent_trend": _pairs(own, ALL, BUY, 3, 86400, DECAY.format(1800.0), True),
        "clicks_ramp_2024": _once(_pairs(own, ALL, ALL, 29, 86400, _ramp("1704067200.0", "1706659200.0"))),
    }[name]


RULES = ("clicks_all_to_all", "carts_orders", "buy_to_buy", "adjacent_clicks", "time_decay", "all_to_buy", "legacy_buy_to_buy", "recent_trend")


def _lengths(source: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, pos) - 1 AS i FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) <= 30)"


CTES: dict[str, str] = {
    "x_ev": _event_source("user_id * 100 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3"),
    "x_user": _event_source("user_id"),
    "x_retail": """SELECT o_custkey AS session, CAST(l_partkey AS INTEGER) AS aid, epoch_us(l_shipdate) // 1000 AS ts,
  CASE l_returnflag WHEN 'A' THEN 'clicks' WHEN 'N' THEN 'carts' ELSE 'orders' END AS type,
  row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) // 1000,
    CASE l_returnflag WHEN 'A' THEN 'clicks' WHEN 'N' THEN 'carts' ELSE 'orders' END) AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "x_cut": f"SELECT max(ts) - {DAYS7} AS c, max(ts) AS e FROM x_ev",
    "x_first": "SELECT session, arg_min(ts, pos) AS f FROM x_ev GROUP BY session",
    "x_train": "SELECT x_ev.* FROM x_ev JOIN x_first USING (session), x_cut WHERE f <= c AND ts < c QUALIFY count(*) OVER (PARTITION BY session) >= 2",
    "x_known": "SELECT DISTINCT aid FROM x_train",
    "x_qev": """SELECT x_ev.*, row_number() OVER (PARTITION BY session ORDER BY ts, pos) - 1 AS i, count(*) OVER (PARTITION BY session) AS n
  FROM x_ev JOIN x_first USING (session), x_cut WHERE f > c AND f <= e AND aid IN (SELECT aid FROM x_known) QUALIFY n >= 2""",
    "x_qk": f"SELECT *, 1 + ({_hash('session', 42)}) % (n - 1) AS k FROM x_qev",
    "x_ctx": "SELECT session, aid, ts, type, pos FROM x_qk WHERE i < k",
    "x_lab": """SELECT session, 'clicks' AS type, arg_min(aid, i) AS aid FROM x_qk WHERE i >= k AND type = 'clicks' GROUP BY session
  UNION ALL SELECT DISTINCT session, type, aid FROM x_qk WHERE i >= k AND type <> 'clicks'""",
    "x_mev": "SELECT session, aid, ts, type, pos FROM x_train UNION ALL SELECT * FROM x_ctx",
    "x_glab": """SELECT session, 'clicks' AS type, arg_min(aid, ts * 1000000 + pos % 1000000) AS aid FROM x_ev, x_cut WHERE ts >= c AND type = 'clicks' GROUP BY session
  UNION ALL SELECT DISTINCT session, type, aid FROM x_ev, x_cut WHERE ts >= c AND type <> 'clicks'""",
    "x_evix": _lengths("x_ev"),
    "x_userix": _lengths("x_user"),
    "x_retailix": _lengths("x_retail"),
    "x_ix": _lengths("x_mev"),
    **{f"x_m_{r}": _top(rule_pairs(r, "x_ix")) for r in RULES},
    "x_typen": "SELECT type, aid, count(*) AS n FROM x_mev GROUP BY type, aid",
    "x_targets": "SELECT unnest(['clicks', 'carts', 'orders']) AS target",
    "x_popraw": """SELECT type AS target, aid, 0 AS tier, row_number() OVER (PARTITION BY type ORDER BY n DESC, aid) AS r FROM x_typen
  UNION ALL SELECT target, aid, 1 AS tier, row_number() OVER (PARTITION BY target ORDER BY sn DESC, aid) AS r
  FROM (SELECT aid, sum(n) AS sn FROM x_typen GROUP BY aid), x_targets""",
    "x_pop": """SELECT target, aid, row_number() OVER (PARTITION BY target ORDER BY o) AS rank
  FROM (SELECT target, aid, min(tier * 1000000 + r) AS o FROM x_popraw GROUP BY target, aid) QUALIFY rank <= 40""",
    "x_cx": "SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, pos) - 1 AS i, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS fi, count(*) OVER (PARTITION BY session) AS n FROM x_ctx",
    "x_rec": "SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY max(i) DESC) AS r FROM x_cx GROUP BY session, aid",
    "x_frec": "SELECT session, aid, count(*) AS f, row_number() OVER (PARTITION BY session ORDER BY max(fi) DESC) AS r FROM x_cx GROUP BY session, aid",
    "x_brec": "SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY max(i) DESC) AS r FROM x_cx WHERE type <> 'clicks' GROUP BY session, aid",
    "x_sess": "SELECT DISTINCT session FROM x_ctx",
}


def _history(source: str, start: float) -> str:
    """Ranks of history items: recency, or the weighted score for 20 items and more."""
    weight = "CASE type WHEN 'clicks' THEN 1.0 WHEN 'carts' THEN 6.0 ELSE 3.0 END"
    term = _fx(f"(pow(2.0, {start} + {1 - start} * i / greatest(1, n - 1)) - 1) * {weight}")
    return f"""SELECT session, aid, CASE WHEN count(*) OVER (PARTITION BY session) >= 20
    THEN row_number() OVER (PARTITION BY session ORDER BY s DESC, first, aid)
    ELSE row_number() OVER (PARTITION BY session ORDER BY last DESC) END AS rank
  FROM (SELECT session, aid, sum({term}) AS s, min(i) AS first, max(i) AS last FROM {source} GROUP BY session, aid)"""


def _public(target: str) -> dict[str, str]:
    p = f"x_p{target}"
    start = 0.1 if target == "clicks" else 0.5
    seeds = [("clicks_all_to_all", "x_rec")] if target == "clicks" else [("buy_to_buy", "x_brec"), ("carts_orders", "x_rec")]
    votes = " UNION ALL ".join(f"SELECT session, target_aid AS aid, '{m}' AS source, {k} AS src, {k} * 1000000000000 + r * 1000000 + rank AS first FROM {seed} JOIN x_m_{m} ON aid = source_aid" for k, (m, seed) in enumerate(seeds))
    return {
        f"{p}_hist": _history("x_cx", start),
        f"{p}_seen": f"SELECT session, aid, source, src, count(*) AS v, min(first) AS first FROM ({votes}) GROUP BY session, aid, source, src",
        f"{p}_near": f"SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY sum(v) DESC, min(first), aid) AS rank FROM {p}_seen GROUP BY session, aid",
        f"{p}_ord": f"""SELECT session, aid, tier, row_number() OVER (PARTITION BY session ORDER BY tier, o) AS r FROM (
    SELECT session, aid, min(tier) AS tier, arg_min(o, tier) AS o FROM (SELECT session, aid, 0 AS tier, rank AS o FROM {p}_hist
      UNION ALL SELECT session, aid, 1, rank FROM {p}_near UNION ALL SELECT session, aid, 2, rank FROM x_sess, x_pop WHERE target = '{target}')
    GROUP BY session, aid) QUALIFY r <= 250""",
        f"{p}_n": f"SELECT session, count(*) AS size FROM {p}_ord GROUP BY session",
        f"{p}_in": f"""SELECT session, aid, CASE tier WHEN 0 THEN 'history' ELSE 'popularity' END AS source, CAST(size - r + 1 AS DOUBLE) AS score, r AS rank FROM {p}_ord JOIN {p}_n USING (session) WHERE tier <> 1
    UNION ALL SELECT session, aid, source, CASE WHEN tier = 1 AND first = min(first) OVER (PARTITION BY session, aid) THEN CAST(size - r + 1 AS DOUBLE) ELSE 0.0 END, r
    FROM {p}_ord JOIN {p}_n USING (session) JOIN {p}_seen USING (session, aid) WHERE tier < 2""",
        f"{p}_cand": _fuse(f"{p}_in", 250),
    }


def _fuse(inputs: str, budget: int) -> str:
    return f"""SELECT session, aid, sum(sc + bonus)::BIGINT / 1e12 AS score, min(rank) AS best_rank, list({{'source': source, 'score': sc / 1e12, 'rank': rank}} ORDER BY source) AS evidence,
    row_number() OVER (PARTITION BY session ORDER BY sum(sc + bonus) DESC, min(rank), aid) AS candidate_rank
  FROM (SELECT session, aid, source, sum({_fx('score')})::BIGINT AS sc, min(rank) AS rank, sum({_fx('1.0 / (60 + rank)')})::BIGINT AS bonus FROM {inputs} GROUP BY session, aid, source)
  GROUP BY session, aid QUALIFY candidate_rank <= {budget}"""


def _legacy(target: str) -> dict[str, str]:
    p = f"x_l{target}"
    names = ["adjacent_clicks", "time_decay"] if target == "clicks" else ["time_decay", "all_to_buy", "legacy_buy_to_buy", "recent_trend"]
    each, over = divmod(180, len(names))
    parts = ["SELECT session, aid, 'history' AS source, CAST(f AS DOUBLE) AS score, r AS rank FROM x_frec WHERE r <= 50"]
    for k, m in enumerate(names):
        parts.append(f"""SELECT * FROM (SELECT session, aid, '{m.removeprefix('legacy_')}' AS source, s / 1e12 AS score, row_number() OVER (PARTITION BY session ORDER BY s DESC, best, aid) AS rank
    FROM (SELECT session, target_aid AS aid, sum({_fx('1.0 / (r * (60 + rank))')})::BIGINT AS s, min(rank) AS best FROM x_frec JOIN x_m_{m} ON aid = source_aid GROUP BY session, target_aid)) WHERE rank <= {each + (k < over)}""")
    parts.append(f"SELECT session, aid, 'popularity', 0.01, rank FROM x_sess, x_pop WHERE target = '{target}'")
    return {f"{p}_in": " UNION ALL ".join(parts), f"{p}_cand": _fuse(f"{p}_in", 250)}


# The window before: the same expressions one week earlier.
_WINDOW = ("x_cut", "x_train", "x_known", "x_qev", "x_qk", "x_ctx", "x_lab")
for _n in _WINDOW:
    CTES[f"{_n}1"] = re.sub(rf"\b({'|'.join(_WINDOW)})\b", r"\g<1>1", CTES[_n])
CTES["x_cut1"] = f"SELECT max(ts) - {2 * DAYS7} AS c, max(ts) - {DAYS7} AS e FROM x_ev"

for _t in ("clicks", "carts", "orders"):
    CTES |= _public(_t) | _legacy(_t)

CTES["x_base_in"] = """SELECT session, aid, 'history' AS source, CAST(f AS DOUBLE) AS score, r AS rank FROM x_frec
  UNION ALL SELECT session, target_aid, 'covisitation', weight / r, rank FROM x_frec JOIN x_m_carts_orders ON aid = source_aid
  UNION ALL SELECT session, aid, 'popularity', 0.01, rank FROM x_sess, x_pop WHERE target = 'clicks'"""
CTES["x_base_cand"] = _fuse("x_base_in", 50)
CTES["x_cand"] = " UNION ALL ".join(f"SELECT session, '{t}' AS target, aid, score, best_rank, evidence, candidate_rank FROM x_p{t}_cand" for t in ("clicks", "carts", "orders"))
CTES["x_rows"] = """SELECT x_cand.*, CASE WHEN x_lab.aid IS NULL THEN 0 ELSE 1 END AS label FROM x_cand LEFT JOIN x_lab
  ON x_cand.session = x_lab.session AND target = x_lab.type AND x_cand.aid = x_lab.aid"""
CTES["x_kept"] = "SELECT * FROM x_rows WHERE candidate_rank <= 120 OR label = 1"
CTES["x_sf"] = """SELECT session, count(*) AS session_length, count(DISTINCT aid) AS session_unique_aids, 1 - count(DISTINCT aid) / count(*) AS session_duplicate_rate,
  arg_max(ts, pos) - arg_min(ts, pos) AS session_duration_ms, CASE WHEN count(*) > 1 THEN (arg_max(ts, pos) - arg_min(ts, pos)) / (count(*) - 1) ELSE 0.0 END AS session_mean_gap_ms,
  coalesce(arg_max(gap, pos), 0) AS session_last_gap_ms, count(*) FILTER (type = 'clicks') AS session_clicks_count, count(*) FILTER (type = 'carts') AS session_carts_count,
  count(*) FILTER (type = 'orders') AS session_orders_count, arg_max(ts, pos) AS session_last_ts
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY session ORDER BY pos) AS gap FROM x_ctx) GROUP BY session"""
CTES["x_af"] = """SELECT session, aid, count(*) AS aid_frequency, min(fi) AS aid_first_position, max(fi) AS aid_last_position, arg_max(ts, fi) AS aid_last_ts,
  count(*) FILTER (type = 'clicks') AS aid_clicks_count, count(*) FILTER (type = 'carts') AS aid_carts_count, count(*) FILTER (type = 'orders') AS aid_orders_count
  FROM x_cx GROUP BY session, aid"""
_SOURCES = ("history", "popularity", "clicks_all_to_all", "carts_orders", "adjacent_clicks", "time_decay", "all_to_buy", "buy_to_buy", "recent_trend")
CTES["x_evid"] = "SELECT session, target, aid, unnest(evidence) AS e FROM x_kept"
CTES["x_piv"] = "SELECT session, target, aid, " + ", ".join(
    f"CAST(coalesce(max(CASE WHEN e.source = '{s}' THEN 1 END), 0) AS INTEGER) AS source_{s}_present, coalesce(max(CASE WHEN e.source = '{s}' THEN e.score END), 0.0) AS source_{s}_score, CAST(coalesce(max(CASE WHEN e.source = '{s}' THEN e.rank END), 0) AS BIGINT) AS source_{s}_rank" for s in _SOURCES
) + " FROM x_evid GROUP BY session, target, aid"
_PIVOT = ", ".join(f"source_{s}_{x}" for s in _SOURCES for x in ("present", "score", "rank"))
CTES["x_feat"] = f"""SELECT k.session, k.target, k.aid, k.label, k.candidate_rank, k.score AS candidate_score, k.best_rank AS candidate_best_rank, CAST(len(k.evidence) AS BIGINT) AS candidate_source_count,
  session_length, session_unique_aids, session_duplicate_rate, session_duration_ms, session_mean_gap_ms, session_last_gap_ms, coalesce(aid_frequency, 0) AS aid_frequency,
  coalesce(session_length - 1 - aid_last_position, session_length) AS aid_recency_events, coalesce(session_last_ts - aid_last_ts, session_duration_ms) AS aid_time_recency_ms,
  coalesce(aid_first_position, session_length) AS aid_first_position, coalesce(aid_last_position, session_length) AS aid_last_position,
  session_clicks_count, session_carts_count, session_orders_count, coalesce(aid_clicks_count, 0) AS aid_clicks_count, coalesce(aid_carts_count, 0) AS aid_carts_count, coalesce(aid_orders_count, 0) AS aid_orders_count, {_PIVOT}
  FROM x_kept k JOIN x_sf ON k.session = x_sf.session LEFT JOIN x_af ON k.session = x_af.session AND k.aid = x_af.aid
  JOIN x_piv ON k.session = x_piv.session AND k.target = x_piv.target AND k.aid = x_piv.aid"""
CTES["x_den"] = """SELECT target, CAST(coalesce(sum(n), 0) AS BIGINT) AS denominator FROM x_targets LEFT JOIN
  (SELECT type, least(count(DISTINCT aid), 20) AS n FROM x_lab GROUP BY session, type) ON type = target GROUP BY target"""
CTES["x_pos"] = "SELECT * FROM x_feat WHERE label > 0"
CTES["x_top"] = "SELECT session, target, aid, candidate_rank AS rank FROM x_kept WHERE candidate_rank <= 20"
CTES["x_subq"] = "SELECT session, target FROM x_sess, x_targets"

# The window before again, for all that comes of its view.
_LATER = [n for n in CTES if n not in {*_WINDOW, *(f"{n}1" for n in _WINDOW)}]
_SHIFTED = set(_WINDOW)
while _MORE := [n for n in _LATER if n not in _SHIFTED and set(re.findall(r"\bx_\w+", CTES[n])) & _SHIFTED]:
    _SHIFTED |= set(_MORE)
for _n in _SHIFTED - set(_WINDOW):
    CTES[f"{_n}1"] = re.sub(rf"\b({'|'.join(sorted(_SHIFTED))})\b", r"\g<1>1", CTES[_n])


def sql(body: str) -> str:
    """``body`` with the expressions that it needs, in order of definition."""
    need: set[str] = set()
    todo = [body]
    while todo:
        for name in set(re.findall(r"\bx_\w+", todo.pop())) & CTES.keys() - need:
            need.add(name)
            todo.append(CTES[name])
    # Used several times, so computed once.
    order: list[str] = []

    def place(name: str) -> None:
        if name not in order:
            for dep in sorted(set(re.findall(r"\bx_\w+", CTES[name])) & CTES.keys()):
                place(dep)
            order.append(name)

    for name in sorted(need):
        place(name)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" if order else "") + body


WEIGHT = "CASE {} WHEN 'clicks' THEN 0.1 WHEN 'carts' THEN 0.3 ELSE 0.6 END"


def queries() -> dict[str, str]:
    share = "CASE WHEN denominator > 0 THEN {} / denominator ELSE 0.0 END"
    sources = " UNION ALL ".join(f"SELECT target, '{s}' AS source, count(*) FILTER (source_{s}_present > 0) AS h, count(*) FILTER (source_{s}_present > 0 AND n_sources = 1) AS m FROM p GROUP BY target" for s in sorted(_SOURCES))
    total = " + ".join(f"source_{s}_present" for s in _SOURCES)
    bucket = "CASE WHEN {0} <= 1 THEN '1' WHEN {0} <= 5 THEN '2-5' WHEN {0} <= 20 THEN '6-20' ELSE '21+' END"
    cosine = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (greatest(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 1e-12) * greatest(sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 1e-12))"
    out = {
        "events_flatten": "SELECT session, aid, ts, type, pos FROM x_ev",
        "events_retail": "SELECT session, aid, ts, type, pos FROM x_retail",
        "ingest_counts": "SELECT count(DISTINCT session) AS sessions, count(*) AS events FROM x_ev",
        "session_prefix_limit": "SELECT session, aid, ts, type, pos FROM x_ev WHERE session IN (SELECT DISTINCT session FROM x_ev ORDER BY session LIMIT 100)",
        "events_union": "SELECT session, aid, ts, type, pos FROM x_ev UNION ALL SELECT session, aid, ts, type, pos + 1 + (SELECT max(pos) FROM x_ev) FROM x_user",
        "events_parquet": "SELECT session, aid, ts, type, pos FROM x_ev",
        "matrix_sink": "SELECT source_aid, target_aid, weight, rank FROM x_m_carts_orders",
        "candidate_parts": "@candidates_labeled_retained",
        "top20_by_score": "SELECT session, target, aid, score, row_number() OVER (PARTITION BY session, target ORDER BY score DESC, aid) AS rank FROM x_kept QUALIFY rank <= 20",
        "group_sizes": "SELECT session, count(*) AS n FROM x_kept WHERE target = 'orders' GROUP BY session",
        "centroid_means": """WITH b AS (SELECT vec_id AS code, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < 8),
            c AS (SELECT CAST(v.embedding AS DOUBLE[]) AS e, (SELECT arg_min(code, list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) FROM b) AS code FROM embeddings v),
            f AS (SELECT code, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS d FROM c)
            SELECT CAST(code AS INTEGER) AS code, CAST(d AS INTEGER) AS d, round(avg(x), 6) AS x FROM f GROUP BY code, d""",
        "gates": """SELECT rules, found, rules >= 0.54 AND found >= 0.62 AS passed, CASE WHEN found - 0.1 >= rules THEN 'validated' ELSE 'rules' END AS strategy
            FROM (SELECT unnest([0.50::DOUBLE, 0.54, 0.60]) AS rules), (SELECT unnest([0.60::DOUBLE, 0.62, 0.70]) AS found)""",
        "smoke": "SELECT 1.0::DOUBLE AS weighted_recall, 9::BIGINT AS submission_rows, 4::BIGINT AS items",
        "validation_report": "@recall_at_20",
        "jsonl_flatten": "SELECT session, aid, ts, type FROM x_ev",
        "jsonl_prefix_limit": "SELECT session, aid, ts, type FROM x_ev WHERE session IN (SELECT DISTINCT session FROM x_ev ORDER BY session LIMIT 100)",
        "two_windows_contexts": "SELECT 'ranker_train' AS win, * FROM x_ctx1 UNION ALL SELECT 'local_validation', * FROM x_ctx",
        "two_windows_labels": "SELECT 'ranker_train' AS win, * FROM x_lab1 UNION ALL SELECT 'local_validation', * FROM x_lab",
        "max_ts": "SELECT max(ts) AS max_ts FROM x_ev",
        "known_aids": f"""SELECT DISTINCT c AS cutoff, aid FROM (SELECT cc.c, x_ev.*, count(*) OVER (PARTITION BY cc.c, session) AS n FROM x_ev JOIN x_first USING (session),
            (SELECT c FROM x_cut UNION ALL SELECT c - {DAYS7} FROM x_cut) cc WHERE f <= cc.c AND ts < cc.c) WHERE n >= 2""",
        "event_index": "SELECT session, aid, ts, type, pos, row_number() OVER (PARTITION BY session ORDER BY ts, pos) - 1 AS i FROM x_ev",
        "event_index_retail": "SELECT session, aid, ts, type, pos, row_number() OVER (PARTITION BY session ORDER BY ts, pos) - 1 AS i FROM x_retail",
        "tail_n": "SELECT session, aid, ts, type, pos FROM x_user QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) <= 30",
        "recency_rank": "SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY max(i) DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, pos) AS i FROM x_user) GROUP BY session, aid",
        "split_global_contexts": "SELECT session, aid, ts, type, pos FROM x_ev, x_cut WHERE ts < c AND session IN (SELECT session FROM x_glab)",
        "split_global_labels": "SELECT session, type, aid FROM x_glab WHERE session IN (SELECT session FROM x_ev, x_cut WHERE ts < c)",
        "split_official_contexts": "SELECT * FROM x_ctx",
        "split_official_labels": "SELECT * FROM x_lab",
        "views_matrix_events": "SELECT * FROM x_mev",
        "covis_pairs_dedup": f"SELECT session, s AS source_aid, t AS target_aid, w FROM ({rule_pairs('carts_orders', 'x_evix')})",
        **{f"covis_{r}": _top(rule_pairs(r, "x_evix")) for r in RULES},
        "covis_ramp_2024": _top(rule_pairs("clicks_ramp_2024", "x_evix")),
        "covis_user_carts_orders": _top(rule_pairs("carts_orders", "x_userix")),
        "covis_retail_buy_to_buy": _top(rule_pairs("buy_to_buy", "x_retailix")),
        "neighbor_lookup": "SELECT source_aid, target_aid, weight, rank FROM x_m_carts_orders WHERE source_aid IN (SELECT aid FROM x_ctx)",
        "popularity_by_target": "SELECT * FROM x_pop",
        "history_scores": _history("(SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, pos) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM x_user)", 0.5),
        "cand_baseline": "SELECT session, aid, score, best_rank, list_transform(evidence, lambda e: e.source) AS sources, candidate_rank FROM x_base_cand",
        "fuse_rrf": "SELECT session, aid, unnest(evidence).source AS source, unnest(evidence).score AS score, unnest(evidence).rank AS rank, candidate_rank FROM x_base_cand",
        "feat_session": "SELECT * FROM x_sf",
        "feat_session_aid": "SELECT * FROM x_af",
        "feat_evidence": f"SELECT session, target, aid, {_PIVOT} FROM x_piv",
        "feature_matrix": "SELECT * FROM x_feat",
        "candidates_labeled_retained": "SELECT session, target, aid, label, candidate_rank FROM x_kept",
        "recall_at_20": f"""SELECT target AS type, CAST(coalesce(h, 0) AS BIGINT) AS hits, denominator, {share.format('coalesce(h, 0)')} AS recall, ({share.format('coalesce(h, 0)')}) * {WEIGHT.format('target')} AS weighted
            FROM x_den LEFT JOIN (SELECT x_top.target AS t, count(*) AS h FROM x_top JOIN x_lab ON x_top.session = x_lab.session AND x_top.target = x_lab.type AND x_top.aid = x_lab.aid GROUP BY 1) ON t = target""",
        "cand_recall_cutoffs": f"""SELECT target, CAST(cutoff AS BIGINT) AS cutoff, CAST(coalesce(h, 0) AS BIGINT) AS hits, denominator, {share.format('coalesce(h, 0)')} AS recall
            FROM x_den CROSS JOIN (SELECT unnest([20, 50, 80, 100, 150]) AS cutoff) LEFT JOIN (SELECT target AS t, cut AS ct, count(*) AS h FROM x_pos, (SELECT unnest([20, 50, 80, 100, 150]) AS cut) WHERE candidate_rank <= cut GROUP BY 1, 2) ON t = target AND ct = cutoff""",
        "cand_recall_weighted": f"SELECT sum(({share.format('coalesce(h, 0)')}) * {WEIGHT.format('target')}) AS weighted FROM x_den LEFT JOIN (SELECT target AS t, count(*) AS h FROM x_pos WHERE candidate_rank <= 100 GROUP BY 1) ON t = target",
        "cand_recall_sources": f"""WITH p AS (SELECT *, {total} AS n_sources FROM x_pos), s AS ({sources} UNION ALL SELECT target, '*', count(*) FILTER (n_sources > 0), count(*) FILTER (n_sources > 0) FROM p GROUP BY target),
            g AS (SELECT target, denominator, unnest([{', '.join(f"'{x}'" for x in (*sorted(_SOURCES), '*'))}]) AS source FROM x_den)
            SELECT g.target, g.source, {share.format('coalesce(h, 0)')} AS recall, {share.format('coalesce(m, 0)')} AS marginal_recall FROM g LEFT JOIN s ON g.target = s.target AND g.source = s.source""",
        "cand_recall_length_buckets": f"""WITH b AS (SELECT DISTINCT target, session, {bucket.format('session_length')} AS bucket FROM x_feat),
            d AS (SELECT target, bucket, CAST(sum(n) AS BIGINT) AS denominator FROM (SELECT session, type, least(count(DISTINCT aid), 20) AS n FROM x_lab GROUP BY session, type) l JOIN b ON b.session = l.session AND b.target = l.type GROUP BY 1, 2),
            h AS (SELECT target, {bucket.format('session_length')} AS bucket, count(*) AS h FROM x_pos WHERE candidate_rank <= 20 GROUP BY 1, 2)
            SELECT d.target, d.bucket, CAST(coalesce(h, 0) AS BIGINT) AS hits, denominator, coalesce(h, 0) / denominator AS recall FROM d LEFT JOIN h ON d.target = h.target AND d.bucket = h.bucket""",
        "cand_rank_hist": "SELECT target, candidate_rank, count(*) AS n FROM x_pos GROUP BY target, candidate_rank",
        "sample_queries": f"""SELECT session, target, aid, label, candidate_rank FROM x_feat WHERE target = 'orders' AND candidate_rank <= 80 AND session IN
            (SELECT session FROM x_feat WHERE target = 'orders' AND (candidate_rank <= 80 OR label > 0) GROUP BY session HAVING sum(label) > 0 ORDER BY {_hash('session', 2026)}, session LIMIT 50)
            UNION SELECT session, target, aid, label, candidate_rank FROM x_feat WHERE target = 'orders' AND label > 0 AND session IN
            (SELECT session FROM x_feat WHERE target = 'orders' AND (candidate_rank <= 80 OR label > 0) GROUP BY session HAVING sum(label) > 0 ORDER BY {_hash('session', 2026)}, session LIMIT 50)""",
        "sample_negatives": f"SELECT session, target, aid, label, candidate_rank FROM x_feat WHERE target = 'clicks' AND (label > 0 OR (candidate_rank <= 80 AND {_hash(_hash('session', 2026) + ' * 31 + aid', 2026)} < 107374182))",
        "positive_groups": "SELECT session, target, aid, label, candidate_rank FROM x_feat WHERE target = 'carts' AND session IN (SELECT session FROM x_feat WHERE target = 'carts' GROUP BY session HAVING sum(label) > 0)",
        "refit_union": " UNION ALL ".join(
            f"""SELECT '{k}:' || session AS query_group, session, aid, label, candidate_rank FROM {rows} WHERE target = 'carts' AND (candidate_rank <= 80 OR label > 0)
            AND session IN (SELECT session FROM {rows} WHERE target = 'carts' GROUP BY session HAVING sum(label) > 0)"""
            for k, rows in enumerate(("x_kept1", "x_kept"))
        ),
        "rules_top20": "SELECT session, target, aid, CAST(-rank AS DOUBLE) AS score, rank FROM x_top",
        "submission_rows": """SELECT session || '_' || target AS session_type, string_agg(aid, ' ' ORDER BY r) AS labels FROM (
            SELECT session, target, aid, row_number() OVER (PARTITION BY session, target ORDER BY min(o)) AS r FROM (SELECT session, target, aid, rank AS o FROM x_top
            UNION ALL SELECT session, x_subq.target, aid, 1000000 + rank FROM x_subq JOIN x_pop ON x_pop.target = x_subq.target) GROUP BY session, target, aid QUALIFY r <= 20) GROUP BY session, target""",
        "submission_csv": "@submission_rows",
        "knn_cosine": f"""SELECT query_id, vec_id, round(similarity, 9) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
            SELECT a.vec_id AS query_id, b.vec_id, {cosine} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) QUALIFY rank <= 10""",
        "sequence_prep": "SELECT session, list(aid ORDER BY i) AS aids, list(type ORDER BY i) AS types, CAST(count(*) AS BIGINT) AS length FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, pos) AS i, row_number() OVER (PARTITION BY session ORDER BY ts DESC, pos DESC) AS back FROM x_user) WHERE back <= 12 GROUP BY session",
        "rq_encode": """WITH b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, vec_id AS bid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < 16),
            l1 AS (SELECT v.vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT arg_min(k, list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) ) FROM b WHERE k < 8) AS c1 FROM embeddings v),
            r AS (SELECT vec_id, c1, list_transform(list_zip(l1.e, b.e), lambda z: z[1] - z[2]) AS e FROM l1 JOIN b ON b.k = c1)
            SELECT vec_id, CAST(c1 AS INTEGER) AS code1, CAST((SELECT arg_min(k - 8, list_sum(list_transform(list_zip(r.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) FROM b WHERE k >= 8) AS INTEGER) AS code2 FROM r""",
    }
    for t in ("clicks", "carts", "orders"):
        for kind, p in (("public", "x_p"), ("legacy", "x_l")):
            out[f"cand_{kind}_{t}"] = f"SELECT session, aid, score, best_rank, list_transform(evidence, lambda e: e.source) AS sources, candidate_rank FROM {p}{t}_cand"
    out = {k: out[v[1:]] if v.startswith("@") else v for k, v in out.items()}
    return {k: _merge(v) for k, v in out.items()}


def _merge(body: str) -> str:
    """A body that has a WITH of its own goes below the shared expressions."""
    text = body.strip()
    if text.startswith("WITH "):
        full = sql(text)
        return full if full == text else full[: full.rindex("\nWITH ")] + ",\n" + text[5:]
    return sql(text)
