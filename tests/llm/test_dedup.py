"""Exact, near, substring and suffix dedup against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartwheel.llm import exact_dedup, induced, line_dedup, minhash, substring_dedup, suffix_dedup

EDGE = [(1, "a"), (2, "a"), (None, "a"), (3, ""), (4, None), (2, "a"), (5, "b"), (6, "c"), (None, "zz")]


def frame(spark, rows):
    """Documents with an extra column whose name clashes with internal ones."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, block string, node string")


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.unhex(F.lit("aa"))], ids=["sha256", "all clash"])
def test_exact_dedup(spark, keep, digest):
    got = exact_dedup.exact_dedup(frame(spark, EDGE), keep, digest).collect()
    groups: dict = {}
    for d, t in EDGE:
        groups.setdefault(t or "", []).append(d)
    best = {t: (max if keep == "largest" else min)([d for d in ds if d is not None], default=None) for t, ds in groups.items()}
    want = sorted(((d, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in EDGE), key=key)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_merge_index_flushes_probes_and_compacts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST", broadcast)
    rng = random.Random(5)
    rows = [(rng.choice([None, rng.randrange(900)]), f"text {rng.choice([0, rng.randrange(700)])}") for _ in range(900)]
    keyed = frame(spark, rows).select(exact_dedup.sha256_digest(F.col("text")).alias("digest"), "doc_id", F.monotonically_increasing_id().alias("seq"))
    index = exact_dedup.MergeIndex(spark, 900, "largest", flush_rows=100, fan=3)
    index.add(keyed)
    assert [len(x) for x in index.levels] == [9]
    assert all(r.rows.count() == r.rows.select("digest").distinct().count() for r in index.levels[0])
    merged = index.compact()
    assert [len(x) for x in index.levels] == [0, 0, 1]
    groups: dict = {}
    for d, t in rows:
        groups.setdefault(hashlib.sha256(t.encode()).digest(), []).append(-1 if d is None else d)
    got = {bytes(r["digest"]): (-1 if r["keep_id"] is None else r["keep_id"], r["group_size"]) for r in merged.collect()}
    assert got == {k: (max(v), len(v)) for k, v in groups.items()}
    out = exact_dedup.exact_dedup(frame(spark, rows), "largest", flush_rows=100, fan=2).collect()
    assert Counter((r["keep_id"], r["group_size"]) for r in out) == Counter((None if max(v) < 0 else max(v), len(v)) for v in groups.values() for _ in v)
    assert Counter(r["text_sha256"] for r in out if r["kept"]) == {k.hex(): 1 for k in groups}


@pytest.mark.parametrize("parts", [1, 13])
def test_slices_hold_every_row_once(spark, parts):
    rows = spark.range(0, 500, 1, parts).withColumn("seq", F.monotonically_increasing_id())
    slices = exact_dedup.MergeIndex(spark, 500)._slices(rows, 5)
    found = [[r["id"] for r in x.collect()] for x in slices]
    assert len(found) == 5 and all(found) and sorted(sum(found, [])) == list(range(500))


def test_filters_hold_every_digest(spark):
    index = exact_dedup.MergeIndex(spark, 5000)
    index.flush(spark.range(5000).selectExpr("unhex(sha2(cast(id AS string), 256)) AS digest", "named_struct('ranked', false, 'id', id, 'seq', id) AS best", "1L AS n"))
    index.flush(spark.range(5000, 9000).selectExpr("unhex(sha2(cast(id AS string), 256)) AS digest", "named_struct('ranked', false, 'id', id, 'seq', id) AS best", "1L AS n"))
    index.flush(spark.range(4000, 5000).selectExpr("unhex(sha2(cast(id AS string), 256)) AS digest", "named_struct('ranked', false, 'id', id, 'seq', id) AS best", "1L AS n"))
    probed = index._probed(index.levels[0]).groupBy("best.id", "maybe").count().collect()
    maybe = {r["id"]: r["maybe"] for r in probed}
    assert all(maybe[k] for k in range(4000, 5000))
    assert sum(maybe[k] for k in maybe if not 4000 <= k < 5000) < 0.15 * 8000


def test_drop_copies_with_clashing_names_and_ties(spark):
    rows = [(1, "a", "p", b"q", "r"), (1, "a", "p", b"q", "r"), (None, "a", "s", b"t", "u"), (2, None, "v", b"w", "x"), (3, "b", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _digest binary, _keep_id string")
    got = exact_dedup.drop_copies(docs, "largest")
    assert got.columns == docs.columns and sorted((tuple(r) for r in got.collect()), key=key) == sorted([rows[0], rows[3], rows[4]], key=key)


def test_drop_copies_keeps_columns(spark):
    got = exact_dedup.drop_copies(frame(spark, EDGE), "largest")
    assert got.columns == ["doc_id", "text", "block", "node"]
    assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=key) == sorted([(2, "a"), (4, ""), (5, "b"), (6, "c"), (None, "zz")], key=key)


def _shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(200))
    words = text.split()
    words[::40] = ["zz"] * len(words[::40])
    pairs = [(text, " ".join(words)), ("x " * 50, "x " * 80), (text, text + " " + text), ("one two", "one two")]
    left, right = (pa.array([p[k] for p in pairs]) for k in (0, 1))
    exact = minhash.similarities(left, right, 5)
    assert exact == pytest.approx([_similarity(_shingles(a), _shingles(b)) for a, b in pairs])

    def sign(column):
        doc, hashes, weight = minhash.weighted(*minhash.shingles(*minhash.utf8(column), 5))
        return minhash.dart_signatures(doc, hashes, weight, len(column), 3000)

    assert (sign(left) == sign(right)).mean(axis=1) == pytest.approx(exact, abs=0.04)


def near_fixture():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(8):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        for _ in range(5):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) + 10 * base, " ".join(own)))
    return rows + [(900, ""), (901, None), (902, "two words"), (903, "two words"), (None, "alone here"), (904, "x " * 500)]


def test_near_dedup_equals_all_pairs(spark):
    rows = near_fixture()
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    shingles = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or _similarity(shingles[i], shingles[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    for i, (doc, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        least = min((m for m in members if m is not None), default=None)
        assert (got[doc]["class_id"], got[doc]["class_size"]) == (least, len(members)), doc
    kept = minhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "block", "node"]
    assert kept.count() == len({root(i) for i in range(len(rows))})


def template_fixture():
    """Texts of one template, about 0.74 alike, and some again with a word more; and the classes by all pairs."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        own = [f"t{k}" for k in range(600)]
        for k in range(9):
            own[66 * k + rng.randrange(60)] = f"u{i}_{k}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, rows[i][1] + f" v{i}") for i in range(7, 300, 25)]
    sets = [set(_shingles(t)) for _, t in rows]
    label = {d: d for d, _ in rows}
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if label[a] != label[b] and (c := len(sets[i] & sets[j])) / (len(sets[i]) + len(sets[j]) - c) >= 0.8:
                gone, stays = max(label[a], label[b]), min(label[a], label[b])
                label = {d: stays if x == gone else x for d, x in label.items()}
    return rows, label


def test_near_dedup_compares_loose_groups_in_full(spark):
    rows, label = template_fixture()
    assert len(rows) - len(set(label.values())) >= 12
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()} == label


def test_near_dedup_stage_compares_loose_groups_in_full(spark):
    rows, label = template_fixture()
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label.values()))


@pytest.mark.parametrize("block, cells", [(128, 4 << 20), (40, 300)])
def test_blocks_compare_every_pair(spark, monkeypatch, block, cells):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows, label = template_fixture()
    found = minhash.near_duplicates(frame(spark, rows), rounds=0).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == label
    left, right = (pa.array([t for _, t in own]) for own in (near_fixture()[:20], near_fixture()[20:]))
    monkeypatch.setattr(minhash, "CELLS", cells)
    n, n2, common = minhash.common_shingles(left, right, 5)
    for i, j in ((i, j) for i in range(len(left)) for j in range(len(right))):
        a, b = _shingles(left[i].as_py()), _shingles(right[j].as_py())
        assert (n[i], n2[j], common[i, j]) == (sum(a.values()), sum(b.values()), sum((a & b).values()))


def test_near_dedup_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1000)
    rng = random.Random(2)
    words = [f"w{rng.randrange(9999)}" for _ in range(30_000)]
    rows = [(k, " ".join(words[: 29_000 + 300 * k])) for k in range(4)] + [(9, " ".join(reversed(words)))]
    for rounds in (0, 2):
        got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in minhash.near_duplicates(frame(spark, rows), rounds=rounds).collect()}
        assert got == {0: (0, 4), 1: (0, 4), 2: (0, 4), 3: (0, 4), 9: (9, 1)}


def repeats_fixture():
    rng = random.Random(5)
    words = [rng.choice(["alpha", "be", "é", "d,", "omega"]) + str(rng.randint(0, 99)) for _ in range(400)]
    rows = []
    for i in range(25):
        a = rng.randint(0, 360)
        rows.append((i, " ".join(words[a : a + rng.randint(5, 90)] + [f"u{i}_{k}" for k in range(rng.randint(0, 20))])))
    return rows + [(50, "a " * 120), (51, None), (52, ""), (None, "\tx y  z\n"), (53, rows[0][1]), (53, rows[0][1]), (54, "lone " * 34)]


@pytest.mark.parametrize("width", [35, 9, 2])
def test_substring_dedup_equals_brute_force(spark, width):
    rows = repeats_fixture()
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    want = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        want.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    got = [tuple(r) for r in substring_dedup.remove_repeats(frame(spark, rows), width).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("base, memory, batch", [(0, 800, 3), (3, 160_000, 7), (0, 3000, 1000), (10_000, 16 << 20, 1000)])
def test_induced_sorting_equals_sorted_suffixes(base, memory, batch):
    rng = random.Random(base)
    for _ in range(60):
        n, letters = rng.randint(0, 150), rng.choice([1, 2, 4])
        text = np.array([rng.randint(1, letters) for _ in range(n)] + [0], np.int64)
        if n > 40:
            text[3:20] = text[20:37]
        order, common = [], []
        budget = induced.Budget(memory, base)
        budget.batch = batch
        for pos, lcp in induced.suffixes(text, 30, budget):
            order += pos.tolist()
            common += lcp.tolist()
        assert sorted(order) == list(range(n + 1))
        plain = text.tolist()
        for k in range(1, n + 1):
            a, b = plain[order[k - 1] :], plain[order[k] :]
            shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert a[:30] <= b[:30] and common[k] == min(shared, 30)


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdé f") for _ in range(1500))
    rows = [(i, base[(a := rng.randint(0, 1200)) : a + rng.randint(50, 400)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 120)))) for i in range(25)]
    rows += [(100, "a" * 700), (101, "ab" * 150), (102, None), (103, ""), (104, "a" * 300), (None, base[:300])]
    assert sorted(suffix_result(spark, rows), key=key) == sorted(suffix_brute(rows), key=key)


def test_suffix_dedup_of_shards_larger_than_memory(spark, monkeypatch):
    """Passages that share a frequent phrase, in shards that pass the budget many times over."""
    monkeypatch.setattr(suffix_dedup, "LEAST_SHARDS", 2)
    monkeypatch.setattr(suffix_dedup, "BLOCK_TEXT", 20_000)
    rng = random.Random(4)
    phrase = "the phrase that very many of the passages hold, word for word"
    passages = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + rng.choice("xyz") for _ in range(12)) + f" {phrase} " + "".join(rng.choice("abc ") for _ in range(90)) for _ in range(60)]
    rows = [(i, "".join(rng.choice(passages)[: rng.randint(150, 400)] + rng.choice("qrs") * rng.randint(0, 2) for _ in range(6))) for i in range(120)]
    want = sorted(suffix_brute(rows), key=key)
    for hot in (1 << 30, 2):
        report = suffix_dedup.shard_report(frame(spark, rows), memory=4000, hot_blocks=hot).collect()
        assert sum(r["symbols"] for r in report) > 20 * 4000
        assert all(r["spilled"] > 4000 and r["mapped"] > 4000 and r["recursions"] >= 1 for r in report if r["symbols"] > 10_000)
        assert any(r["recursions"] >= 1 for r in report)
        assert sorted(suffix_result(spark, rows, memory=4000, hot_blocks=hot), key=key) == want
    assert sorted(suffix_result(spark, rows), key=key) == want


def suffix_brute(rows):
    order = lambda d: (d is not None, d or 0)
    first: dict = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 99):
            x = raw[i : i + 100]
            first[x] = min(first.get(x, (order(d), i)), (order(d), i))
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = set()
        for i in range(len(raw) - 99):
            if first[raw[i : i + 100]] < (order(d), i):
                gone.update(range(i, i + 100))
        spans = sum(1 for i in gone if i - 1 not in gone)
        want.append((d, len(raw), len(gone), spans, bytes(c for i, c in enumerate(raw) if i not in gone)))
    return want


def suffix_result(spark, rows, **params):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in suffix_dedup.remove_earlier(frame(spark, rows), **params).collect()]


def test_line_dedup_by_hand(spark):
    page = lambda k: f"<title>T{k}</title><nav><li>Home</li></nav><script>x</script><p>own   {k}<br>x<b>y</b></p>"
    rows = [(k, f"http://u@A.example:80/{k}", page(k)) for k in range(6)] + [(10, "https://b.example/", page(10)), (11, None, page(11)), (12, "nothing", None), (None, "http://a.example/n", "")]
    got = {r["page_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0]["host"] == "a.example" and got[0]["kept_text"] == "T0\nown 0" and (got[0]["n_lines"], got[0]["n_dropped"]) == (4, 2)
    assert got[10]["n_dropped"] == 0 and got[11]["kept_text"] == "T11\nHome\nown 11\nxy" and got[12]["n_lines"] == 0 and got[None]["n_lines"] == 0


def test_line_dedup_goes_by_the_ratio_alone(spark):
    rows = [(k, f"http://small.example/{k}", f"<p>menu</p><p>own {k}</p>", "x", "y") for k in range(3)]
    rows += [(10, "http://one.example/", "<p>menu</p>", "x", "y"), (11, "http://two.example/", "<p>foot</p><p>foot</p>", "x", "y"), (11, "http://two.example/", "<p>foot</p><p>foot</p>", "x", "y")]
    rows += [(20 + k, f"http://wide.example/{k}", f"<p>{'menu' if k < 2 else 'text'}</p><p>{k}</p>", "x", "y") for k in range(8)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, salt string, found string")
    got = [(r["page_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.drop_boilerplate(docs).collect()]
    want = [(k, 2, 1, f"own {k}") for k in range(3)] + [(10, 1, 0, "menu")] + [(11, 2, 2, "")] * 2
    want += [(20 + k, 2, 0, f"menu\n{k}") for k in range(2)] + [(22 + k, 2, 1, str(2 + k)) for k in range(6)]
    assert sorted(got) == sorted(want)


def test_empty_tables(spark):
    empty = frame(spark, [(1, "a")]).where("doc_id > 5")
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_earlier(empty).count() == 0
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def thue_morse(n, letters):
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return "".join(letters[x] for x in word[:n])


def test_windows_that_collide_in_polynomial_hashes_are_told_apart(spark):
    same = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*same, thue_morse(2048, "ab")])), (2, " ".join([*same, thue_morse(2048, "ba")]))]
    rows += [(3, thue_morse(2048, "cd")), (4, thue_morse(2048, "dc"))]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert [(got[k]["n_words"], got[k]["n_removed"]) for k in (1, 2, 3, 4)] == [(35, 0), (35, 0), (1, 0), (1, 0)]
    assert {r["doc_id"]: r["class_size"] for r in minhash.near_duplicates(frame(spark, rows[2:])).collect()} == {3: 1, 4: 1}
    texts = [(5, thue_morse(1024, "cd") + "x" * 9 + thue_morse(1024, "dc")), (6, "y" + thue_morse(1024, "dc"))]
    assert sorted(suffix_result(spark, texts), key=key) == sorted(suffix_brute(texts), key=key)


def test_near_dedup_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "k", b"n"), (2, "a b c d e f", "l", b"m")], "doc_id long, text string, _kept_id string, _KEPT_NODE binary")
    assert [tuple(r) for r in minhash.drop_near_duplicates(docs).collect()] == [(1, "a b c d e f", "k", b"n")]
