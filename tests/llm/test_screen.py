"""Screens, language, licences, packing and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from cartwheel.llm import decontaminate, language_id, license_scan, packing, secret_scan
from cartwheel.llm.common import written

DOCS = "doc_id long, text string, lang string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "x") for d, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("limit", [32 << 20, 0], ids=["broadcast", "shuffle"])
def test_leaks(spark, limit):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    swapped = "seven eight nine ten eleven twelve one two three four five six"
    half = "one two three four five and then something else entirely for the rest"
    docs = frame(spark, [(1, f"So: {passage.upper()}!"), (2, swapped), (3, half), (4, None), (5, ""), (None, "of and"), (6, "clean words only")])
    bench = items(spark, [(7, passage), (8, "of and"), (9, ""), (10, None), (None, "unrelated words that nobody wrote")])
    got = {r["doc_id"]: r for r in decontaminate.find_leaks(docs, bench, broadcast_bytes=limit).collect()}
    assert {d for d, r in got.items() if r["contaminated"]} == {1, 2, None}
    assert (got[2]["best_item"], got[2]["coverage"]) == (7, 1.0) and got[None]["best_item"] == 8 and got[3]["coverage"] == 0.0
    kept = decontaminate.drop_leaks(docs, bench, broadcast_bytes=limit)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6}
    assert decontaminate.find_leaks(docs, bench.where("item_id < 0"), broadcast_bytes=limit).where("contaminated").count() == 0
    assert decontaminate.find_leaks(docs.where("doc_id < 0"), bench, broadcast_bytes=limit).count() == 0


def test_leaks_are_equal_both_ways(spark):
    hindi = "यह किताब बहुत अच्छी है"
    passage = "one two three four five six"
    docs = frame(spark, [(1, f"x {hindi} y"), (2, passage), (3, "की में"), (4, "nothing of it")])
    bench = items(spark, [(1, passage), (1, passage), (2, "यह किताब नहीं"), (3, "की तो में"), (4, hindi), (5, None)])
    own = [sorted(map(str, decontaminate.find_leaks(docs, bench, least=4, broadcast_bytes=limit).collect())) for limit in (32 << 20, 0)]
    assert own[0] == own[1]
    got = {r["doc_id"]: r for r in decontaminate.find_leaks(docs, bench, broadcast_bytes=0).collect()}
    assert got[2]["n_items"] == 1 and got[2]["items"] == [1] and got[1]["contaminated"] and not got[4]["contaminated"]


def brute_tiles(doc, item, least):
    """Lengths of the tiles: the longest free match again and again, the first in the item and then the document."""
    free_d, free_i, found = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return found
        i, j, n = best
        free_d[i : i + n] = free_i[j : j + n] = [False] * n
        found.append(n)


def test_tiles_equal_repeated_longest_matches():
    rng = np.random.default_rng(2)
    for k in range(90):
        doc, item = rng.integers(0, 4, rng.integers(3, 30)), rng.integers(0, 4, rng.integers(3, 15))
        if k % 3 == 0:  # long matches, found from a longer search on
            item = rng.integers(0, 9, 70)
            doc = np.concatenate([item[30:], rng.integers(0, 9, 5), item[:40], item[10:14]])
        assert [n for _, _, n in decontaminate.tiles(doc, item, 3)] == brute_tiles(doc.tolist(), item.tolist(), 3)


def test_rolled_hashes_equal_those_from_scratch():
    rng = random.Random(3)
    words, free = [rng.randrange(5) for _ in range(60)], [rng.random() < 0.9 for _ in range(60)]
    for size in (1, 3, 7):
        got = dict(decontaminate.rolling(words, free, size))
        assert got.keys() == {i for i in range(61 - size) if all(free[i : i + size])}
        assert all(h == next(decontaminate.rolling(words[i : i + size], [True] * size, size))[1] for i, h in got.items())


def test_chunks_of_a_document_make_no_difference(monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(9)]
    bench = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 30])))) for k in range(8)]
    index = decontaminate.Index(bench, 4)
    texts = [" ".join(rng.choice([*vocabulary, "zz", bench[2][1], bench[5][1]]) for _ in range(60)) for _ in range(40)]
    whole = [index.match(t, 0.5) for t in texts]
    monkeypatch.setattr(decontaminate, "CHUNK", 3)
    assert [index.match(t, 0.5) for t in texts] == whole and any(whole)


@pytest.mark.parametrize("limit", [32 << 20, 0], ids=["broadcast", "shuffle"])
def test_leaks_equal_brute_force(spark, limit):
    rng = random.Random(23)
    vocabulary = [f"w{i}" for i in range(12)]
    bench = [(k if k % 5 else None, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 6, 14, 40])))) for k in range(14)]
    bench += [bench[1], (3, None), (90, "der Fluß ½ fließt"), (91, " ".join(vocabulary * 20))]
    rows = []
    for i in range(50):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.7:
            own = (rng.choice(bench)[1] or "").split()
            cut = rng.randint(0, len(own))
            words += own[cut:] + ["zz"] + own[:cut]
        rows.append((i if i % 9 else None, ", ".join(words).upper()))
    rows += [(700, "Der FLUSS ½ FLIESST"), (701, "der fluß ½ fließt."), (702, "w1 " * 30_000), (702, "w1 " * 30_000)]
    want = Counter()
    for d, t in rows:
        doc, hits = decontaminate.tokens(t), []
        for k, text in {x for x in bench if x[1] is not None}:
            item = decontaminate.tokens(text)
            if item:
                own = doc[:200] if len(doc) > 1000 else doc  # the long one repeats one word
                total = sum(brute_tiles(own, item, min(4, len(item))))
                if total >= 0.5 * len(item):
                    hits.append((-total / len(item), k is None, k or 0))
        hits.sort()
        best = hits[0] if hits else (0.0, True, 0)
        want[d, bool(hits), len(hits), None if best[1] else best[2], round(-best[0], 9)] += 1
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _items string, _key string")
    got = decontaminate.find_leaks(docs, items(spark, bench), broadcast_bytes=limit).collect()
    assert Counter((r["doc_id"], r["contaminated"], r["n_items"], r["best_item"], round(r["coverage"], 9)) for r in got) == want
    assert 5 < sum(n for k, n in want.items() if k[1]) < 50
    kept = decontaminate.drop_leaks(docs, items(spark, bench), broadcast_bytes=limit)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[1])
    assert {(r["_items"], r["_key"]) for r in kept.collect()} == {("x", "y")}


def brute_spans(text):
    kinds = (r"""(?P<k>[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", r"AKIA(?P<v>[A-Z0-9]+)", r"(?P<v>[0-9a-f]+)")
    least = (6, 16, 24)
    found = [(m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, text) if len(m["v"]) >= least[k]]
    return sorted(found)


def test_secret_scan(spark):
    rng = random.Random(6)
    parts = ["password=", "Token: '", "api_key=\"", "secret = ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ſecret=abcdefg", "é ", " ", "abc", "tokKen=abcdefgh", "-", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "passwd = hunter22"), (502, "x key ghp_a8Zk2mQ0vT7rL5wX9cJ3bN6yH1dF4gS2pE8u end"), (503, "see www.example.com/page/2024/index.html now"), (504, "a" * 200_000 + " token=abc123456")]
    got = {r["doc_id"]: r for r in secret_scan.scan(frame(spark, rows)).collect()}
    for d, t in rows:
        base = brute_spans(t or "")
        text = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[d]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (d, t)
        assert (got[d]["n_assign"], got[d]["n_access"], got[d]["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert [x for x in got[d]["spans"].split(",") if x and not x.startswith("model")] == [x for x in text.split(",") if x]
    assert got[502]["spans"] == "model:6:46" and got[503]["n_model"] == 0
    net = secret_scan.trained()
    held, labels = secret_scan.labelled_findings(600, 99)
    scores = net.predict(secret_scan.encode(held))
    assert (scores[labels > 0] >= net.threshold).mean() >= 0.95 and (scores[labels == 0] >= net.threshold).mean() <= 0.05


def test_network_tells_passwords_from_identifiers():
    net, rng = secret_scan.trained(), random.Random(1)
    parts = ["User", "Profile", "Account", "Order", "Item", "Page", "Model", "Service", "Handler", "Token"]
    names = [rng.choice(["get", "set", "find"]) + "".join(rng.choices(parts, k=rng.randint(2, 4))) + rng.choice(["", "ById7", "V2"]) for _ in range(300)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def share(values, lead):
        found = [(f"{lead}{v} every day", len(lead), len(lead) + len(v)) for v in values]
        assert all(secret_scan.candidates(t)[-1] == (s, e) for t, s, e in found)
        return (secret_scan.scores(net, found) >= net.threshold).mean()

    passwords = ["".join(rng.choices(letters, k=10)) + "aB" for _ in range(300)]
    assert share(names, "we call ") <= 0.03
    assert share(passwords, "my password is ") >= 0.95 and share(passwords, "we log in with ") >= 0.5


def test_candidates_are_runs_that_mix_letters():
    text = "plainwords Capitalised 12345678 a1b2c3d4 camelCaseX SHORT1 foo/bar-baz LOUDWORDS aB3_x/y.z"
    assert [text[s:e] for s, e in secret_scan.candidates(text)] == ["a1b2c3d4", "camelCaseX", "aB3_x/y.z"]


def test_secret_inside_a_long_run(spark):
    rng = random.Random(21)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    paths = ["/api/v1/download/nightly/builds/stable/{}/packages/installer.tar.gz", "www.example.com/users/list/of/projects/2024/{}/index/page.html"]
    rows = [(i, f"get {paths[i % 2].format(''.join(rng.choices(letters, k=40)))} now") for i in range(60)]
    rows += [(100 + i, f"get {paths[i % 2].format('release')} now") for i in range(2)]
    got = {r["doc_id"]: r["n_model"] for r in secret_scan.scan(frame(spark, rows)).collect()}
    assert sum(got[i] for i in range(60)) >= 57 and got[100] == got[101] == 0
    text = "x " + "".join(rng.choices(letters, k=1000)) + " y"
    for s, e in ((2, 50), (2, 51), (2, 99), (2, 1002)):
        shown = [inside for _, inside, _ in secret_scan.views(text, s, e)]
        assert all(len(x) <= secret_scan.INSIDE for x in shown)
        assert all(any(text[k : k + 20] in x for x in shown) for k in range(s, e - 19))


def test_threshold_holds_the_recall_below_one_half():
    net = secret_scan.CharCNN()  # not fitted, so that many secrets score little
    items, labels = secret_scan.labelled_findings(400, 31)
    labels[1::6] = 0  # a third of the secrets pass for plain
    net.calibrate(items, labels, 0.98)
    assert net.threshold < 0.5
    assert (secret_scan.scores(net, items)[labels > 0] >= net.threshold).mean() >= 0.98


def test_language_id(spark):
    rng = random.Random(4)
    words = {"en": ["the", "and", "house", "water", "through"], "de": ["der", "und", "haus", "wasser", "durch"], "fr": ["le", "et", "maison", "eau", "à"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang, "x") for i in range(240) for lang in [rng.choice(list(words))]]
    rows += [(900, None, "en", "x"), (901, "123 ½ !", "de", "x"), (None, "the water", "de", "x"), (902, "hausen durchaus", None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    held = [got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:240] if got[i]["held_out"]]
    assert len(held) > 30 and np.mean(held) >= 0.97
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[None]["lang_pred"] == "en" and got[902]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language_id.keep_identified(docs, language_id.train(docs))
    assert kept.columns == docs.columns and {900, 901}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() == 242
    blank = language_id.train(docs.where("lang = 'none'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, blank).collect()} == {"und"}


def brute_languages(rows, longest=4, penalty=16.0):
    """(prediction, score) of each text from counts in plain dictionaries."""
    letters = lambda t: [w for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if any(c.isalpha() for c in w)]
    seen: dict = defaultdict(Counter)
    for d, text, lang, _ in rows:
        if d is not None and lang is not None and text is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            for w in letters(text):
                seen[lang, 0][w] += 1
                for n in range(1, longest + 1):
                    padded = f" {w} "
                    seen[lang, n].update(padded[i : i + n] for i in range(len(padded) - n + 1))
    for (_, n), own in seen.items():
        if n == 0:
            for w in [w for w, k in own.items() if k < 2]:
                del own[w]
    languages = sorted({lang for lang, _ in seen})
    total = {key: sum(own.values()) for key, own in seen.items()}
    value = lambda lang, n, g: max(math.log(seen[lang, n][g] / total[lang, n]), -penalty) if seen[lang, n][g] else -penalty
    known = lambda n, g: any(seen[lang, n][g] for lang in languages)

    def word(w):
        if known(0, w):
            return [value(lang, 0, w) for lang in languages]
        for n in range(longest, 0, -1):
            padded = f" {w} "
            grams = [g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if known(n, g)]
            if grams:
                return [sum(value(lang, n, g) for g in grams) / len(grams) for lang in languages]
        return [-penalty] * len(languages)

    out = []
    for _, text, _, _ in rows:
        words = Counter(letters(text))
        if not words or not languages:
            out.append(("und", 0.0))
            continue
        n = sum(words.values())
        each = {w: word(w) for w in words}
        mean = [sum(k * each[w][x] for w, k in words.items()) / n for x in range(len(languages))]
        best = max(range(len(languages)), key=lambda x: (mean[x], -x))
        out.append((languages[best], 1 / sum(math.exp((m - mean[best]) * min(n, 20)) for m in mean)))
    return out


def test_language_id_equals_brute_force(spark):
    rng = random.Random(19)
    stems = {"aa": ["ka", "lo", "mi"], "bb": ["ka", "zu", "re"], "cc": ["жа", "ли", "ζη", "ka"]}
    make = lambda lang: "".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(90):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        rows.append((i if i % 11 else None, " ".join(make(lang) + rng.choice(["", ".", "7", "'s"]) for _ in range(rng.randint(0, 30))), rng.choice([lang, lang, None]), "x"))
    rows += [(500, None, "aa", "x"), (501, "12 ½", "bb", "x"), (502, "қ ?? 漢字", None, "x"), (503, "kamizu " * 60_000, None, "x"), (503, "kamizu " * 60_000, None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = language_id.identify(docs, language_id.train(docs)).collect()
    want = Counter((d, pred, round(score, 6)) for (d, *_), (pred, score) in zip(rows, brute_languages(rows), strict=True))
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in got) == want
    assert {p for _, p, _ in want} == {"aa", "bb", "cc", "und"}


def test_workers_get_the_package(tmp_path):
    """Training first, with the package on the driver's path alone."""
    root = Path(language_id.__file__).resolve().parents[2]
    code = f"""
import sys; sys.path.append({str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from cartwheel.llm import language_id
docs = spark.createDataFrame([(i, "the house", "en") for i in range(8)], "doc_id long, text string, lang string")
print("found", language_id.identify(docs, language_id.train(docs)).where("lang_pred = 'en'").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "found 8" in done.stdout, done.stderr[-2000:]


def test_small_languages_beside_a_large_one(spark):
    rng = random.Random(15)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"
    rows = [(ids.pop(), " ".join("".join(rng.choices(latin, k=9)) for _ in range(300)), "aa", "x") for _ in range(800)]
    small = {f"l{k}": ["".join(rng.choices(cyrillic, k=7)) for _ in range(6)] for k in range(510)}
    rows += [(ids.pop(), " ".join(words), lang, "x") for lang, words in small.items() for _ in range(2)]
    model = language_id.train(spark.createDataFrame(rows, DOCS))
    assert set(model.languages) == {"aa", *small}
    assert all(w in model.grams[0] for words in small.values() for w in words)
    scorer = language_id.Scorer(model)
    assert all(scorer(" ".join(words[:3]))[0] == lang for lang, words in small.items())
    assert all(scorer(words[0][:4] + words[0][:4])[0] == lang for lang, words in list(small.items())[:50])


def test_license_scan(spark):
    rng = random.Random(7)
    parts = ["MIT", "License", "apache", "general", "public", "license", "the", "é", "under", "-", "mit license", "GNU General Public License", "Licensed under CC BY-NC 4.0."]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(150)] + [(900, None), (901, ""), (None, "mit,license"), (902, "w " * 50_000 + "apache license")]
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, rows)).collect()}
    for d, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        want = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert tuple(got[d][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want, (d, t)
        assert set(want[4].split(",")) - {""} <= set(got[d]["labels"].split(",")) and 0 <= got[d]["score"] <= 1
    full = f"x {license_scan.TEMPLATES[1].words} y"
    one = license_scan.scan(frame(spark, [(1, full), (2, "licensed under cc by nc 4 0")])).orderBy("doc_id").collect()
    assert [(r["labels"], r["base_labels"], r["score"]) for r in one] == [("mit", "", 1.0), ("cc-by-nc", "", 1.0)]
    assert license_scan.scan(frame(spark, [(1, "a")]).where("doc_id > 1")).count() == 0


def brute_matches(words, rare, look):
    """Labels and score by trying every template at every start."""
    templates = license_scan.TEMPLATES
    seen = Counter(w for t in templates for w in set(t.words.split()))
    rank = lambda w: (seen[w], w)
    index = [{w for w in sorted(set(t.words.split()), key=rank)[:rare]} for t in templates]
    own = set(sorted({w for ws in index for w in ws} & set(words), key=rank)[:look])
    labels, score = set(), 0.0
    for t, chosen in zip(templates, index, strict=True):
        text = t.words.split()
        places = [i for i, w in enumerate(text) if w in chosen]
        for start in range(-len(text), len(words)):
            n = sum(0 <= start + i < len(words) and words[start + i] == text[i] and text[i] in own for i in places)
            keys = [(license_scan._find(text, k.split()), k.split()) for k in t.keys]
            if 2 * n >= len(places) and any(start + at >= 0 and words[start + at : start + at + len(k)] == k for at, k in keys):
                labels.add(t.label)
                score = max(score, n / len(places))
    return labels, score


@pytest.mark.parametrize("look", [256, 5])
def test_license_labels_equal_brute_force(spark, look):
    rng = random.Random(17)
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(license_scan.TEMPLATES).words.split()
            a = rng.choice([0, 0, rng.randrange(len(t))])
            part = [w if rng.random() < 0.9 else rng.choice(["zz", "license", "the"]) for w in t[a : a + rng.randint(3, 40)]]
            if rng.random() < 0.3:
                part.insert(rng.randrange(len(part)), "extra")
            words += [f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 4))] + part
        rows.append((i if i % 7 else None, f"n{i} " + " ".join(words)))
    rows += [(500, "license " * 30_000 + license_scan.TEMPLATES[9].words), (501, None), (501, "mit license")]
    key = lambda t: re.findall(r"\S+", t or "")
    got = Counter((r["doc_id"], r["n_words"], r["labels"], round(r["score"], 9)) for r in license_scan.scan(frame(spark, rows), look=look).collect())
    want = Counter()
    for d, t in rows:
        words = key(t)
        if len(words) > 1000:
            labels, score = ({"bsd"}, 1.0) if look > 5 else brute_matches(words[-60:], 8, look)
        else:
            labels, score = brute_matches(words, 8, look)
        base = {x for p, x in license_scan.BASE.items() if f" {p} " in f" {' '.join(words)} "}
        want[d, len(words), ",".join(sorted(labels | base)), round(score, 9)] += 1
    assert (got - want, want - got) == (Counter(), Counter())
    assert sum("," in x[2] for x in want) > (3 if look > 5 else 0)


def test_plans_fill_bins_as_well_as_plain_best_fit():
    rng = random.Random(9)
    for _ in range(120):
        capacity = rng.choice([10, 25, 60])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 60)))
        at = packing.plan(counts, capacity)
        bins = defaultdict(list)
        for length, n in counts.items():
            for rank in range(n):
                i = max(k for k in range(len(at["length"])) if at["length"][k] == length and at["first"][k] <= rank)
                r = rank - at["first"][i]
                bins[at["sequence"][i] + r // at["each"][i]].append((at["offset"][i] + r % at["each"][i] * length, length))
        for own in bins.values():
            end = 0
            for offset, length in sorted(own):
                assert offset == end
                end += length
            assert end <= capacity
        rooms: list[int] = []
        for length in sorted(counts.elements(), reverse=True):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - length)
        assert len(bins) <= len(rooms)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["It's the DOG'S!! 123 ½ ²", "a\x1cb ́x Σς İ ǅ ﬁ", "", None, "word " * 9000, "<|endoftext|> a<|startoftext|>b", "Ça ÀÈ×÷ß ẞ — don't", "same", "same"]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)]
    got = packing.pack(frame(spark, rows), with_ids=True).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    bins = defaultdict(list)
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(by[d], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids and [r["start"] for r in own] == list(range(0, len(ids), 4096))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in own)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack(frame(spark, [(1, "a")]).where("doc_id > 1")).count() == 0


def test_pipeline_equals_its_stages(spark, tmp_path):
    rng = random.Random(3)
    words = {"en": "the and house water through we".split(), "de": "der und haus wasser durch wir".split()}
    texts = [(lang, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "x"]) for _ in range(60))) for lang in ("en", "de") for _ in range(30)]
    rows = [(i, t, lang, "s", len(t)) for i, (lang, t) in enumerate(texts)]
    rows.append((100, rows[0][1], "en", "s", 1))  # a copy; the larger id stays
    near = rows[1][1].split()
    rows.append((101, " ".join(near + ["water"]), "en", "s", 1))  # a near copy; the smaller id stays
    leak = "seven grey geese flew over the quiet lake before dawn broke"
    rows += [(102, f"{rows[2][1]} {leak} {rows[3][1]}", "en", "s", 1), (103, "123", "en", "s", 1), (104, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items(spark, [(1, leak)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == (set(range(60)) - {0}) | {100}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert {(r["doc_id"], r["ids_crc32"]) for r in docs.collect()} == {(r["doc_id"], r["ids_crc32"]) for r in got.collect()}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage again by plain loops: languages, equal texts, all pairs, all tiles, token ids."""
    from tokenizers import Tokenizer

    rng = random.Random(31)
    words = {"en": "the and house water through we over".split(), "de": "der und haus wasser durch wir aus".split()}
    bench = [(1, "seven grey geese flew over the quiet lake before dawn broke"), (2, "one two three"), (None, "wind and rain fell on roofs of old stone all night")]
    rows = []
    for _ in range(70):
        lang = rng.choice(list(words))
        own = [rng.choice(words[lang]) + rng.choice(["", "s", "x", "en", "in"]) for _ in range(rng.randint(8, 80))]
        if rng.random() < 0.2:
            own[4:4] = rng.choice(bench)[1].split()[rng.randint(0, 6) :]
        rows.append((len(rows), " ".join(own), rng.choice([lang, lang, None]), "s", 1))
        if rng.random() < 0.4:
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words[lang])
            rows.append((len(rows), " ".join(own), lang, "s", 1))
        if rng.random() < 0.2:
            rows.append((len(rows), rows[-1][1], None, "t", 2))
    rows += [(len(rows), "12 ?", "en", "s", 1), (None, None, None, None, None), (None, rows[3][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items(spark, bench).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    order = lambda d: (d is not None, d or 0)
    kept = [r for r, (pred, score) in zip(rows, brute_languages([x[:4] for x in rows]), strict=True) if pred != "und" and score >= 0.4]
    by_text: dict = {}
    for r in kept:
        if r[1] not in by_text or order(r[0]) > order(by_text[r[1]][0]):
            by_text[r[1]] = r
    kept = sorted(by_text.values(), key=lambda r: (r[0] is None, r[0] or 0))  # the least id of a class stays
    shingles = [Counter(tuple(r[1].split()[i : i + 5]) for i in range(max(1, len(r[1].split()) - 4))) for r in kept]
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sum((shingles[i] & shingles[j]).values()) >= 0.8 * sum((shingles[i] | shingles[j]).values()):
                gone, stays = max(label[i], label[j]), min(label[i], label[j])
                label = [stays if x == gone else x for x in label]
    near = [kept[k] for k in sorted(set(label))]
    assert len(near) < len(kept) < len(rows)

    def leaks(text):
        doc = decontaminate.tokens(text)
        each = [decontaminate.tokens(t) for _, t in bench]
        return any(sum(brute_tiles(doc, item, min(4, len(item)))) >= 0.5 * len(item) for item in each)

    clean = [r for r in near if not leaks(r[1])]
    assert len(clean) < len(near)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((r[0], zlib.crc32(np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in clean)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096
