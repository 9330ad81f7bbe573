"""Secret scanning: fixed patterns, and a character CNN over every candidate.

A candidate is a maximal run of 8 or more key characters that is no plain word, number or
path: it has two of small letters, capitals after its first letter, and digits.  The
network sees the candidate, the text around it and which is which (a long one by
overlapping windows and by parts, of which the greatest score counts); it is written in
numpy and trained here on labelled findings that a seeded generator makes (``findings`` of
them, half secrets: keys, tokens, passwords named or in prose; half look-alikes:
identifiers, UUIDs, versions, dates, paths, addresses).  Its score is calibrated on a
held-out part and its threshold the highest that still finds ``recall`` of the held-out
secrets.

Pattern spans always stay; candidates that overlap one only get no span of their own.

Defined results: a null text is empty; an empty text has no spans, and the digest of no
spans is that of the empty string; null and repeated doc_ids pass through; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

KINDS = ("assign", "access", "hex", "model")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_PART = re.compile(r"[A-Za-z0-9+_-]{8,}")
#: Two of: a small letter, a capital that isn't the run's first letter, a digit.
_MIXED = re.compile(r"(?=[^a-z]*[a-z])(?=[^A-Za-z]*[A-Za-z][^A-Z]*[A-Z])|(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text) if _MIXED.match(m[0])]


# --- the network -------------------------------------------------------------

BEFORE, INSIDE, AFTER = 24, 48, 12
LENGTH = BEFORE + INSIDE + AFTER
WIDTH, FILTERS, DIMS, CODES = 5, 24, 10, 98


def _codes(shown: list[tuple[str, str, str]]) -> np.ndarray:
    """Character codes (n, LENGTH) of (before, inside, after)."""
    out = np.zeros((len(shown), LENGTH), np.int64)
    for row, (before, inside, after) in zip(out, shown, strict=True):
        for at, part in ((BEFORE - len(before), before), (BEFORE, inside), (BEFORE + INSIDE, after)):
            row[at : at + len(part)] = [min(max(ord(c) - 30, 1), CODES - 1) for c in part]
    return out


def views(text: str, s: int, e: int) -> Iterator[tuple[str, str, str]]:
    """What the network sees of a candidate: (before, inside, after), the first by ``encode``.

    A long candidate shows its head and tail, then overlapping windows that hold each of
    its characters, and each part between / . = that is a candidate of its own.
    """
    before, after = text[max(0, s - BEFORE) : s], text[e : e + AFTER]
    if e - s <= INSIDE:
        yield before, text[s:e], after
        return
    yield before, text[s : s + INSIDE - 16] + text[e - 16 : e], after
    for at in range(s, e - INSIDE, INSIDE // 2):
        yield before, text[at : at + INSIDE], after
    yield before, text[e - INSIDE : e], after
    for m in _PART.finditer(text, s, e):
        if len(m[0]) <= INSIDE and _MIXED.match(m[0]):
            yield before, m[0], after


def encode(items: list[tuple[str, int, int]]) -> np.ndarray:
    """Character codes (n, LENGTH); a long candidate shows its head and tail."""
    return _codes([next(views(*item)) for item in items])


def scores(net: CharCNN, items: Iterable[tuple[str, int, int]], most: int = 2000) -> np.ndarray:
    """The greatest score of each candidate's views; ``most`` views are held at once."""
    shown: list[tuple[str, str, str]] = []
    owner: list[int] = []
    done: list[float] = []

    def flush() -> None:
        for k, score in zip(owner, net.predict(_codes(shown)).tolist(), strict=True):
            done[k] = max(done[k], score)
        shown.clear()
        owner.clear()

    for k, item in enumerate(items):
        done.append(0.0)
        for view in views(*item):
            shown.append(view)
            owner.append(k)
            if len(shown) >= most:
                flush()
    flush()
    return np.array(done)


class CharCNN:
    """Embedding, one convolution, maximum and mean over positions, one logistic unit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "emb": rng.normal(0, 0.3, (CODES, DIMS)),
            "place": rng.normal(0, 0.1, (3, DIMS)),
            "conv": rng.normal(0, 0.2, (WIDTH * DIMS, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.2, 4 * FILTERS),
            "b": np.zeros(1),
        }
        self.scale = np.array([1.0, 0.0])
        self.threshold = 0.5

    _PLACE = np.repeat([0, 1, 2], [BEFORE, INSIDE, AFTER])

    def _forward(self, codes: np.ndarray):
        p = self.p
        x = p["emb"][codes] + p["place"][self._PLACE]
        x[codes == 0] = 0
        n, steps = len(codes), LENGTH - WIDTH + 1
        cols = np.stack([x[:, i : i + steps] for i in range(WIDTH)], axis=2).reshape(n, steps, -1)
        h = np.maximum(cols @ p["conv"] + p["bias"], 0)
        own = h[:, BEFORE - 2 : BEFORE + INSIDE - 2]
        top, mean = own.argmax(axis=1), own.mean(axis=1)
        ctop = h[:, :BEFORE].argmax(axis=1)
        atop = h[:, BEFORE + INSIDE - 4 :].argmax(axis=1)
        pick = lambda a, i: np.take_along_axis(a, i[:, None], 1)[:, 0]
        feats = np.concatenate([pick(own, top), mean, pick(h[:, :BEFORE], ctop), pick(h[:, BEFORE + INSIDE - 4 :], atop)], axis=1)
        return feats @ p["out"] + p["b"][0], (codes, cols, h, top, ctop, atop, feats)

    def _backward(self, grad: np.ndarray, kept) -> dict[str, np.ndarray]:
        codes, cols, h, top, ctop, atop, feats = kept
        p, f = self.p, FILTERS
        g = {"out": feats.T @ grad, "b": np.array([grad.sum()])}
        df = grad[:, None] * p["out"]
        dh = np.zeros_like(h)
        rows, filt = np.arange(len(codes))[:, None], np.arange(f)[None, :]
        dh[:, BEFORE - 2 : BEFORE + INSIDE - 2] += df[:, None, f : 2 * f] / INSIDE
        np.add.at(dh, (rows, top + BEFORE - 2, filt), df[:, :f])
        np.add.at(dh, (rows, ctop, filt), df[:, 2 * f : 3 * f])
        np.add.at(dh, (rows, atop + BEFORE + INSIDE - 4, filt), df[:, 3 * f :])
        dh *= h > 0
        g["conv"] = np.einsum("ntd,ntf->df", cols, dh, optimize=True)
        g["bias"] = dh.sum(axis=(0, 1))
        dcols = (dh @ p["conv"].T).reshape(len(codes), -1, WIDTH, DIMS)
        dx = np.zeros((len(codes), LENGTH, DIMS))
        for i in range(WIDTH):
            dx[:, i : i + dcols.shape[1]] += dcols[:, :, i]
        dx[codes == 0] = 0
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], codes, dx)
        g["place"] = np.stack([dx[:, self._PLACE == k].sum(axis=(0, 1)) for k in range(3)])
        return g

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), batch):
                i = order[at : at + batch]
                z, kept = self._forward(codes[i])
                grads = self._backward((1 / (1 + np.exp(-z)) - labels[i]) / len(i), kept)
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, items: list[tuple[str, int, int]], labels: np.ndarray, recall: float) -> None:
        """Platt scaling, then the highest threshold with the wanted recall."""
        z = self._forward(encode(items))[0]
        a, b = 1.0, 0.0
        target = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
        for _ in range(100):
            q = 1 / (1 + np.exp(-(a * z + b)))
            w = np.maximum(q * (1 - q), 1e-6)
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, [((q - target) * z).sum(), (q - target).sum()])
        self.scale = np.array([a, b])
        own = np.sort(scores(self, items)[labels > 0])
        self.threshold = float(own[int(np.floor((1 - recall) * len(own)))])

    def predict(self, codes: np.ndarray) -> np.ndarray:
        z = np.concatenate([self._forward(codes[i : i + 256])[0] for i in range(0, len(codes), 256)]) if len(codes) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -40, 40)))


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Secrets and look-alikes in made-up surroundings: (text, start, end) and label."""
    rng = np.random.default_rng(seed)
    chars = {"hex": "0123456789abcdef", "up": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "mix": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    draw = lambda kind, k: "".join(rng.choice(list(chars[kind]), k))
    low = "abcdefghijklmnopqrstuvwxyzéüñ"
    word = lambda: "".join(rng.choice(list(low), rng.integers(2, 9)))
    one = lambda *xs: xs[rng.integers(len(xs))]
    prose = lambda: " ".join(word() for _ in range(rng.integers(2, 6)))

    ascii_word = lambda: "".join(rng.choice(list(low[:26]), rng.integers(2, 9)))
    number = lambda k: str(rng.integers(0, 10**k))

    def password() -> str:
        """Eight to fifteen characters: random ones, or a word bent by digits and signs."""
        if rng.random() < 0.6:
            return draw("b64", rng.integers(8, 16))
        bent = "".join({"a": "4", "e": "3", "o": "0", "i": "1"}.get(c, c) if rng.random() < 0.7 else c.upper() for c in ascii_word() + ascii_word())
        return bent + one("", "_", "-", "=", "+") + number(4)

    def secret() -> tuple[str, str]:
        if rng.random() < 0.3:
            return one("password is ", "the password: ", "pwd ", "pass: ", "login admin with ", "passphrase ", "PIN and key ", "my password was ", "credentials root / "), password()
        name = one("auth", "key", "private_key", "access_key", "bearer", "Authorization: Bearer", "credential", "client_id", "signing", "session")
        value = one(lambda: draw("hex", rng.integers(16, 64)), lambda: draw("mix", rng.integers(16, 48)), lambda: draw("b64", rng.integers(20, 64)) + one("", "=", "=="), lambda: one("ghp_", "sk-", "xoxb-", "glpat-", "pk_live_") + draw("mix", rng.integers(16, 40)), lambda: draw("up", rng.integers(16, 32)))()
        return one("", "", f"{name} ", f"{name}: ", f'{name} = "', f"{name} '"), value

    def camel() -> str:
        first = one("get", "set", "is", "load", "make", "find", "update", "on", ascii_word(), ascii_word().capitalize())
        return first + "".join(ascii_word().capitalize() for _ in range(rng.integers(1, 4))) + one("", "", "Id", "URL", "JSON", "V2") + one("", "", number(2))

    def plain() -> tuple[str, str]:
        value = one(
            lambda: f"{word()}{number(3)}.{word()}example.com",
            lambda: f"{word()}/{word()}/{number(4)}/{word()}.html",
            lambda: f"20{number(2)}-{number(2)}-{number(2)}T{number(2)}{number(2)}{number(2)}Z" + word(),
            lambda: f"{word()}_{word()}_{word()}_{number(3)}",
            lambda: f"{word()}-{word()}-{word()}-{number(2)}",
            lambda: "".join(word() for _ in range(4)) + number(2),
            lambda: f"v{number(1)}.{number(2)}.{number(2)}-{word()}-{word()}",
            lambda: f"{word()}{number(2)}.{word()}{number(2)}.{word()}.org",
            lambda: f"{number(6)}.{number(6)}.{number(4)}{word()}",
            camel,
            camel,
            lambda: f"{camel()}.{camel()}",
            lambda: f"{ascii_word().upper()}_{ascii_word().upper()}_{number(2)}{ascii_word()}",
            lambda: "-".join(draw("hex", k) for k in (8, 4, 4, 4, 12)),
            lambda: f"{one('INV', 'No', 'Ref', 'ISBN', 'SKU')}-{number(4)}-{number(6)}{ascii_word()[:1]}",
            lambda: f"src/{ascii_word()}/{camel()}.{one('py', 'java', 'ts', 'cpp')}",
            lambda: one("/", "www.", "") + "/".join(one(ascii_word, ascii_word, ascii_word, lambda: number(4), lambda: f"v{number(1)}", lambda: f"{ascii_word()}.{ascii_word()}")() for _ in range(rng.integers(3, 12))) + one("", ".html", ".tar.gz", ".json"),
            lambda: f"{ascii_word()}{number(4)}",
            lambda: f"{ascii_word().capitalize()}{ascii_word().capitalize()}",
        )()
        value = "".join(c for c in value if c.isascii())
        return one("", "", "see ", "file ", "on ", "id ", "call ", "class ", "the "), value

    items, labels = [], []
    while len(items) < n:
        label = len(items) % 2
        lead, value = secret() if label else plain()
        head = f"{prose()} {lead}"
        m = _CANDIDATE.search(value)
        if not m or not _MIXED.match(m[0]):
            continue
        text = f"{head}{value}" + one(" ", '" ', ". ", ", ", "\n") + prose()
        items.append((text, len(head) + m.start(), len(head) + m.end()))
        labels.append(label)
    return items, np.array(labels, float)


@lru_cache(maxsize=4)
def trained(findings: int = 4800, recall: float = 0.98, seed: int = 5) -> CharCNN:
    """The network, from ``findings`` labelled findings; a quarter is held out."""
    items, labels = labelled_findings(findings, seed)
    cut = findings * 3 // 4
    # Every view of a finding has the finding's label: here a secret is its whole candidate.
    shown = [(view, label) for item, label in zip(items[:cut], labels[:cut].tolist(), strict=True) for view in views(*item)]
    net = CharCNN()
    net.fit(_codes([view for view, _ in shown]), np.array([label for _, label in shown]))
    net.calibrate(items[cut:], labels[cut:], recall)
    return net


def scan(docs: DataFrame, net: CharCNN | None = None) -> DataFrame:
    """Per document: counts by kind, the digest of the pattern spans, and all spans."""
    spark = docs.sparkSession
    prepare(spark)
    net = net or trained()
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"

    def joined(spans) -> str:
        return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            where = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t)]
            found = scores(net, ((texts[i], s, e) for i, s, e in where))
            added: list[list] = [[] for _ in texts]
            for (i, s, e), score in zip(where, found, strict=True):
                if score >= net.threshold:
                    added[i].append((s, 3, e))
            for i, own in enumerate(added):
                if own and base[i]:
                    # Both lists are in order; a candidate is a maximal run, so the walk is linear.
                    starts = np.array([s for s, _, _ in base[i]])
                    ends = np.maximum.accumulate([e for _, _, e in base[i]])
                    k = np.searchsorted(starts, [e for _, _, e in own]) - 1
                    added[i] = [x for x, j in zip(own, k, strict=True) if j < 0 or ends[j] <= x[0]]
            count = lambda kind: pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    count(0),
                    count(1),
                    count(2),
                    pa.array([len(a) for a in added], pa.int64()),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                    pa.array([joined(sorted(b + a)) for b, a in zip(base, added, strict=True)]),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
