"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector over hashed text features and ordered thresholds.
Features of a text are the distinct words (A-Z lower-cased, ASCII punctuation off), the distinct first four bytes of longer
words, which stand for a stem and its endings, and the shapes of its tokens, hashed to 2**18 places; the shape features
carry their share of the text. Weights have an absolute-value penalty and only places that several fitted rows share get
one: without these, chance weights of rare words outweigh the few words that mark a grade. The model gives the expected grade and the probability
of each tail; selection keeps a text whose tail probability passes a cut calibrated on labelled rows left out of the fit.

The fit sees at most ``max_labelled`` labelled documents, in hash order of their ids; scoring covers all documents and
whole texts.

Defined results: a null or empty text has no feature and gets the model's intercepts; repeated rows get equal scores;
without two grades among the labelled rows all texts score the one grade seen (0 if none) and are kept; an empty table
gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_fold_table, q, texts

BITS = 18
_FOLD = ascii_fold_table()
STEM = 4
_SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))


class _Places(dict):
    """key -> place; emptied when it grows large."""

    def __missing__(self, key):
        import xxhash

        if len(self) > 150_000:
            self.clear()
        self[key] = h = xxhash.xxh32_intdigest(key) >> (32 - BITS)
        return h


_PLACES = _Places()


def _squeezed(shape: bytes) -> bytes:
    return bytes(c for i, c in enumerate(shape) if not i or c != shape[i - 1])[:6]


class _Shapes(dict):
    def __missing__(self, token):
        if len(self) > 150_000:
            self.clear()
        self[token] = s = b"\x01" + _squeezed(token.translate(_SHAPE))
        return s


_SHAPES = _Shapes()


def features(b: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text."""
    if not b or not (tokens := b.split()):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    distinct = set(b.translate(_FOLD).split())
    stems = {b"\x02" + w[:STEM] for w in distinct if len(w) > STEM}
    words = [*map(_PLACES.__getitem__, distinct), *map(_PLACES.__getitem__, stems)]
    shapes: dict = {}
    for s in map(_SHAPES.__getitem__, tokens):
        shapes[s] = shapes.get(s, 0) + 1
    places = np.array(words + [_PLACES[s] for s in shapes], np.int32)
    values = np.ones(len(places), np.float32)
    values[len(words) :] = 8 * np.sqrt(np.fromiter(shapes.values(), np.float32, len(shapes)) / len(tokens))
    return places, values


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    """Grades ``levels`` (ascending), weights and thresholds; ``cut`` is the least tail probability that is kept."""

    levels: list[float]
    weights: np.ndarray
    thresholds: np.ndarray
    tail_level: float = 1.0
    cut: float = 0.0
    held_out: dict = field(default_factory=dict)

    def linear(self, values, n: int) -> np.ndarray:
        out = np.zeros(n)
        for i, b in enumerate(values):
            p, v = features(b)
            out[i] = float(self.weights[p] @ v)
        return out

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > level k) for each row and k."""
        return _sigmoid(z[:, None] - self.thresholds[None, :])

    def score(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade >= tail_level))."""
        t = self.tails(z)
        steps = np.diff(self.levels)
        k = int(np.searchsorted(self.levels, self.tail_level))
        tail = np.ones(len(z)) if k == 0 else t[:, k - 1] if k < len(self.levels) else np.zeros(len(z))
        return self.levels[0] + t @ steps, tail


def train(rows: list[tuple[bytes, float]], tail_level: float = 1.0, l1: float = 5e-4, least_rows: int = 8, rounds: int = 300, rate: float = 0.05) -> OrdinalModel:
    """Full-batch proximal Adam on four fifths of ``rows``; the rest calibrates ``cut``. ``l1``: penalty of a weight's
    absolute value. ``least_rows``: a place that fewer fitted rows have gets no weight."""
    levels = sorted({g for _, g in rows})
    if len(levels) < 2:
        return OrdinalModel(levels or [0.0], np.zeros(1 << BITS, np.float32), np.zeros(0), tail_level)
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    used = [r for i, r in enumerate(rows) if i % 5]
    y = np.array([levels.index(g) for _, g in used])
    each = [features(b) for b, _ in used]
    where = np.concatenate([p for p, _ in each])
    value = np.concatenate([v for _, v in each])
    row = np.repeat(np.arange(len(each)), [len(p) for p, _ in each])
    shared = np.bincount(where, minlength=1 << BITS)[where] >= least_rows
    places, where = np.unique(where[shared], return_inverse=True)
    value, row = value[shared].astype(np.float64), row[shared]
    k = len(levels) - 1
    w, n = np.zeros(len(places)), len(y)
    share = np.clip([(y <= i).mean() for i in range(k)], 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(share / (1 - share)))
    gap = np.log(np.maximum(1e-2, np.diff(theta)))  # thresholds stay ordered: first, then positive gaps
    first = theta[0]
    par = np.concatenate([[first], gap])
    m1, v1, m2, v2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(par), np.zeros_like(par)
    weight = np.array([n / (len(levels) * max(1, (y == i).sum())) for i in range(len(levels))])[y]
    weight = np.sqrt(weight)
    for t in range(1, rounds + 1):
        theta = par[0] + np.concatenate([[0], np.cumsum(np.exp(par[1:]))])
        z = np.bincount(row, value * w[where], minlength=n)
        up = np.append(theta, np.inf)[y] - z
        lo = np.concatenate([[-np.inf], theta])[y] - z
        su, sl = np.where(np.isinf(up), 1.0, _sigmoid(up)), np.where(np.isinf(lo), 0.0, _sigmoid(lo))
        p = np.maximum(su - sl, 1e-9)
        du, dl = su * (1 - su) / p * weight / n, sl * (1 - sl) / p * weight / n
        gz = du - dl  # of the loss by z
        gw = np.bincount(where, value * gz[row], minlength=len(w))
        gt = np.zeros(k)
        for i in range(k):
            gt[i] = -du[y == i].sum() + dl[y == i + 1].sum()
        gp = np.concatenate([[gt.sum()], np.exp(par[1:]) * np.cumsum(gt[::-1])[::-1][1:]])
        for x, g, m, v in ((w, gw, m1, v1), (par, gp, m2, v2)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            x -= step * (m / (1 - 0.9**t))
            if x is w:
                x[:] = np.sign(x) * np.maximum(np.abs(x) - step * l1, 0)
    theta = par[0] + np.concatenate([[0], np.cumsum(np.exp(par[1:]))])
    weights = np.zeros(1 << BITS, np.float32)
    weights[places] = w
    model = OrdinalModel(levels, weights, theta, tail_level)
    z = model.linear([b for b, _ in held], len(held))
    expected, tail = model.score(z)
    good = np.array([g >= tail_level for _, g in held])
    if good.any() and not good.all():
        cuts = np.unique(np.concatenate([[0.0], tail]))
        gain = [(tail[good] >= c).mean() + (tail[~good] < c).mean() for c in cuts]
        best = int(np.argmax(gain))
        below = tail[tail < cuts[best]]
        model.cut = float((cuts[best] + below.max()) / 2) if len(below) else float(cuts[best])
        model.held_out = {"rows": len(held), "good_kept": float((tail[good] >= model.cut).mean()), "bad_rejected": float((tail[~good] < model.cut).mean()), "grade_error": float(np.abs(expected - np.array([g for _, g in held])).mean())}
    return model


def fit(docs: DataFrame, labels: DataFrame, grade, tail_level: float, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 6000, max_text_bytes: int = 64 << 20) -> OrdinalModel:
    """``grade``: a column of ``labels``. At most ``max_labelled`` documents, and ``max_text_bytes`` of their texts, are read
    to the driver; of documents that repeat an id the least text is. ``held_out`` of the model tells how many rows were."""
    picked = labels.select(q(id_col).alias("id"), grade.cast("double").alias("g")).where("id is not null and g is not null").groupBy("id").agg(F.max("g").alias("g")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(q(id_col).alias("id"), q(text_col).alias("text")).where("text is not null").join(F.broadcast(picked), "id").groupBy("id", "g").agg(F.min("text").cast("binary").alias("b"))
    got, size = [], 0
    for r in rows.orderBy(F.xxhash64("id"), "id").toLocalIterator():
        if size + len(r["b"]) <= max_text_bytes:  # a text too long for what is left is passed over, not the end of the sample
            size += len(r["b"])
            got.append((bytes(r["b"]), r["g"]))
    model = train(got, tail_level)
    model.held_out["labelled_rows_read"] = len(got)
    return model


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tail_probability, kept) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("expected_grade double, tail_probability double, kept boolean")
    def grade(values):
        import pyarrow as pa

        m = shared.value
        expected, tail = m.score(m.linear(texts(values), len(values)))
        return pa.StructArray.from_arrays([pa.array(expected), pa.array(tail), pa.array(tail >= m.cut)], names=["expected_grade", "tail_probability", "kept"])

    return docs.select(q(id_col), grade(q(text_col)).alias("g")).select(q(id_col), "g.expected_grade", "g.tail_probability", "g.kept")
