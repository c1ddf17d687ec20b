"""Quality rules: base rules on text statistics plus an isolation forest over those statistics.

The forest isolates by random axis-parallel splits of the unit box of statistics. A region that holds few of the
known-good reference rows is cut off after few splits, so a short mean path length marks an anomalous document.
The cut on the score is calibrated on labelled rows. The forest and the calibration see bounded, documented samples
of the labelled rows; statistics and verdicts cover every document and the whole text.

Defined results: a null or empty text has zero statistics and fails the base rules; repeated rows get equal verdicts;
an empty table gives an empty result; with no labelled rows of a class the forest takes no part (base rules decide).
Input columns other than the id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, q, texts

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "symbols_per_word", "upper_share", "dup_line_share", "repeat_share", "shouts_per_word", "odd_punct_per_word",
    "digit_share", "mean_word_length", "lines_per_word", "longest_word", "log_words",
)
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_ODD = b"|_=~^@\\{}[]+<>#*$%&/"


def repeat_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more in the text, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v == n:
        return 0
    if v < 2_000_000:
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:  # the product would not fit 63 bits: number the pairs first
        pair = np.unique(a[:-1] * v + a[1:], return_inverse=True)[1]
        key = pair[:-1] * v + a[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def text_stats(b: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(STATS, FEATURES) of one UTF-8 text. Every feature lies in [0, 1]."""
    if not b or not (words := b.split()):
        return (0, 0, 0, 0, 0), (0.0,) * len(FEATURES)
    n, size = len(words), len(b)
    gone = lambda chars: size - len(b.translate(None, chars))
    chars = len(b.decode("utf-8", "replace")) - gone(SPACE)
    symbols = gone(SYMBOLS)
    seen, dup, lines = set(), 0, 0
    for line in b.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeats = repeat_words(words)
    upper, lower = gone(_UPPER), gone(_LOWER)
    features = (
        min(1.0, symbols / n), upper / max(1, upper + lower), dup / lines, repeats / n, min(1.0, gone(b"!?") / n),
        min(1.0, gone(_ODD) / n), min(1.0, 4 * gone(_DIGIT) / size), min(1.0, chars / n / 24), min(1.0, 4 * lines / n),
        min(1.0, math.log1p(max(map(len, words))) / 8), min(1.0, math.log1p(n) / 16),
    )
    return (n, chars, symbols, dup, repeats), features


def base_failed(n_words, n_repeat_words, min_words: int = 50, max_repeat_percent: int = 50):
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat_percent * n_words)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points (Liu, Ting and Zhou 2008)."""
    m = np.maximum(n, 2).astype(float)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))


@dataclass
class IsolationForest:
    """Random splits of the unit box; each tree sees ``psi`` reference rows. Nodes of all trees lie in flat arrays: a
    node's children are ``child`` and the one after it, ``child`` 0 marks a leaf."""

    root: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    psi: int

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 200, psi: int = 256, depth: int = 14, seed: int = 7) -> IsolationForest:
        rng, dims = np.random.default_rng(seed), x.shape[1]
        roots, feature, split, child, path = [], [], [], [], []

        def node() -> int:
            feature.append(0)
            split.append(0.0)
            child.append(0)
            path.append(0.0)
            return len(path) - 1

        for _ in range(trees):
            rows = x[rng.choice(len(x), min(psi, len(x)), replace=False)]
            roots.append(node())
            todo = [(roots[-1], rows, np.zeros(dims), np.ones(dims), 0)]
            while todo:
                k, r, lo, hi, d = todo.pop()
                if d == depth or len(r) <= 1:
                    path[k] = d + float(_average_path(np.array(len(r))))
                    continue
                f = int(rng.integers(dims))
                s = float(rng.uniform(lo[f], hi[f]))
                feature[k], split[k], child[k] = f, s, node()
                node()
                left_hi, right_lo = hi.copy(), lo.copy()
                left_hi[f] = right_lo[f] = s
                below = r[:, f] < s
                todo += [(child[k], r[below], lo, left_hi, d + 1), (child[k] + 1, r[~below], right_lo, hi, d + 1)]
        return cls(np.array(roots), np.array(feature, np.int16), np.array(split), np.array(child, np.int32), np.array(path), min(psi, len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): larger means more anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            while True:
                inner = self.child[node] > 0
                if not inner.any():
                    break
                step = self.child[node] + (x[rows, self.feature[node]] >= self.split[node])
                node = np.where(inner, step, node)
            total += self.path[node]
        return 2 ** (-total / len(self.root) / max(1e-9, float(_average_path(np.array(max(2, self.psi))))))


def calibrate(good: np.ndarray, bad: np.ndarray, keep_good: float) -> float:
    """The score cut with the best balanced accuracy among those that keep at least ``keep_good`` of the good rows."""
    low = float(np.quantile(good, keep_good))
    cuts = np.unique(np.concatenate([good[good >= low], bad[bad >= low]]))
    cuts = np.append(cuts, cuts[-1] + 1e-6) if len(cuts) else np.array([low])
    edges = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    gain = [(good <= c).mean() + (bad > c).mean() for c in edges]
    return float(edges[int(np.argmax(gain))])


@dataclass
class QualityModel:
    forest: IsolationForest | None
    cut: float


def _stats_udf(model: QualityModel | None):
    fields = [f"{s} long" for s in STATS] + ["base_failed boolean", "kept boolean", "score double", "features array<double>"]

    @F.arrow_udf(", ".join(fields))
    def stats(values):
        import pyarrow as pa

        both = [text_stats(b) for b in texts(values)]
        s = np.array([x[0] for x in both], np.int64).reshape(-1, len(STATS))
        f = np.array([x[1] for x in both], float).reshape(-1, len(FEATURES))
        failed = base_failed(s[:, 0], s[:, 4])
        kept, score = ~failed, np.zeros(len(s))
        if model is not None and model.forest is not None and len(s):
            score = model.forest.score(f)
            kept &= score <= model.cut
        arrays = [pa.array(c) for c in s.T] + [pa.array(failed), pa.array(kept), pa.array(score), pa.array(list(f), pa.list_(pa.float64()))]
        return pa.StructArray.from_arrays(arrays, names=[*STATS, "base_failed", "kept", "score", "features"])

    return stats


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
        max_labelled: int = 12_000, keep_good: float = 0.97) -> QualityModel:
    """Fit the forest and its cut on at most ``max_labelled`` labelled documents, taken in hash order of their ids.

    Every second good row (in hash order) is a reference row of the forest; the others and the bad rows calibrate
    the cut, which keeps at least ``keep_good`` of the good ones.
    """
    picked = (
        labels.select(q(id_col).alias("id"), q(quality_col).alias("y")).where("id is not null and y is not null")
        .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    found = (
        docs.select(q(id_col).alias("id"), q(text_col).alias("text")).join(F.broadcast(picked), "id")
        .select("id", "y", _stats_udf(None)("text").alias("s"))
    )
    # No filter on the statistics: it would be pushed below the join and compute them for all documents.
    passed = F.when(~F.col("s.base_failed"), F.col("s.features"))
    rows = found.groupBy("id", "y").agg(F.min(passed).alias("features")).orderBy(F.xxhash64("id"), "id").collect()
    rows = [r for r in rows if r["features"] is not None]
    good = np.array([r["features"] for r in rows if r["y"] > 0]).reshape(-1, len(FEATURES))
    bad = np.array([r["features"] for r in rows if r["y"] <= 0]).reshape(-1, len(FEATURES))
    if len(good) < 8 or not len(bad):
        return QualityModel(None, 1.0)
    forest = IsolationForest.fit(good[::2])
    return QualityModel(forest, calibrate(forest.score(good[1::2]), forest.score(bad), keep_good))


def verdicts(text: Column, model: QualityModel | None = None) -> Column:
    """A struct of the statistics, ``base_failed``, ``kept``, ``score`` and the forest's ``features`` of a text."""
    return _stats_udf(model)(text)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """One row per document: id, statistics, ``base_failed``, ``kept``, anomaly ``score``."""
    model = fit(docs, labels, id_col, text_col, **fit_options)
    return docs.select(q(id_col), verdicts(q(text_col), model).alias("v")).select(q(id_col), *[f"v.{s}" for s in STATS], "v.base_failed", "v.kept", "v.score")
