"""The pipeline's near_duplicates stage gets its classes through SimHash and Golay-code keys; prefix filtering completes them."""

import numpy as np
import pytest

import corpus_pipeline
from lumenframe.llm import near_copies, simhash


def pairs_of_copies(n=300):
    """Texts two by two: the second has some words of the first replaced, at similarities from 0.8 to 0.95."""
    rng = np.random.default_rng(5)
    rows, similar = [], []
    while len(similar) < n:
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(60, 300)))]
        near = list(words)
        for at in rng.integers(0, len(near), int(rng.integers(1, 1 + len(near) // 40))):
            near[at] = f"new{rng.integers(10**6)}"
        a, b = (near_copies.shingle_set(" ".join(w).encode()) for w in (words, near))
        both = len(np.intersect1d(a, b))
        if 9 * both >= 4 * (len(a) + len(b)) and both < 0.97 * len(a):
            similar.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(near))]
    return rows, similar


def fingerprints(spark, texts, plan):
    sets = [near_copies.shingle_set(t.encode()) for t in texts]
    return spark.createDataFrame([(i, bytearray(simhash.wide_fingerprint(s, simhash.wide_words(plan[1])))) for i, s in enumerate(sets)], "sid long, fp binary")


def test_stage_finds_copies_by_fingerprints(spark, monkeypatch):
    rows, similar = pairs_of_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = near_copies._candidates
    monkeypatch.setattr(near_copies, "_candidates", lambda *args: whole(*args).limit(0))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert sum(b in kept for _, b in similar) <= 0.01 * len(similar)
    assert {a for a, _ in similar} <= kept


def test_fingerprints_that_are_near_meet(spark):
    rows, similar = pairs_of_copies()
    plan = simhash.wide_plan(len(rows), 0.8)
    met = {(r.u, r.v) for r in simhash.wide_links(fingerprints(spark, [t for _, t in rows], plan), *plan).collect()}
    assert len(set(similar) & met) >= 0.99 * len(similar) and len(met - set(similar)) <= 0.01 * len(similar)


@pytest.mark.parametrize("block", [16, 2048])
def test_large_group_of_copies_gives_few_pairs(spark, block):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in range(200)]
    texts = []
    for _ in range(400):
        near = list(base)
        for at in rng.integers(0, 200, 2):
            near[at] = f"new{rng.integers(10**6)}"
        texts.append(" ".join(near))
    plan = simhash.wide_plan(len(texts), 0.8)
    met = simhash.wide_links(fingerprints(spark, texts, plan), *plan, block).collect()
    assert all(r.u < r.v for r in met) and len({(r.u, r.v) for r in met}) == len(met) <= simhash.NEAREST * len(texts)
    assert {r.v for r in met} == set(range(1, 400))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()] == [0]


def test_wide_fingerprint_of_a_set():
    h = np.random.default_rng(7).integers(0, 1 << 64, 600, dtype=np.uint64)
    bits = np.unpackbits(simhash._mix(h[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, 4, dtype=np.uint64)).view(np.uint8)).reshape(600, -1)
    assert simhash.wide_fingerprint(h, 3) == np.packbits(2 * bits.sum(0, dtype=np.int64) > 600).tobytes()
    assert simhash.wide_fingerprint(h[:0], 3) == bytes(24)
