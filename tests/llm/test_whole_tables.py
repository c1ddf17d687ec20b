"""The registered queries against plain versions on whole tables of the smallest folder."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from lumenframe.llm import ordinal, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_statistics(spark, texts):
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = WORD.findall(t or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and (not r.base_failed or not r.kept)


def test_op4_fingerprints_and_components(spark, texts):
    def fingerprint(t):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[j : j + 3]).encode(), 42) for j in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    near = {i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3] for i in prints}
    component = {}
    for i in sorted(prints):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in component:
                component[j] = i
                todo += near[j]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash_dedup(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", component[i]) for i in prints}


def test_op6_round_trip(spark, texts):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(path), 0, {}
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_token_files(spark, SF).collect()} == want


def test_op8_law_of_rows(spark, texts):
    got = queries.op8_sharding(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9_against_a_plain_solver(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    by = defaultdict(list)
    for r in docs:
        by[r.source].append(r.doc_id)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    whole = {s: sum(size[i] for i in by[s]) for s in names}
    target, left, todo = {}, 1.5 * sum(whole.values()), list(names)
    while todo:
        share = {s: left * weight[s] / sum(weight[x] for x in todo) for s in todo}
        full = [s for s in todo if share[s] > 2 * whole[s]]
        target |= {s: 2.0 * whole[s] for s in full} if full else share
        left -= sum(2 * whole[s] for s in full)
        todo = [s for s in todo if s not in full] if full else []
    got = {r.doc_id: r for r in queries.op9_mixing(spark, SF).collect()}
    for s in names:
        assert all(got[i].target == pytest.approx(target[s], rel=1e-9) and got[i].source_size == whole[s] for i in by[s])
        low, high, mean = -60.0, 60.0, whole[s] / len(by[s])
        rate = lambda lam: {i: min(2.0, math.exp(min(60, lam * size[i] / mean))) for i in by[s]}
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(size[i] * w for i, w in rate(mid).items()) > target[s] else (mid, high)
        for i, w in rate(high).items():  # whole copies beside the dual's rate
            assert got[i].taken == got[i].copies * size[i] and (not size[i] or math.floor(w - 1e-6) <= got[i].copies <= math.ceil(w + 1e-6))
        assert abs(sum(got[i].taken for i in by[s]) - target[s]) <= max(0.03 * target[s], max(size[i] for i in by[s]))


def test_op2_fit_of_nulls_repeats_and_empty_tables(spark):
    rows = [(i, f"{'fine' if i % 2 else 'awful'} text w{i % 7} w{i % 11}") for i in range(400)]
    odd = [(None, "fine"), (3, "awful other text"), (5, None), (6, ""), (7, "word " * 50_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (8, None), (9, 1), (9, 1), (12345, 0)], "doc_id long, quality int")
    models = []
    for shuffled in (False, True):
        d = spark.createDataFrame(rows + odd if not shuffled else (rows + odd)[::-1], "doc_id long, text string")
        models.append(ordinal.fit(d.repartition(7) if shuffled else d, labels, labels["quality"], 1.0))
    assert (models[0].weights == models[1].weights).all() and models[0].cut == models[1].cut
    assert models[0].held_out["labelled_rows_read"] == 400 and models[0].held_out["bad_rejected"] > 0.9
    got = {r.doc_id: r for r in ordinal.score(spark.createDataFrame(rows, "doc_id long, text string"), models[0]).collect()}
    assert sum(got[i].kept == bool(i % 2) for i in got) > 380
    few = ordinal.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, labels["quality"], 1.0, max_text_bytes=200)
    assert 0 < few.held_out["labelled_rows_read"] < 20
    none = ordinal.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0), labels["quality"], 1.0)
    assert none.levels == [0.0] and none.cut == 0.0
