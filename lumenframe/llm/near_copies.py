"""Near copies at a Jaccard similarity of five-word shingles: SimHash with Golay-code keys, completed by prefix filtering.

Equal sets of shingles are merged first. Each set has a wide SimHash fingerprint (``simhash.wide_fingerprint``); the sets whose
fingerprints meet under a Golay-code key and are near are verified on the whole sets of 64-bit shingle hashes, and
the links become classes. That misses less than one in a thousand pairs at the similarity itself, and pairs of groups of
copies in which a fingerprint is paired with its nearest only.

What is missed is found among sets of different classes by prefix filtering, which is exact. Shingles are put in one
global order: those that recur in a sample of documents last, by their count there, the others by hash. Of a set of s
shingles only the first ``s - ceil(t * s) + 1`` are keys; two sets of similarity t or more share at least one of them,
whatever the order is, so no pair is lost: the sample only sets the speed. Keys are shuffled once; those of a single set,
most of them, go no further, and of keys with the same sets (as those of a passage have) one stays. All pairs of sets
of different classes are compared, in the task that holds their key, by 256 bits of their parity bitmaps and under
the first of the keys that they share, and those left by the whole bitmaps of at least two bits a shingle (the larger folded
to the smaller), which differ in at most as many bits as the sets differ in shingles, so this loses no pair either; what is
left is verified on the whole sets. A key with very many sets is dealt in blocks, pair of blocks by pair of blocks.

Words are maximal runs of other than ASCII white space, A-Z lower-cased. A text of fewer words than a shingle has its
whole sequence as the one shingle. Null and empty texts have the empty set and are copies of each other. Repeated rows
share their class; a null id never names a class while a non-null id is in it; an empty table gives an empty result.
"""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import files_for, key_groups, q, release, texts, written
from .decontaminate import shingle_hashes
from .graph import components

SIMILARITY = (4, 5)
SAMPLE_DOCS = 10_000
MAX_RECURRING = 200_000
DOCS_PER_FILE = 50_000  # of the intermediate tables
WORDS = ["w0", "w1", "w2", "w3"]
FIRST = [f"k{i}" for i in range(8)]
_NO_KEY = (1 << 63) - 1


def shingle_set(b: bytes | None, k: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(shingle_hashes(b.lower().split(), k)) if b else np.empty(0, np.uint64)


def set_id(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def parity(hashes: np.ndarray) -> bytes:
    """Whether an odd number of the set's hashes fall on each of 1024 bits or more, two a hash at least."""
    bits = 1 << max(10, (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(bits: bytes) -> np.ndarray:
    """A parity bitmap folded to four words."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, 4), axis=0).view(np.int64)


def odd_bits(a, b) -> int:
    """How many bits of two parity bitmaps differ, the larger folded to the smaller."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(a) != len(b):
        a, b = (a, b) if len(a) < len(b) else (b, a)
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def prefix(hashes: np.ndarray, recurring: np.ndarray, counts: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, int]:
    """(keys in order, how many of them do not recur in the sample)."""
    n, d = similarity
    keep = len(hashes) - -(-n * len(hashes) // d) + 1 if len(hashes) else 0
    rank = np.zeros(len(hashes), np.int64)
    if len(recurring) and len(hashes):
        at = np.minimum(np.searchsorted(recurring, hashes), len(recurring) - 1)
        rank = np.where(recurring[at] == hashes, counts[at], 0)
    order = np.lexsort((hashes, rank))[:keep]
    return hashes[order], int((rank[order] == 0).sum())


def recurring_shingles(docs: DataFrame, text: Column, k: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the shingles of at least three documents of a sample of about ``SAMPLE_DOCS``."""

    def shingles(batches):
        import pyarrow as pa

        for batch in batches:
            for b in texts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(b, k).view(np.int64))], names=["key"])

    every = max(1, rows // SAMPLE_DOCS)
    part = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(every)) == 0)
    rows = part.mapInArrow(shingles, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(F.desc("n"), "key").limit(MAX_RECURRING).toArrow()
    key, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def _mixed(x: np.ndarray, odd: int) -> np.ndarray:
    x = x.view(np.uint64) * np.uint64(odd)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key another set has, and all rows of keys that are dealt in blocks. ``at``: size and place in one.
    ``s0, s1``: equal for keys that have the same sets."""

    def meet(batches):
        import pyarrow as pa

        for key, part, sid, at in key_groups(batches):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            stay = ~new | ~np.concatenate([new[1:], [True]]) | (part > 0)
            if stay.any():
                start, group = np.nonzero(new)[0], np.cumsum(new) - 1
                sums = [np.add.reduceat(_mixed(sid, odd), start).view(np.int64)[group] for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                sums = [np.where(part > 0, own, x) for own, x in zip((key, -1), sums, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (key, sid, at, *sums)], names=["key", "sid", "at", "s0", "s1"])

    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(meet, "key long, sid long, at long, s0 long, s1 long")


def _candidates(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(u, v) of different classes that meet under a key and may be similar by their sizes and places in the order."""
    num, den = similarity

    def meet(batches):
        import pyarrow as pa

        def found(key, part, size, pos, sid, label, *more):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            group = np.cumsum(new) - 1

            def near(a, b):
                small, big = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                most = np.minimum(pos[a], pos[b]) + np.minimum(size[a] - pos[a], size[b] - pos[b])
                ok = (den * small >= num * big) & ((den + num) * most >= num * (small + big)) & (label[a] != label[b])
                a, b, total = a[ok], b[ok], (small + big)[ok]
                if len(a):
                    odd = sum(np.bitwise_count((w[a] ^ w[b]).view(np.uint64)).astype(np.int64) for w in words)
                    ok = odd <= total - 2 * -(-num * total // (den + num))
                    a, b = a[ok], b[ok]
                    before = np.zeros(len(a), bool)  # they meet under a smaller key too
                    for x in first:
                        for y in first:
                            before |= (x[a] == y[b]) & (x[a] < key[a])
                    a, b = a[~before], b[~before]
                return sid[a], sid[b]

            words, first = more[: len(WORDS)], more[len(WORDS) :]
            active, step = np.nonzero(~np.concatenate([new[1:], [True]]))[0], 1
            while len(active):
                yield near(active, active + step)
                step += 1
                active = active[active + step < len(key)]
                other = active + step
                active = active[(group[active] == group[other]) & (den * size[active] >= num * size[other])]

        for columns in key_groups(batches):
            for u, v in found(*columns):
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    dealt = rows.select("key", "part", "size", "pos", "sid", "label", *WORDS, *FIRST).repartition("key", "part").sortWithinPartitions("key", "part", "size", "sid")
    return dealt.mapInArrow(meet, "u long, v long").distinct()


def _alike(pairs: DataFrame, one: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose bitmaps allow the similarity."""
    num, den = similarity

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            ok = [i for i, (a, b, t) in enumerate(zip(batch.column(3), batch.column(4), batch.column(2).to_pylist(), strict=True)) if odd_bits(a.as_buffer(), b.as_buffer()) <= t - 2 * -(-num * t // (den + num))]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(ok, pa.int64())) for c in batch.columns[:2]], names=["u", "v"])

    bits = one.select("sid", "size", "bits")
    both = pairs.join(bits.toDF("u", "su", "a"), "u").join(bits.toDF("v", "sv", "b"), "v").select("u", "v", (F.col("su") + F.col("sv")).alias("total"), "a", "b")
    return both.mapInArrow(check, "u long, v long")


def _verified(pairs: DataFrame, docs: DataFrame, text: Column, k: int, similarity: tuple[int, int], files: int) -> DataFrame:
    """The pairs of at least the similarity."""
    num, den = similarity

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            found = [shingle_set(b, k) for b in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["sid", "shingles"])

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            ok = []
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]))
                if (den + num) * int((both[1:] == both[:-1]).sum()) >= num * (len(a) + len(b)):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(ok, pa.int64())) for c in batch.columns[:2]], names=["u", "v"])

    wanted = written(pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))).distinct(), "near-wanted", files)
    held = written(docs.select(text.alias("text")).mapInArrow(sets, "sid long, shingles binary").join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "near-sets", files)
    both = pairs.join(held.toDF("u", "a"), "u").join(held.toDF("v", "b"), "v").select("u", "v", "a", "b")
    out = written(both.mapInArrow(check, "u long, v long"), "near-links", files)
    release(wanted)
    release(held)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: tuple[int, int] = SIMILARITY, block: int = 2048) -> DataFrame:
    """(id, component_id) for each document: the smallest id reachable over pairs of at least the similarity (a fraction)."""
    spark = docs.sparkSession
    text = q(text_col)
    n_docs = docs.count()
    files = files_for(spark, n_docs, DOCS_PER_FILE)
    plan = simhash.wide_plan(n_docs, similarity[0] / similarity[1])
    n_words = simhash.wide_words(plan[1])
    shared = spark.sparkContext.broadcast(recurring_shingles(docs, text, shingle_words, n_docs))

    def describe(batches):
        import pyarrow as pa

        for batch in batches:
            sid, size, rare, bits, keys, words, prints = [], [], [], [], [], [], []
            for b in texts(batch.column(1)):
                s = shingle_set(b, shingle_words)
                p, r = prefix(s, *shared.value, similarity)
                sid.append(set_id(s))
                size.append(len(s))
                rare.append(r)
                bits.append(parity(s))
                words.append(folded(bits[-1]))
                prints.append(simhash.wide_fingerprint(s, n_words))
                keys.append(p.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sid, pa.int64()), pa.array(size, pa.int64()), pa.array(rare, pa.int64()), pa.array(bits, pa.binary()), lists, *map(pa.array, np.array(words).reshape(-1, 4).T.copy()), pa.array(prints, pa.binary())], names=["id", "sid", "size", "rare", "bits", "keys", *WORDS, "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + T._parse_datatype_string("sid long, size long, rare long, bits binary, keys array<long>, w0 long, w1 long, w2 long, w3 long, fp binary").fields)
    whole = written(docs.select(q(id_col).alias("id"), text.alias("text")).mapInArrow(describe, schema), "near-whole")
    own = written(whole.select("id", "sid"), "near-docs", files)
    reps = own.groupBy("sid").agg(F.min("id").alias("rep"))
    one = written(whole.drop("id").dropDuplicates(["sid"]), "near-distinct", files)
    release(whole)
    rows = one.select("sid", "size", "rare", F.posexplode("keys").alias("pos", "key"))
    often = written(rows.where("pos >= rare").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * block), "near-often", files)
    n_blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
    mine = F.pmod(F.xxhash64("sid"), n_blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(often), "key", "left")

    def dealt(rows: DataFrame) -> DataFrame:
        rows = marked(rows).select("key", F.shiftright("at", 32).alias("size"), F.col("at").bitwiseAND((1 << 32) - 1).alias("pos"), "sid", "label", n_blocks.alias("nb"), mine.alias("mine"), other.alias("other"), *WORDS, *FIRST)
        return rows.withColumn("part", F.least("mine", "other") * F.col("nb") + F.greatest("mine", "other"))

    def collected() -> None:
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # shuffle files of plans that are done go

    keyed = marked(rows).select("key", F.when(F.col("n").isNull(), 0).otherwise(1 + mine).cast("long").alias("part"), "sid", (F.shiftleft(F.col("size"), 32) + F.col("pos")).alias("at"))
    met = written(_shared(keyed), "near-met", files)
    shared_rows = written(met.join(met.groupBy("s0", "s1").agg(F.min("key").alias("key")).select("key"), "key", "left_semi").select("key", "sid", "at"), "near-shared", files)
    release(met)
    bits = written(one.select("sid", "size", "bits", *WORDS, "fp"), "near-bits", files)
    release(one)
    collected()
    first = written(_alike(simhash.wide_links(bits.select("sid", "fp"), *plan, block), bits, similarity), "near-fingerprints", files)
    links = _verified(first, docs, text, shingle_words, similarity, files)
    labels = written(components(links).select(F.col("node").alias("sid"), F.col("root").alias("label")), "near-labels", files)
    named = bits.join(labels, "sid", "left").select("sid", F.coalesce("label", "sid").alias("label"), *WORDS)
    firsts = shared_rows.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("key")), 1, len(FIRST)).alias("keys"))
    named = named.join(firsts, "sid").select("sid", "label", *WORDS, *[F.coalesce(F.get("keys", F.lit(i)), F.lit(_NO_KEY)).alias(c) for i, c in enumerate(FIRST)])
    named = shared_rows.join(named, "sid").select("key", "sid", "at", "label", *WORDS, *FIRST)
    collected()
    second = written(_alike(_candidates(dealt(named), similarity), bits, similarity), "near-pairs", files)
    links = links.unionByName(_verified(second, docs, text, shingle_words, similarity, files))
    collected()
    linked = written(components(links), "near-classes", files)
    of_root = linked.join(reps, F.col("node") == F.col("sid")).groupBy("root").agg(F.min("rep").alias("least"))
    least = linked.join(of_root, "root").select(F.col("node").alias("sid"), "least")
    classes = written(reps.join(least, "sid", "left").select("sid", F.coalesce("least", "rep").alias("component_id")), "near-ids", files)
    for table in (shared_rows, bits, first, second, often, labels, linked):
        release(table)
    return own.join(classes, "sid").select(F.col("id").alias(id_col), "component_id")
