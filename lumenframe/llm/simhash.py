"""SimHash near-duplicates with Golay-code fuzzy keys.

A 64-bit fingerprint has four segments of 16 bits. Two fingerprints at 3 or fewer differing bits agree exactly on at
least one segment (pigeonhole), and the 48 bits beside it fall into two halves of 24. Either half A differs in at most
two bits, or half B is equal. For half A (23 of its bits) the perfect binary Golay code [23, 12, 7] gives fuzzy keys:
the codewords that the word itself and its 23 neighbours at one bit decode to, one or six indices of 12 bits. Two words
at up to two differing bits share such a key (that of a word between them). So every pair within 3 bits meets under
one of at most 4 * (6 + 1) keys; pairs that meet are verified on all 64 bits. No pair within the distance is lost.

Equal fingerprints are merged before any key is made. A key with very many fingerprints is dealt in blocks, pair of
blocks by pair of blocks; within a task only a spanning forest of the verified links is emitted, never all pairs.

For similarities that 3 bits cannot reach there are wide fingerprints (:func:`wide_fingerprint`, 64 bits a word) with
keys of the same code: a table takes 32 bits, a Golay word and a few bits as they are. :func:`wide_plan` takes as many tables
as leave less than one in a thousand pairs at the similarity without a common key; two words that no key uses tell
the pairs that meet by chance. Only the pairs just at the similarity can be missed; the caller completes them.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a document of fewer words than
a shingle has its whole sequence as the one shingle; repeated rows share fingerprint and class; a null id never names a
class while a non-null id is in it; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, log, pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_groups, q, release, texts, written
from .graph import components

MAX_BITS = 3
SLOT_SAMPLE = 1 << 20
MAX_HOT = 200_000
MISSED = 0.001
NEAREST = 8
_GENERATOR = 0xC75  # fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1
_MASK23 = (1 << 23) - 1


def fingerprint(b: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64 values."""
    import xxhash

    words = (b or b"").lower().split()
    if not words:
        return 0
    n = len(words)
    if n <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    k = shingle_words - 1
    h = np.frombuffer(b"".join([digest(flat[i:j], seed) for i, j in zip(starts[: n - k].tolist(), ends[k:].tolist(), strict=True)]), np.uint8).reshape(-1, 8)
    count = np.bincount((h.astype(np.int64) + 256 * np.arange(8)).ravel(), minlength=2048).reshape(8, 256)
    bits = count @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return int.from_bytes(np.packbits(2 * bits > n - k).tobytes(), "big")


def fingerprint_column(text: Column, shingle_words: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def udf(values):
        import pyarrow as pa

        return pa.array(np.array([fingerprint(b, shingle_words) for b in texts(values)], np.uint64).view(np.int64))

    return udf(text)


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of the high 12 bits by the generator, error of at most 3 bits by remainder): two small tables that decode."""
    high = np.arange(4096, dtype=np.int64) << 11
    rest = high.copy()
    for i in range(22, 10, -1):
        rest ^= ((rest >> i) & 1) * (_GENERATOR << (i - 11))
    errors = [0]
    for i in range(23):
        errors += [e | 1 << i for e in errors if e.bit_count() < 3]
    errors = np.array(errors)
    table = np.empty(2048, np.int64)
    table[rest[errors >> 11] ^ (errors & 0x7FF)] = errors
    return rest, table


def golay_decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index (high bits) of the codeword nearest to each 23-bit word, always within 3 bits."""
    rest, errors = golay_tables()
    return ((words ^ errors[rest[words >> 11] ^ (words & 0x7FF)]) >> 11).astype(np.int16)


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the codeword indices of each 23-bit word and its neighbours at one bit, each once."""
    around = np.concatenate([[0], 1 << np.arange(23)])
    keys = np.sort(golay_decode(words[:, None] ^ around), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new].astype(np.int64)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each unsigned fingerprint; a key names its table (3 bits) and its value (40 bits)."""
    rows, keys = [], []
    for i in range(4):
        exact = ((fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64)
        low = fp & np.uint64((1 << 16 * i) - 1)
        rest = ((fp >> np.uint64(16 * i)) >> np.uint64(16)) << np.uint64(16 * i) | low
        a, b = (rest & np.uint64(0xFFFFFF)).astype(np.int64), (rest >> np.uint64(24)).astype(np.int64)
        r, k = golay_keys(a & _MASK23)
        rows += [r, np.arange(len(fp))]
        keys += [(2 * i) << 40 | exact[r] << 12 | k, (2 * i + 1) << 40 | exact << 24 | b]
    return np.concatenate(rows), np.concatenate(keys)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spanning_links(fp: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within ``max_bits`` among unsigned fingerprints."""
    out, left = [], fp
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            f = front.pop()
            near = np.bitwise_count(left ^ f) <= max_bits
            if near.any():
                hit = left[near]
                out.append((np.full(len(hit), f), hit))
                left = left[~near]
                front.extend(hit)
    return out


def _slots(some: DataFrame, keys_of, bits: int, every: int) -> DataFrame:
    def count(batches):
        import pyarrow as pa

        for b in (batch.slice(at, 2048) for batch in batches for at in range(0, len(batch), 2048)):
            slot, n = np.unique((_mix(keys_of(b)) & np.uint64((1 << bits) - 1)).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], names=["slot", "n"])

    return some.mapInArrow(count, "slot long, n long").groupBy("slot").agg((F.sum("n") * every).alias("n"))


def _hot(rows: DataFrame, keys_of, n: int, block: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits of a slot, hot slots, blocks of each): hashed slots of keys that are dealt in blocks.

    Keys are counted in slots over all of the ``n`` rows up to ``SLOT_SAMPLE`` and over about as many beyond; whether a slot
    is dealt in blocks decides where its pairs meet, not which. A slot is hot above ``2 * block`` rows, 8 times the mean and
    one ``MAX_HOT``-th of all rows, so at most ``MAX_HOT`` are. Rows are told by their first column.
    """
    bits, every = min(30, max(16, (n // 4).bit_length())), max(1, n // SLOT_SAMPLE)
    some = rows.where(F.pmod(F.xxhash64(rows.columns[0]), F.lit(every)) == 0)
    slots = written(_slots(some, keys_of, bits, every), "simhash-slots")
    total = slots.agg(F.sum("n")).first()[0] or 0
    hot = slots.where(F.col("n") > max(2 * block, 8 * total / (1 << bits), total / MAX_HOT)).orderBy("slot").toArrow()
    release(slots)
    return bits, hot.column("slot").to_numpy(), -(-hot.column("n").to_numpy() // block)


def _deal(row: np.ndarray, key: np.ndarray, who: np.ndarray, bits: int, hot_slot: np.ndarray, hot_blocks: np.ndarray) -> tuple:
    """(row, key, part): keys of hot slots once for each pair of blocks that the row's own (by ``who``) is of, others as they are."""
    part = np.zeros(len(key), np.int64)
    if len(hot_slot):
        slot = (_mix(key) & np.uint64((1 << bits) - 1)).astype(np.int64)
        k = np.minimum(np.searchsorted(hot_slot, slot), len(hot_slot) - 1)
        is_hot = hot_slot[k] == slot
        if is_hot.any():
            nb = hot_blocks[k[is_hot]]
            mine = (_mix(who[row[is_hot]]) % nb.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(nb)), nb)
            other = np.arange(len(again)) - np.repeat(np.cumsum(nb) - nb, nb)
            lo, hi = np.minimum(mine[again], other), np.maximum(mine[again], other)
            hot_row, hot_key = row[is_hot][again], key[is_hot][again]
            row, key = np.concatenate([row[~is_hot], hot_row]), np.concatenate([key[~is_hot], hot_key])
            part = np.concatenate([part[~is_hot], 1 + lo * nb[again] + hi])
    return row, key, part


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = 2048) -> DataFrame:
    """(u, v): links among the distinct signed fingerprints of ``fps.fp``, enough to connect all within ``max_bits``."""
    if max_bits > MAX_BITS:
        raise ValueError("the keys cover up to 3 differing bits")
    hot = _hot(fps.select("fp"), lambda b: fuzzy_keys(b.column(0).to_numpy().view(np.uint64))[1], fps.count(), block)
    shared = fps.sparkSession.sparkContext.broadcast(hot)

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(whole), 4096):
                fp = whole[at : at + 4096]
                row, key, part = _deal(*fuzzy_keys(fp), fp, *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(fp[row].view(np.int64))], names=["key", "part", "fp"])

    def verify(batches):
        import pyarrow as pa

        def found(key, part, fp):
            cut = np.nonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))[0] + 1
            start = np.concatenate([[0], cut])
            size = np.diff(np.concatenate([start, [len(key)]]))
            u, v = [], []
            two = start[size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            u.append(fp[near])
            v.append(fp[near + 1])
            for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                for a, b in spanning_links(fp[s : s + m], max_bits):
                    u.append(a)
                    v.append(b)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

        held = None
        for b in batches:
            if not len(b):
                continue
            now = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            key, part, fp = now
            last = np.nonzero((key != key[-1]) | (part != part[-1]))[0]
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:] for x in now]
            if cut:
                yield found(key[:cut], part[:cut], fp[:cut])
        if held is not None:
            yield found(*held)

    dealt = fps.select("fp").mapInArrow(emit, "key long, part long, fp long").repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(verify, "u long, v long").distinct()


def wide_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """SimHash of 64 * ``words`` bits of a set of 64-bit hashes, which are mixed anew for each word: a bit is set if it is
    set in over half of the set; no hashes give zero."""
    count = np.zeros(64 * words, np.int64)
    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):
        mixed = _mix(hashes[at : at + 255][:, None] + salt)
        count += np.add.reduce(np.unpackbits(mixed.view(np.uint8)).reshape(len(mixed), -1), axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes)).tobytes()


def _meeting(share: float, n: int = 1 << 13) -> float:
    """The chance that two 23-bit words have a Golay key in common if each bit differs with chance ``share``."""
    rng = np.random.default_rng(23)
    words = rng.integers(0, 1 << 23, n)
    other = words ^ ((rng.random((n, 23)) < share) @ (1 << np.arange(23)))
    around = np.concatenate([[0], 1 << np.arange(23)])
    a, b = (golay_decode(w[:, None] ^ around) for w in (words, other))
    return float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())


def wide_plan(rows: int, similarity: float) -> tuple[int, int, int]:
    """(exact bits of a key, tables, most differing bits of the two words beside the keys) for sets of a Jaccard similarity.

    Sets of Jaccard similarity j and one size have a cosine of 2j / (1 + j), so a share acos(cosine) / pi of their bits differs.
    Keys take more exact bits the more rows there are, so that few rows meet by chance, and then more tables.
    """
    share = acos(2 * similarity / (1 + similarity)) / pi
    exact = min(9, max(4, (rows >> 17).bit_length()))
    tables = ceil(log(MISSED) / log(1 - _meeting(share) * (1 - share) ** exact))
    return exact, tables + tables % 2, int(128 * share + 4.2 * sqrt(128 * share * (1 - share)))


def wide_words(tables: int) -> int:
    """Words of a wide fingerprint: one for two tables, and two beside the keys."""
    return tables // 2 + 2


def wide_keys(fp: np.ndarray, exact: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the rows of words of wide fingerprints; a key names its table and its value (32 bits)."""
    rows, keys = [], []
    for t in range(tables):
        half = ((fp[:, t // 2] >> np.uint64(32 * (t % 2))) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        r, k = golay_keys(half & _MASK23)
        rows.append(r)
        keys.append(t << 32 | ((half >> 23) & ((1 << exact) - 1))[r] << 12 | k)
    return np.concatenate(rows), np.concatenate(keys)


def wide_links(fps: DataFrame, exact: int, tables: int, max_bits: int, block: int = 2048) -> DataFrame:
    """(u, v), u < v: ids of the wide fingerprints of ``fps`` (long ``sid``, binary ``fp``) that meet under a key and differ in at
    most ``max_bits`` of the two words beside the keys. Of the smaller such ids each is paired with the nearest under each key,
    and of these with the ``NEAREST``, so pairs grow with the rows and not with the square of a group of near ones."""
    words = wide_words(tables)

    def matrix(column):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)

    def keys_of(b):
        return wide_keys(matrix(b.column(1)), exact, tables)[1]

    shared = fps.sparkSession.sparkContext.broadcast(_hot(fps.select("sid", "fp"), keys_of, fps.count(), block))

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.slice(at, 2048)
                sid, fp = some.column(0).to_numpy(), matrix(some.column(1))
                row, key, part = _deal(*wide_keys(fp, exact, tables), sid, *shared.value)
                a, b = (np.ascontiguousarray(fp[:, w]).view(np.int64)[row] for w in (-2, -1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, part, sid[row], a, b)], names=["key", "part", "sid", "a", "b"])

    def verify(batches):
        import pyarrow as pa

        for key, part, sid, a, b in key_groups(batches):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            other = np.nonzero(new)[0][np.cumsum(new) - 1]
            at, best, mate = np.arange(len(key)), np.full(len(key), max_bits + 1, np.uint8), np.arange(len(key))
            while True:
                at = at[other[at] < at]
                if not len(at):
                    break
                i = other[at]
                bits = np.bitwise_count((a[at] ^ a[i]).view(np.uint64)) + np.bitwise_count((b[at] ^ b[i]).view(np.uint64))
                less = (bits < best[at]) & (sid[i] < sid[at])
                best[at[less]], mate[at[less]] = bits[less], i[less]
                other[at] += 1
            at = np.nonzero(best <= max_bits)[0]
            yield pa.RecordBatch.from_arrays([pa.array(sid[mate[at]]), pa.array(sid[at]), pa.array(best[at].astype(np.int64))], names=["u", "v", "bits"])

    dealt = fps.select("sid", "fp").mapInArrow(emit, "key long, part long, sid long, a long, b long").repartition("key", "part").sortWithinPartitions("key", "part", "sid")
    near = dealt.mapInArrow(verify, "u long, v long, bits long").distinct()
    return near.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("bits", "u"))).where(F.col("nth") <= NEAREST).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle_words: int = 3) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 lower-case hex digits), ``component_id`` (smallest id reachable)."""
    own = written(docs.select(q(id_col).alias("id"), fingerprint_column(q(text_col), shingle_words).alias("fp")), "simhash-docs")
    fps = written(own.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-distinct")
    linked = written(components(links(fps, max_bits)), "simhash-classes")
    of_root = linked.join(fps, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("rep").alias("least"))
    least = linked.join(of_root, "root").select(F.col("node").alias("fp"), "least")
    classes = written(fps.join(least, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "simhash-ids")
    release(fps)
    release(linked)
    return own.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class: that with the class's smallest id; of rows that repeat both id
    and text, one. Rows without an id cannot be named by a class; they stay, one for each text."""
    reps = classes.where(q(id_col) == F.col("component_id")).select(q(id_col).alias("__lf_rep")).distinct()
    named = docs.where(q(id_col).isNotNull()).join(reps, q(id_col) == F.col("__lf_rep"), "left_semi")
    return named.unionByName(docs.where(q(id_col).isNull())).dropDuplicates([id_col, text_col])
