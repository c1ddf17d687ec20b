"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are renumbered by frequency over all documents (rank 0 is the most frequent; ties by id), so that nearly all take
one byte. A rank takes 1 to 4 bytes, little-endian; its length less one is a 2-bit code, and four codes make a control
byte. Control bytes and data bytes are stored apart, so numpy decodes a block with one table lookup and a gather.

A shard file is a row of blocks of whole documents. Block: ``LFTB``, documents (u32), ids (u64), data bytes (u64), then
document ids (i64 each), null flags of those (u8 each), ids per document (u32 each), control bytes, data bytes, all
little-endian. Shards hold documents in ascending id order (those that repeat an id by their text's CRC), shard by shard:
documents are coded once, dealt to ranges of ids, written in order, counted, and each range's file becomes a shard. The manifest lists the files of the tasks
that succeeded, so a retried or lost task leaves no wrong file behind; the ranks are in ``ranks.bin`` (u32 ids by rank).

Tokens come from the ``tokenizers`` library. A byte-level BPE never joins text across the start of a single space after
a non-space, so a text is cut there and each distinct piece is encoded once; a text with a space inside a run of white
space is encoded whole. Strings of special tokens in a text are ordinary text.

Defined results: a null or empty text is the end id alone; null document ids come first; repeated rows are written
each; an empty table gives no file and an empty result; other input columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, q, release, written

MAGIC = b"LFTB"
BLOCK_IDS = 1 << 20
FILE_BYTES = 200_000_000  # bytes of text a file, if there are more than shuffle partitions
READ_ROWS = 256
_CODES = np.array([[(c >> 2 * k) & 3 for k in range(4)] for c in range(256)], np.uint8)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit integers."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    code = _CODES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(code, dtype=np.int64) + np.arange(n) - code
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    v = d[at].astype(np.uint32)
    for k in (1, 2, 3):
        v |= d[at + k].astype(np.uint32) << np.uint32(8 * k)
    return v & _MASKS[code]


_SPACES = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space amid or at the end of a run of white space: there a text cannot be cut.
_RUN = _SPACES + " (" + _SPACES + "|$)|\x00"
#: Leads a piece that starts at a line break; other pieces but a text's first start with a space. Texts with the
#: character zero are encoded whole.
_NEWLINE = "\x00\n"


def _surface(piece: str) -> str:
    return piece[1:] if piece.startswith(_NEWLINE) else " " + piece


class PieceEncoder:
    """Texts to ids, each distinct piece encoded once; the store of pieces is emptied at ``max_pieces``."""

    def __init__(self, path: str, max_pieces: int = 1_200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # distinct pieces seldom repeat a word; the cache only costs
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)  # in a byte-level vocabulary a character stands for a byte
        self.max_pieces = max_pieces
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray):
        first, n = len(self.index), len(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + n > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[first : first + n] = sizes
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.index.update(zip(pieces, range(first, first + n), strict=True))

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        some = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *some]), np.fromiter(map(len, some), np.int64, len(some))

    def _known(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece, those not seen before learnt."""
        at = np.array(list(map(self.index.get, pieces, repeat(-1))), np.int64)
        missing = np.nonzero(at < 0)[0]
        if not len(missing):
            return at
        if len(self.index) + len(missing) > self.max_pieces:
            self.forget()
            missing = np.arange(len(pieces))
        new = [pieces[i] for i in missing.tolist()]
        self._learn(new)
        at[missing] = list(map(self.index.__getitem__, new))
        return at

    def _learn(self, new: list[str]):
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = [p for p in new if p and not p[-1].isspace() and not p[0].isspace() and (p[0] != "\x00" or (len(p) > 2 and not p[2].isspace()))]
        text = [p[1:] if p[0] == "\x00" else " " + p for p in plain]
        for i in range(0, len(plain), 30_000):
            some = text[i : i + 30_000]  # many in one call, few in one text; the tokens' lengths in bytes tell where each ends
            ids, _ = self.each(["".join(some[j : j + 150]) for j in range(0, len(some), 150)])
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(pc.binary_length(pa.array(some)).to_numpy(), dtype=np.int64)) + 1
            self._add(plain[i : i + 30_000], ids, np.diff(ends, prepend=0))
        if len(plain) < len(new):
            odd = [p for p in new if p not in self.index]
            self._add(odd, *self.each([_surface(p) for p in odd]))

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``texts``: an Arrow string array without nulls. (all ids, number of ids of each text), end ids included."""
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(texts)
        whole = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
        lone = pc.invert(pc.match_substring_regex(texts, _SPACES + _SPACES))  # each line break stands alone: cut there too
        cut = pc.if_else(lone, pc.replace_substring(texts, "\n", " " + _NEWLINE), texts)
        parts = pc.split_pattern(pc.if_else(pa.array(whole), pa.scalar("", texts.type), cut), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        encoded = parts.flatten().dictionary_encode()
        piece = self._known(encoded.dictionary.to_numpy(zero_copy_only=False).tolist())[encoded.indices.to_numpy()]
        size = self.size[piece]
        size[bounds[:-1]] = 0  # the first piece has no space before it
        heads = pc.if_else(pa.array(whole), texts, pc.list_element(parts, 0)).to_pylist()
        head_ids, head_size = self.each(heads)
        body = np.concatenate([[0], np.cumsum(size)])
        of_text = body[bounds[1:]] - body[bounds[:-1]]
        counts = head_size + of_text + 1
        out = np.full(int(counts.sum()), end_id, np.uint32)
        begin = np.cumsum(counts) - counts
        step = np.arange(body[-1], dtype=np.int32)  # a slice of texts has fewer ids than 2**31
        source = np.repeat((self.start[piece] - body[:-1]).astype(np.int32), size)
        source += step
        step += np.repeat((begin + head_size - body[bounds[:-1]]).astype(np.int32), of_text)
        out[step] = self.flat[source]
        if n:
            out[np.repeat(begin - np.cumsum(head_size) + head_size, head_size) + np.arange(len(head_ids))] = head_ids
        return out, counts


_ENCODERS: dict[str, PieceEncoder] = {}


_NO_ID = -(1 << 63)


def order_bounds(docs: DataFrame, parts: int, id_col: str, text_col: str, per_part: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Ascending (id, CRC of the text) pairs that cut the documents into ``parts`` about equal ranges, from about
    ``per_part`` rows a range. They decide the size of the files, not their order."""
    rows = docs.select(F.coalesce(q(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), q(text_col).alias("text"))
    every = max(1, rows.count() // (per_part * parts))
    some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0).select("id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("tie")).toArrow()
    ids, ties = (some.column(i).to_numpy() for i in (0, 1))
    order = np.lexsort((ties, ids))
    at = order[np.linspace(0, len(order), parts + 1).astype(int)[1:-1]] if len(order) else order
    return ids[at], ties[at]


def _range_of(ids: np.ndarray, ties: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    lo, hi = np.searchsorted(bounds[0], ids, "left"), np.searchsorted(bounds[0], ids, "right")
    for i in np.nonzero(hi > lo)[0].tolist():
        lo[i] += np.searchsorted(bounds[1][lo[i] : hi[i]], ties[i], "right")
    return lo


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 6_000_000, bounds=None) -> DataFrame:
    """(id, n, wide, ids, tie, part): the ids of each document as little-endian u16 or, if any is larger, u32 (``wide``),
    the CRC of its text and its range among ``bounds``."""
    bounds = bounds or (np.empty(0, np.int64), np.empty(0, np.int64))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, PieceEncoder(tokenizer_path))
        for batch in batches:
            at = 0
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(size)
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + slice_bytes, "right")))
                texts = pc.fill_null(batch.column(1).slice(at, to - at), "")
                ids, n = encoder.encode(texts, end_id)
                wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
                data = ids.astype("<u4" if wide else "<u2").tobytes()
                ends = np.concatenate([[0], np.cumsum(n)]) * (4 if wide else 2)
                blobs = pa.array([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                keys, ties = batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at)
                part = _range_of(pc.fill_null(keys, _NO_ID).to_numpy(), ties.to_numpy(), bounds).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array([wide] * len(n), pa.bool_()), blobs, ties, pa.array(part)], names=["id", "n", "wide", "ids", "tie", "part"])
                at = to

    rows = docs.select(q(id_col).cast("long").alias("id"), q(text_col).alias("text"), F.crc32(F.coalesce(q(text_col), F.lit("")).cast("binary")).alias("tie"))
    return rows.mapInArrow(run, "id long, n long, wide boolean, ids binary, tie long, part int")


def _all_ids(blobs, wide):
    """The ids of a binary array without nulls, of the narrow ones and of the wide ones, straight from its buffer."""
    import pyarrow.compute as pc

    for w, kind in ((False, "<u2"), (True, "<u4")):
        mine = blobs.filter(pc.equal(wide, w))
        if len(mine):
            ends = np.frombuffer(mine.buffers()[1], np.int32)[mine.offset : mine.offset + len(mine) + 1]
            yield np.frombuffer(mine.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)


def _coded(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Control and data bytes of each document, its control bytes padded to whole ones."""
    v = np.ascontiguousarray(ids, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()
    starts = np.cumsum(counts) - counts
    room = -(-counts // 4)
    place = np.cumsum(room) - room
    padded = np.zeros(4 * int(room.sum()), np.uint8)
    padded[np.repeat(4 * place - starts, counts) + np.arange(len(v))] = code
    four = padded.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()
    sizes = np.concatenate([[0], np.cumsum(code, dtype=np.int64) + np.arange(1, len(v) + 1)])
    a, b = sizes[starts].tolist(), sizes[starts + counts].tolist()
    return [control[p : p + r] + data[x:y] for p, r, x, y in zip(place.tolist(), room.tolist(), a, b, strict=True)]


def _joined(coded: list[bytes], counts: np.ndarray) -> tuple[bytes, bytes]:
    """One run of control bytes and one of data bytes from those of several documents."""
    room = -(-counts // 4)
    code = _CODES[np.frombuffer(b"".join([c[:r] for c, r in zip(coded, room.tolist(), strict=True)]), np.uint8)].ravel()
    starts, place = np.cumsum(counts) - counts, 4 * (np.cumsum(room) - room)
    own = code[np.repeat(place - starts, counts) + np.arange(int(counts.sum()))]
    padded = np.zeros(-(-len(own) // 4) * 4, np.uint8)
    padded[: len(own)] = own
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), b"".join([c[r:] for c, r in zip(coded, room.tolist(), strict=True)])


def frequency_ranks(sources: DataFrame) -> np.ndarray:
    """Ids by rank: the most frequent first, ties by id. ``sources``: paths of the tokens' files. One number for each id
    of the vocabulary reaches the driver."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        total = np.zeros(0, np.int64)
        for source in (x for b in batches for x in b.column(0).to_pylist()):
            fs, path = _open(source)
            with fs.open_input_file(path) as stream:
                for b in pq.ParquetFile(stream).iter_batches(READ_ROWS, columns=["wide", "ids"]):
                    for ids in _all_ids(b.column("ids"), b.column("wide")):
                        c = np.bincount(ids, minlength=len(total))
                        c[: len(total)] += total
                        total = c
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = sources.select("source").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write ``docs`` as token files under ``path`` (a new folder in the shared one by default); the folder."""
    spark = docs.sparkSession
    path = (path or new_path(spark, "token-files")).rstrip("/")
    size = docs.agg(F.sum(F.octet_length(q(text_col)).cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES)
    coded = tokenized(docs, tokenizer_path, end_id, id_col, text_col, bounds=order_bounds(docs, parts, id_col, text_col))
    tokens = written(coded.repartitionById(parts, F.col("part")).sortWithinPartitions("id", "tie").select("id", "n", "wide", "ids"), "tokens")
    sources = sorted(tokens.inputFiles(), key=lambda f: (int(re.search(r"part-(\d+)-", f)[1]), f))
    table = spark.createDataFrame(list(enumerate(sources)), "pid int, source string").repartitionById(max(1, len(sources)), F.col("pid"))
    ranks = frequency_ranks(table)
    lookup = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    lookup[ranks] = np.arange(len(ranks), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(lookup)

    def ranked(batch):
        """(id, n, coded) of each document, in the batch's order."""
        import pyarrow.compute as pc

        out: list = [None] * len(batch)
        for w in set(batch.column(2).to_pylist()):
            at = np.nonzero(pc.equal(batch.column(2), w).to_numpy(zero_copy_only=False))[0]
            mine = batch.take(at)
            ids = next(_all_ids(mine.column(3), mine.column(2)))
            n = mine.column(1).to_numpy()
            for i, *x in zip(at.tolist(), mine.column(0).to_pylist(), n.tolist(), _coded(shared.value[ids], n), strict=True):
                out[i] = x
        return out

    def write(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        for pid, source in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            name = f"shard-{pid:06d}-{uuid.uuid4().hex[:12]}.bin"
            docs_n = ids_n = pending = 0
            held: list = []

            def flush(out):
                counts = np.array([n for _, n, _ in held], np.int64)
                control, data = _joined([c for _, _, c in held], counts)
                keys = np.array([i or 0 for i, _, _ in held], "<i8")
                null = np.array([i is None for i, _, _ in held], np.uint8)
                out.write(MAGIC + struct.pack("<IQQ", len(held), int(counts.sum()), len(data)) + keys.tobytes() + null.tobytes() + counts.astype("<u4").tobytes() + control + data)
                held.clear()

            source_fs, source_path = _open(source)
            with source_fs.open_input_file(source_path) as stream, fs.open_output_stream(f"{folder}/{name}") as out:
                for batch in pq.ParquetFile(stream).iter_batches(READ_ROWS, columns=["id", "n", "wide", "ids"]):
                    for i, n, c in ranked(batch):
                        held.append((i, n, c))
                        docs_n, ids_n, pending = docs_n + 1, ids_n + n, pending + n
                        if pending >= BLOCK_IDS:
                            flush(out)
                            pending = 0
                if held:
                    flush(out)
            if docs_n:
                yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int64()), pa.array([name]), pa.array([docs_n], pa.int64()), pa.array([ids_n], pa.int64())], names=["pid", "name", "docs", "ids"])

    files = table.mapInArrow(write, "pid long, name string, docs long, ids long").collect()
    release(tokens)
    fs, folder = _open(path)
    fs.create_dir(folder, recursive=True)
    manifest = [{"name": f["name"], "docs": f["docs"], "ids": f["ids"]} for f in sorted(files, key=lambda f: f["pid"])]
    with fs.open_output_stream(f"{folder}/ranks.bin") as o:
        o.write(ranks.astype("<u4").tobytes())
    with fs.open_output_stream(f"{folder}/manifest.json") as o:
        o.write(json.dumps(manifest).encode())
    return path


def read_shard(stream, ranks: np.ndarray):
    """(document id or None, ids) for each document of a shard file, block by block."""
    while head := stream.read(24):
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        docs, n, size = struct.unpack("<IQQ", head[4:])
        keys = np.frombuffer(stream.read(8 * docs), "<i8").tolist()
        null = np.frombuffer(stream.read(docs), np.uint8).tolist()
        counts = np.frombuffer(stream.read(4 * docs), "<u4").astype(np.int64)
        control = stream.read(-(-n // 4))
        ids = ranks[decode_ids(control, stream.read(size), n)]
        ends = np.cumsum(counts)
        for k, is_null, a, b in zip(keys, null, (ends - counts).tolist(), ends.tolist(), strict=True):
            yield None if is_null else k, ids[a:b]


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for each document of the files under ``path``."""
    fs, folder = _open(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as i:
        manifest = json.loads(i.read())
    starts = np.cumsum([0] + [f["ids"] for f in manifest]).tolist()
    files = spark.createDataFrame([(f["name"], s) for f, s in zip(manifest, starts, strict=False)] or [], "name string, start long")

    def read(batches):
        import pyarrow as pa

        fs, folder = _open(path)
        with fs.open_input_stream(f"{folder}/ranks.bin") as i:
            ranks = np.frombuffer(i.read(), "<u4")
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with fs.open_input_stream(f"{folder}/{name}") as stream:
                    for key, ids in read_shard(stream, ranks):
                        rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, len(manifest))).mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
