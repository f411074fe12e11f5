"""Token ids in files of directly addressable codes: any token is read without decoding others.

An id is split into chunks, the low bits first. Level 0 holds the first chunk of every id; a bitmap beside it says which
ids go on, and these have their next chunk on the next level, in the same order. The place there is the number of
set bits before, which the rank directory gives for each 512 bits, so that at most 64 bytes are counted. The widths
of the chunks are those that make a file smallest, found from how many ids have how many bits.

A file is: 8 bytes of magic, the header's length in 4 bytes, the header (JSON: counts, and where each part lies), then
the parts. Numbers are little-endian. Files hold documents in ascending order of their keys, and so do the files of a
folder by the order of their manifest.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.common import Scratch, text_hash
from tidewell.llm.packing import END_ID, default_tokenizer

MAGIC = b"TWDAC01\n"
#: Bits of a bitmap for each entry of its rank directory.
RANK_BITS = 512
#: Tokens of a file, but for one that holds a longer document. A writer holds so many at once.
FILE_TOKENS = 4 << 20
#: Files of one block, within which the numbers of tokens before are summed up.
BLOCK_FILES = 4096
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


# --- codes --------------------------------------------------------------------


def chunk_widths(ids: np.ndarray) -> list[int]:
    """Widths of the levels, low bits first, for which chunks, bitmaps and ranks take the fewest bits."""
    most = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    longer = [len(ids)] + [int(np.count_nonzero(ids >> s)) for s in range(1, most + 1)]  # ids with bits from s on
    cost, width = [0.0] * (most + 1), [0] * (most + 1)
    for s in range(most - 1, -1, -1):
        options = [(longer[s] * (w + (s + w < most) * (1 + 32 / RANK_BITS)) + cost[s + w], w) for w in range(1, most - s + 1)]
        cost[s], width[s] = min(options)
    out, s = [], 0
    while s < most:
        out.append(width[s])
        s += width[s]
    return out


#: Numbers that are turned into bits at once; a multiple of 8, so that such a part ends with a byte.
BIT_BLOCK = 1 << 16


def _packed(values: np.ndarray, width: int) -> bytes:
    out = []
    for at in range(0, len(values), BIT_BLOCK):
        bits = (values[at : at + BIT_BLOCK, None] >> np.arange(width, dtype=np.uint32)) & 1
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def _unpacked(raw: bytes, first: int, n: int, width: int) -> np.ndarray:
    """n numbers of ``width`` bits that start at bit ``first`` (of 0 to 7) of ``raw``."""
    out, weights, whole = np.empty(n, np.uint32), np.uint32(1) << np.arange(width, dtype=np.uint32), np.frombuffer(raw, np.uint8)
    for at in range(0, n, BIT_BLOCK):
        m = min(BIT_BLOCK, n - at)
        bits = np.unpackbits(whole[at * width // 8 : (first + (at + m) * width + 7) // 8], bitorder="little")[first : first + m * width]
        out[at : at + m] = bits.reshape(m, width).astype(np.uint32) @ weights
    return out


def encode_levels(ids: np.ndarray, widths: list[int]) -> list[dict]:
    """Of each level its width, number of chunks, and the bytes of chunks, bitmap and rank directory; the last has no bitmap."""
    out, rest = [], ids.astype(np.uint32)
    for k, w in enumerate(widths):
        level = {"width": w, "n": len(rest), "chunks": _packed(rest & ((1 << w) - 1), w), "bitmap": b"", "ranks": b""}
        rest = rest >> np.uint32(w) if w < 32 else np.zeros_like(rest)
        if k + 1 < len(widths):
            more = rest > 0
            level["bitmap"] = np.packbits(more, bitorder="little").tobytes()
            ends = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.uint32)
            level["ranks"] = np.concatenate([[0], np.cumsum(ends)[:-1]])[: len(ends)].astype("<u4").tobytes()
            rest = rest[more]
        out.append(level)
    return out


class TokenFile:
    """Reads one file of token ids; only the bytes that a request needs are read.

    >>> f.token(12345)        # one id, from a few bytes of each level that it reaches
    >>> f.tokens(100, 200)    # ids 100 to 199
    """

    def __init__(self, path: str):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(at)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} isn't a file of token ids")
        size = int.from_bytes(self.file.read_at(4, 8), "little")
        self.header = json.loads(self.file.read_at(size, 12))
        self.base = 12 + size
        self.n_tokens, self.n_docs = self.header["n_tokens"], self.header["n_docs"]

    def close(self) -> None:
        self.file.close()

    def _bytes(self, part: list[int], start: int, end: int) -> bytes:
        end = min(end, part[1])
        return self.file.read_at(end - start, self.base + part[0] + start) if end > start else b""

    def _rank(self, level: dict, i: int) -> int:
        """Set bits of the level's bitmap before bit i."""
        block = i // RANK_BITS
        before = int.from_bytes(self._bytes(level["ranks"], 4 * block, 4 * block + 4), "little")
        raw = self._bytes(level["bitmap"], block * RANK_BITS // 8, i // 8 + 1)
        k = i // 8 - block * RANK_BITS // 8
        part = raw[k] & ((1 << i % 8) - 1) if len(raw) > k else 0
        return before + int(ONES[np.frombuffer(raw[:k], np.uint8)].sum()) + int(ONES[part])

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = shift = 0
        for level in self.header["levels"]:
            w = level["width"]
            raw = self._bytes(level["chunks"], i * w // 8, (i * w + w + 7) // 8)
            out |= (int.from_bytes(raw, "little") >> i * w % 8 & ((1 << w) - 1)) << shift
            shift += w
            bit = self._bytes(level["bitmap"], i // 8, i // 8 + 1)
            if not bit or not bit[0] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return out

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` - 1: a stretch of level 0, and of each level below the stretch of those that go on."""
        start, end = max(0, start), min(end, self.n_tokens)
        out = np.zeros(max(0, end - start), np.uint32)
        where, shift = slice(None), 0
        for level in self.header["levels"]:
            n, w = end - start, level["width"]
            if n <= 0:
                break
            chunks = _unpacked(self._bytes(level["chunks"], start * w // 8, (end * w + 7) // 8), start * w % 8, n, w)
            out[where] |= chunks << np.uint32(shift)
            shift += w
            if not level["bitmap"][1]:
                break
            more = np.unpackbits(np.frombuffer(self._bytes(level["bitmap"], start // 8, (end + 7) // 8), np.uint8), bitorder="little")[start % 8 : start % 8 + n].astype(bool)
            where = np.flatnonzero(more) if isinstance(where, slice) else where[more]
            start = self._rank(level, start)
            end = start + len(where)
        return out

    def documents(self) -> pa.Table:
        """key and start (in the file) of each document, in order."""
        with pa.ipc.open_stream(self._bytes(self.header["documents"], 0, self.header["documents"][1])) as r:
            return r.read_all()


def file_bytes(keys: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file of documents whose ids lie one after the other."""
    parts, at = [], 0

    def place(raw: bytes) -> list[int]:
        nonlocal at
        parts.append(raw)
        at += len(raw)
        return [at - len(raw), len(raw)]

    levels = [{"width": x["width"], "n": x["n"], **{k: place(x[k]) for k in ("chunks", "bitmap", "ranks")}} for x in encode_levels(ids, chunk_widths(ids))]
    docs = pa.table({"key": keys, "start": pa.array(np.cumsum(counts) - counts, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_table(docs)
    header = json.dumps({"n_tokens": len(ids), "n_docs": len(counts), "levels": levels, "documents": place(sink.getvalue().to_pybytes())}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *parts])


# --- folders of files ---------------------------------------------------------


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, key: str, text: str) -> DataFrame:
    """key, h (a hash of the text), n, ids (numbers of 2 or 4 bytes); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewell.llm.tokens import WordTokenizer

        words = WordTokenizer.at(tokenizer_path)
        end, width = np.array([end_id], words.dtype).tobytes(), words.dtype.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [words.encode(t or "") + end for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "h", "n", "ids"])

    cols = docs.select(F.col(key).alias("key"), text_hash(text).alias("h"), F.col(text).alias("text"))
    return cols.mapInArrow(run, f"key {cols.schema['key'].dataType.simpleString()}, h long, n long, ids binary")


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write the ids of every whole text, each followed by ``end_id``, to files in ``path``; returns the manifest.

    ``path`` is a folder that all executors share, with a scheme that pyarrow knows (file, hdfs, s3, gs). The manifest
    (file, start, n_docs, n_tokens, n_bytes) lists the files in order and is what counts: a task that is run again
    writes a file of another name, and one that no manifest lists is rubbish. It is written as Parquet beside the files.

    Documents come in ascending order of their keys, null ones first, then by a hash of their text; rows that
    repeat both each count and may lie in several files. A null or empty text is a document of the end id only. An
    empty table gives no file. Other columns are ignored. A task holds ``file_tokens`` tokens or one document.
    """
    spark, tokenizer_path = docs.sparkSession, tokenizer_path or default_tokenizer()
    scratch = Scratch(spark, "token-files")
    tokens = scratch.keep(tokenized(docs, tokenizer_path, end_id, key, text).withColumn("row", F.monotonically_increasing_id()), "zstd")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    arrow_key = to_arrow_type(tokens.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        part, made = TaskContext.get().partitionId(), 0
        keys, bodies, counts, held = [], [], [], 0

        def put() -> pa.RecordBatch:
            nonlocal made, held
            ids = np.concatenate(bodies)
            raw = file_bytes(pa.concat_arrays(keys), np.array(counts, np.int64), ids)
            name = f"{part:06d}-{made:06d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(raw)
            out = pa.RecordBatch.from_pylist([{"part": part, "seq": made, "file": f"{path}/{name}", "n_docs": len(counts), "n_tokens": len(ids), "n_bytes": len(raw)}], schema=MANIFEST)
            made, held = made + 1, 0
            for x in (keys, bodies, counts):
                x.clear()
            return out

        store.create_dir(root, recursive=True)
        for batch in batches:
            ns, raws = batch.column("n").to_pylist(), batch.column("ids")
            for i, n in enumerate(ns):
                if held and held + n > file_tokens:
                    yield put()
                view = raws[i].as_buffer()
                bodies.append(np.frombuffer(view, "<u2" if len(view) == 2 * n else "<u4").astype(np.uint32))
                keys.append(batch.column("key").slice(i, 1).cast(arrow_key))
                counts.append(n)
                held += n
        if counts:
            yield put()

    order = [F.col("key").asc_nulls_first(), F.col("h").asc(), F.col("row").asc()]
    placed = tokens.repartitionByRange(max(1, -(-total // file_tokens)), *order).sortWithinPartitions(*order)
    written = scratch.keep(placed.select("key", "n", "ids").mapInArrow(run, "part int, seq int, file string, n_docs long, n_tokens long, n_bytes long"))
    scratch.drop(tokens)
    files = written.withColumn("block", F.floor(F.col("part") / BLOCK_FILES))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.groupBy("block").agg(F.sum("n_tokens").alias("t")).select("block", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy("block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.join(blocks, "block").withColumn("start", F.col("block_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    starts.select("file", "start", "n_docs", "n_tokens", "n_bytes").write.mode("overwrite").parquet(f"{path}/manifest")
    scratch.drop(written)
    return spark.read.schema("file string, start long, n_docs long, n_tokens long, n_bytes long").parquet(f"{path}/manifest")


#: The columns that a writer returns.
MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def read_token_files(manifest: DataFrame, key_type: str, with_ids: bool = False) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens and ids_crc32 of each document, and its ids (4 bytes each) if asked for, as read from the files."""
    n_files = manifest.count()
    names = ["key", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(row["file"])
                docs, ids = f.documents(), f.tokens(0, f.n_tokens).astype("<u4")
                f.close()
                starts = docs["start"].to_numpy()
                ends = np.append(starts[1:], f.n_tokens)
                for at in range(0, len(starts), 4096):
                    some = slice(at, at + 4096)
                    bodies = [ids[a:b].tobytes() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                    out = [docs["key"].slice(at, 4096).combine_chunks(), pa.array(starts[some] + row["start"]), pa.array(ends[some] - starts[some]), pa.array([zlib.crc32(x) for x in bodies], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out + [pa.array(bodies, pa.binary())] * with_ids, names)

    return manifest.repartition(max(1, n_files)).mapInArrow(run, f"key {key_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_at(spark: SparkSession, manifest: DataFrame, place: int) -> int:
    """The id at one place of the whole corpus: the manifest gives the file, a few bytes of that the id."""
    row = manifest.where((F.col("start") <= place) & (F.lit(place) < F.col("start") + F.col("n_tokens"))).first()
    if row is None:
        raise IndexError(place)
    f = TokenFile(row["file"])
    try:
        return f.token(place - row["start"])
    finally:
        f.close()


def written_tokens(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of ``docs`` as read back from token files in a folder of their own: key, start, n_tokens, ids_crc32."""
    path = f"{Scratch(docs.sparkSession, 'tokens').root}/files"
    manifest = write_token_files(docs, path, tokenizer_path, end_id, file_tokens, key, text)
    return read_token_files(manifest, docs.schema[key].dataType.simpleString()).withColumnRenamed("key", key)
