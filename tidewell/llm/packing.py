"""Packing of whole documents into sequences, mixed by deficit round-robin over source queues.

Each source is a queue of its documents in a seeded order. In every round a source gets its target share of a mixing
window as credit, carries over what it didn't use, and sends the packets that its credit covers. So a packet that ends
E tokens into its queue goes in round ceil(E / credit): the deficits of all rounds follow from running sums, and no
task has to see more than a bucket of a queue or a window of the mix. The mixed stream is then cut into sequences.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, text_hash

SEQUENCE = 4096
END_ID = 2
#: A mixing window holds so many sequences. Larger: fewer cuts; smaller: closer to the proportions.
WINDOW_SEQUENCES = 64
#: Documents of a queue that one task orders.
BUCKET_DOCS = 4_000
#: A source's target share is its share of the corpus to this power, scaled to 1 over all sources: below 1 small sources
#: come more often than they are long, so that a sequence mixes more sources, until they run out.
MIX_EXPONENT = 0.7


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, h (the text's hash), n (ids with the end), ids (numbers of 2 or 4 bytes). A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewell.llm.tokens import WordTokenizer

        words = WordTokenizer.at(tokenizer_path)
        end = np.array([end_id], words.dtype).tobytes()
        width = words.dtype.itemsize
        for batch in batches:
            texts = batch.column(3)
            for at in range(0, len(texts), 512):
                ids = [words.encode(t or "") + end for t in texts[at : at + 512].to_pylist()]
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "h", "n", "ids"],
                )

    cols = docs.select(F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), text_hash(text).alias("h"), F.col(text).alias("t"))
    return cols.mapInArrow(run, f"doc_id {dict(cols.dtypes)['k']}, source string, h long, n long, ids binary")


def mixed_positions(
    queue: DataFrame, total: int, n_docs: int, weights: dict[str, float] | None, sequence: int, window_sequences: int, seed: int,
    exponent: float = MIX_EXPONENT, bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """row, source, start, length, round, position: where each packet of ``queue`` (row, doc_id, source, h, n) lies in the mix.

    A queue's order follows from key and text. Only copies of one row are ordered by ``row``, and they can stand for each other.
    """
    bits = max(1, math.ceil(math.log2(max(2, n_docs / bucket_docs))))
    q = queue.select("row", "doc_id", "source", "h", "n", F.xxhash64(F.lit(seed), "doc_id", "h").alias("seeded"))
    q = q.withColumn("bucket", F.shiftright("seeded", 64 - bits))
    # Copies of one row are in one bucket as often. Where they are very many, they lie behind the bucket's other rows, in blocks of the input.
    copies = q.groupBy("source", "seeded").agg(F.count(F.lit(1)).alias("c"))
    copies = copies.where(F.col("c") > bucket_docs).select("source", "seeded", F.lit(True).alias("many"))
    q = q.join(copies, ["source", "seeded"], "left").select(
        "row", "doc_id", "source", "h", "n", "seeded", "bucket", F.when(F.col("many"), F.col("seeded")).alias("copied"),
        F.when(F.col("many"), F.shiftright("row", 12)).alias("block"),
    )
    place = F.struct("bucket", F.col("copied").isNotNull().alias("many"), F.coalesce("copied", F.lit(0)).alias("copied"), F.coalesce("block", F.lit(0)).alias("block"))
    q = q.withColumn("place", place)
    before = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        q.groupBy("source", "place")
        .agg(F.sum("n").alias("n"))
        .select(
            F.col("source"), F.col("place"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("place_start"),
            F.sum("n").over(Window.partitionBy("source")).alias("source_tokens"),
        )
    )
    of_corpus = F.col("source_tokens") / F.lit(float(max(total, 1)))
    if weights:
        whole = sum(weights.values())
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v / whole))])
        share = F.coalesce(F.element_at(given, F.col("source")), of_corpus)
    elif exponent == 1:
        share = of_corpus
    else:
        totals = queue.groupBy("source").agg(F.sum("n").alias("source_tokens"))
        whole = totals.agg(F.sum(F.pow(of_corpus, F.lit(exponent)))).first()[0] or 1.0
        # Twelve digits don't depend on the order in which the sum was made.
        share = F.pow(of_corpus, F.lit(exponent)) / F.lit(float(f"{whole:.12g}"))
    in_place = Window.partitionBy("source", "place").orderBy("seeded", "doc_id", "h", "row").rowsBetween(Window.unboundedPreceding, 0)
    q = q.join(sums, ["source", "place"]).select(
        "row", "source", "n",
        (F.col("place_start") + F.sum("n").over(in_place) - F.col("n")).alias("queue_start"),
        (share * F.lit(float(sequence * window_sequences))).alias("credit"),
    )
    packets = q.select(
        "row", "source", "n", "queue_start", "credit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(sequence).cast("long"))).alias("start"),
    ).withColumn("length", F.least(F.lit(sequence).cast("long"), F.col("n") - F.col("start")))
    ends = F.col("queue_start") + F.col("start") + F.col("length")
    packets = packets.select("row", "source", "start", "length", ends.alias("queue_end"), F.ceil(ends / F.col("credit")).cast("long").alias("round"))

    rounds = packets.groupBy("round").agg(F.sum("length").alias("t")).withColumn("block", F.floor(F.col("round") / 4096))
    blocks = rounds.groupBy("block").agg(F.sum("t").alias("t"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy("block").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    rounds = rounds.join(blocks, "block").select("round", (F.col("block_start") + F.sum("t").over(inside) - F.col("t")).alias("round_start"))
    in_round = Window.partitionBy("round").orderBy("source", "queue_end").rowsBetween(Window.unboundedPreceding, 0)
    return packets.join(rounds, "round").select(
        "row", "source", "start", "length", "round", (F.col("round_start") + F.sum("length").over(in_round) - F.col("length")).alias("position"),
    )


def cut(packets: DataFrame, total: int, sequence: int) -> DataFrame:
    """row, start, length, sequence_id, offset: the packets cut at the ends of sequences.

    The tokens that don't fill a last sequence go to sequences whose lengths are powers of two, largest
    first, so that none needs padding.
    """
    full, rest = divmod(total, sequence)
    tail = [0]
    for b in range(sequence.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            tail.append(tail[-1] + (1 << b))
    tail_starts = F.array(*[F.lit(full * sequence + t).cast("long") for t in tail])

    def sequence_of(pos):
        in_tail = F.size(F.filter(tail_starts, lambda s: s <= pos)) - 1
        return F.when(pos < full * sequence, F.floor(pos / sequence)).otherwise(F.lit(full) + in_tail).cast("long")

    def start_of(seq):
        return F.when(seq < full, seq * sequence).otherwise(F.get(tail_starts, (seq - full).cast("int"))).cast("long")

    last = F.col("position") + F.col("length") - 1
    p = packets.select("*", F.explode(F.sequence(sequence_of(F.col("position")), sequence_of(last))).alias("sequence_id"))
    begin = F.greatest(F.col("position"), start_of(F.col("sequence_id")))
    end = F.least(F.col("position") + F.col("length"), start_of(F.col("sequence_id") + 1))
    return p.select(
        "row", (F.col("start") + begin - F.col("position")).alias("start"), (end - begin).alias("length"), "sequence_id", (begin - start_of(F.col("sequence_id"))).alias("offset"),
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    weights: dict[str, float] | None = None,
    sequence: int = SEQUENCE,
    window_sequences: int = WINDOW_SEQUENCES,
    end_id: int = END_ID,
    seed: int = 5,
    with_ids: bool = False,
    exponent: float = MIX_EXPONENT,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence.

    Returns key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and the piece's ids (4 bytes
    each) if asked for. ``sequence`` must be a power of two. ``weights`` gives target proportions by source (a source
    without one keeps its share of the corpus). Without ``weights`` the targets are the corpus's own shares to the power ``exponent``; at
    1 all queues end together, below 1 smaller sources end earlier, and what is left goes on in its own proportions.

    The result depends on the rows, not on how the input is split: a queue is ordered by key and text. A null text is a
    document of the end id only; a null source counts as the source ''. Repeated rows are packed
    each, however many. Null numbers are kept. An empty table gives no pieces. Other columns are ignored.
    """
    if sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    path = tokenizer_path or default_tokenizer()
    scratch = Scratch(docs.sparkSession, "pack")
    tokens = scratch.keep(tokenized(docs, path, end_id, key, text, source).withColumn("row", F.monotonically_increasing_id()), "zstd")
    n_docs, total = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    packets = mixed_positions(tokens.select("row", "doc_id", "source", "h", "n"), total, n_docs, weights, sequence, window_sequences, seed, exponent, bucket_docs)
    pieces = cut(packets, total, sequence)
    by_doc = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    joined = tokens.join(by_doc, "row").select("doc_id", "source", "n", "ids", "pieces")

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pieces")
            cells = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            start, length = (cells.field(k).to_numpy() for k in ("start", "length"))
            bodies, crcs, at = [], [], 0
            for raw, n, k in zip(batch.column("ids"), batch.column("n").to_pylist(), counts.tolist(), strict=True):
                view = raw.as_buffer()
                ids = np.frombuffer(view, "<u2" if len(view) == 2 * n else "<u4").astype("<u4")
                for a, b in zip(start[at : at + k].tolist(), length[at : at + k].tolist(), strict=True):
                    body = ids[a : a + b].tobytes()
                    crcs.append(zlib.crc32(body))
                    if with_ids:
                        bodies.append(body)
                at += k
            rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            out = [
                batch.column("doc_id").take(rows), cells.field("start"), cells.field("length"), pa.array(crcs, pa.int64()),
                batch.column("n").take(rows), cells.field("sequence_id"), cells.field("offset"), batch.column("source").take(rows),
            ]
            yield pa.RecordBatch.from_arrays(out + [pa.array(bodies, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    kinds = f"doc_id {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    out = joined.mapInArrow(run, kinds + ", ids binary" * with_ids)
    return out.withColumnsRenamed({"doc_id": key, "source": source})
