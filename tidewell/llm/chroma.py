"""Audio fingerprints from pitch classes, and the alignment of recordings by them.

Frames of a recording become twelve pitch-class energies. Filters over an integral image of the frames compare
rectangles of time and pitch; each gives two bits, and sixteen make one packed integer for each frame. Recordings
that share integers of two frames in a row are compared bit by bit at every offset at which such integers meet, and
the best of these offsets counts. Single integers meet by chance far more often than runs of two, and an error touches
frames in a row, so like recordings keep such runs; ``in_a_row=1`` finds the rest that shares any integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch

RATE = 5512
FRAME, HOP = 2048, 690
LOWEST_HZ, HIGHEST_HZ = 28.0, 2700.0
SPAN = 8
#: Recordings that a task makes or reads at once, some 6 MB of the synthesised ones.
BATCH_RECORDINGS = 64
#: Recordings of one length whose fingerprints are made together, and frames that are transformed at once, some 4 MB of each kind.
STACK, BLOCK_FRAMES = 16, 512
#: Weights of a frame and its neighbours in the smoothed image.
SMOOTHING = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: A filter's response below, between and above these gives 0 to 3.
CUTS = (-0.25, 0.0, 0.25)
#: Least shared keys at one offset, least overlap in frames, and most differing bits among all compared.
LEAST_VOTES, LEAST_OVERLAP, MOST_ERRORS = 1, 24, 0.15
#: Integers of so many frames in a row are one key, 1 or 2.
IN_A_ROW = 2


def filter_bank() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch, pitches, frames) of sixteen filters, by rule: each kind at several places and sizes."""
    sizes = ((4, 4), (6, 8), (3, 6), (8, 4))
    return [(kind, (3 * kind + 2 * i) % (13 - high), high, wide) for kind in range(4) for i, (high, wide) in enumerate(sizes)]


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Smoothed, normalised energies of twelve pitch classes for each frame: (recordings, frames, 12) of (recordings, samples)."""
    n = (samples.shape[1] - FRAME) // HOP + 1
    if n < len(SMOOTHING):
        return np.zeros((len(samples), 0, 12))
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ))
    classes = np.eye(12, dtype=np.float32)[np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12]
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=1)[:, ::HOP][:, :n]
    window, image = np.hanning(FRAME).astype(np.float32), np.zeros((len(samples), n, 12))
    block = max(1, BLOCK_FRAMES // len(samples))
    for at in range(0, n, block):
        bins = np.fft.rfft(frames[:, at : at + block] * window, axis=2)[:, :, used[0] : used[-1] + 1]
        image[:, at : at + block] = (bins.real**2 + bins.imag**2) @ classes
    m = n - len(SMOOTHING) + 1
    smooth = sum(w * image[:, i : i + m] for i, w in enumerate(SMOOTHING))
    norm = np.linalg.norm(smooth, axis=2, keepdims=True)
    return np.where(norm > 1e-2, smooth / np.maximum(norm, 1e-2), 0.0)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Packed 32-bit integers of recordings of one length, one for each frame that the filters reach; none if they are too short."""
    image = chroma(samples, rate)
    n = image.shape[1] - SPAN + 1
    if n < 1:
        return np.zeros((len(samples), 0), np.uint32)
    total = np.zeros((len(image), image.shape[1] + 1, 13))
    total[:, 1:, 1:] = image.cumsum(axis=1).cumsum(axis=2)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        later, earlier = total[:, t1 : t1 + n], total[:, t0 : t0 + n]
        return later[:, :, p1] - earlier[:, :, p1] - later[:, :, p0] + earlier[:, :, p0]

    out = np.zeros((len(image), n), np.uint32)
    for kind, p, high, wide in filter_bank():
        if kind == 0:  # lower and upper pitches
            a, b = area(0, wide, p, p + high // 2), area(0, wide, p + high // 2, p + high)
        elif kind == 1:  # earlier and later frames
            a, b = area(0, wide // 2, p, p + high), area(wide // 2, wide, p, p + high)
        elif kind == 2:  # opposite quarters
            a = area(0, wide // 2, p, p + high // 2) + area(wide // 2, wide, p + high // 2, p + high)
            b = area(wide // 2, wide, p, p + high // 2) + area(0, wide // 2, p + high // 2, p + high)
        else:  # the middle third of the frames and the rest
            third = max(1, wide // 3)
            a = area(third, wide - third, p, p + high)
            b = area(0, third, p, p + high) + area(wide - third, wide, p, p + high)
        response = np.log1p(a) - np.log1p(b)
        level = sum((response >= cut).astype(np.uint32) for cut in CUTS)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ in one bit
    return out


def synthesised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shift: int = 4) -> DataFrame:
    """(key, audio): a melody for each vector, 16-bit mono at ``RATE``, whose note i depends on component i.

    The tables have no audio, so this stands in for a media column. Recording k begins k modulo ``shift`` notes late,
    so that like ones need aligning. A null vector gives silence of no length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(HOP) / RATE
        scale = [220.0 * 2 ** (4 * i / 12) for i in range(3)]
        waves = np.stack([(np.sin(2 * np.pi * f * t) + 0.5 * np.sin(4 * np.pi * f * t)) * 9000 for f in scale]).astype(np.int16)
        edges = np.array([-0.431, 0.431])  # a normal variable takes the three levels equally often
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_RECORDINGS):
                part, out = batch.slice(first, BATCH_RECORDINGS), []
                for k, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    x = np.nan_to_num(np.array(v or [], np.float64))
                    spread = np.sqrt((x * x).mean()) if len(x) else 1.0
                    out.append(waves[np.digitize(x / (spread or 1.0), edges)][(k or 0) % shift :].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["k", "audio"])

    kind = dict(vectors.dtypes)[key]
    return vectors.select(key, vector).mapInArrow(run, f"k {kind}, audio binary").withColumnRenamed("k", key)


def fingerprints(recordings: DataFrame, rate: int = RATE, key: str = "vec_id", audio: str = "audio") -> DataFrame:
    """(key, prints): the packed integers of each recording of 16-bit mono samples. A null recording is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_RECORDINGS):
                part = batch.slice(at, BATCH_RECORDINGS)
                raw = [x.as_buffer() if x.is_valid else b"" for x in part.column(1)]
                samples = [np.frombuffer(x, "<i2", len(x) // 2) for x in raw]
                found: list = [None] * len(samples)
                order = sorted(range(len(samples)), key=lambda i: len(samples[i]))
                for _, same in groupby(order, lambda i: len(samples[i])):
                    alike = list(same)
                    for first in range(0, len(alike), STACK):
                        group = alike[first : first + STACK]
                        for i, row in zip(group, fingerprint(np.stack([samples[i] for i in group]), rate).view(np.int32), strict=True):
                            found[i] = row
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], ["k", "prints"])

    kind = dict(recordings.dtypes)[key]
    return recordings.select(key, audio).mapInArrow(run, f"k {kind}, prints array<int>").withColumnRenamed("k", key)


def align(
    recordings: DataFrame, is_query, key: str = "vec_id", audio: str = "audio", rate: int = RATE, least_votes: int = LEAST_VOTES, in_a_row: int = IN_A_ROW
) -> DataFrame:
    """Recordings that hold the same sound, for all queries against all recordings.

    ``is_query`` is a condition on the key. Recordings with equal fingerprints are one class. Returns rows of two kinds:
    'member' (key, class_id) for every recording, and 'match' (key: the class's id, class_id: the class of a
    query, offset, votes, overlap, bit_errors, error_rate) for each pair of classes that align; frame i of the
    query lies at frame i + offset of the other. All pairs of recordings follow from both without being listed.

    Every offset at which ``least_votes`` keys meet is compared; of those that match, the one with most votes counts, of
    several the least. What shares no key is not found: ``in_a_row=1`` loses fewer such pairs and compares some fifteen
    times as many offsets.

    A null or too short recording has no fingerprint; all such are one class, which matches nothing. Repeated rows are members
    each. A null key is never a query. An empty table gives an empty result.
    """
    if in_a_row not in (1, 2):
        raise ValueError("in_a_row is 1 or 2")
    scratch = Scratch(recordings.sparkSession, "chroma")
    made = scratch.keep(fingerprints(recordings, rate, key, audio).select(F.col(key).alias("k"), "prints"))
    classes = scratch.keep(
        made.groupBy("prints").agg(F.min("k").alias("class_id"), F.max(F.coalesce(is_query(F.col("k")), F.lit(False))).alias("asked"), F.count(F.lit(1)).alias("n"))
    )
    one, two = F.slice("prints", F.lit(1), F.size("prints") - 1), F.slice("prints", F.lit(2), F.size("prints") - 1)
    runs = F.zip_with(one, two, lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    values = runs if in_a_row == 2 else F.col("prints").cast("array<bigint>")
    placed = classes.where(F.size("prints") >= in_a_row).select("class_id", "asked", F.posexplode(values).alias("at", "value"))
    queries = placed.where("asked").select(F.col("class_id").alias("q"), F.col("at").alias("q_at"), "value")
    votes = (
        queries.join(placed.select("class_id", "at", "value"), "value")
        .where("q != class_id")
        .groupBy("q", "class_id", (F.col("at") - F.col("q_at")).alias("offset"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    # The histogram of a pair goes with the pair, so that the integers meet once for each pair and every offset is compared.
    histograms = votes.where(F.col("votes") >= least_votes).groupBy("q", "class_id").agg(F.collect_list(F.struct("offset", "votes")).alias("voted"))
    left = classes.select(F.col("class_id").alias("q"), F.col("prints").alias("x"))
    right = classes.select("class_id", F.col("prints").alias("y"))
    pairs = histograms.join(left, "q").join(right, "class_id").select("q", "class_id", "x", "y", F.inline("voted"))
    x0, y0 = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    overlap = F.least(F.size("x") - x0, F.size("y") - y0)
    pairs = pairs.withColumn("overlap", overlap).where(F.col("overlap") >= LEAST_OVERLAP)
    unlike = F.aggregate(
        F.zip_with(F.slice("x", x0 + 1, F.col("overlap")), F.slice("y", y0 + 1, F.col("overlap")), lambda a, b: F.bit_count(a.bitwiseXOR(b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))),
        F.lit(0), lambda s, v: s + v,
    )
    matched = pairs.withColumn("bit_errors", unlike).withColumn("error_rate", F.col("bit_errors") / (F.col("overlap") * 32)).where(F.col("error_rate") <= MOST_ERRORS)
    best = F.max_by(F.struct("offset", "votes", "overlap", "bit_errors", "error_rate"), F.struct("votes", -F.col("offset")))
    matched = matched.groupBy("q", "class_id").agg(best.alias("best")).select("q", "class_id", "best.*")
    matched = matched.select(
        F.lit("match").alias("kind"), F.col("class_id").alias(key), F.col("q").alias("class_id"), F.col("offset").cast("int").alias("offset"), F.col("votes").cast("int").alias("votes"),
        F.col("overlap").cast("int").alias("overlap"), F.col("bit_errors").cast("int").alias("bit_errors"), "error_rate",
    )
    members = made.join(classes.select("prints", "class_id"), "prints").select(
        F.lit("member").alias("kind"), F.col("k").alias(key), "class_id", *[F.lit(None).cast("int").alias(c) for c in ("offset", "votes", "overlap", "bit_errors")], F.lit(None).cast("double").alias("error_rate"),
    )
    return members.unionByName(matched)
