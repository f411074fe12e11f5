"""Hard negatives of anchors by distributed radix selection on exact integer scores.

Anchors and rows lie in blocks; each pair of blocks is a cell, whose scores are one matrix product and are never stored.
What is looked for is the kth row of a window: of an anchor's other rows with its label (its positives), or of an anchor
and positive, the rows with other labels whose score lies in a band below the positive's. A window's rows are ordered by
score, then number. Each pass counts, for every window, the rows by one digit of that order within the bucket that holds
the kth row; the counts, added up over all cells, tell the next bucket. Score digits come first, then those of the number,
so ties of any size are narrowed too. Once a window's bucket holds few rows, or one place in the order, the rows up to it are gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch

#: Vectors of a block of rows and of a block of anchors; a cell has the product of both.
ROW_BLOCK, ANCHOR_BLOCK = 2048, 512
#: Cells that one task goes through.
TASK_CELLS = 16
#: Bits of a digit.
DIGIT = 8
#: A window with so many rows up to the end of its bucket isn't narrowed any more.
FEW_ROWS = 32
WINDOW = "w int, a int, lo long, hi long, s0 long, b int, i0 long, c int, need long, above long, active boolean"
#: Largest sums that a float of 4 or 8 bytes and an integer of 8 bytes hold exactly.
EXACT = ((1 << 24, np.float32), (1 << 53, np.float64), ((1 << 63) - 1, np.int64))


def _packed(rows: DataFrame, n: int, size: int, name: str) -> DataFrame:
    """Blocks of ``rows`` (id, label, q): ``name`` (from 0), ids, labels and q as bytes, by ascending label; q is padded to the longest of the block."""
    blocks = max(1, math.ceil(n / size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = [b for b in batches if b.num_rows]
        if not found:
            return
        t = pa.Table.from_batches(found)
        ids, labels = (t[c].to_numpy().astype("<i8") for c in ("id", "label"))
        lists = t["q"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        q = np.zeros((len(ids), int(lengths.max())), "<i8")
        q[np.arange(q.shape[1]) < lengths[:, None]] = flat
        order = np.lexsort((ids, labels))
        if len(q) == 0 or max(abs(int(q.min(initial=0))), abs(int(q.max(initial=0)))) < 1 << 31:
            q = q.astype("<i4")
        cells = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([q.shape[1]], pa.int32()), *[pa.array([x[order].tobytes()], pa.binary()) for x in (ids, labels, q)]]
        yield pa.RecordBatch.from_arrays(cells, [name, "n", "dim", "ids", "labels", "q"])

    return rows.repartition(blocks).mapInArrow(run, f"{name} int, n int, dim int, ids binary, labels binary, q binary")


class _Cell:
    """One block of anchors with its windows and one block of rows."""

    def __init__(self, batch: pa.RecordBatch, k: int, bound: int):
        def column(name, dtype):
            return np.frombuffer(batch.column(name)[k].as_buffer(), dtype)

        def vectors(side):
            n, dim, raw = batch.column(f"{side}_n")[k].as_py(), batch.column(f"{side}_dim")[k].as_py(), batch.column(f"{side}_q")[k].as_buffer()
            return np.frombuffer(raw, "<i4" if len(raw) == 4 * n * dim else "<i8").reshape(n, dim)

        self.a_ids, self.a_labels, self.r_ids, self.r_labels = (column(c, "<i8") for c in ("a_ids", "a_labels", "r_ids", "r_labels"))
        a, r = vectors("a"), vectors("r")
        dim = min(a.shape[1], r.shape[1])
        kind = next(t for most, t in EXACT if bound <= most)
        self.a, self.r = a[:, :dim].astype(kind), r[:, :dim].astype(kind)
        w = batch.column("windows")[k].values
        self.w = {f.name: w.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(w.type)}

    def pairs(self, same: bool, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Anchor, row and score of the pairs with equal (or other) labels, other numbers and scores from low to high, both by anchor."""
        if not same:
            s = self.a @ self.r.T
            x, y = np.nonzero((s >= low[:, None]) & (s <= high[:, None]))
            other = self.a_labels[x] != self.r_labels[y]
            x, y = x[other], y[other]
            other = self.a_ids[x] != self.r_ids[y]
            yield x[other], y[other], s[x[other], y[other]].astype(np.int64)
            return
        for label in np.unique(self.a_labels):  # both sides lie by label
            (x0, y0), (x1, y1) = ([int(np.searchsorted(x, label, side)) for x in (self.a_labels, self.r_labels)] for side in ("left", "right"))
            if y0 == y1:
                continue
            s = self.a[x0:x1] @ self.r[y0:y1].T
            x, y = np.nonzero((s >= low[x0:x1, None]) & (s <= high[x0:x1, None]))
            other = self.a_ids[x0 + x] != self.r_ids[y0 + y]
            x, y = x[other], y[other]
            yield x0 + x, y0 + y, s[x, y].astype(np.int64)

    def members(self, same: bool, gather: bool, least_id: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Window, row, score, order by score, order by number of the rows in the windows' buckets; to gather, also of those before."""
        w = self.w
        use = np.ones(len(w["w"]), bool) if gather else w["active"].astype(bool)
        if not use.any():
            return
        # a bucket is s0 .. s0 + 2^b - 1, counted down from the window's highest score
        top = w["hi"] if gather else w["hi"] - w["s0"]
        bottom = np.maximum(w["lo"], w["hi"] - w["s0"] - ((np.int64(1) << w["b"].astype(np.int64)) - 1))
        low, high = np.full(len(self.a), np.iinfo(np.int64).max), np.full(len(self.a), np.iinfo(np.int64).min)
        np.minimum.at(low, w["a"][use], bottom[use])
        np.maximum.at(high, w["a"][use], top[use])
        by_anchor = np.argsort(w["a"], kind="stable")
        first = np.searchsorted(w["a"][by_anchor], np.arange(len(self.a) + 1))
        for x, y, score in self.pairs(same, low, high):
            for j in range(int(np.diff(first).max(initial=0))):
                at = first[x] + j
                ok = at < first[x + 1]
                win = by_anchor[np.minimum(at, len(by_anchor) - 1)]
                ok &= use[win] & (score <= top[win]) & (score >= bottom[win])
                k, row, sc = win[ok], y[ok], score[ok]
                s = w["hi"][k] - sc
                i = self.r_ids[row].view(np.uint64) - np.uint64(least_id % (1 << 64))
                tied = w["b"][k] == 0  # the bucket is one score: numbers decide
                inside = (i >> w["c"][k].astype(np.uint64)) == (w["i0"][k].view(np.uint64) >> w["c"][k].astype(np.uint64))
                inside |= w["c"][k] >= 64
                if gather:
                    inside |= i < w["i0"][k].view(np.uint64)
                    tied &= s == w["s0"][k]
                keep = ~tied | inside
                yield k[keep], row[keep], sc[keep], s[keep], i[keep]


def _cells(anchors: DataFrame, rows: DataFrame, n_a: int, n_r: int) -> DataFrame:
    """Each block of anchors beside each block of rows, some cells in a partition."""
    side = lambda df, s: df.select(*[F.col(c).alias(c if c in ("windows", "ablock", "rblock") else f"{s}_{c}") for c in df.columns])
    a = side(anchors, "a").withColumn("rblock", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    r = side(rows, "r").withColumn("ablock", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))))
    parts = max(1, math.ceil(n_a * n_r / TASK_CELLS))
    return a.repartition(parts, "ablock", "rblock").join(r.repartition(parts, "ablock", "rblock"), ["ablock", "rblock"]).sortWithinPartitions("ablock")


def _histograms(cells: DataFrame, same: bool, bound: int, least_id: int) -> DataFrame:
    """ablock, w, digit, n: how many rows of each window's bucket have each next digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = None, None

        def put():
            at = np.flatnonzero(counts)
            arrays = [np.full(len(at), held, np.int32), (at >> DIGIT).astype(np.int32), (at & ((1 << DIGIT) - 1)).astype(np.int32), counts[at]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["ablock", "w", "digit", "n"])

        for batch in batches:
            for k in range(batch.num_rows):
                cell, block = _Cell(batch, k, bound), batch.column("ablock")[k].as_py()
                if held != block:
                    if counts is not None:
                        yield put()
                    held, counts = block, np.zeros(len(cell.w["w"]) << DIGIT, np.int64)
                for w, _, _, s, i in cell.members(same, False, least_id):
                    b, c = cell.w["b"][w].astype(np.int64), cell.w["c"][w].astype(np.uint64)
                    by_score = (s - cell.w["s0"][w]) >> np.maximum(b - DIGIT, 0)
                    by_id = ((i - cell.w["i0"][w].view(np.uint64)) >> np.where(c > DIGIT, c - np.uint64(DIGIT), np.uint64(0))).astype(np.int64)
                    digit = np.where(b > 0, by_score, by_id)
                    counts += np.bincount((w << DIGIT) + digit, minlength=len(counts))
        if counts is not None:
            yield put()

    return cells.mapInArrow(run, "ablock int, w int, digit int, n long").groupBy("ablock", "w", "digit").agg(F.sum("n").alias("n"))


def _narrowed(anchors: DataFrame, counts: DataFrame, id_bits: int) -> DataFrame:
    """The anchors' blocks with each active window in the bucket of its kth row."""
    w = anchors.select("ablock", F.explode("windows").alias("x")).select("ablock", "x.*")
    order = Window.partitionBy("ablock", "w").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("cum", F.sum("n").over(order)).withColumnRenamed("w", "_w").withColumnRenamed("ablock", "_ablock")
    met = c.join(w.where("active").select("ablock", "w", "need"), (F.col("_ablock") == F.col("ablock")) & (F.col("_w") == F.col("w"))).where("cum >= need and cum - n < need")
    hit = met.select(F.col("ablock").alias("_ablock"), F.col("w").alias("_w"), "digit", (F.col("cum") - F.col("n")).alias("before"), F.col("n").alias("inside"))
    j = w.join(hit, (F.col("_ablock") == F.col("ablock")) & (F.col("_w") == F.col("w")), "left")
    on, by_score = F.col("active") & F.col("digit").isNotNull(), F.col("b") > 0
    left = lambda c: F.greatest(F.col(c) - DIGIT, F.lit(0))
    digit = F.col("digit").cast("long")
    placed = lambda c, at: F.col(at).bitwiseOR(F.call_function("shiftleft", digit, left(c)))
    b = F.when(on & by_score, left("b")).otherwise(F.col("b")).cast("int")
    cc = F.when(on & ~by_score, left("c")).otherwise(F.col("c")).cast("int")
    above = F.when(on, F.col("above") + F.col("before")).otherwise(F.col("above"))
    few = above + F.col("inside") <= FEW_ROWS
    # a window with fewer rows than it needs has no kth row: all of it is gathered
    active = on & ~few & ((b > 0) | (cc > 0))
    new = F.struct(
        "w", "a", "lo", "hi", F.when(on & by_score, placed("b", "s0")).otherwise(F.col("s0")).alias("s0"), b.alias("b"), F.when(on & ~by_score, placed("c", "i0")).otherwise(F.col("i0")).alias("i0"), cc.alias("c"),
        F.when(on, F.col("need") - F.col("before")).otherwise(F.col("need")).alias("need"), above.alias("above"), F.coalesce(active, F.lit(False)).alias("active"),
    )
    windows = j.select("ablock", new.alias("x")).groupBy("ablock").agg(F.sort_array(F.collect_list("x")).alias("windows"))
    return anchors.drop("windows").join(windows, "ablock")


def _gathered(cells: DataFrame, same: bool, bound: int, least_id: int, k: int) -> DataFrame:
    """ablock, w, rank, id, score: the first k rows of each window. A task passes on k rows of a window at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                cell = _Cell(batch, at, bound)
                found = [(cell.w["w"][w], cell.r_ids[row], score) for w, row, score, _, _ in cell.members(same, True, least_id)]
                if not found:
                    continue
                w, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((ids, -score, w))
                w, ids, score = w[order], ids[order], score[order]
                starts = np.flatnonzero(np.diff(w, prepend=-1))
                keep = np.arange(len(w)) - np.repeat(starts, np.diff(np.append(starts, len(w)))) < k
                block = np.full(int(keep.sum()), batch.column("ablock")[at].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(w[keep].astype(np.int32)), pa.array(ids[keep].astype(np.int64)), pa.array(score[keep])], ["ablock", "w", "id", "score"])

    found = cells.mapInArrow(run, "ablock int, w int, id long, score long")
    order = Window.partitionBy("ablock", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _selected(scratch: Scratch, anchors: DataFrame, rows: DataFrame, shape: tuple[int, int], same: bool, k: int, bound: int, id_bits: int, least_id: int) -> DataFrame:
    """The first k rows of every window of ``anchors``."""
    anchors = scratch.keep(anchors)
    while anchors.where(F.exists("windows", lambda w: w["active"])).head(1):
        counts = _histograms(_cells(anchors, rows, *shape), same, bound, least_id)
        before, anchors = anchors, scratch.keep(_narrowed(anchors, counts, id_bits))
        scratch.drop(before)
    return scratch.keep(_gathered(_cells(anchors, rows, *shape), same, bound, least_id, k))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, key: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hardest negatives of each anchor and positive.

    A component x counts as floor(``scale`` * x), a score is the integer inner product of two rows; higher scores come first, ties by the smaller
    number. An anchor's positives are its first ``n_positives`` rows of the same label and another number. Of each the first ``n_negatives`` rows of
    another label count whose score is from ``low`` to ``high`` percent of the positive's, both included; a negative score has no such rows.

    Rows with a null number, label, vector or component, or a component that isn't finite, take no part. Of vectors of other lengths
    the common components count. Repeated rows are rows of their own: a repeated anchor repeats its result, and a repeated positive its negatives. Empty tables, anchors without
    positives and positives without negatives give no rows. Numbers and labels are integers; other columns are ignored. Scores
    that may not fit in 63 bits are an error.

    Anchors times rows is the work; what crosses the network is each block once for every block of the other side and pass, and
    at most 256 counts of a window and task. Windows with thousands of ties are narrowed by number like any other.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    q = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    good = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
    good = scratch.keep(good.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), q.alias("q"), is_anchor.alias("anchor")))
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    most = F.array_max(F.transform("q", lambda x: F.abs(x)))
    n, n_anchors, least_id, greatest_id, largest, dim = good.agg(F.count(F.lit(1)), F.count_if("anchor"), F.min("id"), F.max("id"), F.max(most), F.max(F.size("q"))).first()
    if not n_anchors:
        return empty
    bound = max(1, (largest or 0) ** 2 * dim)
    if bound > EXACT[-1][0] // 2:
        raise ValueError("scores may not fit in 63 bits")
    blocks = scratch.keep(_packed(good.select("id", "label", "q"), n, ROW_BLOCK, "rblock"))
    packed = scratch.keep(_packed(good.where("anchor").select("id", "label", "q"), n_anchors, ANCHOR_BLOCK, "ablock"))
    shape = (max(1, math.ceil(n_anchors / ANCHOR_BLOCK)), max(1, math.ceil(n / ROW_BLOCK)))
    id_bits, score_bits = (greatest_id - least_id).bit_length(), (2 * bound).bit_length()
    long = lambda v: F.lit(v).cast("long")
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(
        i.alias("w"), i.alias("a"), long(-bound).alias("lo"), long(bound).alias("hi"), long(0).alias("s0"), F.lit(score_bits).alias("b"), long(0).alias("i0"), F.lit(id_bits).alias("c"), long(n_positives).alias("need"), long(0).alias("above"), F.lit(True).alias("active"),
    ))
    positives = _selected(scratch, packed.withColumn("windows", every), blocks, shape, True, n_positives, bound, id_bits, least_id)


    def percent(p: int, beyond: str) -> Column:
        """p percent of the score, cut towards zero, and ``beyond`` of what was cut; hundreds apart from the rest, so that nothing overflows."""
        return F.expr(f"{p} * (score div 100) + ({p} * (score % 100)) div 100 + ({beyond.format(f'({p} * (score % 100)) % 100')})")

    ceiling, floor = percent(low, "IF({0} > 0, 1, 0)"), percent(high, "IF({0} < 0, -1, 0)")
    bands = positives.select("ablock", F.col("w").alias("a"), F.col("rank").alias("j"), F.col("id").alias("positive_id"), "score", ceiling.cast("long").alias("lo"), floor.cast("long").alias("hi"))
    bands = bands.where("lo <= hi").withColumn("w", (F.col("a") * n_positives + F.col("j") - 1).cast("int"))
    bands = scratch.keep(bands)
    width = F.ceil(F.log2(F.col("hi") - F.col("lo") + 1.0)).cast("int") + 1
    window = F.struct("w", "a", "lo", "hi", long(0).alias("s0"), width.alias("b"), long(0).alias("i0"), F.lit(id_bits).alias("c"), long(n_negatives).alias("need"), long(0).alias("above"), F.lit(True).alias("active"))
    windows = bands.groupBy("ablock").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    # windows of a block are found by their place, so they are numbered without gaps there
    windows = windows.select("ablock", F.transform("windows", lambda x, i: x.withField("w", i)).alias("windows"), F.transform("windows", lambda x: x["w"]).alias("_of"))
    names = scratch.keep(windows.select("ablock", F.posexplode("_of").alias("w", "_of")))
    negatives = _selected(scratch, packed.join(windows.drop("_of"), "ablock"), blocks, shape, False, n_negatives, bound, id_bits, least_id)

    ids = _ids(packed)
    out = negatives.join(names, ["ablock", "w"]).select("ablock", F.col("_of").alias("w"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(bands.select("ablock", "w", "a", "positive_id", F.col("score").alias("positive_score")), ["ablock", "w"]).join(ids, ["ablock", "a"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _ids(packed: DataFrame) -> DataFrame:
    """ablock, a, anchor_id: the anchors by their place in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch.column("ablock")[k].as_py(), np.int32)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["ablock", "a", "anchor_id"])

    return packed.select("ablock", "ids").mapInArrow(run, "ablock int, a int, anchor_id long")
