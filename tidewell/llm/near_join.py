"""Similarity join of texts on their sets of word n-grams.

Texts with one set are one class, so copies cost nothing further. Class representatives meet in the buckets of MinHash
bands. In each bucket every member is verified against a few hubs instead of all others; the main hub is the set with
the fewest n-grams that no other has, which is the least edited one. Where members then still belong to several
components, all pairs across these are verified, but for those that the n-grams of their own rule out: a set of
n with u of its own shares n - u at most. So no link between two components is lost, and a group of m near copies
costs about m verifications.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, text_hash

#: Members that meet one copy of a hub's set in one task.
FAN = 64
#: Sets of one component that meet those of another such block, or each other, at once.
BLOCK = 256
#: Hubs of a bucket: the one with the fewest n-grams of its own, and others by a hash.
HUBS = 3


def bands_for(threshold: float, recall: float = 0.999, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows in a band, and so the fewest false candidates, with the wanted recall at the threshold."""
    best = (most_hashes, 1)
    for rows in range(1, 33):
        bands = 1
        while 1 - (1 - threshold**rows) ** bands < recall:
            bands += 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def signatures(docs: DataFrame, bands: int, rows: int, n: int, seed: int, text: str, key: str) -> DataFrame:
    """doc, text_hash, set_id (16 bytes that name the set of n-grams), size, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewell.llm.grams import GOLDEN, gram_sets, mix

        rng = np.random.default_rng(seed)
        factor = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        weight = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = np.arange(bands, dtype=np.uint64) * GOLDEN
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, sizes, keys = [], [], []
                for grams in gram_sets(part.column(2), n):
                    sizes.append(len(grams))
                    ids.append(np.array([mix(grams).sum(dtype=np.uint64), mix(grams ^ GOLDEN).sum(dtype=np.uint64)], "<u8").tobytes())
                    if not len(grams):
                        keys.append(None)
                        continue
                    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
                    short = (grams >> np.uint64(32)).astype(np.uint32)
                    for b in range(0, len(short), 256):
                        np.minimum(least, (short[b : b + 256, None] * factor + shift).min(axis=0), out=least)
                    keys.append(mix((least.reshape(bands, rows).astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc", "text_hash", "set_id", "size", "bands"],
                )

    cols = docs.select(F.col(key).alias("doc"), text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)[key]
    return cols.mapInArrow(run, f"doc {kind}, text_hash long, set_id binary, size int, bands array<long>")


def gram_arrays(docs: DataFrame, n: int) -> DataFrame:
    """set_id, grams for rows of (set_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewell.llm.grams import gram_sets

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                grams = [x.view(np.int64) for x in gram_sets(part.column(1), n)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grams, pa.list_(pa.int64()))], ["set_id", "grams"])

    return docs.select("set_id", "text").mapInArrow(run, "set_id binary, grams array<long>")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, root for all nodes of ``edges`` (a, b); the root is one node of the component.

    Contracts the graph. In each round every node moves to the first of itself and its neighbours, in the order of a
    hash, and only the edges between nodes that remain are taken on. Two rounds of one order draw a star together;
    another order for each two rounds keeps chains from being walked node by node. The moves of all rounds are then
    followed backwards. Each round is written; the driver only learns whether edges are left.
    """

    def ranked(col: str, order: int):
        return F.struct(F.xxhash64(F.lit(order), col).alias("h"), F.col(col).alias("id"))

    def keep_edges(x: DataFrame) -> DataFrame:
        return scratch.keep(x.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    now, moves = keep_edges(edges), []
    while now.head(1):
        order = len(moves) // 2
        both = now.select("a", "b").union(now.select("b", "a"))
        first = both.groupBy("a").agg(F.min(ranked("b", order)).alias("m"))
        move = scratch.keep(first.select("a", F.least("m", ranked("a", order))["id"].alias("m")))
        to_b = move.select(F.col("a").alias("b"), F.col("m").alias("to_b"))
        nxt = keep_edges(now.join(move, "a").join(to_b, "b").select(F.col("m").alias("a"), F.col("to_b").alias("b")))
        scratch.drop(now)
        moves.append(move)
        now = nxt
    if not moves:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1].select(F.col("a").alias("node"), F.col("m").alias("root"))
    for move in reversed(moves[:-1]):
        further = roots.select(F.col("node").alias("m"), "root")
        roots = move.join(further, "m", "left").select(F.col("a").alias("node"), F.coalesce("root", "m").alias("root"))
    return scratch.keep(roots)


def verified(pairs: DataFrame, sets: DataFrame, fan: int = FAN) -> DataFrame:
    """a, b, shared, jaccard of ``pairs`` (a, b), with the sets of ``sets`` (set_id, grams).

    The set of b is copied once for every ``fan`` partners, so that a hub with many partners is spread over tasks.
    """
    chunk = F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int")
    fans = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / fan).cast("int").alias("chunks"))
    left = pairs.join(fans, "b").withColumn("chunk", chunk)
    left = left.join(sets.select(F.col("set_id").alias("a"), F.col("grams").alias("x")), "a")
    right = fans.join(sets.select(F.col("set_id").alias("b"), F.col("grams").alias("y")), "b")
    right = right.select("b", "y", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    met = left.join(right, ["b", "chunk"])
    shared = F.size(F.array_intersect("x", "y"))
    out = met.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    return out.select("a", "b", (F.col("shared") / F.greatest(F.col("total") - F.col("shared"), F.lit(1))).alias("jaccard"))


def link_counts(roots: DataFrame, sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """set_id, n_links: to how many other sets of its component each set is as similar as the threshold.

    All pairs of a component are compared, as links never leave one. The sets of a component are dealt into blocks by a
    hash, and each two blocks meet in a group of their own, which gives counts only. So a set is copied once for each
    block, and the comparisons, not the rows, grow with the square of a component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            edges = _group_edges(part)
            for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
                yield from _counted(part.slice(lo, hi - lo), threshold)
            rest = part.slice(edges[-2]) if len(edges) > 1 else None
        if rest is not None:
            yield from _counted(rest, threshold)

    blocks = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int")
    dealt = roots.join(blocks, "root").select("root", F.col("node").alias("set_id"), own.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "set_id", (F.col("mine") > F.col("other")).alias("second"))
    met = dealt.join(sets, "set_id").select("root", "i", "j", "set_id", "second", "grams")
    met = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return met.mapInArrow(run, "set_id binary, n long").groupBy("set_id").agg(F.sum("n").alias("n_links"))


def _group_edges(part: pa.Table) -> list[int]:
    """Where groups of equal (root, i, j) start in sorted rows, and the end."""
    keys = list(zip(*(part.column(c).to_pylist() for c in ("root", "i", "j")), strict=True))
    return [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]


def _counted(part: pa.Table, threshold: float, width: int = 2048) -> Iterator[pa.RecordBatch]:
    """set_id, n of the sets in one meeting of two blocks, or of one with itself."""
    part = part.combine_chunks()
    n, grams = part.num_rows, part.column("grams").combine_chunks()
    if n < 2:
        return
    sizes = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), sizes)
    _, at, times = np.unique(grams.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    # A gram of one set is shared by no pair.
    number = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    row, at = row[keep], number[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    shared = np.zeros((n, n), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [lo, lo + width])
        has = np.zeros((n, width), np.float32)
        has[row[a:b], at[a:b] - lo] = 1
        shared += has @ has.T
    shared = shared.astype(np.float64)
    linked = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1) >= threshold
    np.fill_diagonal(linked, False)
    if part.column("i")[0].as_py() != part.column("j")[0].as_py():
        second = part.column("second").to_numpy()
        linked &= second[:, None] != second[None, :]
    yield pa.RecordBatch.from_arrays([part.column("set_id").combine_chunks(), pa.array(linked.sum(axis=1), pa.int64())], ["set_id", "n"])


def near_classes(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, seed: int = 11, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every row with its class of near copies.

    Returns key, text_hash, class_id (the least key in the class), class_rank (0 for the row of the class, and for rows that repeat its number and text, with the
    least key), class_size (rows), set_id and n_links: to how many other sets of its class the row's set is as similar as
    the threshold. Texts belong to one class if links of similarity ``threshold`` or more lead from one to the other.

    A null text counts as empty. All texts without words are one class; a text of fewer than ``n`` words has one gram of
    all its words. Repeated rows are in one class, and each is returned. A null key orders last. An empty table gives
    an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    bands, rows = bands_for(threshold, recall)
    signed = scratch.keep(signatures(docs, bands, rows, n, seed, text, key))
    reps = signed.groupBy("set_id").agg(
        F.first("size").alias("size"), F.first("bands").alias("bands"), F.min_by(F.struct("doc", "text_hash"), F.struct(F.col("doc").isNull(), "doc", "text_hash")).alias("rep"),
    )
    placed = reps.select("set_id", "size", F.explode("bands").alias("band"))
    crowded = placed.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("band")
    members = scratch.keep(placed.join(crowded, "band"))

    wanted = members.select("set_id").distinct().join(reps.select("set_id", "rep.doc", "rep.text_hash"), "set_id")
    source = docs.select(F.col(key).alias("doc"), text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    same = source["doc"].eqNullSafe(wanted["doc"]) & (source["text_hash"] == wanted["text_hash"])
    texts = source.join(wanted, same).select("set_id", "text")
    sets = scratch.keep(gram_arrays(texts, n).dropDuplicates(["set_id"]))

    # How many n-grams of a set no other set has that shares a bucket with any.
    own = sets.select(F.xxhash64("set_id").alias("sid"), F.explode("grams").alias("g")).repartition("g").groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("sid").alias("sid"))
    own = own.where("k = 1").groupBy("sid").agg(F.count(F.lit(1)).cast("int").alias("own"))
    stats = sets.select("set_id", F.xxhash64("set_id").alias("sid"), F.size("grams").alias("n")).join(own, "sid", "left")
    stats = scratch.keep(stats.select("set_id", "n", F.coalesce("own", F.lit(0)).alias("own")))

    placed = members.select("set_id", "band").join(stats, "set_id")
    orders = [F.struct("own", F.xxhash64("set_id"), "set_id"), *[F.struct(F.xxhash64(F.lit(i), "set_id"), F.lit(0), "set_id") for i in range(1, HUBS)]]
    hubs = placed.groupBy("band").agg(F.array(*[F.min_by(F.struct("set_id", "n", "own"), o) for o in orders]).alias("hubs"))
    hubs = hubs.select("band", F.explode(F.array_distinct("hubs")).alias("hub"))
    pairs = placed.join(hubs, "band").where((F.col("set_id") != F.col("hub.set_id")) & _possible(threshold, "n", "own", "hub.n", "hub.own"))
    pairs = pairs.select(F.col("set_id").alias("a"), F.col("hub.set_id").alias("b")).distinct()
    checked = scratch.keep(verified(pairs, sets))
    roots = components(scratch, checked.where(F.col("jaccard") >= threshold))

    rooted = placed.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    several = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    several = several.where("lo != hi").select("band", "least", "most")
    # A set of n drops out if it shares too little with any set of a size in the bucket; the best size is what it has in common.
    best = F.least("most", F.greatest("least", F.col("n") - F.col("own")))
    open_ = rooted.join(several, "band").where(_possible(threshold, "n", "own", best, F.lit(0)))
    rest = scratch.keep(_across(open_, reps, checked, threshold))
    if rest.head(1):
        more = scratch.keep(verified(rest, sets))
        found = more.where(F.col("jaccard") >= threshold).select("a", "b")
        roots = components(scratch, found.union(roots.select("node", "root")))

    degree = link_counts(roots, sets, threshold)
    of_set = reps.select("set_id", "rep").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").join(degree, "set_id", "left")
    of_set = of_set.select("set_id", "rep", F.coalesce("root", "set_id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    sizes = signed.groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"))
    of_class = (
        of_set.join(sizes, "set_id")
        .groupBy("root")
        .agg(F.min_by("rep", F.struct(F.col("rep.doc").isNull(), "rep")).alias("head"), F.sum("copies").alias("class_size"))
    )
    table = of_set.join(of_class, "root").select("set_id", "head", "class_size", "n_links")
    row = F.struct("doc", "text_hash")
    out = signed.select("doc", "text_hash", "set_id").join(table, "set_id")
    return out.select(
        F.col("doc").alias(key), "text_hash", F.col("head.doc").alias("class_id"), F.when(row.eqNullSafe(F.col("head")), 0).otherwise(1).alias("class_rank"),
        F.col("class_size").cast("long").alias("class_size"), F.hex("set_id").alias("set_id"), F.col("n_links").cast("long").alias("n_links"),
    )


def _possible(threshold: float, n_a, own_a, n_b, own_b):
    """Whether two sets may be as similar as the threshold, by their sizes and what no other set has of them."""
    n_a, own_a, n_b, own_b = (F.col(x) if isinstance(x, str) else x for x in (n_a, own_a, n_b, own_b))
    shared = F.least(n_a - own_a, n_b - own_b)
    return shared * (1 + threshold) >= (n_a + n_b) * threshold - 1e-6


def _across(open_: DataFrame, reps: DataFrame, checked: DataFrame, threshold: float) -> DataFrame:
    """All pairs of one bucket in two components that may yet be similar and weren't verified; each pair once.

    The rows of a bucket's largest component meet those of the others only. A pair comes from the first bucket that
    both share.
    """
    per = open_.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    main = per.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    sided = open_.join(main, "band").join(reps.select("set_id", "bands"), "set_id")
    cols = ["set_id", "root", "n", "own", "bands"]
    few = sided.where("root != main").select("band", *[F.col(c).alias(f"a_{c}") for c in cols])
    all_ = sided.select("band", *[F.col(c).alias(f"b_{c}") for c in cols], (F.col("root") == F.col("main")).alias("b_main"))
    once = F.col("b_main") | (F.col("a_set_id") < F.col("b_set_id"))
    first = F.array_min(F.array_intersect("a_bands", "b_bands")) == F.col("x.band")
    apart = (F.col("a_root") != F.col("b_root")) & _possible(threshold, "a_n", "a_own", "b_n", "b_own") & once & first
    x, y = few.alias("x"), all_.alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & apart).select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"))
    return pairs.join(checked.select("a", "b").union(checked.select("b", "a")), ["a", "b"], "left_anti").distinct()
