"""Periodic runs of words: stretches that repeat a period three times or more, in whole texts.

For each period p the grid points 0, p, 2p, ... of a text are compared with the next ones: how far the words agree from
there on and before (longest common extensions). A run of three periods holds two neighbouring grid points at least,
so the grids of all periods, n / 1 + n / 2 + ... points, find every run. Extensions are found by binary search on
prefix hashes for all pairs of a block of texts at once. Equal hashes don't prove equal words, so every run's words are
compared, and a run that fails is extended anew by its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words of the texts that are searched at once; a longer text is searched alone.
BLOCK_WORDS = 200_000
#: Pairs of grid points that are looked at together.
BLOCK_PAIRS = 2_000_000
MOD = (1 << 31) - 1
BASE = 1_000_003 * 911 % MOD


class _Numbered(dict):
    """Words by numbers, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo MOD."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * (int(out[-1]) * BASE % MOD) % MOD])
    return out[:n]


class _Block:
    """The words of some texts one after the other, as numbers, with prefix hashes."""

    def __init__(self, texts: list[list[bytes]]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        numbers = _Numbered()
        self.words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(sizes.sum()))
        spread = self.words * 0x9E3779B1 % MOD
        self.power = _powers(len(spread) + 1)
        self.hashes = np.concatenate([[0], np.cumsum(spread * self.power[:-1] % MOD) % MOD])

    def same(self, i: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the hashes of ``length`` words from i and from i + p are equal."""
        h, j = self.hashes, i + p
        return (h[i + length] - h[i]) % MOD * self.power[p] % MOD == (h[j + length] - h[j]) % MOD

    def extended(self, i: np.ndarray, p: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from i on (or before i) equal those p further, ``most`` at most; never too few, too many only where hashes collide."""
        low, high = np.zeros_like(most), most.copy()
        open_ = np.flatnonzero(high > low)
        while len(open_):
            a, b, at, by = low[open_], high[open_], i[open_], p[open_]
            mid = (a + b + 1) >> 1
            ok = self.same(at if forward else at - mid, by, mid)
            low[open_] = np.where(ok, mid, a)
            high[open_] = np.where(ok, b, mid - 1)
            open_ = open_[low[open_] < high[open_]]
        return low

    def pairs(self, least_periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, period and first grid point of all neighbouring grid points with equal words, some at a time."""
        sizes = self.ends - self.starts
        periods = sizes // least_periods
        t_of = np.repeat(np.arange(len(sizes)), periods)
        p_all = np.arange(len(t_of)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        n_all = (sizes[t_of] - 1) // p_all
        until, at = np.cumsum(n_all), 0
        while at < len(t_of):
            # periods of texts, so many that their grid points fit
            done = int(until[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(until, done + BLOCK_PAIRS, "right")))
            t, p, counts = t_of[at:end], p_all[at:end], n_all[at:end]
            total, at = until[at:end] - done, end
            place = np.arange(total[-1]) - np.repeat(total - counts, counts)
            p_of = np.repeat(p, counts)
            i = np.repeat(self.starts[t], counts) + place * p_of
            hit = np.flatnonzero(self.words[i] == self.words[i + p_of])
            if len(hit):
                yield np.repeat(t, counts)[hit], p_of[hit], i[hit]

    def runs(self, least_length: int, least_periods: int) -> list[list[tuple[int, int, int]]]:
        """(start, length, period) of the runs of each text, by start, then period."""
        found = []
        for t, p, i in self.pairs(least_periods):
            after = self.extended(i, p, self.ends[t] - i - p, True)
            before = self.extended(i, p, i - self.starts[t], False)
            long = np.flatnonzero(after + before + p >= np.maximum(least_length, least_periods * p))
            cells = np.stack([t[long], i[long] - before[long], i[long] + p[long] + after[long], p[long]], axis=1)
            found.append(np.unique(cells, axis=0))
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.starts]
        if not found:
            return out
        cells = np.unique(np.concatenate(found), axis=0)  # by text, start, end, period
        cells = self.verified(cells, least_length, least_periods)
        # periods of one stretch are multiples of its smallest one
        first = np.ones(len(cells), bool)
        first[1:] = (cells[1:, :3] != cells[:-1, :3]).any(axis=1)
        cells = cells[first]
        cells = cells[np.lexsort((cells[:, 3], cells[:, 1], cells[:, 0]))]
        for t, a, b, p in cells.tolist():
            out[t].append((a - int(self.starts[t]), b - a, p))
        return out

    def verified(self, cells: np.ndarray, least_length: int, least_periods: int) -> np.ndarray:
        """Of each stretch the smallest period for which its words agree. Where hashes made a stretch too long, all of that period in the text are found by words."""
        good, last, again = [], None, False
        for t, a, b, p in cells.tolist():
            if last == (t, a, b):  # a multiple of its smallest period
                continue
            if np.array_equal(self.words[a : b - p], self.words[a + p : b]):
                good.append((t, a, b, p))
                last = (t, a, b)
                continue
            again = True
            lo, hi = int(self.starts[t]), int(self.ends[t])
            equal = self.words[lo : hi - p] == self.words[lo + p : hi]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if y - x + p >= max(least_length, least_periods * p):
                    good.append((t, lo + x, lo + y + p, p))
        out = np.array(good, np.int64).reshape(-1, 4)
        return np.unique(out, axis=0) if again else out


def runs_of(texts: list[list[bytes]], least_length: int = 24, least_periods: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text (a list of words), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some, held = [], 0
    for k, t in enumerate([*texts, None]):
        if some and (t is None or held + len(t) > BLOCK_WORDS):
            for i, found in zip(some, _Block([texts[i] for i in some]).runs(least_length, least_periods), strict=True):
                out[i] = found
            some, held = [], 0
        if t is not None and len(t) >= least_length:
            some.append(k)
            held += len(t)
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    r = np.array(runs, np.int64)
    np.add.at(edge, r[:, 0] + r[:, 2], 1)
    np.add.at(edge, r[:, 0] + r[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text", least_length: int = 24, least_periods: int = 3) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period) and ``collapsed``, the text without what runs repeat.

    Words are parted by ASCII white space. A run is a stretch whose words a smallest period apart are equal, that no neighbouring word
    extends, and that has ``least_length`` words and ``least_periods`` (2 at least) periods or more. Runs come by start, then period;
    ``collapsed`` drops the words that any run holds after its first period and joins the others by one space.

    One pass without a shuffle; a text is searched in n log n pairs of grid points, a bounded number at a time. A null or empty text has
    no words and no runs, and ``collapsed`` is empty. Repeated rows each get their result. Columns of those three names are
    replaced; all others are kept. An empty table gives an empty result.
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    cell = "struct<start:bigint,length:bigint,period:bigint>"
    schema = StructType.fromDDL(f"n_words long, runs array<{cell}>, collapsed string")
    kinds = to_arrow_schema(schema)
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [(t or "").encode().split() for t in part.column(place).to_pylist()]
                found = runs_of(texts, least_length, least_periods)
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found]
                left = [b" ".join(collapsed(t, f)).decode() for t, f in zip(texts, found, strict=True)]
                more = [pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, kinds.field("runs").type), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema=pa.schema([*part.schema, *kinds]))

    cols = docs.select(*[F.col(f"`{c}`") for c in kept])
    return cols.mapInArrow(run, StructType([*cols.schema, *schema]))


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A tenth of the texts with periodic ends: key and text, whose words from a on repeat p words.

    h is the crc32 of the key in decimal (null: of no text). Where h % 10 = 0 and there are n > 0 words: g = h div 10, a = g % n,
    p = 1 + (n - a) div (3 + g % 8), and word i from a on becomes word a + (i - a) % p. Other texts stay as they are.
    """
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(key), F.col(text), F.when(h % 10 == 0, words).alias("_w"), F.floor(h / 10).alias("_g"))
    rows = rows.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    tail, size = F.slice("_w", F.col("_a") + 1, F.col("_p")), F.col("_n") - F.col("_a")
    again = F.slice(F.flatten(F.array_repeat(tail, F.ceil(size / F.col("_p")).cast("int"))), 1, size)
    changed = F.array_join(F.concat(F.slice("_w", 1, F.col("_a")), again), " ")
    return rows.select(key, F.when(F.col("_n") > 0, changed).otherwise(F.col(text)).alias(text))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_runs, the run of the greatest length / period (start, length, period, exponent_milli) and digests of all runs and of the collapsed text.

    Quotients of two numbers of words are told apart exactly by doubles up to 67 million words a text. Ties go to the smallest start, then period.
    """
    best = F.array_min(F.transform("runs", lambda r: F.struct((-(r["length"] / r["period"])).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    return out.select(
        key, "n_runs", *[F.col("_b")[c].alias(c) for c in ("start", "length", "period")], F.expr("(1000 * _b.length) div _b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )
