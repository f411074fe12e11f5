"""A hidden Markov language model trained by Baum-Welch on all training documents.

A token's probability in a state is its unigram probability times the state's preference for the token's
class: P(w) * B[s, class(w)] / P(class(w)). A word with ``own_from`` occurrences or more in training is a class of its own, whatever the size
of the corpus; rarer ones are classed by their ending, unknown words and the end of a text have a class each. With 1 every word has its own.
For each state the probabilities of all words and the unknown one sum to one, and the score of a text is exact for the model.

What is gathered grows with the corpus and never leaves the executors: texts are read in chunks, each chunk's distinct words
meet the others' in a shuffle, and counts go back to the chunk. Chunks make up larger groups for the passes, so that a word
travels once for a group. Expected counts of words by state are a table with a row for each such word, joined to
the words of a group in each pass. The driver holds the states' moves and the shared classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, held_out_fold

#: Bytes of text whose distinct words are counted together.
CHUNK_BYTES = 32 << 20
#: Tokens of the chunks that a pass takes together, some 100 MB of text, and the groups that a smaller corpus has, as far as its chunks go.
GROUP_TOKENS, LEAST_GROUPS = 1 << 24, 8
#: A word has expected counts of its own from so many occurrences in training.
OWN_FROM = 64
ENDINGS = 1 << 12
UNKNOWN, END = ENDINGS, ENDINGS + 1
#: Classes that words share. Codes of tokens from here on are places in their chunk's list of words with own counts.
N_CLASSES = ENDINGS + 2
STATES = 8
ITERATIONS = 3
#: Documents from which the first guess of the states is made, and the tokens of the longest.
GUESS_DOCS, GUESS_TOKENS = 1500, 1 << 14
#: The most frequent classes that the guess looks at.
GUESS_CLASSES = 3000
#: Tokens that forward and backward recursion hold at once, but for a longer single text.
BATCH_TOKENS = 250_000
#: Added to each state's counts, in proportion to the classes' probabilities.
PRIOR = 500.0

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pack_ints(x: np.ndarray) -> bytes:
    """Whole numbers as all their low bytes, then all second ones, and so on, which compress well."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_ints(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def chunk_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of documents (ids: places in the chunk's list of words) and rows of words (hash, ending, count in training)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tidewell.llm.grams import _runs, hash_runs, text_bytes

        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        names = ["chunk", "doc", "fold", "ids", "word", "hash", "ending", "train"]
        kind = None

        def flush() -> Iterator[pa.RecordBatch]:
            hashes = np.concatenate([h[1] for h in held])
            endings = np.concatenate([h[2] for h in held])
            counts = np.concatenate([h[3] for h in held])
            folds = np.concatenate([h[0].column(1).to_numpy() for h in held])
            words, first, inverse, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-times, kind="stable")] = np.arange(len(words))
            ids = rank[inverse] + 1  # 0 is the end of a text
            train = np.bincount(ids, np.repeat(folds != 1, counts), minlength=len(words) + 1).astype(np.int64)
            train[0] = int((folds != 1).sum())
            ends = np.cumsum(counts)
            raw = [pack_ints(ids[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            n = len(raw)
            keys = pa.concat_arrays([h[0].column(0) for h in held])
            none = lambda t, k: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, chunk)), keys, pa.array(folds.astype(np.int32)), pa.array(raw, pa.binary()), none(pa.int32(), n), none(pa.int64(), n), none(pa.int32(), n), none(pa.int64(), n)], names
            )
            hash_of = np.zeros(len(words) + 1, np.int64)
            ending_of = np.zeros(len(words) + 1, np.int32)
            hash_of[rank + 1] = words.view(np.int64)
            ending_of[rank + 1] = endings[first]
            for at in range(0, len(hash_of), 50_000):
                part = slice(at, min(at + 50_000, len(hash_of)))
                k = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(k, chunk)), none(keys.type, k), none(pa.int32(), k), none(pa.binary(), k), pa.array(np.arange(part.start, part.stop, dtype=np.int32)),
                        pa.array(hash_of[part]), pa.array(ending_of[part]), pa.array(train[part]),
                    ],
                    names,
                )

        for batch in batches:
            data, offsets = text_bytes(batch.column(2), lower=False)
            i, n = 0, batch.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 19), "right")) - 1)
                part = LOWER[data[offsets[i] : offsets[j]]]
                bounds = offsets[i : j + 1] - offsets[i]
                keep = ~SPACE[part]
                starts, lengths = _runs(part, bounds, keep) if len(part) else (np.zeros(0, np.int64),) * 2
                edges = np.searchsorted(starts, bounds)
                edges[-1] = len(starts)
                ending = np.zeros(len(starts), np.int64)
                for back in range(1, 4):
                    at = starts + lengths - back
                    ending = ending * 257 + np.where(lengths >= back, part[np.maximum(at, 0)].astype(np.int64) + 1, 0)
                ending = (ending * 2654435761 >> 7) % ENDINGS
                held.append((batch.slice(i, j - i), hash_runs(part, starts, lengths, keep), ending.astype(np.int32), np.diff(edges)))
                size += len(part)
                i = j
                if size >= CHUNK_BYTES:
                    yield from flush()
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield from flush()

    kind = dict(docs.dtypes)[key]
    cols = docs.select(F.col(key).alias("doc"), held_out_fold(key).cast("int").alias("fold"), F.col(text).alias("text"))
    return cols.mapInArrow(run, f"chunk long, doc {kind}, fold int, ids binary, word int, hash long, ending int, train long")


def groups_of(texts: DataFrame, group_tokens: int) -> DataFrame:
    """(chunk, grp): chunks that follow each other make up groups of ``group_tokens``, or what is nearest to it for all to be alike. A row for each chunk."""
    sizes = texts.groupBy("chunk").agg(F.sum("n_tokens").alias("n"))
    every, before = Window.partitionBy(), Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("chunk", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past"), F.sum("n").over(every).alias("total"), F.count("n").over(every).alias("chunks"))
    groups = F.greatest(F.ceil(F.col("total") / group_tokens), F.least("chunks", F.lit(LEAST_GROUPS)))
    return sizes.select("chunk", F.floor((F.col("past") + F.col("n") / 2) * groups / F.col("total")).cast("long").alias("grp"))


def _merged(lists: pa.Table) -> pa.Table:
    """Words of a group's chunks and their counts, each once."""
    hashes, counts = (np.frombuffer(b"".join(lists.column(c).to_pylist()), np.int64) for c in ("hashes", "counts"))
    hashes, first = np.unique(hashes, return_index=True)
    return pa.table([np.full(len(hashes), lists.column("grp")[0].as_py(), np.int64), hashes, counts[first]], ["grp", "hash", "c"])


def classed(docs: DataFrame, scratch: Scratch, key: str, text: str, own_from: int, group_tokens: int = GROUP_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame, int, np.ndarray, float]:
    """Texts (grp, chunk, at, doc, fold, n_tokens, n_known, base_score, codes), the chunks' lists of words with own counts (grp, chunk, hashes), those of
    a group, each once (grp, hash, c), N, the probabilities of the shared classes, and N + 0.5 (V + 1), over which all probabilities are taken.
    """
    rows = scratch.keep(chunk_rows(docs, key, text), "zstd")
    is_end = F.col("word") == 0
    words = rows.where("word is not null").select("chunk", "word", F.when(is_end, F.lit(None)).otherwise(F.col("hash")).alias("hash"), "ending", "train")
    # A word's counts are summed before they are shuffled, and go back by a join, which Spark splits where a word is in most chunks.
    by_word = scratch.keep(words.where("hash is not null").groupBy("hash").agg(F.sum("train").alias("c"), F.min("ending").alias("ending")))
    ends = words.where("hash is null").agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    inner, distinct = by_word.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = inner + ends, distinct + (ends > 0)
    whole = total + 0.5 * (distinct + 1)
    cls = F.when(F.col("c") == 0, UNKNOWN).when(F.col("c") < own_from, F.col("ending")).cast("int")
    mass = np.zeros(N_CLASSES)
    by_class = by_word.where(f"c > 0 and c < {own_from}").groupBy("ending").agg(F.sum(F.col("c") + 0.5).alias("m")).toArrow()  # ENDINGS rows at most
    mass[by_class.column("ending").to_numpy()] = by_class.column("m").to_numpy() / whole
    mass[END] = (ends + 0.5) / whole if ends else 0.0
    mass[UNKNOWN] = 0.5 / whole
    kind = dict(docs.dtypes)[key]
    names = ["chunk", "at", "doc", "fold", "n_tokens", "n_known", "base_score", "codes", "hashes", "counts"]
    schema = f"chunk long, at int, doc {kind}, fold int, n_tokens long, n_known long, base_score double, codes binary, hashes binary, counts binary"

    def look_up(docs: pa.Table, words: pa.Table) -> pa.Table:
        order = words.column("word").to_numpy()
        count, code = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        shared = words.column("cls").fill_null(-1).to_numpy()
        count[order] = words.column("c").to_numpy()
        own = words.filter(pa.array(shared < 0)).sort_by("word")
        code[order] = shared
        code[own.column("word").to_numpy()] = N_CLASSES + np.arange(own.num_rows)
        logs = np.log10((count + 0.5) / whole)
        known = count > 0
        n_tokens, n_known, base, codes = [], [], [], []
        for raw in docs.column("ids").to_pylist():
            ids = np.append(unpack_ints(raw), 0)
            n_tokens.append(len(ids))
            n_known.append(int(known[ids].sum()))
            base.append(float(logs[ids].sum()))
            codes.append(pack_ints(code[ids]))
        n = docs.num_rows
        texts = pa.table(
            [
                docs.column("chunk"), pa.array(np.arange(n, dtype=np.int32)), docs.column("doc"), docs.column("fold"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                pa.array(base, pa.float64()), pa.array(codes, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
            ],
            names,
        )
        none = [pa.nulls(1, f.type) for f in texts.schema]
        packed = [pa.array([own.column(c).to_numpy().tobytes()], pa.binary()) for c in ("hash", "c")]
        listed = pa.table([words.column("of").slice(0, 1), *none[1:8], *packed], names)
        return pa.concat_tables([texts, listed.cast(texts.schema)])

    texts = rows.where("word is null").select("chunk", "doc", "fold", "ids").groupBy("chunk")
    end = F.lit(END if ends else UNKNOWN)
    counted = words.where("hash is not null").select("chunk", "word", "hash").join(by_word.select("hash", "c", cls.alias("cls")), "hash")
    counted = counted.select(F.col("chunk").alias("of"), "word", "c", "cls", F.when(F.col("cls").isNull(), F.col("hash")).alias("hash")).unionByName(
        words.where("hash is null").select(F.col("chunk").alias("of"), "word", F.lit(ends).cast("long").alias("c"), end.alias("cls"), F.lit(None).cast("long").alias("hash"))
    )
    out = scratch.keep(texts.cogroup(counted.groupBy("of")).applyInArrow(look_up, schema), "zstd")
    scratch.drop(rows, by_word)
    texts = out.where("at is not null").drop("hashes", "counts")
    groups = F.broadcast(scratch.keep(groups_of(texts, group_tokens).coalesce(1)))  # a row for each chunk
    lists = out.where("at is null").select("chunk", "hashes", "counts").join(groups, "chunk")
    own = scratch.keep(lists.groupBy("grp").applyInArrow(_merged, "grp long, hash long, c long"))
    return texts.join(groups, "chunk"), lists.drop("counts"), own, total, mass, whole


class Model:
    """start[s], move[s, s'], and prefer[class, s]: the state's probability of a class over the class's own."""

    def __init__(self, start: np.ndarray, move: np.ndarray, prefer: np.ndarray, even: float = 0.0, factor: np.ndarray | float = 1.0):
        self.start, self.move, self.prefer, self.even, self.factor = start, move, prefer, even, factor

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, mass: np.ndarray, own_emit: np.ndarray | float = 0.0) -> Model:
        """The next model from expected counts; emit is [class, state] of the shared classes, ``own_emit`` the sum over all other
        words, which have what probability ``mass`` leaves. The unknown word keeps its unigram probability.
        """
        share = np.where(mass > 0, mass, 0)
        share[UNKNOWN] = 0
        known = max(1 - mass[UNKNOWN], 1e-300)  # the probability of all other words, shared or not
        emit = emit.copy()
        emit[UNKNOWN] = 0
        even = PRIOR / known
        factor = known / np.maximum(emit.sum(axis=0) + own_emit + PRIOR, 1e-300)
        prefer = np.ones_like(emit)
        some = share > 0
        prefer[some] = (emit[some] / mass[some, None] + even) * factor
        return cls((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), prefer, even, factor)

    def with_words(self, emit: np.ndarray, mass: np.ndarray) -> Model:
        """The same with some words of their own classes appended."""
        own = (emit / mass[:, None] + self.even) * self.factor
        return Model(self.start, self.move, np.concatenate((self.prefer, own)), self.even, self.factor)

    def forward(self, packed: _Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward recursion: alphas, scales and natural log likelihood ratios by text."""
        emit = self.prefer[packed.classes]
        alpha, scale = np.empty_like(emit), np.empty(len(emit))
        previous = None
        for lo, hi in packed.steps:
            now = emit[lo:hi] * (self.start if previous is None else previous[: hi - lo] @ self.move)
            s = now.sum(axis=1)
            now /= s[:, None]
            alpha[lo:hi], scale[lo:hi] = now, s
            previous = now
        return alpha, scale, packed.sums(np.log(scale))

    def of(self, classes: np.ndarray) -> Model:
        """The same with some of the classes only, as texts need that have no others."""
        return Model(self.start, self.move, self.prefer[classes], self.even, self.factor)

    def expect(self, packed: _Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions of some texts, and their log likelihood ratio."""
        alpha, scale, total = self.forward(packed)
        emit = self.prefer[packed.classes] / scale[:, None]
        beta = np.ones_like(alpha)
        back = self.move.T.copy()
        for i in range(len(packed.steps) - 1, 0, -1):
            lo, hi = packed.steps[i]
            at = packed.steps[i - 1][0]
            emit[lo:hi] *= beta[lo:hi]
            beta[at : at + hi - lo] = emit[lo:hi] @ back
        gamma = alpha * beta
        later = slice(packed.steps[0][1], len(alpha))
        moves = self.move * (alpha[packed.before[later]].T @ emit[later])
        emits = np.stack([np.bincount(packed.classes, gamma[:, s], minlength=len(self.prefer)) for s in range(len(self.start))], axis=1)
        return gamma[: packed.steps[0][1]].sum(axis=0), moves, emits, float(total.sum())


class _Packed:
    """The classes of several texts by time: first those of all first tokens, then of all second ones, and so on."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        time = np.concatenate([np.arange(n) for n in sizes])
        place = np.argsort(time, kind="stable")
        self.classes = np.concatenate([texts[i] for i in self.order])[place].astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)[place]
        active = np.bincount(time)
        ends = np.cumsum(active)
        self.steps = list(zip((ends - active).tolist(), ends.tolist(), strict=True))
        self.before = np.arange(len(place)) - np.concatenate((np.zeros(active[0], np.int64), np.repeat(active[:-1], active[1:])))

    def renumber(self) -> np.ndarray:
        """Number the classes by those that the texts have, and return these."""
        place = np.zeros(int(self.classes.max()) + 1, np.int64)
        place[self.classes] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        self.classes = place[self.classes]
        return used

    def sums(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.owner, x, minlength=len(self.order))
        return out


def _packs(texts: _Texts) -> Iterator[tuple[np.ndarray, _Packed]]:
    """Texts of like length together."""
    order = np.argsort(-texts.sizes, kind="stable")
    at = 0
    while at < len(order):
        end, tokens = at, 0
        while end < len(order) and (end == at or tokens + texts.sizes[order[end]] <= BATCH_TOKENS):
            tokens += texts.sizes[order[end]]
            end += 1
        yield order[at:end], _Packed([texts.classes(i) for i in order[at:end].tolist()])
        at = end


def first_guess(counts: np.ndarray, states: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """States of some texts and counts of their classes by state, from a mixture of unigrams; counts is [text, class]."""
    rng = np.random.default_rng(seed)
    length = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    posterior = rng.dirichlet(np.full(states, 0.3), len(counts))
    for _ in range(25):
        emit = posterior.T @ counts + 0.1
        logs = np.log(emit / emit.sum(axis=1, keepdims=True))
        x = (counts @ logs.T + np.log(posterior.mean(axis=0) + 1e-3) * np.sqrt(length)) / np.sqrt(length)
        posterior = np.exp(x - x.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
    return posterior.sum(axis=0), (posterior.T @ counts).T


def _with_words(texts: DataFrame, lists: DataFrame, words: DataFrame, state: DataFrame, columns: list[str]):
    """Texts of a group and its chunks' lists together with the group's own words and their expected counts."""
    # expected counts travel as numbers of 4 bytes; sums are made of 8
    few = state.select("hash", *[F.col(c).cast("float").alias(c) for c in columns])
    known = words.join(few, "hash", "left").select(F.col("grp").alias("of"), "hash", "c", *[F.coalesce(c, F.lit(0.0).cast("float")).alias(c) for c in columns])
    return texts.unionByName(lists, allowMissingColumns=True).groupBy("grp").cogroup(known.groupBy("of"))


class _Texts:
    """A group's texts. Their tokens are decoded as they are needed: shared classes, then the rows of ``words``."""

    def __init__(self, rows: pa.Table, words: pa.Table):
        valid = pc.is_valid(rows.column("codes"))
        self.rows = rows.drop_columns(["codes", "hashes"]).filter(valid)
        self.sizes = self.rows.column("n_tokens").to_numpy()
        self._codes = rows.column("codes")
        self._at = np.flatnonzero(valid.to_numpy()).tolist()
        lists = rows.select(["chunk", "hashes"]).filter(pc.invert(valid))
        hashes = words.column("hash").to_numpy()
        order = np.argsort(hashes)
        self._places = {}
        for chunk, raw in zip(lists.column("chunk").to_pylist(), lists.column("hashes").to_pylist(), strict=True):
            self._places[chunk] = N_CLASSES + order[np.searchsorted(hashes, np.frombuffer(raw, np.int64), sorter=order)]
        self._chunks = self.rows.column("chunk").to_pylist()

    def classes(self, i: int) -> np.ndarray:
        code = unpack_ints(self._codes[self._at[i]].as_buffer())
        own = code >= N_CLASSES
        code[own] = self._places[self._chunks[i]][code[own] - N_CLASSES]
        return code


def _own(words: pa.Table, columns: list[str], whole: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts and probabilities of a group's own words."""
    return np.stack([words.column(c).to_numpy() for c in columns], axis=1).astype(np.float64), (words.column("c").to_numpy() + 0.5) / whole


def guessed(training: DataFrame, lists: DataFrame, words: DataFrame, mass: np.ndarray, states: int, columns: list[str]) -> tuple[Model, DataFrame]:
    """The first model and expected counts (hash, one column for each state) from a bounded sample of texts."""
    spark = training.sparkSession
    by_hash = F.xxhash64(F.lit(41), "doc")
    # A thinned choice first, as each task would send the driver as many rows as it wants in all.
    every = max(1, training.count() // (2 * GUESS_DOCS))
    some = training.where((F.col("n_tokens") <= GUESS_TOKENS) & (F.pmod(by_hash, F.lit(every)) == 0))
    picked = some.orderBy(by_hash, "doc", "n_tokens", "base_score").select("chunk", "at").limit(GUESS_DOCS).collect()
    rows = spark.createDataFrame([(r["chunk"], r["at"], i) for i, r in enumerate(picked)], "chunk long, at int, row long")
    sample = training.join(F.broadcast(rows), ["chunk", "at"]).select("grp", "chunk", "n_tokens", "codes", "row")  # GUESS_DOCS rows at most
    nothing = spark.createDataFrame([], "hash long, " + ", ".join(f"{c} double" for c in columns))

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        texts = _Texts(rows, words)
        listed = words.column("hash").to_numpy()
        at, own, key, n = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, row in enumerate(texts.rows.column("row").to_pylist()):
            found, times = np.unique(texts.classes(i), return_counts=True)
            mine = found >= N_CLASSES
            code = found.copy()
            code[mine] = listed[found[mine] - N_CLASSES]
            at.append(np.full(len(found), row)), own.append(mine), key.append(code), n.append(times)
        return pa.table([np.concatenate(x) for x in (at, own, key, n)], ["row", "own", "key", "n"])

    counts = _with_words(sample, lists, words, nothing, columns).applyInArrow(run, "row long, own boolean, key long, n long")
    top = counts.groupBy("own", "key").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "own", "key").limit(GUESS_CLASSES).select("own", "key")
    found = counts.join(F.broadcast(top), ["own", "key"]).toArrow()  # GUESS_DOCS * GUESS_CLASSES rows at most
    own, key = found.column("own").to_numpy(), found.column("key").to_numpy()
    row = found.column("row").to_numpy()
    used, column = np.unique(np.stack([own.astype(np.int64), key]), axis=1, return_inverse=True)
    table = np.zeros((max(1, len(picked)), max(1, used.shape[1])), np.float32)
    table[row, column.ravel()] = found.column("n").to_numpy()
    start, counted = first_guess(table, states)
    shared, mine = np.zeros((N_CLASSES, states)), used[0] == 1
    counted = counted[: used.shape[1]].astype(np.float64)
    shared[used[1][~mine]] = counted[~mine]
    stay = (np.full((states, states), 1.0) + np.eye(states) * 20 * states) * 1e3
    state = pa.table([pa.array(used[1][mine], pa.int64()), *(pa.array(counted[mine, s]) for s in range(states))], ["hash", *columns])
    model = Model.from_counts(start, stay, shared, mass, counted[mine].sum(axis=0))
    return model, spark.createDataFrame(state) if state.num_rows else nothing


def baum_welch(training: DataFrame, lists: DataFrame, words: DataFrame, state: DataFrame, model: Model, mass: np.ndarray, whole: float, columns: list[str], scratch: Scratch) -> tuple[Model, DataFrame, DataFrame]:
    """One iteration over all texts: expected counts by group, summed by word or class in a shuffle and kept as a table, which comes last."""
    states = len(model.start)

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        here = model.with_words(*_own(words, columns, whole))
        start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros_like(here.prefer), 0.0
        for _, packed in _packs(_Texts(rows, words)):
            used = packed.renumber()
            a, b, c, d = here.of(used).expect(packed)
            start, move, total = start + a, move + b, total + d
            emit[used] += c
        keys = np.concatenate((np.arange(N_CLASSES), words.column("hash").to_numpy()))
        some = np.flatnonzero(emit.any(axis=1))
        keys = np.concatenate((keys[some], N_CLASSES + np.arange(states + 2)))
        own = np.concatenate((some >= N_CLASSES, np.zeros(states + 2, bool)))
        values = np.concatenate((emit[some], move, start[None], np.full((1, states), total)))
        values[own] = values[own].astype(np.float32)  # shorter in the shuffle
        return pa.table([own, keys, *(values[:, s] for s in range(states))], ["own", "key", *columns])

    schema = "own boolean, key long, " + ", ".join(f"{c} double" for c in columns)
    needed = training.select("grp", "chunk", "n_tokens", "codes")
    sums = scratch.keep(_with_words(needed, lists, words, state, columns).applyInArrow(run, schema).groupBy("own", "key").agg(*[F.sum(c).alias(c) for c in columns]))
    table = np.zeros((N_CLASSES + states + 2, states))
    found = sums.where("not own").toArrow()  # a row for each shared class: bounded by N_CLASSES
    table[found.column("key").to_numpy()] = np.stack([found.column(c).to_numpy() for c in columns], axis=1)
    rest = sums.where("own").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in columns]).first()
    model = Model.from_counts(table[N_CLASSES + states], table[N_CLASSES : N_CLASSES + states], table[:N_CLASSES], mass, np.array(rest, float))
    return model, sums.where("own").select(F.col("key").alias("hash"), *columns), sums


def language_scores(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, key: str = "doc_id", text: str = "text", own_from: int | None = None, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Every row's unigram score and log10 probability under the model.

    Returns key, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows whose number has crc32 modulo 5 equal to 1
    are held out from all counts and training. A null text counts as empty and has the end of text only. Repeated rows
    are scored each, and count each. Null numbers are kept; their fold is that of empty text. An empty table
    gives an empty result. Other columns are ignored. Words meet by 64-bit hashes.

    ``own_from``: occurrences from which a word has emission statistics of its own, ``OWN_FROM`` by default; it doesn't depend on the corpus. Smaller:
    more rows in each pass's shuffles, up to the distinct words of all groups at 1. ``group_tokens``: tokens whose texts one task takes together;
    more of them make fewer such rows and take more memory, and change sums by rounding only.

    The states are first guessed from at most ``GUESS_DOCS`` training texts of up to ``GUESS_TOKENS`` tokens, chosen by a hash;
    everything after that, word counts and all passes of Baum-Welch, is over all training texts.
    """
    scratch = Scratch(docs.sparkSession, "hmm")
    columns = [f"s{s}" for s in range(states)]
    texts, lists, words, total, mass, whole = classed(docs, scratch, key, text, OWN_FROM if own_from is None else own_from, group_tokens)
    training = texts.where("fold != 1")
    model, state = guessed(training, lists, words, mass, states, columns)
    past = []
    for _ in range(iterations if total else 0):
        model, state, sums = baum_welch(training, lists, words, state, model, mass, whole, columns, scratch)
        scratch.drop(*past)
        past = [sums]

    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        here = model.with_words(*_own(words, columns, whole))
        coded = _Texts(rows, words)
        texts = coded.rows
        ratio = np.zeros(texts.num_rows)
        for some, packed in _packs(coded):
            ratio[some] = here.forward(packed)[2]
        base = texts.column("base_score").to_numpy()
        return pa.table(
            [
                texts.column("doc"), pa.array(texts.column("fold").to_numpy() == 1), texts.column("n_tokens"), texts.column("n_known"),
                pa.array(np.full(texts.num_rows, total, np.int64)), texts.column("base_score"), pa.array(base + ratio / math.log(10)),
            ],
            names,
        )

    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_words(texts.drop("at"), lists, words, state, columns).applyInArrow(run, schema)
