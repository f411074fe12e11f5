"""Quality of documents by attention over their passages.

Multiple-instance learning: a document is a bag of passages of which only the bag has a label. Every passage is
encoded, gated attention weighs the passages, and the weighted mean of the encodings is scored. The weights are
learnt from a bounded sample of labelled documents; all documents are scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held_out_fold, let_workers_import

#: White-space separated tokens of a passage.
PASSAGE_TOKENS = 64
#: Labelled documents to learn from, at most, for each label; longer texts than this are not used for learning.
SAMPLE_PER_LABEL = 2000
SAMPLE_TEXT_BYTES = 1 << 18
THRESHOLD = 0.3

#: Classes of bytes that are counted in each passage; 0 is any other.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "*", "#", "$", "%", "&", "|", "<>{}[]()/\\=+_~^`@", "-:;'\""]
BYTE_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(CLASSES):
    BYTE_CLASS[list(_chars.encode())] = _i + 1
BYTE_CLASS[128:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
#: Slots for hashed words.
WORD_SLOTS = 64
N_FEATURES = N_CLASSES + 10 + WORD_SLOTS


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many passages each text has (one at least)."""
    from tidewell.llm.grams import _runs, hash_runs

    n = len(offsets) - 1
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, offsets = data[lo:hi], offsets - lo
    kind = BYTE_CLASS[data]
    token_byte = (kind != 4) & (kind != 5)
    starts, lengths = _runs(data, offsets, token_byte) if len(data) else (np.zeros(0, np.int64),) * 2
    edges = np.searchsorted(starts, offsets)
    edges[-1] = len(starts)
    tokens = np.diff(edges)
    passages = np.maximum(1, -(-tokens // PASSAGE_TOKENS))
    first = np.concatenate(([0], np.cumsum(passages)[:-1]))
    m = int(passages.sum())
    doc_of_token = np.repeat(np.arange(n), tokens)
    passage = first[doc_of_token] + (np.arange(len(starts)) - edges[doc_of_token]) // PASSAGE_TOKENS
    out = np.zeros((m, N_FEATURES), np.float32)
    if not len(starts):
        return out, passages
    gap_end = np.concatenate((starts[1:], [len(data)]))  # a token and the space after it
    per_byte = np.repeat(passage, gap_end - starts)
    counts = np.bincount(per_byte * N_CLASSES + kind[starts[0] :], minlength=m * N_CLASSES).reshape(m, N_CLASSES)
    size = np.maximum(counts.sum(axis=1), 1)
    out[:, :N_CLASSES] = np.sqrt(counts / size[:, None])

    def per_passage(x: np.ndarray) -> np.ndarray:
        return np.bincount(passage, x, minlength=m)

    k = np.maximum(per_passage(np.ones(len(starts))), 1)
    upper = np.add.reduceat((kind == 2).astype(np.int64), starts)
    lower = np.add.reduceat((kind == 1).astype(np.int64), starts)
    last = kind[starts + lengths - 1]
    hashes = hash_runs(data, starts, lengths, token_byte)
    docs = doc_of_token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def repeated(x: np.ndarray) -> np.ndarray:
        """Whether a value occurs more than once."""
        order = np.argsort(x, kind="stable")
        same = x[order][1:] == x[order][:-1]
        twice = np.zeros(len(x), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return twice

    # Pairs of neighbours within a document; a document's last token starts none.
    inner = np.flatnonzero(doc_of_token[1:] == doc_of_token[:-1])
    twice = np.zeros(len(hashes), bool)
    twice[inner] = repeated(hashes[inner] * np.uint64(31) + hashes[inner + 1] + docs[inner])
    columns = [
        np.log(per_passage(lengths) / k + 1) / 3, per_passage((upper > 1) & (lower == 0)) / k, per_passage((upper > 0) & (lower > 0)) / k,
        per_passage(last >= 9) / k, per_passage((last == 8) & (lengths > 1)) / k, per_passage(repeated(hashes + docs)) / k, per_passage(twice) / k,
        per_passage(repeated(hashes + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) / k, np.log(k) / 4, np.log(np.repeat(tokens, passages) + 1.0) / 8,
    ]
    for i, c in enumerate(columns):
        out[:, N_CLASSES + i] = c
    # Words by themselves: how many of a passage's tokens fall in each slot of a hash.
    slot = (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
    spread = np.bincount(passage * WORD_SLOTS + slot, minlength=m * WORD_SLOTS).reshape(m, WORD_SLOTS)
    out[:, N_CLASSES + len(columns) :] = np.sqrt(spread / k[:, None])
    return out, passages


class AttentionModel:
    """Passage encoder, gated attention and a logistic score."""

    def __init__(self, features: int, hidden: int = 24, gates: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)

        def draw(a: int, b: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(a), (a, b))

        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.p = {"E": draw(features, hidden), "e": np.zeros(hidden), "V": draw(hidden, gates), "U": draw(hidden, gates), "w": draw(gates, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "b": np.zeros(1)}

    def _forward(self, x: np.ndarray, sizes: np.ndarray) -> dict:
        p = self.p
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        h = np.tanh((x - self.mean) / self.scale @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, at), sizes))
        a /= np.repeat(np.add.reduceat(a, at), sizes)
        z = np.add.reduceat(h * a[:, None], at)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return {"at": at, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self._forward(x.astype(np.float64), sizes)["y"]

    def gradients(self, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean of the documents' log losses."""
        p, f = self.p, self._forward(x, sizes)
        err = (f["y"] - labels) * weights / len(labels)
        dz = np.repeat(err[:, None] * p["c"], sizes, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["at"]), sizes))
        dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = dz * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T
        de = dh * (1 - f["h"] ** 2)
        xb = (x - self.mean) / self.scale
        return {"E": xb.T @ de, "e": de.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ err, "b": np.array([err.sum()])}

    def fit(self, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> None:
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng, p = np.random.default_rng(seed), self.p
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(sizes))
            for at in range(0, len(order), 64):
                docs = order[at : at + 64]
                n = sizes[docs]
                rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in docs])
                grads = self.gradients(x[rows], n, labels[docs], weights[docs])
                step += 1
                lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
                for k, v in p.items():
                    d = grads[k] + decay * v
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    v -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def _batched(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    from tidewell.llm.grams import text_bytes

    data, offsets = text_bytes(batch.column(column), lower=False)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield batch.slice(i, j - i), data, offsets[i : j + 1]
        i = j


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, sample_text_bytes: int = SAMPLE_TEXT_BYTES, key: str = "doc_id", text: str = "text", label: str = "quality") -> AttentionModel:
    """Learn from at most ``per_label`` documents of each label, chosen by a hash of their number.

    Rows of the held-out fold, without a label, with a null number or null text, or with a text of over
    ``sample_text_bytes`` aren't used for learning; of several labels or texts for a number the least counts. Each label weighs as much as it has among all rows that may be used.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (held_out_fold(key) != 0)).groupBy(key).agg(F.min(label).alias("y"))
    share = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [usable.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(23), key), key).limit(per_label) for y in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))  # 2 * per_label rows at most
    # One text for each number, the least, so that what reaches the driver is bounded however often a number occurs.
    sample = docs.where(F.octet_length(text) <= sample_text_bytes).select(F.col(key), F.col(text).alias("text")).join(picked, key)
    sample = sample.groupBy(key, "y").agg(F.min("text").alias("text")).select(key, "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _batched(batch, 1):
                x, sizes = passage_features(data, offsets)
                ends = np.cumsum(sizes)
                raw = [x[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(raw, pa.binary())], ["k", "y", "x"])

    kind = dict(docs.dtypes)[key]
    rows = sample.select(key, "text", F.col("y").cast("int").alias("y")).mapInArrow(run, f"k {kind}, y int, x binary").collect()
    model = AttentionModel(N_FEATURES)
    if not rows:
        return model
    rows.sort(key=lambda r: (r["k"], bytes(r["x"])))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    y = np.array([r["y"] for r in rows], np.float64)
    got = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    whole = sum(share.values())
    weights = np.array([share.get(int(v), 1) / whole * len(y) / got[int(v)] for v in y])
    model.fit(np.concatenate(bags), np.array([len(b) for b in bags]), y, weights)
    return model


def scored(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key, held_out, score and predicted; one row for each row, in a single pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _batched(batch, 2):
                y = model.score(*passage_features(data, offsets))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(y, pa.float64()), pa.array(y >= threshold).cast(pa.int32())], [key, "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), (held_out_fold(key) == 0).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Train on the labelled documents and score all.

    A null text counts as empty, and an empty one has a single passage without tokens. Repeated rows get equal scores.
    Null numbers are scored. Without labels the untrained model scores. An empty table gives an empty result. Columns other
    than the number and the text are no input.
    """
    let_workers_import(docs.sparkSession)
    return scored(docs, train(docs, labels, key=key, text=text, **options), threshold, key, text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that aren't rejected, with all their columns, whatever these are called.

    Null and empty texts are scored like any other, repeated rows stay or go together, and an empty table gives an
    empty result.
    """
    let_workers_import(docs.sparkSession)
    model = train(docs, labels, key=key, text=text, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part, data, offsets in _batched(batch, at):
                yield part.filter(pa.array(model.score(*passage_features(data, offsets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
