"""Removal of long byte strings that occur more than once in a corpus.

A full-text index of all bytes with one step of backward extension for each of the 400 lengths would cost hundreds of
passes over the corpus. So the intervals are narrowed first. Every string of the minimum length selects one short gram in it, the
least by a hash of its bytes, so equal strings select equal grams at equal places; a gram's
occurrences are an interval of the sorted suffixes. Each occurrence has a context that spans all strings that may
select it. Occurrences with one context are settled together. Where a gram's contexts differ, their interval is expanded:
sorted by what follows, it is extended backwards byte by byte, breadth first, splitting by the preceding
byte. The longest common prefix with a neighbour then tells at each step whether the string of the minimum length is
shared, and an interval of one occurrence is dropped. All of this compares bytes, except that contexts and grams meet
by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, text_hash

MINIMUM = 400
GRAM = 96
BLOCK_BYTES = 1 << 20
POSITION_BITS = 24
#: Contexts of one gram that one task expands, some 100 MB. Those of a more frequent gram meet by the hashes of all their strings instead.
GROUP_CONTEXTS = 50_000
BATCH_CONTEXTS = 16_000
#: Anchors of the texts that meet in one chunk before they meet those of others, some 40 MB of text.
CHUNK_ANCHORS = 250_000

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and of its inverse."""
    from tidewell.llm.grams import BASE, powers

    if not _tables or len(_tables[0][0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        _tables[0] = (powers(size, BASE), powers(size, pow(BASE, -1, 2**64)))
    return _tables[0]


class Hashes:
    """Hashes of any slice of some bytes."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i."""
    n = len(x)
    padded = np.full(-(-n // width) * width + width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def selected(data: np.ndarray, first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray, minimum: int, gram: int):
    """Grams selected by the strings that start in first[i] .. last[i] of text i, which spans lo[i] .. hi[i] of ``data``.

    Returns the text's index, the place, the gram's hash and the context's hash of each.
    """
    from tidewell.llm.grams import GOLDEN, mix

    empty = np.zeros(0, np.int64)
    if len(data) < minimum or not len(first):
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    hashes = Hashes(data)
    starts = np.arange(len(data) - gram + 1)
    grams = mix((hashes.sums[gram:] - hashes.sums[: len(starts)]) * hashes.inverse[: len(starts)])
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = sliding_least((grams & ~low) | starts.astype(np.uint64), minimum - gram + 1)
    valid = np.zeros(len(data) + 1, np.int32)
    np.add.at(valid, first, 1)
    np.add.at(valid, last + 1, -1)
    places = (least[np.cumsum(valid)[: len(least)] > 0] & low).astype(np.int64)
    places = places[np.concatenate(([True], places[1:] != places[:-1]))] if len(places) else places
    owner = np.searchsorted(lo, places, "right") - 1
    left = np.maximum(lo[owner], places + gram - minimum)
    right = np.minimum(hi[owner], places + minimum)
    shape = ((places - left) * 4096 + (right - places)).astype(np.uint64)
    return owner, places, grams[places], mix(hashes.of(left, right) + shape * GOLDEN)


def anchors_of(data: np.ndarray, offsets: np.ndarray, minimum: int, gram: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the places in it, gram hashes and context hashes of its selected grams."""
    none = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = [none] * (len(offsets) - 1)
    sizes = np.diff(offsets)
    i, n = 0, len(sizes)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        if offsets[j] - offsets[i] <= 2 * BLOCK_BYTES:
            base = offsets[i]
            texts = np.flatnonzero(sizes[i:j] >= minimum)
            lo, hi = offsets[i:j][texts] - base, offsets[i + 1 : j + 1][texts] - base
            if len(texts):
                owner, places, grams, contexts = selected(data[base : offsets[j]], lo, hi - minimum, lo, hi, minimum, gram)
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                places = (places - lo[owner]).astype(np.int32)
                for t, a, b in zip(texts.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    out[i + t] = (places[a:b], grams[a:b].view(np.int64), contexts[a:b].view(np.int64))
        else:  # one long text, in blocks of the strings' starts
            base, end = int(offsets[i]), int(offsets[i + 1])
            parts = []
            for at in range(base, end - minimum + 1, BLOCK_BYTES):
                stop = min(at + BLOCK_BYTES, end - minimum + 1)  # strings that start before
                lo, hi = max(base, at - minimum), min(end, stop + 2 * minimum)
                one = [np.array([x]) for x in (at - lo, stop - 1 - lo, 0, hi - lo)]
                _, places, grams, contexts = selected(data[lo:hi], *one, minimum, gram)
                parts.append((places + (lo - base), grams, contexts))
            places, grams, contexts = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, keep = np.unique(places, return_index=True)
            out[i] = (places[keep].astype(np.int32), grams[keep].view(np.int64), contexts[keep].view(np.int64))
        i = j
    return out


def expand(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], minimum: int, gram: int) -> np.ndarray:
    """shared[i, d]: whether another context of i's group has the string that starts d bytes before the gram.

    ``lefts`` are the bytes before the gram and ``rights`` those from its start, both as far as the text and
    the strings reach.
    """
    m, depth = len(lefts), minimum - gram
    shared = np.zeros((m, depth + 1), bool)
    order = np.array(sorted(range(m), key=lambda i: (groups[i], rights[i])), np.int64)
    left_len = np.array([len(x) for x in lefts])
    right_len = np.array([len(x) for x in rights])
    left = np.frombuffer(b"".join(x[::-1].ljust(depth + 1, b"\0") for x in lefts), np.uint8).reshape(m, depth + 1)
    right = np.frombuffer(b"".join(x.ljust(minimum, b"\0") for x in rights), np.uint8).reshape(m, minimum)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        for s in range(0, len(a), 4096):
            x, y = a[s : s + 4096], b[s : s + 4096]
            unlike = right[x] != right[y]
            first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), minimum)
            out[s : s + 4096] = np.minimum(first, np.minimum(right_len[x], right_len[y]))
        return out

    cls = groups[order].astype(np.int64)
    prefix = np.full(m, -1, np.int64)  # with the one before in the same interval
    inner = np.flatnonzero(cls[1:] == cls[:-1]) + 1
    prefix[inner] = common(order[inner - 1], order[inner])
    for d in range(depth + 1):
        if d:  # backward extension by one byte
            byte = left[order, d - 1].astype(np.int64)
            alive = left_len[order] >= d
            same = cls[1:] == cls[:-1]
            if not alive.all() or (same & (byte[1:] != byte[:-1])).any():
                at = np.flatnonzero(alive)
                before = np.full(m, -1, np.int64)
                before[order[1:]] = np.where(same, order[:-1], -1)
                known = np.full(m, -1, np.int64)
                known[order] = prefix
                at = at[np.argsort(cls[at] * 256 + byte[at], kind="stable")]
                key = cls[at] * 256 + byte[at]
                order = order[at]
                starts = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
                cls = np.cumsum(starts)
                single = starts & np.concatenate((starts[1:], [True])) if len(key) else starts
                order, cls, starts = order[~single], cls[~single], starts[~single]
                prefix = np.where(starts, -1, known[order])
                moved = np.flatnonzero(~starts)
                moved = moved[before[order[moved]] != order[moved - 1]]
                prefix[moved] = common(order[moved - 1], order[moved])
        if not len(order):
            break
        hit = prefix >= minimum - d
        hit[:-1] |= hit[1:] & (cls[1:] == cls[:-1])
        shared[order[hit], d] = True
    return shared


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], row.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _keyed(docs: DataFrame, key: str, text: str, *others) -> DataFrame:
    """kd and kt, which name a row's number (of any type) and text, with the number, the text and other columns."""
    return docs.select(F.xxhash64(F.lit(3), F.col(key)).alias("kd"), text_hash(text).alias("kt"), F.col(key).alias("doc"), F.col(text).alias("text"), *others)


def repeated_spans(
    docs: DataFrame, minimum: int = MINIMUM, gram: int = GRAM, key: str = "doc_id", text: str = "text", group_contexts: int = GROUP_CONTEXTS, chunk_anchors: int = CHUNK_ANCHORS,
):
    """(summary, copies, spans).

    summary has for every row kd, kt, its key, n_bytes and sha256. copies has the sha256 of the texts of at least the minimum
    that several rows have: all their bytes are repeated. spans has kd, kt and the byte ranges [(s, e), ...] of other
    texts with repeats, in arbitrary order and perhaps overlapping.

    A text that many rows have is looked at once. Anchors of the texts of a chunk meet first, so a passage
    that many texts share makes one row for each chunk and not for each text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    keyed = _keyed(docs, key, text)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewell.llm.grams import text_bytes

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                data, offsets = text_bytes(part.column(3), lower=False)
                found = anchors_of(data, offsets, minimum, gram)
                ends = offsets.tolist()
                sums = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = [pa.array([x[k] for x in found], pa.list_(pa.int32() if k == 0 else pa.int64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.string()), *lists],
                    ["kd", "kt", "doc", "n_bytes", "sha256", "places", "grams", "contexts"],
                )

    kind = dict(docs.dtypes)[key]
    made = keyed.mapInArrow(
        anchors, f"kd long, kt long, doc {kind}, n_bytes long, sha256 string, places array<int>, grams array<long>, contexts array<long>"
    )
    summary = scratch.keep(made)
    long_enough = summary.where(F.col("n_bytes") >= minimum)
    copies = long_enough.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha256")
    once = long_enough.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("kd", "kt", "n_bytes", "places", "grams", "contexts")).alias("t"))
    once = once.select("copies", "t.*")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts (places, and which of the chunk's anchors is there) and rows of the chunk's different anchors."""
        from pyspark import TaskContext

        names = ["chunk", "kd", "kt", "n_bytes", "places", "which", "anchor", "gram", "context", "n", "place"]
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held).combine_chunks()
            kd, kt, copies = (part.column(c).to_numpy() for c in ("kd", "kt", "copies"))
            place, g, c = (part.column(x).combine_chunks().flatten().to_numpy(zero_copy_only=False) for x in ("places", "grams", "contexts"))
            lengths = part.column("places").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((c, g))
            starts = np.ones(len(order), bool)
            starts[1:] = (g[order][1:] != g[order][:-1]) | (c[order][1:] != c[order][:-1])
            which = np.empty(len(order), np.int32)
            which[order] = np.cumsum(starts) - 1
            first = order[starts]  # lexsort is stable: the first text of the chunk that has the anchor
            times = np.bincount(which, minlength=len(first)).astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)[first]
            none = lambda n, t: pa.nulls(n, t)
            ints = pa.list_(pa.int32())
            single = np.flatnonzero(copies == 1)
            edges = np.concatenate(([0], np.cumsum(lengths))).tolist()
            n = len(single)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, chunk)), pa.array(kd[single]), pa.array(kt[single]), pa.array(part.column("n_bytes").to_numpy()[single]),
                    pa.array([place[edges[i] : edges[i + 1]] for i in single.tolist()], ints), pa.array([which[edges[i] : edges[i + 1]] for i in single.tolist()], ints),
                    none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int32()),
                ],
                names,
            )
            for at in range(0, len(first), 50_000):
                f = first[at : at + 50_000]
                n = len(f)
                o = owner[at : at + n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, chunk)), pa.array(kd[o]), pa.array(kt[o]), none(n, pa.int64()), none(n, ints), none(n, ints),
                        pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(g[f]), pa.array(c[f]), pa.array(times[at : at + n]), pa.array(place[f]),
                    ],
                    names,
                )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                size += len(part.column(part.schema.get_field_index("places")).flatten())
                if size >= chunk_anchors:
                    yield from flush()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from flush()

    fields = "chunk long, kd long, kt long, n_bytes long, places array<int>, which array<int>, anchor int, gram long, context long, n long, place int"
    chunked = scratch.keep(once.mapInArrow(chunks, fields))
    each = chunked.where("anchor is not null").select("chunk", "anchor", "gram", "context", "n", "kd", "kt", "place")
    alike = scratch.keep(each.groupBy("gram", "context").agg(F.sum("n").alias("n"), F.min(F.struct("kd", "kt", "place")).alias("one")))
    repeated = each.select("chunk", "anchor", "gram", "context").join(alike.where("n > 1").select("gram", "context"), ["gram", "context"]).select(F.col("chunk").alias("of"), "anchor")

    def settle(texts: pa.Table, hot: pa.Table) -> pa.Table:
        """The merged ranges of each text around its repeated anchors."""
        texts = texts.combine_chunks()
        lengths = texts.column("places").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if texts.num_rows else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(texts.num_rows), lengths)
        which = texts.column("which").combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(owner) else np.zeros(0, np.int32)
        hit = np.zeros(max(int(which.max(initial=0)), int(hot.column("anchor").to_numpy().max(initial=0))) + 1, bool)
        hit[hot.column("anchor").to_numpy()] = True
        on = np.flatnonzero(hit[which])
        owner = owner[on]
        place = texts.column("places").combine_chunks().flatten().to_numpy(zero_copy_only=False)[on].astype(np.int64) if len(on) else np.zeros(0, np.int64)
        s = np.maximum(0, place + gram - minimum)
        e = np.minimum(texts.column("n_bytes").to_numpy()[owner], place + minimum)
        opens = np.ones(len(s), bool)  # places ascend, and so do both ends
        opens[1:] = (owner[1:] != owner[:-1]) | (s[1:] > e[:-1])
        closes = np.append(opens[1:], True) if len(opens) else opens
        at = owner[opens]
        return pa.table({"kd": texts.column("kd").to_numpy()[at], "kt": texts.column("kt").to_numpy()[at], "s": s[opens], "e": e[closes]})

    texts = chunked.where("anchor is null").select("chunk", "kd", "kt", "n_bytes", "places", "which")
    settled = texts.groupBy("chunk").cogroup(repeated.groupBy("of")).applyInArrow(settle, "kd long, kt long, s long, e long")

    mixed = alike.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("gram", "k")
    wanted = alike.join(mixed, "gram").select("one.*", "gram", "n", "k")
    wanted = wanted.groupBy("kd", "kt").agg(F.collect_list(F.struct("place", "gram", "n", "k")).alias("at"))
    # Rows that repeat number and text are one text.
    held = keyed.select("kd", "kt", "text").join(wanted, ["kd", "kt"]).dropDuplicates(["kd", "kt"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kd", "kt", "place", "gram", "n", "k", "before", "after"]
        for batch in batches:
            rows: list[tuple] = []
            for kd, kt, body, at in zip(*(batch.column(c) for c in ("kd", "kt", "text", "at")), strict=True):
                raw = (body.as_py() or "").encode()
                for z in at.as_py():
                    x = z["place"]
                    rows.append((kd.as_py(), kt.as_py(), x, z["gram"], z["n"], z["k"], raw[max(0, x + gram - minimum) : x], raw[x : x + minimum]))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    found = scratch.keep(held.mapInArrow(contexts, "kd long, kt long, place long, gram long, n long, k long, before binary, after binary"), "zstd")

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> pa.RecordBatch:
            groups = np.unique(rows.column("gram").to_numpy(), return_inverse=True)[1]
            shared = expand(groups, rows.column("before").to_pylist(), rows.column("after").to_pylist(), minimum, gram)
            wanted = np.flatnonzero((rows.column("n").to_numpy() == 1) & shared.any(axis=1))
            kd, kt, place = (rows.column(c).to_numpy() for c in ("kd", "kt", "place"))
            owner, s, e = [], [], []
            for i in wanted.tolist():
                near, far = _runs(shared[i])
                owner += [i] * len(near)
                s += (place[i] - far).tolist()
                e += (place[i] - near + minimum).tolist()
            owner = np.array(owner, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(kd[owner]), pa.array(kt[owner]), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["kd", "kt", "s", "e"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while rest.num_rows >= BATCH_CONTEXTS:
                gram_of = rest.column("gram").to_numpy()
                cuts = np.flatnonzero(gram_of[1:] != gram_of[:-1]) + 1
                cuts = cuts[cuts <= BATCH_CONTEXTS]
                if not len(cuts):
                    break
                yield done(rest.slice(0, int(cuts[-1])))
                rest = rest.slice(int(cuts[-1]))
        if rest is not None and rest.num_rows:
            yield done(rest)

    few = found.where(F.col("k") <= group_contexts).repartition(F.col("gram")).sortWithinPartitions("gram")
    few = few.mapInArrow(expanded, "kd long, kt long, s long, e long")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every string of the minimum length of a context, by its place and hash."""
        from tidewell.llm.grams import mix

        names = ["kd", "kt", "n", "gram", "s", "back", "hash"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols: list[list[np.ndarray]] = [[] for _ in names]
                for kd, kt, place, g, n, before, after in zip(*(part.column(c).to_pylist() for c in ("kd", "kt", "place", "gram", "n", "before", "after")), strict=True):
                    data = np.frombuffer(before + after, np.uint8)
                    first = np.arange(len(data) - minimum + 1)
                    first = first[(first <= len(before)) & (first + minimum >= len(before) + gram)]
                    hashed = mix(Hashes(data).of(first, first + minimum)).view(np.int64)
                    for c, x in zip(cols, (kd, kt, n, g, place - len(before) + first, len(before) - first, hashed), strict=True):
                        c.append(np.full(len(first), x, np.int64) if np.isscalar(x) else x.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)

    many = found.where(F.col("k") > group_contexts).mapInArrow(strings, "kd long, kt long, n long, gram long, s long, back long, hash long")
    twice = many.groupBy("gram", "back", "hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", "back", "hash")
    many = many.where("n = 1").join(twice, ["gram", "back", "hash"]).select("kd", "kt", "s", (F.col("s") + minimum).alias("e"))
    single = chunked.where("anchor is null").select("kd", "kt")
    spans = settled.unionByName(few).unionByName(many).groupBy("kd", "kt").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = scratch.keep(spans.join(single, ["kd", "kt"], "left_semi"))
    return summary, copies, spans


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((z["s"], z["e"]) for z in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in spans:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]])


def repeat_summary(docs: DataFrame, minimum: int = MINIMUM, gram: int = GRAM, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """For every row key, n_bytes, n_removed, n_spans (maximal runs of removed bytes) and kept_sha256 of what stays.

    A byte goes if a string of ``minimum`` bytes that covers it also starts elsewhere, in the same text or another;
    strings never cross texts. A null text is empty. Repeated rows are texts like any other, so they
    remove each other if long enough. A null key is kept. An empty table gives an empty result. Other columns are ignored.
    """
    summary, copies, spans = repeated_spans(docs, minimum, gram, key, text, **options)
    kind = dict(docs.dtypes)[key]
    rows = summary.select("kd", "kt", "doc", "n_bytes", "sha256").join(copies.withColumn("whole", F.lit(True)), "sha256", "left")
    whole = rows.where("whole").select(
        F.col("doc").alias(key), "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"),
    )
    single = rows.where("whole is null")
    clean = single.join(spans.select("kd", "kt"), ["kd", "kt"], "left_anti").select(
        F.col("doc").alias(key), "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw, spans = (body.as_py() or "").encode(), _merged(found.as_py())
                kept = _cut(raw, spans)
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *cols], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    held = _keyed(docs, key, text).join(spans, ["kd", "kt"])
    cut = held.select("doc", "text", "spans").mapInArrow(run, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return clean.unionByName(whole).unionByName(cut)


def remove_repeats(docs: DataFrame, minimum: int = MINIMUM, gram: int = GRAM, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows with their columns, the text without its repeated bytes.

    A character of which only some bytes go leaves none behind. Texts without repeats stay as they are, null included;
    the others have a text, which is empty if all of it goes. Texts that several rows have go whole if they are at
    least as long as the minimum. An empty table gives an empty result; other columns may have any names.
    """
    summary, copies, spans = repeated_spans(docs, minimum, gram, key, text, **options)
    every = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))
    whole = summary.join(copies, "sha256").select("kd", "kt", "n_bytes").distinct().select("kd", "kt", every.alias("spans"))
    spans = spans.join(whole.select("kd", "kt"), ["kd", "kt"], "left_anti").unionByName(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = body.as_py()
                out.append(raw if found.as_py() is None else _cut(raw.encode(), _merged(found.as_py())).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    others = [c for c in docs.columns if c != text]
    joined = _keyed(docs, key, text, F.struct(*[F.col(c) for c in others]).alias("row")).join(spans, ["kd", "kt"], "left").select("row", "text", "spans")
    row = joined.schema["row"].dataType.simpleString()
    cut = joined.mapInArrow(run, f"row {row}, text string")
    return cut.select(*[F.col("text").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
