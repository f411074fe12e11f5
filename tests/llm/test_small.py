"""Small tables: nulls, empty texts, ties, repeated rows, no rows, and columns with names that the operators use inside."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import chat, chroma, decontamination, hmm, licenses, near_join, packing, quality, queries, repeats, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kd long, kt string, row string, spans string, k int, _doc int, _hash int, text_hash int, doc int, n int, bucket int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts():
    rng = random.Random(5)
    passage, base = words(rng, 160), words(rng, 120)
    near = base.split()
    near[60] = "changed"
    out = [None, "", "   ", "one", "one two three", "tie", "tie", base, base, " ".join(near), f"{words(rng, 30)} {passage} {words(rng, 40)}", f"{words(rng, 50)} {passage}", passage]
    out += [words(rng, rng.randint(1, 300)) for _ in range(12)]
    out += ["éa" * 400, "xéa" * 300 + "é" * 500, "z" * 2000, words(rng, 3000), "line one\n" * 90, "Ünï cödé, tëxt! 123 x1y2 <|endoftext|> it's ﬁ İstanbul ½ a\x1cb Ὀδυσσεύς"]
    return out


def rows():
    found = [(i, t, "en", None if i % 3 else f"s{i % 2}", len(t or ""), 1, "x", "y", "z", 2, 3, 4, 5, 6, 7, 8) for i, t in enumerate(texts())]
    return [*found, found[7], found[1], (None, "no number", None, None, None, *found[0][5:]), (None, None, None, None, None, *found[0][5:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def clean(t):
    return t or ""


def test_chat(spark):
    rng = random.Random(1)
    parts = ["\\", "### ", "</turn>", "\n", ":", "<", "a", ":\n", "</turn>\n", "é"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "".join(rng.choices(parts, k=rng.randint(0, 8)))])) for c in range(12) for t in range(rng.randint(1, 9))]
    turns += [(None, 0, "user", "x"), (3, None, "assistant", "late"), turns[0], (5, 1, "assistant", "y" * 3_000_000), (5, 2, "user", "z" * 1_500_000)]
    df = spark.createDataFrame([(*t, 1, 2) for t in turns], "conv_id long, turn long, role string, text string, part int, piece int").repartition(4)
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    by: dict = {}
    for c, t, r, x in turns:
        by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    assert set(got) == set(by)
    for c, found in by.items():
        ordered = [(r, x) for _, _, _, r, _, x in sorted(found)]
        masked = "".join(x for r, x in ordered if r == "assistant")
        assert got[c]["n_turns"] == len(ordered)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ordered).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(chat.render(r, x)[0]) for r, x in ordered)
    for r in chat.format_turns(df.where("role = 'assistant'")).collect():
        assert chat.unescape(r["rendered"][r["loss_start"] : r["loss_end"]]) == r["text"]
    assert chat.conversation_digests(df.where("false")).count() == 0


def contained_by_hand(docs, items):
    def grams(t):
        w = re.findall(r"[^\W_]+", clean(t).lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets: dict = {}
    for i, t in items:
        sets.setdefault(i, set()).update(grams(t))
    out = set()
    for d, t in docs:
        g = grams(t)
        out |= {(d, i, len(s & g)) for i, s in sets.items() if s and len(s & g) >= 0.8 * len(s)}
    return out


def test_decontamination(spark, docs, none):
    base = texts()[7]
    w = texts()[22].split()
    items = [(1, base), (2, " ".join(base.split()[:40]).upper()), (3, "one two three"), (4, None), (5, " ".join(w[:6])), (6, " ".join(w[:50] + ["oops"] + w[51:60])), (None, base), (1, " ".join(w[:9]))]
    bench = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, h int, q int")
    want = contained_by_hand([(r[0], r[1]) for r in rows()], items)
    for limit in (decontamination.BROADCAST_SHINGLES, 0):
        got = decontamination.contained_items(docs, bench, broadcast_shingles=limit).collect()
        assert {(r["doc_id"], r["item_id"], r["found"]) for r in got} == want
        assert len(got) == len(want)
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = {d for d, _, _ in want}
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(r[0]) for r in rows() if r[0] not in bad)
    assert decontamination.contained_items(none, bench).count() == decontamination.contained_items(docs, bench.where("false")).count() == 0
    assert decontamination.least_hits(16, 0.8, 1e-6) == 4


def test_sharding(docs, none, tmp_path):
    got = sharding.shuffle_into_shards(docs, 7, bucket_bytes=300).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len(clean(r[1]).encode()) + 16, zlib.crc32(clean(r[1]).encode())) for r in rows())
    for s in range(7):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    grown = {(r["doc_id"], r["shard"]) for r in sharding.shuffle_into_shards(docs, 8, payload=[]).collect()}
    assert {(r["doc_id"], r["grown_shard"]) for r in got} == grown
    assert all(r["grown_shard"] in (r["shard"], 7) for r in got)
    again = sharding.shuffle_into_shards(docs, 7, bucket_bytes=300).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shuffle_into_shards(none, 7).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(rows())


def test_sharding_query_reads_what_it_wrote(docs, none, spark, tmp_path):
    want = sharding.shuffle_into_shards(docs, 40, payload=[]).drop("record").collect()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op3_sharding(spark, str(tmp_path))
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, want)) and out.columns == list(want[0].__fields__)
    at = {f.rsplit("/shard=", 1)[0] for f in out.inputFiles()}
    assert len(at) == 1
    kept = spark.read.parquet(at.pop())
    assert Counter((r["key"], r["text"], *r["rest"]) for r in kept.collect()) == Counter(rows())
    assert sharding.written_shards(none).count() == 0


def classes_by_hand(found, threshold=0.8):
    def grams(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", clean(t).lower())
        m = min(5, len(w))
        return frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if w else frozenset()

    sets = [grams(t) for _, t in found]
    root = list(range(len(found)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(found)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= threshold * len(a | b):
                root[top(i)] = top(j)
    return [top(i) for i in range(len(found))]


def test_near_classes(spark, docs, none):
    found = [(r[0], r[1]) for r in rows()]
    by_hand = classes_by_hand(found)
    least: dict = {}
    for (d, _), c in zip(found, by_hand, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    got = near_join.near_classes(docs).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter((d, least.get(c)) for (d, _), c in zip(found, by_hand, strict=True))
    sizes = Counter(by_hand)
    assert Counter((r["doc_id"], r["class_size"]) for r in got) == Counter((d, sizes[c]) for (d, _), c in zip(found, by_hand, strict=True))
    assert near_join.near_classes(none).count() == 0


def test_near_classes_of_one_large_group(spark):
    rng = random.Random(9)
    base = words(rng, 150).split()
    found = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = words(rng, 1) + str(i)
        found.append((i, " ".join(w)))
    by_hand = classes_by_hand(found)
    least: dict = {}
    for (d, _), c in zip(found, by_hand, strict=True):
        least[c] = min(d, least.get(c, d))
    got = near_join.near_classes(spark.createDataFrame(found, "doc_id long, text string")).collect()
    assert len(least) > 10
    wrong = sum(r["class_id"] != least[by_hand[r["doc_id"]]] for r in got)
    assert wrong == 0


def truncated_group():
    """Pairs of copies of one text, more alike than the pairs are to each other, and copies that lack a piece."""
    rng = random.Random(21)
    base, out = words(rng, 200).split(), []

    def edited(w, n):
        w = list(w)
        for i in rng.sample(range(len(w)), n):
            w[i] = words(rng, 1) + str(rng.randrange(10**6))
        return w

    for _ in range(120):
        w = edited(base, 2)
        out += [edited(w, 2), edited(w, 2)]
    for i in range(100):
        at = rng.randrange(200)
        out.append([*(base[at:] + base[:at])[:146], f"end{i}"])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def links_by_hand(spark, found, threshold=0.8):
    """All pairs of texts that share a bucket and are as similar as the threshold."""
    df = spark.createDataFrame(found, "doc_id long, text string")
    signed = near_join.signatures(df, *near_join.bands_for(threshold), 5, 11, "text", "doc_id").collect()
    bands = {r["doc"]: set(r["bands"]) for r in signed}
    grams = {d: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for d, w in ((d, t.split()) for d, t in found)}
    pairs = [(a, b) for a, _ in found for b, _ in found if a < b and bands[a] & bands[b]]
    return [(a, b) for a, b in pairs if len(grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b])]


def test_near_classes_of_a_group_with_truncated_copies(spark, monkeypatch):
    monkeypatch.setattr(near_join, "HUBS", 1)
    found = truncated_group()
    got = {r["doc_id"]: r["class_id"] for r in near_join.near_classes(spark.createDataFrame(found, "doc_id long, text string")).collect()}
    links = links_by_hand(spark, found)
    assert len(links) > 100 and len(set(got.values())) > 20
    assert [(a, b) for a, b in links if got[a] != got[b]] == []


@pytest.mark.parametrize("block", [16, 256])
def test_links_of_one_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(near_join.link_counts, "__defaults__", (block,))
    rng = random.Random(9)
    base, found = words(rng, 150).split(), []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = words(rng, 1) + str(i)
        found.append((i, " ".join(w)))
    grams = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in found)]
    got = near_join.near_classes(spark.createDataFrame(found, "doc_id long, text string")).collect()
    cls = {r["doc_id"]: r["class_id"] for r in got}
    want = {i: sum(i != j and cls[i] == cls[j] and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(grams)) for i, a in enumerate(grams)}
    assert max(want.values()) > 40
    assert {r["doc_id"]: r["n_links"] for r in got} == want


def test_bands():
    bands, r = near_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** bands >= 0.999 and bands * r <= 160


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in rows():
        ids = np.array([*tok.encode(clean(r[1]), add_special_tokens=False).ids, 2], "<u4")
        want[(r[0], len(ids), ids.tobytes())] += 1
    got = packing.pack(docs, sequence=64, window_sequences=2, with_ids=True).collect()
    total = sum(n * k for (_, n, _), k in want.items())
    assert sum(r["length"] for r in got) == total
    by_place = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    lengths = Counter()
    for r in by_place:
        assert r["offset"] == lengths[r["sequence_id"]]
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        lengths[r["sequence_id"]] += r["length"]
    assert all(n == 64 or n & (n - 1) == 0 and n < 64 for n in lengths.values()) and set(lengths) == set(range(len(lengths)))
    pieces = Counter()
    for (d, n, ids), k in want.items():
        for r in got:
            if r["doc_id"] == d and r["doc_tokens"] == n and r["ids"] == ids[4 * r["start"] : 4 * (r["start"] + r["length"])]:
                pieces[(d, n, ids)] += r["length"] / (k if k > 1 else 1)
    assert all(pieces[x] >= x[1] for x in want)
    assert packing.pack(none).count() == 0


def test_packing_follows_weights(spark):
    docs = spark.createDataFrame([(i, "word " * 50, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    got = packing.pack(docs, weights={"a": 3.0, "b": 1.0}, sequence=256, window_sequences=4).collect()
    early = [r for r in got if r["sequence_id"] < 40]
    share = sum(r["length"] for r in early if r["source"] == "a") / sum(r["length"] for r in early)
    assert abs(share - 0.75) < 0.02
    assert sum(r["length"] for r in got) == 400 * 51


def test_packing_does_not_depend_on_splits(spark):
    found = [(i % 90, f"text {i % 45} " * (1 + i % 13), "abc"[i % 3]) for i in range(300)]
    found += [(None, None, None), (7, "copy of one row", "a"), (None, "no number", "b")] * 120
    docs = spark.createDataFrame(found, "doc_id long, text string, source string")

    def packed(parts, order):
        given = docs.repartition(parts, *order).withColumn("n", F.lit(1)).withColumn("row", F.lit("x"))
        return Counter(tuple(r) for r in packing.pack(given, sequence=64, window_sequences=2, bucket_docs=8).collect())

    one = packed(1, ["text"])
    assert one == packed(7, [F.rand(3)]) and sum(n * r[2] for r, n in one.items()) > 0
    places = sorted((r[5], r[6], r[2]) for r, n in one.items() for _ in range(n))
    ends = {}
    for seq, at, n in places:
        assert at == ends.get(seq, 0)
        ends[seq] = at + n


def test_packing_steers_the_mix(spark):
    docs = spark.createDataFrame([(i, "word " * 50, "b" if i % 10 == 0 else "a") for i in range(1000)], "id long, body string, kind string")
    got = packing.pack(docs, sequence=256, window_sequences=4, exponent=0.5, key="id", text="body", source="kind").collect()
    early = [r for r in got if r["sequence_id"] < 40]
    share = sum(r["length"] for r in early if r["kind"] == "b") / sum(r["length"] for r in early)
    assert abs(share - 0.25) < 0.02  # 0.1 and 0.9 by their roots: 1 to 3
    assert sum(r["length"] for r in got) == 1000 * 51 and {r["id"] for r in got} == set(range(1000))


def repeats_by_hand(found, m=400):
    raw = [clean(t).encode() for t in found]
    count = Counter(b[p : p + m] for b in raw for p in range(len(b) - m + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - m + 1):
            if count[b[p : p + m]] > 1:
                gone[p : p + m] = b"\1" * m
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((len(b), sum(gone), sum(1 for i, y in enumerate(gone) if y and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [50_000, 1])
def test_repeats(docs, none, limit):
    found = [r[1] for r in rows()]
    want = Counter((r[0], *w) for r, w in zip(rows(), repeats_by_hand(found), strict=True))
    got = repeats.repeat_summary(docs, group_contexts=limit).collect()
    assert Counter(tuple(r) for r in got) == want
    if limit > 1:
        cut = repeats.remove_repeats(docs)
        assert cut.columns == docs.columns and cut.count() == len(found)
        assert repeats.repeat_summary(none).count() == 0
        gone = {r["doc_id"]: r["text"] for r in cut.collect()}
        assert len(gone[12]) == 0 and gone[0] is None and gone[3] == "one"


def test_repeats_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    alphabet = "ab"
    long = "".join(rng.choice(alphabet) for _ in range(9000))
    found = [long, long[2000:2600] + "c" + long[5000:5450], "".join(rng.choice(alphabet) for _ in range(600)), long[100:560] + "d" + long[100:480], "ab" * 450]
    from tidewell.llm.grams import text_bytes

    import pyarrow as pa

    data, offsets = text_bytes(pa.array(found), lower=False)
    whole = repeats.anchors_of(data, offsets, 400, 96)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 700)
    parts = repeats.anchors_of(data, offsets, 400, 96)
    for a, b in zip(whole, parts, strict=True):
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeat_summary(df).collect()}
    assert [got[i] for i in range(len(found))] == repeats_by_hand(found)


def test_repeats_of_small_chunks_and_text_keys(spark, docs):
    """A chunk of a few anchors, keys that are text, and rows that repeat often give what brute force gives."""
    rng = random.Random(12)
    passage = words(rng, 90)
    found = [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(30)] + [words(rng, 200)] * 40 + ["short"] * 5
    want = Counter((f"k{i % 50}", *w) for i, w in enumerate(repeats_by_hand(found)))
    df = spark.createDataFrame([(f"k{i % 50}", t) for i, t in enumerate(found)], "doc_id string, text string").repartition(3)
    assert Counter(map(tuple, repeats.repeat_summary(df, chunk_anchors=5).collect())) == want
    cut = repeats.remove_repeats(df, chunk_anchors=5).collect()
    assert Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in cut) == Counter(w[-1] for w in want.elements())
    assert repeats.remove_repeats(docs).schema["doc_id"].dataType.simpleString() == "bigint"


def test_language_model(docs, none):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = {i: [*re.findall(r"[^\x20\x09-\x0d]+", clean(r[1]).translate(low)), None] for i, r in enumerate(rows())}
    fold = {i: zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 for i, r in enumerate(rows())}
    count = Counter(w for i, ws in split.items() if fold[i] != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(r[0]), fold[i] == 1, len(split[i]), sum(count[w] > 0 for w in split[i]), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split[i]), 6)) for i, r in enumerate(rows()))
    got = hmm.language_scores(docs).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert hmm.language_scores(none).count() == 0


def test_forward_and_expectation_by_hand():
    rng = np.random.default_rng(2)
    mass = rng.dirichlet(np.ones(hmm.N_CLASSES))
    emit = rng.random((hmm.N_CLASSES, 3))
    model = hmm.Model.from_counts(rng.random(3), rng.random((3, 3)) * 5, emit, mass)
    b = model.prefer * mass[:, None]
    assert np.allclose(b.sum(axis=0), 1)
    seqs = [rng.integers(0, hmm.N_CLASSES, n) for n in (4, 1, 3, 4)]
    packed = hmm._Packed(seqs)
    _, _, got = model.forward(packed)
    start, move, emitted, total = model.expect(packed)
    want_move, want = np.zeros((3, 3)), []
    for s in seqs:
        paths = np.array(np.meshgrid(*[range(3)] * len(s), indexing="ij")).reshape(len(s), -1).T
        p = np.array([model.start[q[0]] * np.prod([model.move[a, c] for a, c in zip(q, q[1:])]) * np.prod(model.prefer[s, q]) for q in paths])
        want.append(np.log(p.sum()))
        for q, w in zip(paths, p / p.sum(), strict=True):
            for a, c in zip(q, q[1:]):
                want_move[a, c] += w
    assert np.allclose(got, want) and np.isclose(total, sum(want))
    assert np.allclose(move, want_move) and np.isclose(start.sum(), 4) and np.isclose(emitted.sum(), 12)


def test_quality(docs, none, labels, spark):
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.quality_scores(docs, labels.where("false")).count() == len(rows())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_quality_learns(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet".replace("sf0.001", "sf0.01"))
    y = spark.read.parquet(f"{sf_dir}/labels.parquet".replace("sf0.001", "sf0.01"))
    held = quality.quality_scores(d, y).where("held_out").join(y, "doc_id").collect()
    assert len(held) > 40 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_passages_dont_depend_on_neighbours():
    rng = random.Random(3)
    found = [words(rng, n).encode() for n in (30, 1, 90, 64)]
    def features(order):
        ends = np.concatenate(([0], np.cumsum([len(found[i]) for i in order])))
        x, sizes = quality.passage_features(np.frombuffer(b"".join(found[i] for i in order), np.uint8), ends)
        at = np.concatenate(([0], np.cumsum(sizes)))
        return {i: x[at[k] : at[k + 1]] for k, i in enumerate(order)}
    one, other = features([0, 1, 2, 3]), features([2, 0, 3, 1])
    assert all(np.array_equal(one[i], other[i]) for i in range(4))


def test_attention_gradients():
    """A step of plain descent along the gradients that ``fit`` uses lowers the loss as finite differences say."""
    rng = np.random.default_rng(4)
    model = quality.AttentionModel(7, hidden=5, gates=3)
    x, sizes, y = rng.normal(size=(9, 7)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.score(x, sizes)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grads = model.gradients(x, sizes, y, np.ones(3))
    for name, p in model.p.items():
        for at in np.ndindex(p.shape):
            was = p[at]
            p[at] = was + 1e-6
            up = loss()
            p[at] = was - 1e-6
            down = loss()
            p[at] = was
            assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-6, (name, at)


def test_language_model_beats_unigrams_on_held_out_texts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet".replace("sf0.001", "sf0.01"))
    score, base = hmm.language_scores(d).where("held_out").agg({"score": "sum", "base_score": "sum"}).select("sum(score)", "sum(base_score)").first()
    assert score > 0.95 * base  # both are negative


def test_shards_dont_depend_on_partitions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(d.repartition(n), 5).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1]


def test_licenses_against_every_place(spark):
    """Statements with a fifth of their words missing, changed or added to are found wherever brute force aligns them."""
    rng = random.Random(8)
    found = []
    for _, t in licenses.TEMPLATES:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randint(0, len(w) // 5)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["zzz"], [w[at], "zzz"]])
            found.append(f"{words(rng, rng.randint(0, 30))} {' '.join(w)} {words(rng, rng.randint(0, 30))}")
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {(r["doc_id"], r["template"]): r["coverage"] for r in sorted(licenses.license_spans(df).collect(), key=lambda r: r["coverage"])}
    split = lambda t: [x.lower() for x in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]
    number: dict = {}
    want = {}
    for k, (_, t) in enumerate(licenses.TEMPLATES):
        a = np.array([number.setdefault(w, len(number)) for w in split(t)], np.uint64)
        for i, text in enumerate(found):
            b = np.array([number.setdefault(w, len(number)) for w in split(text)], np.uint64)
            most = max(licenses.align(a, b, d)[0] for d in range(-3, len(b))) / len(a)
            if most >= 0.8:
                want[i, k] = most
    assert got.keys() <= want.keys() and len(got) >= 0.98 * len(want) and len(want) > 60
    assert sum(abs(got[x] - want[x]) < 1e-9 for x in got) >= 0.95 * len(got)


def test_text_keys(spark):
    said = [("a", 0, "user", "hi"), ("a", 1, "assistant", "yes"), (None, 0, "user", "x")]
    df = spark.createDataFrame(said, "conv_id string, turn long, role string, text string")
    assert {r["conv_id"]: r["n_turns"] for r in chat.conversation_digests(df).collect()} == {"a": 2, None: 1}
    docs = spark.createDataFrame([("a", "one two", "s"), (None, None, None)], "doc_id string, text string, source string")
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == {"a", None}


def test_licenses(docs, none, spark):
    found = [(0, "Before. Licensed under the Apache License, Version 2.0. After"), (1, "é RELEASED under the\nMIT license!"), (2, None), (3, ""), (4, "this work was licensed under the GNU General Public License version 3"), (5, "license under mit"), (6, "Released under the MIT License. " * 5), (None, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(*x, 1) for x in found], "doc_id long, text string, template int")
    got = licenses.license_spans(df).collect()
    spans = {(r["doc_id"], r["license"], dict(found)[r["doc_id"]][r["first_char"] : r["end_char"]]) for r in got}
    assert (0, "Apache-2.0", "Licensed under the Apache License, Version 2.0") in spans
    assert (1, "MIT", "RELEASED under the\nMIT license") in spans
    assert any(r["doc_id"] == 4 and r["license"] == "GPL-3.0" and r["matched"] == 11 and r["words"] == 12 for r in got)
    assert sum(r["doc_id"] == 6 and r["license"] == "MIT" for r in got) == 5
    assert (None, "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0") in spans and not any(r["doc_id"] in (2, 3, 5) for r in got)
    assert licenses.license_spans(none).count() == 0 and licenses.license_spans(docs).count() == 0


def test_alignment_is_the_longest_common_subsequence_in_the_band():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.randrange(5) for _ in range(rng.randint(1, 9))]
        b = [rng.randrange(5) for _ in range(rng.randint(1, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got = licenses.align(np.array(a, np.uint64), np.array(b, np.uint64), 0, band=20)
        assert got[0] == table[-1][-1]


def test_chroma(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 64))
    found = [(i, (centres[i % 6] + rng.normal(size=64) * (0.08 if i // 6 % 2 else 0.0)).tolist()) for i in range(240)]
    found += [(240, None), (None, found[0][1]), (241, [0.1] * 3), (100, found[100][1])]
    df = spark.createDataFrame([(*x, 1) for x in found], "vec_id long, embedding array<double>, offset int")
    media = chroma.synthesised(df)
    got = chroma.align(media, lambda k: k % 100 == 0).collect()
    members = [r for r in got if r["kind"] == "member"]
    assert len(members) == len(found)
    cls = {r["vec_id"]: r["class_id"] for r in members}
    prints = {r["vec_id"]: np.array(r["prints"], np.int32).view(np.uint32) for r in chroma.fingerprints(media).collect()}
    assert len(prints[240]) == 0
    truth = set()
    for q in (0, 100, 200):
        for k, y in prints.items():
            x = prints[q]
            for off in range(-8, 9):
                n = min(len(x) - max(0, -off), len(y) - max(0, off))
                if n >= chroma.LEAST_OVERLAP and cls[k] != cls[q]:
                    e = np.bitwise_count(x[max(0, -off) :][:n] ^ y[max(0, off) :][:n]).sum()
                    if e <= chroma.MOST_ERRORS * 32 * n:
                        truth.add((cls[q], cls[k]))
    match = {(r["class_id"], r["vec_id"]) for r in got if r["kind"] == "match"}
    assert len(truth) > 20 and len(match & truth) >= 0.95 * len(truth) and match <= truth
    single = {(r["class_id"], r["vec_id"]) for r in chroma.align(media, lambda k: k % 100 == 0, in_a_row=1).where("kind = 'match'").collect()}
    assert match <= single <= truth
    for r in got:  # each row's figures are those of its offset
        if r["kind"] == "match":
            x, y, off = prints[r["class_id"]], prints[r["vec_id"]], r["offset"]
            n = min(len(x) - max(0, -off), len(y) - max(0, off))
            e = np.bitwise_count(x[max(0, -off) :][:n] ^ y[max(0, off) :][:n]).sum()
            assert (r["overlap"], r["bit_errors"]) == (n, e) and r["votes"] >= 1
    assert chroma.align(media.where("false"), lambda k: k % 100 == 0).count() == 0


def test_chroma_compares_every_offset(spark):
    """The offset with most votes doesn't match; another, with fewer, does. Ties of votes go to the least offset."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**31, 60).astype(np.int32)
    y = rng.integers(0, 2**31, 60).astype(np.int32)
    flip = np.array([1 << (i % 31) for i in range(60)], np.int32)
    y[4:] = x[:56] ^ flip[:56]
    y[4:6] = x[:2]  # one key at the offset that matches
    y[30:36] = x[2:8]  # five at one that doesn't
    made = spark.createDataFrame([(0, x.tolist()), (1, y.tolist()), (2, [7] * 60), (3, [7] * 40)], "vec_id long, prints array<int>")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(chroma, "fingerprints", lambda df, *_: df)
        got = {(r["class_id"], r["vec_id"]): r for r in chroma.align(made, lambda k: k % 2 == 0).where("kind = 'match'").collect()}
    assert set(got) == {(0, 1), (2, 3)}
    assert (got[0, 1]["offset"], got[0, 1]["votes"]) == (4, 1)
    assert (got[2, 3]["offset"], got[2, 3]["overlap"], got[2, 3]["bit_errors"]) == (-20, 40, 0)  # 39 votes at each offset from -20 to 0


def test_pipeline(docs, none, labels, spark, tmp_path):
    bench = spark.createDataFrame([(1, texts()[22])], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns and out.count() <= at.count(), name
    kept = corpus_pipeline.near_duplicates(spark, at, str(tmp_path)).collect()
    assert len(kept) == len(set(classes_by_hand([(r[0], r[1]) for r in rows()])))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def test_language_model_does_not_depend_on_chunks(spark, monkeypatch):
    """Words with counts of their own, in one chunk or in many, give the same model; more of them fit held-out texts better."""
    rng = random.Random(31)
    topics = [[f"w{t}x{i}" for i in range(30)] for t in range(4)]
    data = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(60))) for i in range(400)] + [(None, None), (1, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(hmm, "OWN_FROM", 8)
    one, many = (sorted(map(str, ((r["doc_id"], round(r["score"], 3)) for r in hmm.language_scores(df.repartition(n, "text")).collect()))) for n in (1, 7))
    assert one == many
    held = hmm.language_scores(df).where("held_out").agg({"score": "sum", "base_score": "sum"}).first().asDict()
    assert held["sum(score)"] > 0.9 * held["sum(base_score)"]
    for own_from in (1, 8):  # the forward recursion stays exact and the held-out score finite, whatever has its own statistics
        got = hmm.language_scores(df, own_from=own_from).where("held_out").agg({"score": "sum"}).first()[0]
        assert np.isfinite(got)
    monkeypatch.setattr(hmm, "OWN_FROM", 10**9)
    assert hmm.language_scores(df).where("held_out").agg({"score": "sum"}).first()[0] < held["sum(score)"]


def test_language_model_words_travel_once_for_a_group(spark, tmp_path):
    """Chunks make groups: a word with own counts has a row for each group and not for each chunk, and the scores stay."""
    rng = random.Random(5)
    data = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(80))) for i in range(320)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(16, "doc_id")
    scratch = hmm.Scratch(spark, "groups")
    texts, _, words, *_ = hmm.classed(df, scratch, "doc_id", "text", 8)
    chunks, groups = texts.select("chunk").distinct().count(), texts.select("grp").distinct().count()
    assert chunks > 12 and groups == hmm.LEAST_GROUPS
    assert words.groupBy("grp", "hash").count().where("count > 1").count() == 0
    assert words.count() == 40 * groups
    few, many = (sorted((r["doc_id"], round(r["score"], 3)) for r in hmm.language_scores(df, own_from=8, group_tokens=n).collect()) for n in (1, 1 << 24))
    assert few == many and len(few) == 320
