"""Token files, periodic runs and hard negatives against plain versions of them, on small and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_small import DOCS, rows
from tidewell.llm import hard_negatives as hn
from tidewell.llm import queries, runs, token_files


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- token files --------------------------------------------------------------


@pytest.mark.parametrize("ids", [[], [0], [0] * 700, [2], [1, 255, 256, 65535, 70000, 3], list(range(5000)), [2**31 + 5, 1, 2**32 - 1]])
def test_codes_give_every_token(tmp_path, ids):
    ids = np.array(ids, np.uint32)
    path = tmp_path / "x.dac"
    path.write_bytes(token_files.file_bytes(pa.array([7]), np.array([len(ids)]), ids))
    f = token_files.TokenFile(f"file://{path}")
    assert (f.n_tokens, f.n_docs) == (len(ids), 1)
    assert f.tokens(0, len(ids)).tolist() == ids.tolist()
    for i in range(0, len(ids), max(1, len(ids) // 300)):
        assert f.token(i) == ids[i]
    for bad in (-1, len(ids)):
        with pytest.raises(IndexError):
            f.token(bad)


def test_codes_of_random_ids(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BIT_BLOCK", 64)
    rng = np.random.default_rng(3)
    for n in (1, 7, 511, 512, 513, 4000):
        ids = (rng.pareto(0.4, n) * 20).clip(0, 49_000).astype(np.uint32)
        widths = token_files.chunk_widths(ids)
        assert sum(widths) == max(1, int(ids.max()).bit_length())
        path = tmp_path / f"{n}.dac"
        path.write_bytes(token_files.file_bytes(pa.array(["a", None]), np.array([n, 0]), ids))
        f = token_files.TokenFile(f"file://{path}")
        assert [f.token(i) for i in range(n)] == ids.tolist()
        for _ in range(30):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert f.tokens(a, b).tolist() == ids[a:b].tolist()
        assert f.documents().to_pydict() == {"key": ["a", None], "start": [0, n]}


def test_codes_are_smaller_than_plain_numbers():
    ids = (np.random.default_rng(1).pareto(0.7, 100_000) * 50).clip(0, 49_000).astype(np.uint32)
    assert sum(len(x[k]) for x in token_files.encode_levels(ids, token_files.chunk_widths(ids)) for k in ("chunks", "bitmap", "ranks")) < 2 * len(ids)


def expected_tokens(found):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {x: [*t.encode(x or "", add_special_tokens=False).ids, 2] for x in {r["text"] for r in found}}


@pytest.mark.parametrize("file_tokens", [1, 300, 1 << 20])
def test_token_files(spark, docs, tmp_path, file_tokens):
    found = docs.collect()
    ids = expected_tokens(found)
    path = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(docs, path, file_tokens=file_tokens)
    got = token_files.read_token_files(manifest, "bigint", with_ids=True).orderBy("start").collect()
    assert len(got) == len(found)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    keys = [r["key"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    as_bytes = lambda x: np.array(x, "<u4").tobytes()
    assert sorted((str(r["key"]), bytes(r.ids)) for r in got) == sorted((str(r.doc_id), as_bytes(ids[r.text])) for r in found)
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    assert all(token_files.token_at(spark, manifest, p) == whole[p] for p in (0, 5, at // 2, at - 1))
    with pytest.raises(IndexError):
        token_files.token_at(spark, manifest, at)
    listed = {r.file for r in manifest.collect()}
    assert {f"{path}/{p.name}" for p in (tmp_path / "files").glob("*.dac")} == listed
    if file_tokens == 300:
        assert len(listed) > 10


def test_token_files_of_nothing_and_of_text_keys(spark, none, docs):
    assert token_files.written_tokens(none).count() == 0
    named = docs.selectExpr("concat('d', cast(doc_id as string)) as doc_id", "text")
    a = token_files.written_tokens(named).orderBy("start").collect()
    assert [r.doc_id for r in a] == sorted((r.doc_id for r in a), key=lambda k: (k is not None, k or ""))
    # rows of one number are ordered by their text, so the split of the input doesn't matter
    one = docs.selectExpr("1L as doc_id", "text")
    b, c = (token_files.written_tokens(x).orderBy("start").collect() for x in (one, one.repartition(7)))
    assert b == c


def test_a_large_group_of_one_row_is_spread_over_files(spark, tmp_path):
    copies = spark.range(3000).selectExpr("5L as doc_id", "'the same few words again' as text")
    manifest = token_files.write_token_files(copies, f"file://{tmp_path}/files", file_tokens=1000)
    assert manifest.count() >= 15
    got = token_files.read_token_files(manifest, "bigint").collect()
    assert sorted(r.start for r in got) == [i * got[0].n_tokens for i in range(3000)]


# --- runs ---------------------------------------------------------------------


def plain_runs(w, least=24, times=3):
    w = np.array([hash(x) for x in w], np.int64)
    best = {}
    for p in range(1, len(w) // times + 1):
        equal = (w[:-p] == w[p:]).astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], equal, [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s + p >= max(least, times * p):
                best.setdefault((s, e - s + p), p)
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def awkward_words(rng):
    out = [[], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"a"] * 500, [b"a", b"b"] * 12, [b"a", b"b"] * 300 + [b"c"] + [b"a", b"b"] * 300]
    thue = [0]
    for _ in range(11):
        thue += [1 - x for x in thue]
    out.append([b"ab"[x : x + 1] for x in thue])
    out.append([b"ab"[x : x + 1] for x in thue] * 4)
    for _ in range(60):
        n, letters = rng.randint(1, 400), rng.choice([1, 2, 3, 30])
        w = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
        a, p = rng.randrange(n), rng.randint(1, 20)
        out.append([w[i] if i < a else w[a + (i - a) % min(p, n - a)] for i in range(n)])
    return out


@pytest.mark.parametrize(("least", "times"), [(24, 3), (1, 2), (6, 2), (9, 4)])
def test_runs_of_words(least, times):
    texts = awkward_words(random.Random(least))
    for got, w in zip(runs.runs_of(texts, least, times), texts, strict=True):
        assert got == plain_runs(w, least, times)


def test_runs_do_not_rest_on_hashes(monkeypatch):
    """With hashes of 5 values nearly all comparisons are wrong; words decide."""
    monkeypatch.setattr(runs, "MOD", 5)
    monkeypatch.setattr(runs, "BASE", 2)
    monkeypatch.setattr(runs, "BLOCK_PAIRS", 50)
    texts = awkward_words(random.Random(8))[:40]
    for got, w in zip(runs.runs_of(texts), texts, strict=True):
        assert got == plain_runs(w)


def test_runs_of_a_text_of_megabytes():
    rng = random.Random(2)
    w = [str(rng.randrange(20_000)).encode() for _ in range(400_000)]
    w[100_000:130_000] = (w[100_000:107_000] * 5)[:30_000]
    w[300_000:300_400] = [b"x"] * 400
    got = runs.runs_of([w, [b"y"] * 100_000])
    assert got[1] == [(0, 100_000, 1)]
    assert [r for r in got[0] if r[2] == 1] == [(300_000, 400, 1)]
    s, n, p = next(r for r in got[0] if r[2] > 1)
    assert p == 7000 and s <= 100_000 and s + n >= 130_000


def test_periodic_runs_of_awkward_rows(docs, none):
    extra = docs.withColumn("text", docs["text"])
    got = runs.periodic_runs(extra.withColumnRenamed("kd", "Runs").withColumnRenamed("kt", "collapsed")).collect()
    assert len(got) == docs.count()
    for r in got:
        w = (r.text or "").encode().split()
        found = [(x.start, x.length, x.period) for x in r.runs]
        assert found == plain_runs(w) and r.n_words == len(w)
        drop = {i for s, n, p in found for i in range(s + p, s + n)}
        assert r.collapsed == " ".join(x.decode() for i, x in enumerate(w) if i not in drop)
    assert any(r.runs for r in got)
    assert runs.periodic_runs(none).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        runs.periodic_runs(docs, least_periods=1)


def plain_digests(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *one, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_run_query(spark, sf_dir, docs):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = queries.op12_periodic_runs(spark, sf_dir).select(columns).collect()
    want = [plain_digests(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_runs for r in got) > 10
    again = runs.run_digests(runs.periodic_runs(runs.with_repeats(docs))).select(columns).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(str(plain_digests(r.doc_id, r.text)) for r in docs.collect())


# --- hard negatives -----------------------------------------------------------


def plain_negatives(found, is_anchor, scale=256, k=5, m=3, low=50, high=95):
    good = []
    for i, label, v in found:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, label, [math.floor(scale * x) for x in v]))
    out = []
    for a, label, v in good:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u, strict=False)), i, other) for i, other, u in good if i != a)
        for ps, p, _ in [x for x in scored if x[2] == label][:k]:
            hits = [x for x in scored if x[2] != label and low * -ps <= 100 * -x[0] <= high * -ps][:m]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(hits, 1)]
    return sorted(out)


def vectors(seed, n, dim=6, labels=3):
    rng = random.Random(seed)
    near = [[rng.uniform(0, 1) for _ in range(dim)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = rng.randrange(labels)
        out.append((i, label, [x + rng.uniform(-0.4, 0.4) for x in near[rng.choice([label, 0])]]))
    return out


KINDS = "vec_id long, label int, embedding array<float>"


def as_floats(found):
    return [(i, n, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, n, v in found]


@pytest.mark.parametrize(("few", "blocks"), [(0, (16, 7)), (4, (16, 64)), (32, (2048, 512))])
def test_hard_negatives(spark, monkeypatch, few, blocks):
    monkeypatch.setattr(hn, "FEW_ROWS", few)
    monkeypatch.setattr(hn, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", blocks[1])
    nan, inf = float("nan"), float("inf")
    found = vectors(1, 150)
    one = [0.5] * 6
    found += [(1000 + i, i % 4, one) for i in range(90)]  # one common vector: ties of score among many numbers
    found += [(-5, 1, one), (-10, 0, one), (2, 1, one), (20, 2, [0.25] * 6), (20, 2, [0.25] * 6), (2_000_000_000_000, 0, one)]
    found += [(None, 1, one), (3000, None, one), (3010, 1, None), (3020, 1, [0.1, None, 0, 0, 0, 0]), (3030, 1, [nan] * 6), (3040, 1, [inf] * 6), (3050, 0, []), (3060, 1, [1.0, 2.0])]
    found = as_floats(found)
    got = hn.hard_negatives(spark.createDataFrame([(*r, "x", 1) for r in found], KINDS + ", w string, id int").repartition(5), spark_anchor())
    want = plain_negatives(found, lambda i: i % 10 == 0)
    assert len(want) > 100
    assert sorted(map(tuple, got.collect())) == want


def spark_anchor():
    from pyspark.sql import functions as F

    return F.col("vec_id") % 10 == 0


def test_hard_negatives_of_large_numbers_and_of_none(spark):
    found = as_floats([(i * 10, i % 2, [1e6 + i * 1e5, -3e5]) for i in range(40)])  # scores beyond what a double holds exactly
    got = hn.hard_negatives(spark.createDataFrame(found, KINDS), spark_anchor())
    want = plain_negatives(found, lambda i: True)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    table = spark.createDataFrame(found, KINDS)
    assert hn.hard_negatives(table.where("false"), spark_anchor()).count() == 0
    assert hn.hard_negatives(table.where("vec_id = 10"), spark_anchor()).count() == 0
    assert hn.hard_negatives(table, table["vec_id"] < 0).count() == 0
    with pytest.raises(ValueError, match="63 bits"):
        hn.hard_negatives(spark.createDataFrame(as_floats([(0, 1, [1e15])]), KINDS), spark_anchor())


def test_hard_negative_query(spark, sf_dir):
    got = queries.op13_hard_negatives(spark, sf_dir).collect()
    found = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, got)) == plain_negatives(found, lambda i: i % 50 == 0)


# --- workers ------------------------------------------------------------------


def test_the_archive_holds_the_library():
    import subprocess
    import sys

    from tidewell.llm.common import library_archive

    path = library_archive()
    said = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {path!r}); import tidewell.llm.runs as r; print(r.__file__, r.runs_of([[b'a'] * 30]))"], capture_output=True, text=True, cwd="/")
    assert said.stdout.startswith(path) and said.stdout.strip().endswith("[[(0, 30, 1)]]")
