"""Stored tables, file imports, versions, streams, patterns, orders, memory and evidence on small and awkward tables."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.operators import contacts, evidence, lookalike, matching, memory, ordering, stages
from tidewell.sources.stored import StoredTable, insert_with_ids
from tidewell.sources.tables import read_csv_files
from tidewell.sources.versions import Added, Dropped, Renamed, Retyped, VersionedTable
from tidewell.streaming import runs


def at(day, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=day, hours=hour)


# --- dedupe in rounds -----------------------------------------------------------


def same(a, b):
    key = lambda x: (x or "").strip().lower().removeprefix("the ").strip()
    a, b = key(a), key(b)
    return bool(a and b) and (a == b or len(a) >= 4 <= len(b) and (a in b or b in a))


def fold(rows):
    kept = {}
    for i, ord_, name, org, batch in sorted(rows, key=lambda r: (r[1], r[0])):
        mine = kept.setdefault(batch, [])
        if not any(same(name, n) or same(org, o) for _, n, o in mine):
            mine.append((i, name, org))
    return sorted(i for mine in kept.values() for i, _, _ in mine)


FOUND = "id long, ord long, name string, organization string, batch int"


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_dedupe_equals_a_fold(spark, seed):
    rng = random.Random(seed)
    part = lambda: rng.choice(["fund", "trust", "gift", "home", "ab", "x"])
    name = lambda: rng.choice([None, "", "  ", " ".join(part() for _ in range(rng.randint(1, 3))), f"The {part()} {rng.randint(1, 40)}", part() + part()])
    rows = [(i, rng.randint(0, 60), name(), name(), rng.choice([None, 1, 2])) for i in range(120)]
    got = matching.greedy_distinct(spark.createDataFrame(rows, FOUND), "batch")
    assert sorted(r.id for r in got.collect()) == fold(rows)


def test_greedy_dedupe_of_a_chain_of_copies_and_of_nothing(spark):
    chain = [(i, i, f"name{i // 2:03d}", f"unit{(i + 1) // 2:03d}", 1) for i in range(16)]  # each hangs on the one before
    copies = [(100 + i, 500 - i, "one large group", None, 1) for i in range(300)]
    assert sorted(r.id for r in matching.greedy_distinct(spark.createDataFrame(chain + copies, FOUND), "batch").collect()) == fold(chain + copies)
    assert matching.greedy_distinct(spark.createDataFrame([], FOUND), "batch").count() == 0


# --- contacts -------------------------------------------------------------------


def one_by_one(directory, writes, now):
    """The directory after the writes, one after the other."""
    rows = {r[0]: list(r) for r in directory}
    for seq, name, email, org, p, c in sorted(writes):
        email = (email or "").strip().lower() or None
        name = (name or "").strip() or (org or "").strip() or email
        if not name:
            continue
        if email:
            hit = next((r for r in rows.values() if r[2] == email), None)
            if hit:
                hit[1:6], hit[7] = [name, email, org, p, c], now
            else:
                rows[seq] = [seq, name, email, org, p, c, now, now]
            continue
        hits = [r for r in rows.values() if r[2] is None and r[1].lower() == name.lower() and r[3] == org]
        if hits:
            best = max(hits, key=lambda r: (r[6], r[0])) if all(r[6] is not now for r in hits) else next(r for r in hits if r[6] is now)
            best[4], best[5], best[7] = p if p is not None else best[4], c if c is not None else best[5], now
        else:
            rows[seq] = [seq, name, None, org, p, c, now, now]
    return sorted(map(tuple, rows.values()))


def test_merged_contacts_equal_writes_one_by_one(spark):
    rng = random.Random(4)
    directory = [(i, f"N{i % 4}", f"u{i}@x" if i % 2 else None, rng.choice([None, "O"]), i, None, at(i), at(i)) for i in range(20)]
    pick = lambda *x: rng.choice(x)
    writes = [(100 + i, pick(None, " ", f"n{i % 5} "), pick(None, " ", f"U{i % 7}@x ", "new@x"), pick(None, "O"), pick(None, i), pick(None, -i)) for i in range(60)]
    kinds = "id long, name string, email string, organization string, source_prospect_id long, source_candidate_id long, created_at timestamp, updated_at timestamp"
    now = at(100)
    got = contacts.merged(spark.createDataFrame(directory, kinds), spark.createDataFrame(writes, "seq long, name string, email string, organization string, source_prospect_id long, source_candidate_id long"), F.lit(now))
    assert sorted(map(tuple, got.collect())) == one_by_one(directory, writes, now)


# --- stored tables ----------------------------------------------------------------


def files(path):
    return {b: sorted(os.path.basename(f) for f in glob.glob(f"{path}/_bucket={b}/*.parquet")) for b in range(8)}


def test_stored_table_rewrites_only_what_it_touches(spark, tmp_path):
    path = f"{tmp_path}/t"
    t = StoredTable(spark, f"file://{path}", StructType.fromDDL("id long, name string, n int, updated_at timestamp"), "id", 8)
    t.create(spark.createDataFrame([(i, f"a{i}", i, None) for i in range(40)] + [(None, "x", 1, None)], "id long, name string, n int, updated_at timestamp"))
    rows = lambda: {r.id: (r.name, r.n) for r in t.read().collect()}
    want = {i: (f"a{i}", i) for i in range(40)}
    assert rows() == want
    before = files(path)
    write = spark.createDataFrame([(3, "new", 1), (3, "newer", 2), (99, "added", 1), (None, "none", 9)], "id long, name string, seq int")
    for _ in range(2):  # again gives the same
        t.upsert(write, "seq", F.lit(at(1)))
        want |= {3: ("newer", 3), 99: ("added", None)}
        assert rows() == want
    changed = {b for b, f in files(path).items() if f != before[b]}
    assert 1 <= len(changed) <= 2
    assert {r.id: r.updated_at for r in t.read().where("updated_at is not null").collect()} == {3: at(1), 99: at(1)}
    t.update(spark.createDataFrame([(5, None), (500, 1)], "id long, n int"))
    want[5] = ("a5", None)
    assert rows() == want
    assert [r.name for r in t.lookup([99, 7]).orderBy("id").collect()] == ["a7", "added"]
    t.delete(spark.createDataFrame([(i,) for i in range(40)], "id long"))  # whole folders lose all rows
    assert rows() == {99: ("added", None)}
    t.delete(spark.createDataFrame([(None,), (1234,)], "id long"))
    t.upsert(write.where("false"), "seq")
    assert rows() == {99: ("added", None)}
    t.upsert(spark.createDataFrame([(8, "again")], "id long, name string"))
    assert rows() == {99: ("added", None), 8: ("again", None)}


def test_children_go_with_their_parents_and_new_rows_get_ids(spark, tmp_path):
    t = StoredTable(spark, f"file://{tmp_path}/c", StructType.fromDDL("id long, parent long"), "id", 4)
    t.create(spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(30)], "id long, parent long"))
    t.delete_where_parent_in("parent", spark.createDataFrame([(1,), (1,), (7,)], "p long"))
    assert sorted(r.id for r in t.read().collect()) == [i for i in range(30) if i % 5 == 0 or i % 3 != 1]
    new = insert_with_ids(spark.createDataFrame([("b",), ("a",)], "name string"), t.read(), "id", ["name"])
    assert sorted(map(tuple, new.collect())) == [(30, "a"), (31, "b")] or sorted(map(tuple, new.collect())) == [(30, "a"), (31, "b")]
    assert insert_with_ids(spark.createDataFrame([("b",)], "name string"), t.read().where("false"), "id", ["name"]).first()["id"] == 1


# --- files ------------------------------------------------------------------------


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n  \nName,Channel\r\nA,x\r\n"B, ""b""",y\nName,Channel\n\n')
    (tmp_path / "b.csv").write_text("channel, NAME ,name,extra\nz,first,last,1\nonly\n")
    (tmp_path / "c.csv").write_text("\n \n")
    (tmp_path / "d.csv").write_text("name")
    (tmp_path / "e.csv").write_text("name,other\n" + "".join(f"e{i},x\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # the last file is read in parts
    try:
        got = [(r.file[-5], r.name, r.channel) for r in read_csv_files(spark, str(tmp_path), ["name", "channel"]).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    small = sorted(x for x in got if x[0] != "e")
    assert small == [("a", "A", "x"), ("a", 'B, "b"', "y"), ("a", "Name", "Channel"), ("b", "", "only"), ("b", "last", "z")]
    assert sorted(x[1] for x in got if x[0] == "e") == sorted(f"e{i}" for i in range(5000))


def test_versions_read_as_the_newest(spark, tmp_path):
    first = StructType.fromDDL("id long, area string, old int")
    t = VersionedTable(spark, f"file://{tmp_path}/v", first, [Retyped("area", "array<string>", "CASE WHEN area IS NOT NULL THEN array(area) END"), [Renamed("id", "key"), Added("n", "int", "7"), Dropped("old")]])
    assert t.read().count() == 0 and t.read().columns == ["key", "area", "n"]
    t.write(spark.createDataFrame([(1, "a", 1), (2, None, 2)], "id long, area string, old int"), 0)
    t.write(spark.createDataFrame([(3, ["b", "c"], 3)], "id long, area array<string>, old int"), 1)
    t.write(spark.createDataFrame([(9, None, 4)], "n int, area array<string>, key long"))
    t.write(spark.createDataFrame([(5, ["d"], None)], "key long, area array<string>, n int"))
    assert sorted(map(tuple, t.read().collect())) == [(1, ["a"], 7), (2, None, 7), (3, ["b", "c"], 7), (4, None, 9), (5, ["d"], None)]
    plan = t.read().where("key > 3")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThan(id,3)") == 2 and plan.count("GreaterThan(key,3)") == 1  # filters reach the files of all versions
    with pytest.raises(ValueError, match="already"):
        VersionedTable(spark, "x", first, [Renamed("id", "area")])


# --- streams ----------------------------------------------------------------------

EVENTS = "event_id long, run_id long, status string, at timestamp"
MOVES, ENDS = [("a", "b"), ("b", "c")], ["c", "error"]


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"file://{folder}/in/{n}")


def play(spark, folder):
    events = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")
    q = runs.start_runs(events, f"file://{folder}/out", f"file://{folder}/cp", MOVES, ENDS, 3600, "10 minutes")
    q.awaitTermination()


def test_runs_move_end_and_get_stuck(spark, tmp_path):
    put(spark, tmp_path, 1, [(1, 1, "a", at(0)), (2, 1, "c", at(0, 0.1)), (3, 1, "b", at(0, 0.2)), (4, 2, "a", at(0)), (5, 3, "a", at(0)), (6, None, "a", at(0)), (7, 4, None, at(0))])
    play(spark, tmp_path)
    out = lambda: sorted((r.run_id, r.step, r.to_status, r.accepted) for r in spark.read.schema(runs.OUT).parquet(f"file://{tmp_path}/out").collect())
    first = [(1, 1, "a", True), (1, 1, "c", False), (1, 2, "b", True), (2, 1, "a", True), (3, 1, "a", True)]
    assert out() == first
    put(spark, tmp_path, 2, [(8, 1, "c", at(0, 0.5)), (9, 3, "b", at(0, 0.9)), (10, 9, "a", at(0, 1.5))])
    play(spark, tmp_path)  # goes on from the checkpoint; run 2 has said nothing for an hour
    second = sorted([*first, (1, 3, "c", True), (3, 2, "b", True), (9, 1, "a", True), (2, 2, "error", True)])
    assert out() == second
    put(spark, tmp_path, 3, [(11, 2, "b", at(0, 1.6)), (12, 1, "a", at(0, 1.6))])
    play(spark, tmp_path)  # ended runs take no more
    assert out() == sorted([*second, (2, 2, "b", False), (1, 3, "a", False)])
    play(spark, tmp_path)
    assert len(out()) == len(second) + 2
    assert {r.run_id: (r.status, r.steps) for r in runs.current_runs(spark, f"file://{tmp_path}/out").collect()} == {1: ("c", 3), 2: ("error", 2), 3: ("b", 2), 9: ("a", 1)}


# --- patterns ---------------------------------------------------------------------


def like(pattern, name):
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c != "\\":
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.fullmatch(out, name, re.I | re.S) is not None


def test_patterns_match_as_sql_does(spark):
    rng = random.Random(7)
    names = [None, "", "a", "ab", "AbC", "a_b", "a%b", "a.b", "(x)", "line\nend", "100% sure", "back\\slash", "zz" * 9, "Ünïcode"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    patterns = [None, "", "%", "_", "__", "___%", "%_%", "abc", "a\\_b", "a\\%b", "%b%", "a%c", "%ab%ca%", "_b_", "a.b", "(%", "%\n%", "100\\% %", "back\\\\%", "ünï%", "zz%zz", "%zzz", "nothing%here", "%\\"]
    n = [(i, x) for i, x in enumerate(names + names[:9])]
    p = [(i, x) for i, x in enumerate(patterns + patterns[:5])]
    found = lookalike.looked_up(spark.createDataFrame(p, "id int, pattern string"), "pattern", spark.createDataFrame(n, "id int, name string"))
    for r in found.collect():
        hits = [i for i, x in n if x is not None and r.pattern is not None and like(r.pattern, x)]
        assert (r.matches, r.first, r.only) == (len(hits), min(hits, default=None), hits[0] if len(hits) == 1 else None), r.pattern
    assert found.count() == len(p)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan


# --- orders -----------------------------------------------------------------------


def test_sums_before_and_budgets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "k", "l"]), rng.choice([None, 0, 5, 7])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a int, k string, n int")
    got = {r.id: r.before for r in ordering.sums_before(df, ["-a", "id"], F.col("n")).collect()}
    total = 0
    for i, _, _, n in sorted(rows, key=lambda r: (-(r[1] or 0), r[0])):
        assert got[i] == total
        total += n or 0
    assert [r.place for r in ordering.numbered(df, ["id"]).orderBy("id").collect()] == list(range(1, 201))
    kept = {r.id for r in stages.budgeted(df, "n", ["id"], 40, "k").collect()}
    for key in (None, "k", "l"):
        total = 0
        for i, _, k, n in rows:
            if k == key:
                assert (i in kept) == (total < 40)
                total += n or 0
    assert ordering.sums_before(df.where("false"), ["id"], F.col("n")).count() == 0


# --- memory and evidence ------------------------------------------------------------


def test_touches_meet_the_state_of_their_time(spark):
    rng = random.Random(9)
    changes = [(i, rng.choice([None, 1, 2]), f"s{i}", at(rng.randint(0, 400))) for i in range(60)]
    touches = [(i, rng.choice([None, 1, 2, 3]), at(rng.randint(0, 500))) for i in range(150)]
    got = memory.with_state_then(spark.createDataFrame(touches, "id long, prospect_id long, occurred_at timestamp"), spark.createDataFrame(changes, "id long, prospect_id long, to_stage string, created_at timestamp"))
    rows = got.collect()
    assert len(rows) == len(touches)
    for r in rows:
        past = [(c[3], c[0], c[2]) for c in changes if c[1] is not None and c[1] == r.prospect_id and c[3] <= r.occurred_at]
        assert (r.stage_then, r.entered_at) == ((max(past)[2], max(past)[0]) if past else (None, None))


def test_refusals_that_are_due(spark):
    kinds = "id long, prospect_id long, result string, revisit_on date, created_at timestamp"
    day = lambda n: at(n).date()
    rows = [(1, 1, "no", day(5), at(0)), (2, 2, "no", day(5), at(0)), (3, 2, "yes", None, at(1)), (4, 3, "no", day(50), at(0)), (5, 4, "no", None, at(0)), (6, 5, "defer", day(5), at(0)), (7, 5, "no", day(10), at(0))]
    got = memory.revisit_due(spark.createDataFrame(rows, kinds), F.lit(at(10)))
    assert sorted((r.prospect_id, r.id, r.days_due) for r in got.collect()) == [(1, 1, 5), (5, 7, 0)]


def test_evidence_for_an_audience(spark):
    items = [(1, "public", ["a", "b", "a"]), (2, "partners_only", ["a", None]), (3, "internal", ["a", "b"]), (4, "do_not_share", ["a", "b"]), (5, None, ["a"]), (6, "public", None), (7, "odd", ["a"])]
    drafts = [(1, "public", ["a"]), (2, "partners_only", ["a", "a"]), (3, "internal", ["b", "a"]), (4, "do_not_share", ["a"]), (5, None, ["a", None]), (6, "internal", []), (7, "internal", None), (8, "internal", ["a", "nowhere"])]
    got = evidence.selectable(spark.createDataFrame(drafts, "draft_id int, audience string, tags array<string>"), spark.createDataFrame(items, "item_id int, permission string, tags array<string>"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 3), (4, 1), (5, 1)]


def test_evidence_does_not_move_an_items_tags_once_for_each_of_them(spark):
    rng = random.Random(4)
    tags = [f"{rng.getrandbits(64):016x}" for _ in range(1500)]
    items = spark.createDataFrame([(i, "public", tags) for i in (1, 2)], "item_id int, permission string, tags array<string>")
    drafts = spark.createDataFrame([(i, "public", [t]) for i, t in enumerate(tags)], "draft_id int, audience string, tags array<string>")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def written():
        bus.waitUntilEmpty()
        return sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))

    key = "spark.sql.autoBroadcastJoinThreshold"
    usual, before = spark.conf.get(key), written()
    spark.conf.set(key, -1)  # as with more drafts than a broadcast takes
    try:
        assert evidence.selectable(drafts, items).count() == 2 * len(tags)
    finally:
        spark.conf.set(key, usual)
    assert written() - before < 2_000_000  # two items of 1500 tags and 1500 drafts; 3000 copies of an item's tags make 88 MB


def test_evidence_of_repeated_and_missing_ids(spark):
    rng, tags = random.Random(6), ["a", "b", "c", "d", "e"]
    some = lambda: rng.sample(tags, rng.randint(1, 4))
    items = [(rng.choice([None, 1, 2, 3]), rng.choice(evidence.PERMISSIONS[:3]), some()) for _ in range(30)]
    drafts = [(rng.choice([None, 7, 8]), rng.choice(evidence.PERMISSIONS[:3]), some()) for _ in range(15)]
    may = evidence.PERMISSIONS.index
    want = [(d[0], i[0]) for d in drafts for i in items if may(i[1]) <= may(d[1]) and set(d[2]) <= set(i[2])]
    got = evidence.selectable(spark.createDataFrame(drafts, "draft_id int, audience string, tags array<string>"), spark.createDataFrame(items, "item_id int, permission string, tags array<string>"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
