"""Edge cases of the column functions and operators, on rows written by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import arrays, dates, labels, numbers, text
from tidewell.operators import contacts, latest, lifecycle, lookups, matching, screening, stages
from tidewell.sources.tables import append_only, csv_fields, read_csv, read_csv_rows
from tidewell.streaming import latest as stream


def values(spark, fn, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    ("fn", "given", "wanted"),
    [
        (text.strip, ["\t a \n", "", None], ["a", "", None]),
        (text.null_if_empty, ["", "a", None], [None, "a", None]),
        (text.org_key, ["  The Fund ", "THEFUND", None], ["fund", "thefund", ""]),
        (text.link, ["www.x.org", "HTTP://x", " ", None], ["https://www.x.org", "HTTP://x", "", None]),
        (text.initials, ["Ann B. Lee", "ann@x.org", "", None, "é"], ["AB", "AX", "?", "?", "É"]),
        (text.greeting_name, ["ann.b_lee@x.org", "X@y"], ["Ann b lee", "X"]),
        (text.comma_list, ["a, b ,,c", " , ", "", None], [["a", "b", "c"], [], None, None]),
        (text.line_list, ["a\n\n b ", " \n", None], [["a", "b"], None, None]),
        (text.sentences, ["One. Two? three! Four", "", "A.B"], [["One.", "Two? three!", "Four"], [], ["A.B"]]),
        (text.url_query, ["a b&c"], ["a%20b%26c"]),
        (labels.fit_bucket, [None], [None]),
    ],
)
def test_text(spark, fn, given, wanted):
    assert values(spark, fn, given) == wanted


@pytest.mark.parametrize(
    ("fn", "given", "wanted"),
    [
        (numbers.short_money, [999.0, 1000.0, 25000.0, 1250.0, 1000000.0, 1200000.0, None], ["$999", "$1K", "$25K", "$1.3K", "$1M", "$1.2M", None]),
        (numbers.round_half_up, [-2.5, 2.5, 0.49], [-2, 3, 0]),
        (numbers.clamp, [-1.0, 0.5, 2.0], [0.0, 0.5, 1.0]),
        (numbers.file_size, [0.0, 1023.0, 1536.0, 2097152.0, None], ["", "1023 B", "1.5 KB", "2.0 MB", ""]),
        (labels.nearest_importance, [0.0, 2.0, 4.0, 9.0], [1, 1, 3, 5]),
        (screening.tier, [None, 0.7, 0.4, 0.39], [2, 1, 2, 3]),
    ],
)
def test_numbers(spark, fn, given, wanted):
    assert values(spark, fn, given, "double") == wanted


def test_number_of_text(spark):
    assert values(spark, numbers.number, ["1.5", "x", "", None]) == [1.5, None, None, None]


def test_health(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    got = values(spark, lambda c: dates.health_status(c.cast("date"), now), [None, "2024-01-31", "2024-02-01", "2024-02-04", "2024-02-05"])
    assert got == [None, "stalled", "due_soon", "due_soon", "on_track"]
    assert values(spark, lambda c: dates.relative_day(c.cast("timestamp"), now), ["2024-02-02", "2024-01-31", "2024-01-20"]) == ["today", "yesterday", "12 days ago"]


@pytest.mark.parametrize(
    ("field", "operator", "value", "passes"),
    [
        (None, "equals", None, True), ("A", "equals", "a", True), (None, "not_equals", "x", True), ("abc", "contains", "", True), ("abc", "not_contains", "", False), ("  \t", "is_set", None, False),
        ("  \t", "is_not_set", None, True), ("x", "is_set", None, True), ("x", "resembles", "x", False),
    ],
)
def test_criteria(spark, field, operator, value, passes):
    df = spark.createDataFrame([(field, operator, value)], "f string, o string, v string")
    assert df.select(screening.criterion(F.col("f"), F.col("o"), F.col("v"))).first()[0] is passes


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("The Maclellan Foundation", "Maclellan Foundation", True), ("Assemblies of God", "Assemblies of God World Missions (AGWM)", True), ("AGW", "AGW Fund", False),
        ("2PC Foundation", "Second Presbyterian Church Foundation", False), ("", "", False), (None, "x", False),
    ],
)
def test_same_org(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(matching.same_org(F.col("a"), F.col("b"))).first()[0] is same
    found = spark.createDataFrame([(1, a, None)], "id int, name string, organization string")
    known = spark.createDataFrame([(b, None)], "name string, organization string")
    assert matching.fuzzy_anti_join(found, known).count() == (0 if same else 1)


def test_greedy_distinct_depends_on_order(spark):
    rows = [(1, 1, "Grace Fund", None, "a"), (2, 2, "Grace Fund of Ohio", None, "a"), (3, 3, "Hope", "Grace Fund", "a"), (4, 4, "Hope", None, "b"), (5, 5, "hope", None, "b")]
    df = spark.createDataFrame(rows, "id int, ord int, name string, organization string, batch string")
    assert sorted(r["id"] for r in matching.greedy_distinct(df, "batch").collect()) == [1, 3, 4]


def test_csv(spark, tmp_path):
    given = ['"Fund, ""A""",foundation,,"Education, Youth"', 'a"b,c"d,e', '"",x', "a,,b", '""""', 'x"",y', "", '"open,end']
    wanted = [['Fund, "A"', "foundation", "", "Education, Youth"], ["ab,cd", "e"], ["", "x"], ["a", "", "b"], ['"'], ["x", "y"], [""], ["open,end"]]
    assert values(spark, csv_fields, given) == wanted
    path = tmp_path / "in.csv"
    path.write_text("Name, Channel ,name\n\nA,church, B \nC,daf\n")
    rows = read_csv(spark, str(path), ["name", "channel", "website"]).collect()
    assert [tuple(r) for r in rows] == [("B", "church", ""), ("", "daf", "")]
    lines = spark.createDataFrame([("x,y",)], "value string")
    assert read_csv_rows(lines, "a,b", ["b"]).first()["b"] == "y"


def test_board_and_detail_differ(spark):
    ts = lambda d: datetime(2024, 1, d)
    p = spark.createDataFrame([(1, "outreach", ts(1)), (2, "outreach", ts(1))], "id int, stage string, created_at timestamp")
    log = spark.createDataFrame([(1, 1, "outreach", ts(5)), (2, 1, "proposal", ts(9))], "id int, prospect_id int, to_stage string, created_at timestamp")
    now = F.lit("2024-01-11").cast("timestamp")
    board = {r["id"]: r["days"] for r in stages.days_in_stage(p, log, now).collect()}
    detail = {r["id"]: r["days"] for r in stages.days_since_entry(p, log, now).collect()}
    assert board == {1: 10.0, 2: 10.0} and detail == {1: 6.0, 2: 10.0}


def test_ties_and_nulls_of_latest(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, None, 1)], "id int, k string, created_at int")
    assert sorted(r["id"] for r in latest.latest_per_key(df, ["k"]).collect()) == [2, 3]


def test_screening_without_rules(spark):
    e = spark.createDataFrame([(1, "x", "n"), (2, None, "m")], "id int, channel string, name string")
    kinds = "rule_id int, ord int, label string, channel string, weight int, field string, operator string, value string, active boolean"
    r = spark.createDataFrame([(1, 1, "l", "y", 3, "name", "is_set", None, True), (2, 2, "l", None, 3, "name", "is_set", None, False)], kinds)
    got = {x["id"]: x for x in screening.screened(e, r, ["channel", "name"]).collect()}
    assert all((got[i]["score"], got[i]["share"], got[i]["tier"], got[i]["breakdown"]) == (0, None, 2, []) for i in (1, 2))
    r = r.withColumn("active", F.lit(True))
    got = {x["id"]: x for x in screening.screened(e, r, ["channel", "name"]).collect()}
    assert [got[i]["tier"] for i in (1, 2)] == [1, 1] and got[2]["max_possible"] == 3


def test_contacts(spark):
    df = spark.createDataFrame([(None, "X", "A@B.c"), (" ", None, " Q@r "), (None, None, None)], "n string, o string, e string")
    got = [tuple(r) for r in df.select(contacts.display_name(F.col("n"), F.col("o"), F.col("e")), contacts.clean_email(F.col("e"))).collect()]
    assert got == [("X", "a@b.c"), ("q@r", "q@r"), (None, None)]


def test_lifecycle(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id int, stage string")
    commands = spark.createDataFrame([(1, 1, 5, "a", "c"), (2, 2, 5, "a", "c"), (3, 3, 5, "a", "c"), (4, 1, 5, "a", "d"), (5, 1, 4, "x", "e")], "id int, record_id int, created_at int, from_stage string, to_stage string")
    moved = lifecycle.move_stages(p, commands)
    assert {r["id"]: r["accepted"] for r in moved.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {tuple(r) for r in lifecycle.apply_moves(p, moved.where("accepted")).collect()} == {(1, "c"), (2, "b")}
    stamped = lifecycle.apply_moves(p, moved.where("accepted"), F.lit("2024-02-01").cast("timestamp")).collect()
    assert {r["id"]: r["updated_at"] is not None for r in stamped} == {1: True, 2: False}
    kids = spark.createDataFrame([(10, 1), (11, 9), (12, None)], "id int, parent int")
    assert [r["id"] for r in lifecycle.orphans(kids, p, "parent", "id").collect()] == [11]
    assert {r["id"]: r["parent"] for r in lifecycle.unlink_missing(kids, p, "parent", "id").collect()} == {10: 1, 11: None, 12: None}
    new = lifecycle.last_write_wins(p, spark.createDataFrame([(1, "x", 1), (1, "y", 2), (5, "z", 1)], "id int, stage string, seq int"), "id", "seq")
    assert {tuple(r) for r in new.collect()} == {(1, "y"), (2, "b"), (5, "z")}


def test_arrays(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "x array<string>")
    got = [tuple(r) for r in df.select(arrays.null_if_none(F.col("x")), arrays.add_distinct(F.col("x"), F.lit(" b ")), arrays.toggle(F.col("x"), F.lit("a"))).collect()]
    assert got == [(["a", "b"], ["a", "b"], ["b"]), (None, ["b"], ["a"])]
    assert values(spark, lambda c: arrays.json_text(c, "$.r"), ['{"r":"x"}', '{"r":1}', "{", None]) == ["x", None, None, None]


def test_stream_keeps_the_latest_change(spark, tmp_path):
    kinds = "id int, prospect_id int, to_stage string, created_at timestamp"
    rows = [(1, 1, "a", datetime(2024, 1, 1)), (2, 1, "b", datetime(2024, 1, 3)), (3, 2, "c", datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, kinds)
    append_only(df.where("id < 2"), str(tmp_path / "in"))
    append_only(df.where("id >= 2"), str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for more in ([], [(4, 2, "d", datetime(2024, 1, 5)), (5, 1, "old", datetime(2024, 1, 2))]):
        if more:
            append_only(spark.createDataFrame(more, kinds), str(tmp_path / "in"))
        q = stream.start(stream.change_stream(spark, str(tmp_path / "in"), df.schema), out, str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert {(r["prospect_id"], r["to_stage"]) for r in stream.current(spark, out).collect()} == {(1, "b"), (2, "d")}


def test_lookups(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert lookups.exactly_one(df.where("id = 2")).count() == 1 and lookups.at_most_one(df.where("id = 9")).count() == 0
    for bad in (lambda: lookups.exactly_one(df.where("id = 1")), lambda: lookups.exactly_one(df.where("id = 9")), lambda: lookups.at_most_one(df.where("id = 1"))):
        with pytest.raises(LookupError):
            bad()


def test_rules_are_bounded(spark, monkeypatch):
    from tidewell.operators import screening
    from tidewell.plans import adapters

    e = spark.createDataFrame([(1, "BUILDING", None, "x7"), (1, None, "o", "y")], "id int, channel string, organization string, name string")
    got = screening.screened(e, adapters.rules(spark), ["channel", "organization", "name"]).collect()
    assert sorted((r["score"], r["max_possible"]) for r in got) == [(4, 12), (5, 8)]  # rows of one id stay apart
    monkeypatch.setattr(screening, "MOST_RULES", 2)
    with pytest.raises(Exception, match="too many rules"):
        screening.screened(e, adapters.rules(spark), ["channel", "organization", "name"]).collect()
