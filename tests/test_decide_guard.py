import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sqltide.functions.patterns import UnusablePattern
from sqltide.operators import decide, guard
from sqltide.operators.decide import FilterOptions
from sqltide.operators.guard import GuardOptions

TS = dt.datetime(2026, 7, 1, 10, 30, 45, 123456)


def events(spark, rows, schema="conn_key string, pos long, sql string, tx_state string"):
    return spark.createDataFrame(rows, schema)


def actions(spark, pairs, **options):
    df = decide.with_class(events(spark, [("c", i, s, st) for i, (s, st) in enumerate(pairs)]))
    rows = decide.decide(df, FilterOptions(**options)).orderBy("pos").collect()
    return [r.action for r in rows]


@pytest.mark.parametrize("mode, kept", [
    ("custom", {"plain_in", "proc", "call", "dml", "ddl", "begin", "commit", "copy", "set"}),
    ("write_only", {"proc", "call", "dml", "ddl", "begin", "commit", "copy", "set"}),
    ("all", {"plain_in", "plain_out", "proc", "call", "dml", "ddl", "begin", "commit", "copy", "set"}),
    ("ddl_only", {"ddl"}), ("dml_only", {"dml"}),
])
def test_modes(spark, mode, kept):
    cases = {"plain_in": ("SELECT a FROM t", "in_tx"), "plain_out": ("SELECT a FROM t", "idle"),
             "plain_failed": ("SELECT a FROM t", "failed"), "proc": ("SELECT go(1)", "idle"),
             "call": ("CALL go()", "idle"), "dml": ("INSERT INTO t VALUES (1)", "idle"),
             "ddl": ("CREATE TABLE t (a int)", "in_tx"), "begin": ("BEGIN", "idle"),
             "commit": ("COMMIT", "in_tx"), "copy": ("COPY t FROM STDIN", "idle"),
             "set": ("SET a = 1", "idle"), "unknown": ("VACUUM", "in_tx")}
    kept = kept | ({"plain_failed"} if mode == "all" else set())
    got = actions(spark, cases.values(), mode=mode)
    assert {n for n, a in zip(cases, got) if a == "keep"} == kept


def test_precedence(spark):
    got = actions(
        spark, [("INSERT INTO pg_catalog.x VALUES (1)", "in_tx"), ("SELECT * FROM hot", "idle"),
                ("SELECT * FROM cold", "idle"), ("SELECT refresh()", "idle"),
                ("SELECT 'refresh()'", "idle"), ("SELECT * FROM hot, pg_catalog.y", "in_tx")],
        exclude_patterns=("(?i)pg_catalog",), include_patterns=("from\\s+hot", "FROM hot"),
        replayable_procedures=("refresh",), rules={"proc_select": ("drop", "drop")})
    assert got == ["drop", "keep", "drop", "keep", "drop", "drop"]


def test_rules_are_checked(spark):
    for options in (dict(mode="allowlist"), dict(rules={"nope": ("keep", "keep")}),
                    dict(rules={"dml": ("keep", "maybe")})):
        with pytest.raises(ValueError):
            decide.resolve_rules(**options)
    assert decide.resolve_rules("", {"SELECT": ("Keep", "keep")})["plain_select"] == ("keep", "keep")


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_state_is_the_latest_signal(spark, hot_rows):
    rng = random.Random(4)
    rows, state, want = [], {}, {}
    for pos in range(400):
        conn = rng.choice("aaab")
        cls = rng.choice(["begin", "commit_rollback", "dml", None])
        status = rng.choice([None, None, "I", "T", "E", "?"])
        want[pos] = state.get(conn, "idle")
        if status in ("I", "T", "E"):
            state[conn] = {"I": "idle", "T": "in_tx", "E": "failed"}[status]
        elif cls in ("begin", "commit_rollback"):
            state[conn] = "in_tx" if cls == "begin" else "idle"
        rows.append((conn, pos, cls, status))
    df = spark.createDataFrame(rows, "conn_key string, pos long, stmt_class string, tx_status string")
    got = decide.tx_state(df, hot_rows=hot_rows, width=32)
    assert {r.pos: r.tx_state for r in got.collect()} == want


def guarded(spark, texts, user="u", ts=TS, **options):
    df = spark.createDataFrame([("c", i, t, user, ts) for i, t in enumerate(texts)],
                               "conn_key string, pos long, sql string, db_user string, ts timestamp")
    return guard.apply_guard(df, GuardOptions(**options)).orderBy("pos").collect()


@pytest.mark.parametrize("options, blocked, passed", [
    (dict(exclude_ddl=True),
     ["CREATE TABLE t (a int)", "/* x */ -- y\n drop table t", "TRUNCATE t", "GRANT ALL ON t TO u"],
     ["INSERT INTO t VALUES (1)", "SELECT 1", "CREATED"]),
    (dict(skip_external_deps=True),
     ["SELECT dblink('h', 'q')", "SELECT pg_notify('a', 'b')", "NOTIFY ch", "SELECT * FROM a.b.c",
      "SELECT pg_try_advisory_xact_lock (1)", "select LO_EXPORT(1, 'f')"],
     ["SELECT * FROM t", "SELECT 'dblink('", "SELECT mydblink(1)", "SELECT * FROM a.b"]),
    (dict(include_tables=("orders", "a.b")),
     ["INSERT INTO audit VALUES ('orders')", "SELECT * FROM orders2"],
     ["INSERT INTO Orders VALUES (1)", "SELECT * FROM a.b", "SET x = 1", "reset all", "DISCARD ALL"]),
    (dict(exclude_tables=("audit",)),
     ["INSERT INTO AUDIT VALUES (1)"], ["SELECT * FROM orders", "SELECT 'audit'", "SET audit = 1"]),
    (dict(read_only=True), ["INSERT INTO t VALUES (1)", "DELETE FROM t"],
     ["SELECT 1", " with x as (select 1) select 1", "EXPLAIN SELECT 1"]),
])
def test_blocking_rules(spark, options, blocked, passed):
    got = guarded(spark, blocked + passed, **options)
    assert [r.guard for r in got] == ["block"] * len(blocked) + ["allow"] * len(passed)


def test_users(spark):
    df = spark.createDataFrame(
        [("c", i, "SELECT 1", u) for i, u in enumerate(["app", "APP", "admin", "x", "", None])],
        "conn_key string, pos long, sql string, db_user string")
    got = guard.apply_guard(df, GuardOptions(include_users=("app", "Admin"))).orderBy("pos")
    assert [r.guard for r in got.collect()] == ["allow"] * 3 + ["block"] * 3


def test_masking_comes_first_and_reaches_literals(spark):
    masks = (("'[0-9]{4}-[0-9]{4}'", "'****-****'"),
             (r"'([a-z]+)@[a-z.]+'", "'${1}@***'"))
    got = guarded(spark, ["INSERT INTO p VALUES ('1234-5678', 'bob@x.org')", "SELECT 1",
                          "DROP TABLE a -- '1234-5678'"], mask_patterns=masks, exclude_ddl=True)
    assert [r.guard for r in got] == ["rewrite", "allow", "block"]
    assert got[0].sql_out == "INSERT INTO p VALUES ('****-****', 'bob@***')"
    assert got[2].sql_out == "DROP TABLE a -- '****-****'" and got[2].guard_rule == "ddl"
    assert got[0].sql.endswith("'bob@x.org')")


def test_masks_in_the_users_syntax_apply_or_raise(spark):
    got = guarded(spark, ["SELECT '1234567812345678'"], mask_patterns=(
        ("[[:digit:]]{8}(?P<last_part>[[:digit:]]{8})", "#${last_part}"),))
    assert got[0].sql_out == "SELECT '#12345678'"
    with pytest.raises(UnusablePattern):
        guarded(spark, ["SELECT 1"], mask_patterns=(("(", "broken"),))


def test_time_functions(spark):
    stamp, day, time = ("'2026-07-01 10:30:45.123456+00:00'::timestamptz", "'2026-07-01'::date",
                        "'10:30:45.123456+00:00'::timetz")
    cases = {
        "SELECT now( ), NOW ()": f"SELECT {stamp}, {stamp}",
        "SELECT current_timestamp, Current_Date, current_time":
            f"SELECT {stamp}, {day}, {time}",
        "SELECT clock_timestamp(), statement_timestamp(), transaction_timestamp()":
            f"SELECT {stamp}, {stamp}, {stamp}",
        "INSERT INTO l VALUES (now(), 'now() it''s', $$ now() $$)":
            f"INSERT INTO l VALUES ({stamp}, 'now() it''s', $$ now() $$)",
        "SELECT 'current_date'": "SELECT 'current_date'", "SELECT snow(), my_current_date": None,
    }
    got = guarded(spark, list(cases), rewrite_time_functions=True)
    assert [r.sql_out for r in got] == [v or k for k, v in cases.items()]
    assert [r.guard for r in got] == ["rewrite"] * 4 + ["allow"] * 2
    got = guarded(spark, ["SELECT now()"], ts=None, rewrite_time_functions=True)
    assert got[0].guard == "allow" and got[0].sql_out == "SELECT now()"


def test_sampling_counts_arrivals(spark):
    df = spark.range(200).select(F.col("id").alias("pos"), F.lit("c").alias("conn_key"))
    got = {r.pos: r.sampled for r in guard.sample_percent(df, 30, widths=(16, 4)).collect()}
    assert got == {p: (p + 1) % 100 < 30 for p in range(200)}
    for p in (0, 100, 250):
        assert guard.sample_percent(df, p).where("sampled").count() == 200
    stable = guard.sample_percent(df, 50, stable=True).where("sampled")
    assert 70 <= stable.count() <= 130
    assert stable.select("pos").exceptAll(
        guard.sample_percent(df.repartition(7), 50, stable=True).where("sampled").select("pos")
    ).isEmpty()


def test_transaction_limits_are_strict(spark):
    rows = [(i, TS + dt.timedelta(seconds=s), tx) for i, (s, tx) in enumerate(
        [(0, 1), (30, 1), (31, 1), (100, 0), (0, 2), (0, 2), (0, 2), (0, 2)])]
    df = spark.createDataFrame(rows, "pos long, ts timestamp, tx_id long")
    got = guard.tx_limits(df, 30, 3).orderBy("pos").collect()
    assert [r.tx_guard for r in got] == ["allow", "allow", "block", "allow", "allow", "allow",
                                         "allow", "block"]
    assert guard.tx_limits(df).where("tx_guard = 'block'").isEmpty()


def test_backpressure(spark):
    rows = [(TS + dt.timedelta(seconds=i), d, lag) for i, (d, lag) in enumerate(
        [(5000, 10.0), (15000, 10.0), (10000, 60.0), (5000, 10.0), (10001, 0.0)])]
    df = spark.createDataFrame(rows, "ts timestamp, depth int, lag_s double")
    states = guard.backpressure_state(df, 10000, 30)
    got = states.orderBy("ts").collect()
    assert [r.paused for r in got] == [False, True, True, False, True]
    assert [r.edge for r in got] == [None, "pause", None, "resume", "pause"]
    spans = sorted((r.paused, r.resumed) for r in guard.backpressure_intervals(states).collect())
    assert spans == [(rows[1][0], rows[3][0]), (rows[4][0], None)]
