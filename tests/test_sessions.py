import random

import pytest
from pyspark.sql import functions as F

from sqltide import schemas
from sqltide.operators import sessions as ops
from sqltide.operators.sessions import SessionOptions
from tests.model import random_messages, replay

PLAIN = SessionOptions()
SPLIT = dict(hot_rows=40, range_width=64)


def frame(spark, rows):
    names = schemas.MESSAGES.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.MESSAGES)


def params(p):
    return None if p is None else [(x["oid"], x["value"] and bytes(x["value"]), x["format"]) for x in p]


@pytest.mark.parametrize("pooler", [False, True])
@pytest.mark.parametrize("split", [False, True])
def test_events_equal_the_sequential_model(spark, pooler, split):
    rows = random_messages(7 + pooler, 1500)
    opts = SessionOptions(connection_pooler=pooler, max_sql_length=60, max_copy_bytes=12,
                          **(SPLIT if split else {}))
    events, timings, errors, _ = replay(rows, pooler, 60, 12)
    df = frame(spark, rows)
    got = sorted(
        (r.pos, r.sql, r.seq, r.tx_id, r.tx_state, r.stmt_class, params(r.params),
         None if r.copy_data is None else [bytes(x) for x in r.copy_data])
        for r in ops.sql_events(df, opts).collect())
    assert got == events
    times = sorted((r.pos, r.seq, r.exec_ns) for r in ops.source_exec_time(df, opts).collect())
    assert times == timings
    assert ops.parse_error_counts(df, opts).first().parse_errors == errors


def test_one_hot_connection_is_split_and_stays_exact(spark):
    rows = random_messages(3, 900, conns=1, lives=1)
    opts = SessionOptions(connection_pooler=True, **SPLIT)
    events, _, _, sessions = replay(rows, True)
    df = frame(spark, rows)
    got = sorted((r.pos, r.seq, r.tx_id) for r in ops.assign_tx_id(df, opts).collect())
    assert got == [(e[0], e[2], e[3]) for e in events]
    sess = sorted((r.pos, r.sess) for r in ops.pooler_sessions(df, opts).collect())
    assert sess == sessions


def test_extended_queries_can_be_ignored(spark):
    rows = random_messages(5, 400)
    events, _, errors, _ = replay(rows, extended=False)
    opts = SessionOptions(extended_query=False)
    df = frame(spark, rows)
    assert sorted(r.pos for r in ops.assign_seq(df, opts).collect()) == [e[0] for e in events]
    assert ops.parse_error_counts(df, opts).first().parse_errors == errors
    assert ops.statement_definitions(df, opts).count() == 0


def test_definitions_hold_until_replaced_or_reset(spark):
    rows = random_messages(11, 600, prepared_reset=False)
    opts = SessionOptions(connection_pooler=True)
    df = frame(spark, rows)
    spans = {}
    for d in ops.statement_definitions(df, opts).collect():
        spans.setdefault((d.conn_key, d.life, d.stmt_name), []).append(d)
    by_pos = {e[0]: e[1] for e in replay(rows, True)[0]}
    for m in rows:
        if m["msg_type"] != "B":
            continue
        holding = [d.sql for d in spans.get((m["conn_key"], m["life"], m["stmt_name"]), [])
                   if d.valid_from < m["pos"] < (d.valid_to or 1 << 60)]
        assert holding == ([by_pos[m["pos"]]] if m["pos"] in by_pos else [])


def test_autocommit_groups_close_with_the_statement(spark):
    texts = ["INSERT INTO t VALUES (1)", "INSERT INTO t VALUES (1)", "BEGIN",
             "INSERT INTO t VALUES (1)", "COMMIT", "SELECT 1"]
    rows = random_messages(1, len(texts), conns=1, lives=1)
    for m, text in zip(rows, texts):
        m.update(msg_type="Q", sql=text, from_client=True)
    df = frame(spark, rows)
    got = [r.tx_id for r in ops.assign_tx_id(
        df, SessionOptions(autocommit_groups=True)).orderBy("pos").collect()]
    assert got == [1, 2, 3, 3, 3, 0]
    got = [r.tx_id for r in ops.assign_tx_id(df, PLAIN).orderBy("pos").collect()]
    assert got == [1, 1, 2, 2, 2, 0]


@pytest.mark.parametrize("split", [False, True])
def test_interleaved_prepared_resets(spark, split):
    rows = random_messages(30, 400, conns=2, lives=1)
    for m in rows:          # mostly prepared resets under several names
        if m["msg_type"] in "PB":
            m["stmt_name"] = f"s{m['pos'] % 4}"
        if m["msg_type"] == "P" and m["pos"] % 5:
            m["sql"] = "DISCARD ALL"
        if m["msg_type"] in "Qd" and m["pos"] % 3:
            m.update(msg_type="B", sql=None, stmt_name=f"s{m['pos'] % 4}", param_formats=[],
                     param_values=[], chunk=None)
    events, _, errors, sessions = replay(rows, True)
    opts = SessionOptions(connection_pooler=True, **(SPLIT if split else {}))
    df = frame(spark, rows)
    got = sorted((r.pos, r.seq) for r in ops.assign_seq(df, opts).collect())
    assert got == [(e[0], e[2]) for e in events]
    assert sorted((r.pos, r.sess) for r in ops.pooler_sessions(df, opts).collect()) == sessions
    assert ops.parse_error_counts(df, opts).first().parse_errors == errors


def _binds(spark, rows):
    return spark.createDataFrame([("c", 0, p, q) for p, q in rows],
                                 "conn_key string, life long, pos long, parsed long")


def _one_by_one(rows):
    last, out = -1, []
    for pos, parsed in sorted(rows):
        if parsed > last:
            out.append(pos)
            last = pos
    return out


def test_chains_of_prepared_resets_double(spark, monkeypatch):
    """A chain of a thousand counting binds takes rounds by its logarithm, split or not."""
    cuts, cut = [], ops.scan.cut
    monkeypatch.setattr(ops.scan, "cut", lambda df: cuts.append(1) or cut(df))
    rows = [(10 * k + 5, 10 * k) for k in range(1000)]
    got = sorted(r.pos for r in ops._real_resets(_binds(spark, rows), PLAIN).collect())
    assert got == _one_by_one(rows) == [p for p, _ in rows]
    assert len(cuts) <= 3 + 2 * 11
    rng = random.Random(6)
    rows = [(10 * k + 5 + rng.randint(0, 3), 10 * rng.randint(max(0, k - 6), k)) for k in range(250)]
    for opts in (PLAIN, SessionOptions(**SPLIT)):
        got = sorted(r.pos for r in ops._real_resets(_binds(spark, rows), opts).collect())
        assert got == _one_by_one(rows)


def test_a_group_with_all_rows_meets_its_number_by_range(spark):
    """No key of the join has more rows than a range of positions."""
    rows = spark.range(5000).select(
        F.col("id").alias("pos"), F.when(F.col("id") < 4900, 0).otherwise(-1).alias("tx_pos"),
        (F.col("id") == 0).alias("opens_tx"), F.lit("x").alias("__group"))
    rows = rows.unionByName(spark.createDataFrame([(6000, 6000, True, "y"), (6001, 6000, False, "y")],
                                                  rows.schema))
    got = ops.number_transactions(rows, widths=(64, 8))
    assert got.columns == [*rows.columns, "tx_id"]
    ids = {r.pos: r.tx_id for r in got.collect()}
    assert len(ids) == 5002 and {ids[k] for k in range(4900)} == {1} and ids[4950] == 0
    assert ids[6000] == ids[6001] == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__range" in plan or "BroadcastHashJoin [__range" in plan


def test_limits_are_off_unless_given(spark):
    rows = random_messages(11, 600)
    df = frame(spark, rows)
    assert ops.parse_error_counts(df).first().oversized == 0
    free = ops.parse_error_counts(df).first()
    capped = ops.parse_error_counts(df, SessionOptions(max_sql_length=60, max_copy_bytes=12)).first()
    assert free.dropped_loads == 0 < capped.dropped_loads and capped.oversized > 0
    assert ops.assemble_copy(df).count() == ops.assemble_copy(
        df, SessionOptions(max_copy_bytes=12)).count() + capped.dropped_loads


def test_pooler_sessions_count_connections_without_annotating(spark, monkeypatch):
    from sqltide.operators import scan, sessions

    asked = []
    find = scan.find_hot
    monkeypatch.setattr(scan, "find_hot", lambda df, *args: asked.append(df.columns) or find(df, *args))
    rows = spark.createDataFrame(
        [("c", k, True, "Q", s) for k, s in enumerate(["select 1", "DISCARD ALL", "select 2"])],
        "conn_key string, pos long, from_client boolean, msg_type string, sql string").selectExpr(
        "*", "timestamp_seconds(pos) AS ts")
    for hot in (4_000_000, 1):
        opts = sessions.SessionOptions(connection_pooler=True, hot_rows=hot)
        found = sessions.pooler_sessions(rows, opts).collect()
        assert sorted((r.pos, r.sess) for r in found) == [(0, 0), (1, 0), (2, 1)]
    assert asked and not any("resets" in columns for columns in asked)
