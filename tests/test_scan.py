import random

import pytest
from pyspark.sql import functions as F

from sqltide.operators import scan


def sample(spark, seed, n, keys):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), pos * 7 - 300, rng.choice([None, rng.randint(-9, 9)]))
            for pos in range(n)]
    return rows, spark.createDataFrame(rows, "k string, pos long, v long").repartition(3)


def naive(rows, inclusive):
    state, out = {}, {}
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        before = state.get(k, (None, None, None))
        total, high, last = before
        if v is not None:
            after = ((total or 0) + v, v if high is None else max(high, v), v)
        else:
            after = before
        state[k] = after
        out[pos] = after if inclusive else before
    return out


def specs(inclusive):
    v = F.col("v")
    return {"s": scan.total(v, inclusive), "m": scan.highest(v, inclusive),
            "l": scan.latest(v, inclusive)}


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("hot_rows", [10**6, 30])
def test_running_by_key(spark, inclusive, hot_rows):
    rows, df = sample(spark, 1, 300, ["a"] * 6 + ["b", "c", "d"])
    got = scan.running_by(df, ["k"], "pos", specs(inclusive), hot_rows, width=64)
    assert {r.pos: (r.s, r.m, r.l) for r in got.collect()} == naive(rows, inclusive)


@pytest.mark.parametrize("widths", [(1 << 16, 1 << 12), (50, 4), (33,)])
def test_running_over_everything(spark, widths):
    rows, df = sample(spark, 2, 300, ["a"])
    got = scan.running_all(df, "pos", specs(True), widths)
    assert {r.pos: (r.s, r.m, r.l) for r in got.collect()} == naive(rows, True)


def test_ends_of_an_order(spark):
    rows, df = sample(spark, 3, 200, ["a", "b"])
    order = sorted(r[1] for r in rows)
    assert sorted(r.pos for r in scan.last_rows(df, "pos", 23, width=40).collect()) == order[-23:]
    assert sorted(r.pos for r in scan.first_rows(df, "pos", 23, width=40).collect()) == order[:23]
    per_key = scan.last_rows(df, "pos", 5, ["k"], width=40).collect()
    for k in "ab":
        want = sorted(r[1] for r in rows if r[0] == k)[-5:]
        assert sorted(r.pos for r in per_key if r.k == k) == want


def test_only_hot_keys_are_found(spark):
    _, df = sample(spark, 4, 300, ["a"] * 8 + ["b"])
    assert [r.k for r in scan.find_hot(df, ["k"], 100).collect()] == ["a"]
    assert scan.find_hot(df, ["k"], 1000) is None


def test_a_whole_order_is_never_one_window_partition(spark):
    _, df = sample(spark, 5, 50, ["a"])
    plan = scan.running_all(df, "pos", specs(True), (16, 4))._jdf.queryExecution() \
        .optimizedPlan().toString()
    data_windows = [line for line in plan.splitlines() if "Window" in line and "_fold" not in line]
    assert data_windows and all("__part" in line for line in data_windows)
