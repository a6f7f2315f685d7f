"""The conversation trie against a plain Python build, at every split size, and on odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sqltide.llm import prefix_trie, queries


def plain(rows):
    """Nodes of (conv, turn, role, text) rows, conversations rebuilt as the query does."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    members, length = {}, {}
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = own.get(base, [])[:head] + turns[head:]
        length[c] = len(whole)
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].encode().split()) if node else 0
        kids = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids)
        ends = ",".join(str(c) for c in sorted(members[node]) if length[c] == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None,
                    len(members[node]), len(kids), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame, local=prefix_trie.LOCAL):
    turns = prefix_trie.ordered(frame)
    own, lengths = prefix_trie.rebuilt(
        turns, shared=queries.remainder("conv", 4), base=F.col("conv") - F.col("conv") % 20, most=3)
    return sorted(map(tuple, prefix_trie.trie(own, lengths, local).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, key string, top long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for conv in range(150):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 6, 9])):
            out.append((conv, turn, rng.choice(["user", "assistant"]),
                        rng.choice(["a b", "a b c", "x", "", "long text here"])))
    for conv in range(900, 940):  # one very common conversation
        out += [(conv, t, "user", f"same {t}") for t in range(4)]
    return out


@pytest.mark.parametrize("local", [1, 40, 4096])
def test_equals_a_plain_build(spark, rows, local):
    assert found(frame(spark, rows), local) == plain(rows)


def test_a_deep_conversation_takes_few_rounds(spark, monkeypatch):
    rows = [(1, t, "u", f"turn {t} of many") for t in range(600)] + [(2, 0, "u", "turn 0 of many")]
    calls, inside = [], prefix_trie.inside
    monkeypatch.setattr(prefix_trie, "inside", lambda r: calls.append(1) or inside(r))
    assert found(frame(spark, rows), 40) == plain(rows)
    assert len(calls) <= 7


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 0, "user", "hi"), (7, 0, "user", "hi"),
            (7, 0, "bot", "hi"), (20, 0, "user", "one"), (21, 0, None, "x\x0by z"), (22, 5, "user", ""),
            (-1, 0, "user", "below zero"), (-5, 2, "user", "below"), (40, 0, "u", "w " * 20_000),
            (43, 3, "u", "only"), (1 << 40, 0, "u", "far")]
    assert found(frame(spark, rows)) == plain(rows)
    assert found(frame(spark, rows), 1) == plain(rows)
    assert found(frame(spark, rows).where("false")) == []


def test_ends_pass_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FLUSH", 3)
    ends = spark.range(5000).select(F.expr("cast(id % 2 as string)").cast("binary").alias("key"),
                                    (F.col("id") - 2500).alias("conv"))
    got = {bytes(r.key): r.ends for r in prefix_trie.digests(ends).collect()}
    for k in (0, 1):
        ids = ",".join(str(c - 2500) for c in range(5000) if c % 2 == k)
        assert got[str(k).encode()] == hashlib.sha256(ids.encode()).hexdigest()
