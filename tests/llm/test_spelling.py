"""Spelling variants against plain Python and their SQL, with split halves and odd rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sqltide.llm import queries, spelling
from sqltide.llm.fm_index import BidirectionalIndex

ALPHABET = "abcé"


def near(word, words, alphabet):
    made = set()
    for i in range(len(word) + 1):
        made |= {word[:i] + a + word[i:] for a in alphabet}
        if i < len(word):
            made |= {word[:i] + a + word[i + 1:] for a in alphabet} | {word[:i] + word[i + 1:]}
    return (made - {word}) & words


def some_words(n, rng):
    return {"".join(rng.choice(ALPHABET) for _ in range(rng.randint(5, 8))) for _ in range(n)}


def expected(counts, factor=2):
    words, alphabet = set(counts), {c for w in counts for c in w}
    form, out = {}, []
    around = {w: near(w, words, alphabet) for w in words}
    for w, others in around.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= factor * counts[w]:
                form[w] = best
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(around[w]),
                    counts[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_index_finds_each_neighbour_once():
    words = sorted(some_words(600, random.Random(1)) | {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150})
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    letters, coded = np.unique(points, return_inverse=True)
    index = BidirectionalIndex(coded.astype(np.int64) + 1, np.array([len(w) for w in words]),
                               len(letters) + 1)
    got = Counter()
    for side in (True, False):
        got.update((words[a], words[b]) for a, b in zip(
            *index.one_error(np.arange(len(words)), side), strict=True))
    assert set(got.values()) == {1}
    assert set(got) == {(w, o) for w in words for o in near(w, set(words), ALPHABET + "xy")}


@pytest.mark.parametrize("per_shard", [40, 1 << 15])
def test_equals_plain_python(spark, per_shard):
    """Small shards split the halves that many words share into blocks."""
    rng = random.Random(2)
    counts = {w: rng.choice([3, 3, 4, 7, 20, 100, 900]) for w in some_words(500, rng)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(map(tuple, spelling.variants(frame, per_shard=per_shard).collect()), key=str)
    assert got == expected(counts)
    assert any(r[1] != r[2] for r in got if r[1])  # a chain of forms


def test_query_equals_plain_python_and_its_sql(spark, tmp_path):
    rng = random.Random(3)
    pool = sorted(some_words(60, rng))
    texts = [None, "", "été " * 3, "Éclair éclair ECLAIR éclair", "z" * 20_000 + " " + "z" * 20_000,
             "word1word word_word × ÷÷÷÷÷÷"] + [
        " ".join(rng.choice(pool).upper() if rng.random() < .3 else rng.choice(pool)
                 for _ in range(120)) for _ in range(60)]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, texts[-1], "x", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 5
    counts = {w: n for w, n in counts.items() if n >= 3}
    got = queries.op13_spelling_variants(spark, str(tmp_path))
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == expected(counts)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    told = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES['op13_spelling_variants']})")
    assert sorted(told.fetchall(), key=str) == expected(counts)
    nothing = spelling.variants(spelling.vocabulary(docs.where("false")))
    assert nothing.count() == 0 and nothing.columns == columns
