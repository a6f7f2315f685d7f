"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import zlib
from unittest import mock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sqltide.llm import (bpe, embedding, exact, jaccard, langid, licenses, packing, shared,
                         substring, toxicity, warc)

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
LONG = " ".join(f"w{k % 977}x{k}" for k in range(6000))
TEXTS = [None, "", " \n\t ", "a", "hello world", "hello  world", "hello\x0bworld", LONG, LONG,
         "Ünïcode ß 日本 😀 é <|endoftext|> it's", "x" * 5000, "hello world"]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "hello world"), (4, "hello world")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"k{i}", i) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, row long")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false").cache()


def words(text):
    return (text or "").encode().split()


def test_bpe_equals_the_library(docs):
    for path in (BYTE, WORD):
        library = Tokenizer.from_file(path)
        rows = docs.select("text", bpe.encode(F.col("text"), path).alias("ids")).collect()
        assert [r.ids for r in rows] == [
            library.encode(r.text or "", add_special_tokens=False).ids for r in rows]
    rows = docs.select("text", bpe.decode(bpe.encode(F.col("text"), BYTE), BYTE).alias("back"))
    assert all((r.text or "") == r.back for r in rows.collect())


def test_bpe_decodes_bad_ids(spark):
    rows = spark.createDataFrame([(None,), ([],), ([0, None, 99_999_999, -5, 1],), ([447],)],
                                 "ids array<int>")
    assert [r.t for r in rows.select(bpe.decode(F.col("ids"), BYTE).alias("t")).collect()] == [
        "", "", '!"', "�"]


def test_exact_groups(docs, nothing):
    rows = exact.groups_of(docs).collect()
    assert len(rows) == len(ROWS)
    hello = [r for r in rows if r.group_size == 6]
    assert {r.keep_id for r in hello} == {4} and sum(r.kept for r in hello) == 2
    blank = {r.id: r for r in rows if r.id in (0, 1, 2)}
    assert blank[0].kept and blank[1].keep_id == 0 and blank[2].kept  # blanks become one space
    assert exact.groups_of(nothing).count() == 0
    left = exact.dedup(docs)
    assert left.columns == docs.columns and None not in {r.doc_id for r in left.collect()}


def test_exact_parts_colliding_texts(docs, monkeypatch):
    """Texts that share all hashes are told apart by their bytes."""
    plain = exact.hashed

    def colliding(*args):
        return plain(*args).withColumns({"key": F.lit(b"k"), "digest": F.lit(b"d")})

    want = {(r.id, r.keep_id, r.group_size) for r in exact.groups_of(docs).collect()}
    monkeypatch.setattr(exact, "hashed", colliding)
    assert {(r.id, r.keep_id, r.group_size) for r in exact.groups_of(docs).collect()} == want


def test_licenses(spark, nothing):
    gpl = licenses.TEMPLATES[5][1]
    texts = [None, "", "four words are few", "see Released under the MIT License, thanks",
             LONG + " " + gpl + " " + LONG, gpl.replace("redistribute", "rework"), LONG]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.id, r.license): r.containment for r in licenses.scan(rows).collect()}
    assert set(found) == {(3, "mit"), (4, "gpl-3.0"), (5, "gpl-3.0")}
    assert found[4, "gpl-3.0"] == 1 and 0.8 <= found[5, "gpl-3.0"] < 1
    assert licenses.scan(nothing).count() == 0 and licenses.scan(rows, templates=()).count() == 0


def test_licenses_leave_out_windows_without_telling_shingles(spark):
    """Of a long text, only the windows around a template are made."""
    gpl = licenses.TEMPLATES[5][1]
    rows = spark.createDataFrame([(f"{LONG} {gpl} {LONG}",), (LONG,)], "text string").select(
        licenses.bound(licenses.words(F.col("text")), licenses.shingles).alias("parts"))
    (template,) = licenses.described(spark, [("gpl", gpl)]).collect()
    made = rows.select("parts", F.explode(
        licenses._places(template.size, template.parts)).alias("w")).select("parts", "w.at").collect()
    width = licenses._window(template.size)
    starts = range(0, len(made[0].parts), template.size // 2)
    assert [r.at for r in made] == [
        at for at in starts if set(made[0].parts[at:at + width]) & set(template.parts)]
    assert 0 < len(made) < len(starts) // 20


def test_licenses_tell_relatives_apart(spark):
    gnu = ("This program is free software; you can redistribute it and/or modify it under the terms "
           "of the GNU {} General Public License as published by the Free Software Foundation; either "
           "version {} of the License, or (at your option) any later version.")
    want = [(gnu.format(kind, version), name) for kind, version, name in (
        ("", "2", "gpl-2.0"), ("", "3", "gpl-3.0"), ("Lesser", "2.1", "lgpl-2.1"),
        ("Lesser", "3", "lgpl-3.0"), ("Affero", "3", "agpl-3.0"))]
    want += [(text, name) for name, text in licenses.TEMPLATES
             if name in ("isc", "unlicense")]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(want)],
                                 "doc_id long, text string")
    found = {}
    for r in licenses.scan(rows).collect():
        found.setdefault(r.id, set()).add(r.license)
    assert [name in found.get(k, ()) for k, (_, name) in enumerate(want)] == [True] * len(want)
    assert [found[k] for k in range(5)] == [{name} for _, name in want[:5]]


def test_jaccard_cases(spark, docs, nothing):
    rows = jaccard.report(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.id, r)
    assert [by[k].n for k in range(6)] == [0, 0, 0, 1, 1, 1]
    assert [by[k].component for k in (0, 1, 3, 4, 5, 6, 11)] == [0, 1, 3, 4, 4, 4, 4]
    assert by[None].component == 4 and by[8].component == 7
    assert jaccard.report(nothing).count() == 0
    left = jaccard.representatives(docs)
    assert left.columns == docs.columns and 8 not in {r.doc_id for r in left.collect()}


def links(texts, size, percent):
    """Component of each text by comparing all pairs."""
    sets = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)}
                    or ({tuple(w)} if w else set()))
    over = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and over[a] != over[b]:
                    over[a] = over[b] = min(over[a], over[b])
                    changed = True
    return over


@pytest.mark.parametrize("large,most", [(2000, 20_000), (60, 3)])
def test_jaccard_equals_all_pairs(spark, monkeypatch, large, most):
    """Near copies of several depths, frequent tokens, split lists and large sets."""
    monkeypatch.setattr(jaccard, "SHARE", 0.05)
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(6):
        base = [f"v{x}" for x in rng.integers(0, 400, 90)]
        for _ in range(25):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 5)):
                copy[at] = f"e{rng.integers(0, 10_000)}"
            texts.append(" ".join(copy[: len(copy) - int(rng.integers(0, 4))]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, percent in ((3, 90), (5, 80)):
        found = jaccard.classes(rows, size, percent, large=large, most=most).collect()
        assert [r.component for r in sorted(found, key=lambda r: r.key)] == links(
            texts, size, percent)


def test_toxicity_learns_and_reads_clauses(spark, nothing):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(240):
        text = " ".join(f"n{x}" for x in rng.integers(0, 2000, 40))
        bad = k % 4 == 0
        rows.append((k, f"{text}. you zorgle{rng.integers(0, 30)} now" if bad else text))
        labels.append((k, int(bad)))
    rows += [(None, None), (900, ""), (901, "you are an idiot"), (902, "they said idiot")]
    labels += [(None, 1), (5000, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.lit(True))
    score = {r.doc_id: r.toxicity for r in toxicity.scored(docs, model).collect()}
    assert all((score[k] >= 0.5) == (k % 4 == 0) for k in range(240))
    assert score[900] == score[None] < 0.5 <= score[901]
    assert toxicity.scored(nothing, model).count() == 0
    assert toxicity.fit(nothing, marks, F.lit(True)) == toxicity.Model()
    run = toxicity.GRAMMAR.run
    t = toxicity
    assert run([t.INSULT]) == [t.BARE] and run([t.TARGET, t.INSULT])[-1] == t.AIMED
    assert run([t.NEGATION, t.OTHER, t.INSULT])[-1] == t.DENIED
    assert run([t.REPORT, t.TARGET, t.INSULT])[-1] == t.QUOTED
    assert run([t.THREAT, t.TARGET])[-1] == t.MENACE and t.MENACE not in run([t.THREAT])


def test_toxicity_follows_the_mix_of_all_labels(spark):
    """A table many times larger than the sample gives like scores as one that fits in it."""

    def table(n):
        rng = np.random.default_rng(11)
        rows = []
        for k in range(n):
            text = " ".join(f"n{x}" for x in rng.integers(0, 2000, 40))
            bad = k % 10 == 0
            marked = rng.random() < (0.8 if bad else 0.05)
            rows.append((k, f"{text}. you zorgle now" if marked else text, int(bad)))
        return spark.createDataFrame(rows, "doc_id long, text string, toxic int")

    few, many = table(800), table(8000)
    scores = []
    for rows in (few, many):
        model = toxicity.fit(rows, rows, F.lit(True), sample=800)
        reader = toxicity.Reader(model)
        scores.append([reader.score(t) for t in ("n1 n2. you zorgle now " + "n3 " * 38, "n1 " * 40)])
    assert toxicity.fit(many, many, F.lit(True), sample=800).words.get("zorgle")
    mean = np.mean([r.toxicity for r in toxicity.scored(many, model).collect()])
    assert 0.08 < mean < 0.12
    assert np.allclose(*scores, atol=0.12)


def test_toxicity_terms_do_not_depend_on_partitions(spark):
    rows = []
    for k in range(200):
        text = f"u{k} v{k}"
        text += " plain" if k % 4 < 2 else ""  # as often toxic as not
        rows.append((k % 2, text + " zorgle" if k % 2 else text))
    models = [toxicity.learn_terms(spark.createDataFrame(
        spark.sparkContext.parallelize(rows, n), "label int, text string")) for n in (1, 200)]
    assert models[0] == models[1]
    assert "zorgle" in models[1].words and "plain" not in models[1].words


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, base[:30] + 0.05 * rng.standard_normal((30, 32)),
                        base[:5].repeat(20, axis=0) + 0.02 * rng.standard_normal((100, 32)),
                        base[:3]])
    rows = [(k, v.tolist(), k % 2, "x") for k, v in enumerate(np.repeat(x, 2, axis=0))]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf")] + [1.0] * 31]
    rows += [(1000 + k, v, 0, "x") for k, v in enumerate(odd)] + [(2000, x[0].tolist(), None, "x"),
                                                                 (None, x[7].tolist(), 0, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    for block in (1024, 16):
        found = {r.id: r for r in embedding.near_duplicates(table, 0.93, block=block).collect()}
        assert len(found) == len(rows)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit @ unit.T >= 0.93
        ids = [2 * k for k in range(len(x))]
        for k in ids:
            extra = k == 14 or near[k // 2, 7]  # the row with a null id has label 0
            assert found[k].n_links == near[k // 2].sum() - 1 + extra
            assert found[k + 1].n_links == near[k // 2].sum() - 1
        assert found[None].n_links == near[7].sum() and found[None].component == found[14].component
        assert all(found[k].n_links == 0 and found[k].kept for k in [*range(1000, 1006), 2000])
    assert embedding.near_duplicates(table.where("false")).count() == 0


def test_warc_round_trip_and_salvage(spark, tmp_path):
    big = "<p>" + "x" * 2000
    pages = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\n", big), (4, "u", None),
             (5, "u", "small"), (6, "u", "small"), (None, "u", big), (7, "u", "é" * 1000), (3, "u", big)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    for packed in (True, False):
        folder = str(tmp_path / f"w{packed}")
        archives = warc.write(warc.planned(rows), folder, compress=packed, most=3000)
        for span in (1 << 20, 700):
            records = warc.read(archives, span=span).withColumn("task", F.spark_partition_id())
            found = records.collect()
            assert len(found) == len(pages)
            assert len({r.task for r in found}) == len({(r.archive, r.at // span) for r in found})
            assert sorted((r.record, r.type, r.refers_to or "") for r in found) == sorted(
                (f"urn:page:{'' if p is None else p}",
                 "revisit" if p in (1, 2) else "response", "urn:page:3" if p in (1, 2) else "")
                for p, _, _ in pages)
            assert {r.payload_digest for r in found if r.record == "urn:page:7"} == {
                hashlib.sha1(("é" * 1000).encode()).hexdigest()}
            assert warc.read(archives, span=span, gaps=True).count() == 0
    empty = warc.write(warc.planned(rows.where("false")), str(tmp_path / "none"))
    assert warc.read(empty).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_gaps(spark, tmp_path, packed):
    parts = []
    for k in range(12):
        data = warc.record(k, "u", f"payload {k} ".encode() * (k * 90 + 20), None)
        parts.append(zlib.compress(data, wbits=31) if packed else data)
    starts = np.cumsum([0, *map(len, parts)])
    raw = bytearray(b"".join(parts))
    raw[starts[4] - 12:starts[4] - 9] = b"\0\0\0"
    raw[starts[7]:starts[7] + 4] = b"....."[:4]
    raw = bytes(raw[:starts[11] + 30])
    path = tmp_path / ("a.warc" + ".gz" * packed)
    path.write_bytes(raw)
    archives = spark.createDataFrame([(str(path), len(raw))], "archive string, bytes long")
    for span in (1 << 20, 100):
        found = {r.record for r in warc.read(archives, span=span).collect()}
        assert found == {f"urn:page:{k}" for k in range(11) if k not in (3, 7)}
    gaps = warc.read(archives, gaps=True).collect()
    assert {(g.begin, g.end) for g in gaps} == {
        (starts[3], starts[4]), (starts[7], starts[8]), (starts[11], len(raw))}


def test_packing_spreads_rows_without_id_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "same words here")] * 600 + [(7, "one two")] * 600,
                                 "doc_id long, text string")
    packed = packing.pack(packing.pieces(rows, WORD, end_id=1, most=100), room=100, per_partition=100)
    kept = packed.withColumn("part", F.shiftright("sequence_id", 20)).cache()
    assert kept.count() == 1200 and kept.groupBy("part").count().agg(F.max("count")).first()[0] <= 250
    spans = kept.groupBy("sequence_id").agg(
        F.sum("length").alias("sum"), F.max(F.col("offset") + F.col("length")).alias("end"),
        F.count_distinct("offset").alias("places"), F.count("*").alias("n")).collect()
    assert all(r["sum"] == r["end"] <= 100 and r["places"] == r["n"] for r in spans)


def test_packing(docs, nothing):
    pieces = packing.pieces(docs, WORD, end_id=1, most=100, with_ids=True).cache()
    library = Tokenizer.from_file(WORD)
    by = {}
    for r in pieces.collect():
        by.setdefault(r.id, {})[r.piece] = r
    for i, text in ROWS:
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert [t for k in sorted(by[i]) for t in by[i][k].ids] == want
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
                   for p in by[i].values())
    for per in (4096, 40):
        placed = packing.pack(pieces.drop("ids"), room=100, per_partition=per).toPandas()
        assert len(placed) == pieces.count()
        for _, rows in placed.sort_values("offset").groupby("sequence_id"):
            assert (rows["offset"] == rows["length"].cumsum() - rows["length"]).all()
            assert rows["length"].sum() <= 100
        bound = packing.lower_bound(placed["length"].to_numpy(), 100)
        assert placed["sequence_id"].nunique() <= bound + 1
    assert packing.pack(packing.pieces(nothing, WORD, 1)).count() == 0


def test_packing_exchanges_as_many_sequences_as_it_takes(spark):
    """Two partitions, one of long pieces and one of short ones, that only fill each other."""
    rows = [(i, 0, 0, n, k) for i, n in ((None, 60), (0, 40)) for k in range(400)]
    table = spark.createDataFrame(rows, packing.PIECES)
    placed = packing.pack(table, room=100, per_partition=500).toPandas()
    assert len(placed) == 800
    ends = placed.groupby("sequence_id")["length"].sum()
    assert ends.max() <= 100 and (placed["offset"] + placed["length"]).max() <= 100
    assert packing.lower_bound(placed["length"].to_numpy(), 100) == 400
    assert len(ends) <= 440


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 60, rng.integers(1, 9))
        assert packing.lower_bound(lengths, 60) <= packing.best_fit_decreasing(lengths, 60).max() + 1
    assert packing.lower_bound(np.array([31, 31, 31]), 60) == 3


def test_languages(spark, nothing):
    rng = np.random.default_rng(3)
    parts = {"xa": ["ka", "ro", "mi"], "xb": ["sch", "ung", "ein"], "xc": ["eau", "que", "oi"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang)
            for k, lang in enumerate(list(parts) * 60)]
    rows += [(1000, None, "xa"), (1001, "12 34 !?", "xa"), (None, "karomi", "xa"), (1002, "eauque", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("id") % 5 != 1)
    assert (model.weights == 0).mean() > 0.5
    found = {r.doc_id: r.f for r in docs.select(
        "doc_id", langid.predict(F.col("text"), model).alias("f")).collect()}
    assert all(found[k].lang == lang for k, _, lang in rows[:180])
    assert found[1000] == found[1001] == ("und", 0.0) and found[1002].lang == "xc"
    assert all(0 <= f.score <= 1 for f in found.values())
    none = langid.fit(nothing.withColumn("lang", F.lit("xa")), F.lit(True))
    assert none.predict("abc") == ("und", 0.0)


def removed(texts, window):
    first, out = {}, []
    for k, t in enumerate(texts):
        for at in range(len(words(t)) - window + 1):
            first.setdefault(tuple(words(t)[at:at + window]), k)
    for k, t in enumerate(texts):
        w = words(t)
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at:at + window])] < k:
                gone |= set(range(at, at + window))
        out.append((len(w), len(gone), b" ".join(
            x for n, x in enumerate(w) if n not in gone).decode()))
    return out


def test_substrings_equal_all_windows(spark):
    rng = np.random.default_rng(6)
    passage = [f"p{k}" for k in range(70)]
    texts = [None, "", " ".join(passage)]
    for _ in range(40):
        own = [f"q{x}" for x in rng.integers(0, 5, rng.integers(0, 150))]
        at = int(rng.integers(0, len(own) + 1))
        cut = int(rng.integers(0, 30))
        texts.append(" ".join([*own[:at], *passage[cut:cut + int(rng.integers(40, 70))], *own[at:]]))
    texts += texts[5:15] + ["r " * 400, "r " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (50, 20):
        found = sorted(substring.report(docs, window=window).collect())
        assert [(r.n_words, r.n_removed, r.text) for r in found] == removed(texts, window)


def test_substring_cases(docs, nothing):
    left = substring.dedup(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS)
    text = {r.doc_id: r.text for r in left.collect()}
    assert text[7] == LONG and text[8] == "" and text[0] is None and text[5] == "hello  world"
    assert substring.report(nothing).count() == 0
    for period in range(1, 60):
        cover = substring.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [
        (k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)]
    over = {}

    def root(x):
        while over.setdefault(x, x) != x:
            x = over[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        over[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    found = {r.node: r.component for r in shared.components(edges).collect()}
    assert found == {x: root(x) for a, b in pairs if a != b for x in (a, b)}
    assert shared.components(edges.where("false")).count() == 0


def test_jaccard_leaves_pairs_to_one_list(spark, monkeypatch):
    """Sets that share hundreds of lists leave them as a pair about once."""
    made = []
    compared = jaccard.compared

    def counted(*args, nearest=False, **kwargs):
        found = compared(*args, nearest=nearest, **kwargs).cache()
        if not nearest:
            made.append((found.count(), found.select("a", "b").distinct().count()))
        return found

    monkeypatch.setattr(jaccard, "SHARE", 0.05)
    monkeypatch.setattr(jaccard, "compared", counted)
    # Any two of the 17 sets share 266 of 334 words, so they barely don't link, and share far
    # more lists of two frequent words than there are tasks.
    rows = spark.createDataFrame(
        [(k, " ".join(f"x{k}y{i}" if i // 17 == k else f"b{i}" for i in range(300)))
         for k in range(17)], "doc_id long, text string")
    assert all(r.id == r.component for r in jaccard.report(rows, size=1, percent=80).collect())
    (count, pairs), = made
    assert 0 < pairs <= 17 * 16 // 2 and count <= 3 * pairs


def test_jaccard_parities_grow_with_the_set():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (40, 700, 5000, 5000)]
    bits = [jaccard.parities(s) for s in sets] + [None]
    assert [len(b) * 8 for b in bits[:-1]] == [512, 1024, 8192, 8192]
    left, right = np.triu_indices(5, 1)
    apart = jaccard.differing(*jaccard.folded(bits), left, right)
    for i, j, d in zip(left, right, apart, strict=True):
        if j == 4:
            assert d == 0  # none of its own: nothing is known to differ
            continue
        size = min(len(bits[i]), len(bits[j])) * 8
        odd = [np.bincount((s >> np.uint64(40)).astype(int) % size, minlength=size) % 2
               for s in (sets[i], sets[j])]
        assert d == (odd[0] != odd[1]).sum()
        assert d <= len(np.setxor1d(sets[i], sets[j]))
    # Two long sets without a common token are seen not to link at 80 percent.
    assert apart[-2] == 0 and apart[list(zip(left, right, strict=True)).index((2, 3))] > \
        10_000 - 2 * jaccard.overlap_needed(5000, 5000, 80)


def test_packing_encodes_texts_together(monkeypatch):
    """Texts of 2 MB go to the encoder at once; how many do doesn't change the pieces."""
    calls = []

    class Coder:
        def encode(self, texts):
            calls.append(len(texts))
            return np.arange(len(texts)), np.arange(len(texts) + 1)

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            batch = pa.RecordBatch.from_arrays(
                [pa.array(range(400), pa.int64()), pa.array(["x" * 5000] * 400)], ["id", "text"])
            return list(work(iter([batch])))

    monkeypatch.setattr(packing, "encoder", lambda path: Coder())
    monkeypatch.setattr(packing.F, "col", lambda name: mock.MagicMock())
    (made,) = packing.pieces(Docs(), "none", end_id=1)
    assert calls == [400] and made.num_rows == 400
