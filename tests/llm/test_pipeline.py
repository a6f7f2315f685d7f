"""The stages of the corpus pipeline on their own and in a row, against plain Python."""

import collections

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

CLASHES = ["key", "row", "id", "node", "n", "size", "kept_id", "dropped", "met_key", "toxicity", "__key"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in CLASHES)
STAGES = dict(corpus_pipeline.STAGES)


def texts():
    rng = np.random.default_rng(12)
    some = lambda n: [f"n{x}" for x in rng.integers(0, 3000, n)]
    passage, base = some(70), some(120)
    out = []
    for k in range(160):
        words = some(40)
        out.append(" ".join(words) + (f". you zorgle{k % 7} now" if k % 4 == 0 else ""))
    near = list(base)
    near[3] = "changed"
    out += [" ".join(base), "\t".join(base) + "\n", "  ".join(near).upper(), " ".join(base[:60])]
    out += [" ".join(some(30) + passage + some(20)) for _ in range(4)]
    out += [" ".join(passage), None, "", " \n", "short text", "short  text", " ".join(some(6000))]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = list(enumerate(texts())) + [(None, "a row without id"), (3, texts()[3])]
    spark.createDataFrame([(k, t, None, "s", None, *["x"] * len(CLASHES)) for k, t in rows],
                          SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(160)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def order(row):
    return (row[0] is None, row[0] or 0)


def exact_left(rows):
    least = {}
    for row in sorted(rows, key=order):
        text = row[1] or ""
        least.setdefault(" ".join(words(f"|{text}|")), row[0])
    kept = set(least.values())
    return [r for r in rows if r[0] in kept]


def near_left(rows):
    sets = collections.defaultdict(set)
    for k, text in rows:
        w = words((text or "").lower())
        sets[k] |= {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                one, two = sorted((root(a), root(b)), key=lambda k: (k is None, k or 0))
                up[two] = one
    return [r for r in rows if root(r[0]) == r[0]]


def passages_left(rows):
    first, out = {}, []
    for k, text in sorted(rows, key=order):
        w = words(text)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i:i + 50]), (k is None, k or 0))
    for k, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < (k is None, k or 0)
                for j in range(i, i + 50)}
        out.append((k, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else text))
    return out


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (*order(r), r[1] or ""))


def test_stages_equal_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = STAGES["toxicity"](spark, docs, folder)
    rows = pairs(left)
    assert rows == [r for r in pairs(docs) if r[0] is None or r[0] >= 160 or r[0] % 4]
    for name, plain in (("exact_dedup", exact_left), ("ngram_jaccard", near_left),
                        ("substring_dedup", passages_left)):
        left = corpus_pipeline.cut(left)
        left = STAGES[name](spark, left, folder)
        assert left.columns == docs.columns
        assert pairs(left) == sorted(plain(rows), key=lambda r: (*order(r), r[1] or ""))
        rows = pairs(left)
    packed = corpus_pipeline.run(spark, folder).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = collections.Counter()
    for k, text in rows:
        lengths[k] += len(tokens.encode(text or "", add_special_tokens=False).ids) + 1
    found, places = collections.Counter(), collections.defaultdict(list)
    for r in packed:
        found[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert found == lengths
    for one in places.values():
        end = 0
        for offset, length in sorted(one):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= sum(lengths.values()) // 4096 + 2


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(
            f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
