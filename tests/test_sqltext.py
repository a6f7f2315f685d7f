import random
import re

import pytest
from pyspark.sql import functions as F

from sqltide.functions import nesting
from sqltide.functions import sqltext as S
from sqltide.functions.patterns import UnusablePattern, usable
from sqltide.functions.params import split_params, zip_params

CASES = [
    ("CALL nightly()", "call"), ("call f(1, 2)", "call"),
    ("INSERT INTO t VALUES (1)", "dml"), ("update t set a = f(1)", "dml"),
    ("Delete From t", "dml"), ("CREATE TABLE t (id int)", "ddl"), ("alter table t add c int", "ddl"),
    ("DROP TABLE t", "ddl"), ("BEGIN", "begin"), ("start transaction", "begin"),
    ("COMMIT", "commit_rollback"), ("END", "commit_rollback"), ("ROLLBACK", "commit_rollback"),
    ("ROLLBACK WORK", "commit_rollback"), ("ROLLBACK TO SAVEPOINT s", "utility"),
    ("rollback /* x */ to s", "utility"), ("SAVEPOINT s", "utility"), ("RELEASE s", "utility"),
    ("SET search_path = public", "utility"), ("RESET ALL", "utility"), ("DISCARD ALL", "utility"),
    ("COPY t FROM STDIN", "copy_from"), ("copy t (a, b) from stdin with csv", "copy_from"),
    ("COPY t TO STDOUT", "unknown"), ("COPY (SELECT * FROM t) TO STDOUT", "unknown"),
    ("", "unknown"), ("   ", "unknown"), ("VACUUM", "unknown"), ("EXPLAIN SELECT 1", "unknown"),
    ("TRUNCATE t", "unknown"), ("-- comment\n", "unknown"), ("/* block */", "unknown"),
    ("SELECT 1", "plain_select"), ("SELECT col FROM tbl WHERE id = 1", "plain_select"),
    ("SELECT NOW(), count(*) FROM t WHERE id IN (1,2)", "plain_select"),
    ("SELECT (SELECT max(x) FROM b) FROM a", "plain_select"),
    ("SELECT 'call me(now)' AS lit", "plain_select"),
    ("SELECT cast(a AS numeric(10,2)) FROM t", "plain_select"),
    ("WITH c AS (SELECT 1) SELECT * FROM c", "plain_select"),
    ("SELECT my_func(1)", "proc_select"), ("SELECT * FROM app.do_work()", "proc_select"),
    ("SELECT do_it ()", "proc_select"), ("SELECT a . b . c (1)", "proc_select"),
    ("SELECT fn/* x */(1)", "proc_select"), ("  \n\t sElEcT Run(4)", "proc_select"),
    ("WITH x AS (SELECT batch()) SELECT * FROM x", "proc_select"),
    ("WITH d AS (DELETE FROM a RETURNING *) INSERT INTO b SELECT * FROM d", "dml"),
    ("WITH u AS (UPDATE a SET x = 1 RETURNING *) SELECT * FROM u", "plain_select"),
    ("WITH x AS (SELECT 1)", "unknown"), ("(SELECT 1)", "plain_select"),
    ("/* a /* nested */ still */ SELECT f(1)", "proc_select"),
    ("-- x\nSELECT do_thing()", "proc_select"), ("SELECT $$ f(x) $$ AS x", "plain_select"),
    ("SELECT $a$ $b$ f( $a$, 1", "plain_select"), ("SELECT $1, $2 FROM t", "plain_select"),
    ("SELECT \"Count\"(1)", "plain_select"), ("SELECT \"odd name\"(1)", "proc_select"),
    ("SELECT \"a(b\" FROM t", "plain_select"), ("SELECT 'it''s f(x)'", "plain_select"),
    ("SELECT 'open f(", "plain_select"), ("SELECT größe(1)", "proc_select"),
    ("SELECT 1;", "plain_select"), ("SELECT 1; INSERT INTO t VALUES (';')", "dml"),
    ("BEGIN; INSERT INTO t VALUES (1); COMMIT", "commit_rollback"),
    ("SELECT ';COMMIT', $$;COMMIT$$ -- ;COMMIT", "plain_select"),
    ("CREATE RULE r AS ON INSERT TO t DO (DELETE FROM a; DELETE FROM b)", "ddl"),
    ("SET a = 1; SELECT f(1)", "proc_select"), ("CALL a(); DELETE FROM t", "call"),
    ("DELETE FROM t; CALL a()", "dml"), (" ; ; ", "unknown"), ("SELECT \"x;y\" FROM t; DROP TABLE t", "ddl"),
    ("WITH a AS (" + "(" * 40 + "select 1" + ")" * 40 + ") DELETE FROM t", "dml"),
    ("SELECT '" + "x" * 300_000 + "'; DROP TABLE t", "ddl"),
    ("SELECT '" + "''" * 200_000 + "'", "plain_select"),
    ("/*" + "*" * 100_000 + "*/ SELECT f(1)", "proc_select"),
    ("INSERT INTO t VALUES " + ",".join(f"({i},'x')" for i in range(40_000)) + "; COMMIT",
     "commit_rollback"),
]


def apply(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string").repartition(4)
    rows = df.select("i", fn(F.col("sql")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_classes(spark):
    got = apply(spark, [c[0] for c in CASES], S.classify_sql)
    assert [(c[0][:60], g) for c, g in zip(CASES, got)] == [(c[0][:60], c[1]) for c in CASES]


def test_class_does_not_depend_on_case(spark):
    rng = random.Random(1)
    texts = [c[0] for c in CASES if len(c[0]) < 200 and "$" not in c[0]]
    mixed = ["".join(rng.choice([ch.upper(), ch.lower()]) if ch.isascii() else ch for ch in x)
             for x in texts]
    assert apply(spark, mixed, S.classify_sql) == apply(spark, texts, S.classify_sql)


def test_called_names_decide_random_selects(spark):
    rng = random.Random(2)
    known = ["count", "coalesce", "in", "values", "round"]
    own = ["run_job", "app.refresh", "zeta9"]
    texts, want = [], []
    for _ in range(150):
        names = [rng.choice(known + own) for _ in range(rng.randint(0, 4))]
        noise = rng.choice(["", " /* fake(1) */", " -- fake(1)\n", " 'fake(1)'"])
        texts.append("SELECT " + ", ".join(f"{n}{rng.choice(['', ' '])}(1)" for n in names) + noise)
        want.append(any(n in own for n in names))
    assert apply(spark, texts, S.is_proc_invoking) == want


def test_own_builtins_are_added(spark):
    texts = ["SELECT myfunc(1)", "SELECT now()", "SELECT other()"]
    assert apply(spark, texts, lambda c: S.classify_sql(c, ["MyFunc"])) == [
        "plain_select", "plain_select", "proc_select"]
    assert apply(spark, ["INSERT INTO t SELECT f()", "CALL f()"], S.is_proc_invoking) == [False, False]


def test_split(spark):
    got = apply(spark, ["a; b(';') ;; $$;$$ c -- x;y\n;", "one", " ; ", "f(a; b); c"],
                S.split_statements)
    assert got == [["a", "b(';')", "$$;$$ c -- x;y"], ["one"], [], ["f(a; b)", "c"]]


def test_replayable_calls(spark):
    texts = ["SELECT refresh()", "SELECT app.work(1)", "SELECT work(1)", "SELECT '/* refresh() */'",
             "SELECT refresh FROM t"]
    got = apply(spark, texts, lambda c: S.invokes_any(c, [" Refresh ", "work", ""]))
    assert got == [True, True, True, False, False]
    got = apply(spark, texts, lambda c: S.invokes_any(c, ["app.work"]))
    assert got == [False, True, False, False, False]


def test_leading_words(spark):
    texts = ["BEGIN", " -- x\n/* y */ commit work", "rollback to s", "ABORT;", "beginning()", "", "END"]
    assert apply(spark, texts, S.is_transaction_control) == [
        True, True, True, True, False, False, True]
    texts = ["SET x = 1", "  reset all", "DISCARD ALL", "SETTING x", "SELECT 1", "set\tx"]
    assert apply(spark, texts, S.is_session_command) == [True, True, True, False, False, False]
    texts = ["SELECT 1", " with x", "Explain y", "INSERT", "-- c\nSELECT 1"]
    assert apply(spark, texts, S.is_read_statement) == [True, True, True, False, False]
    texts = ["DISCARD ALL", " reset all ", "DEALLOCATE ALL; x", "DISCARD ALL x", "DISCARD TEMP"]
    assert apply(spark, texts, S.is_pooler_reset) == [True, True, True, False, False]


def test_literals(spark):
    texts = ["a 'b''c' $x$ y'$x$ z", "$1$ t $1$", "x $$ open 'y'", "it's", "none", "a $1 b $2"]
    assert apply(spark, texts, S.strip_literals) == [
        "a '' $x$$x$ z", "$1$$1$", "x $$ open 'y'", "it'", "none", "a $1 b $2"]
    got = apply(spark, ["now() 'now()' $a$ now() $a$ now()", "now()", "'now() open"],
                lambda c: S.replace_outside_literals(c, r"(?i)\bNOW\(\)", "T"))
    assert got == ["T 'now()' $a$ now() $a$ T", "T", "'now() open"]


def test_user_patterns(spark):
    assert S.replacement_template("$1-${2}$$ \\ $10") == r"$1-$2\$ \\ $10"
    assert S.replacement_template("${1}0") == r"$1\0"
    assert S.replacement_template("${name}$1x") == "${name}"
    assert S.replacement_template("${card_no}") == "${gcardU95no}"
    for pattern, text, hit in [
            (r"[[:digit:]]{4}", "a 1234", True), (r"^[^[:space:]]+$", "a b", False),
            (r"(?P<card_no>\d{4})$", "x1234", True), (r"\d$", "1\n", False),
            (r"(?m)a$", "a\nb", True), (r"[a[&&b]", "[", True), (r"\p{Greek}", "é", False),
            (r"\Qa.b\E", "axb", False)]:
        found = spark.range(1).select(S.matches_any(F.lit(text), [pattern]).alias("m")).first().m
        assert found is hit, pattern
    for pattern in ("(", r"(?=x)", r"(a)\1", r"(?<!x)y", "a++", r"[[:nope:]]", r"\h", "(?U)a", "[a"):
        with pytest.raises(UnusablePattern):
            usable(pattern)


@pytest.mark.parametrize("formats, want", [([], [0, 0, 0]), ([1], [1, 1, 1]), ([0, 1], [0, 1, 0])])
def test_parameters(spark, formats, want):
    df = spark.createDataFrame(
        [([23, 25], formats, [bytearray(b"a"), None, bytearray(b"c")])],
        "o array<bigint>, f array<smallint>, v array<binary>")
    p = zip_params(F.col("o"), F.col("f"), F.col("v"))
    row = df.select(p.alias("p"), split_params(p).alias("s")).first()
    assert [(x.oid, x.value and bytes(x.value), x.format) for x in row.p] == [
        (23, b"a", want[0]), (25, None, want[1]), (0, b"c", want[2])]
    assert row.s.formats == want and len(row.s["values"]) == 3
    none = spark.sql("SELECT CAST(NULL AS ARRAY<BIGINT>) o, CAST(NULL AS ARRAY<SMALLINT>) f, "
                     "CAST(ARRAY() AS ARRAY<BINARY>) v")
    assert none.select(p.alias("p")).first().p == []


def _scanned(sql, names):
    """Semicolons outside everything, and block comments, letter by letter."""
    cuts, comments, i, depth = [], [], 0, 0
    while i < len(sql):
        c = sql[i]
        if sql.startswith("--", i):
            i = (sql + "\n").index("\n", i)
        elif sql.startswith("/*", i):
            begin, i, level = i, i + 2, 1
            while i < len(sql) and level:
                step = sql[i:i + 2]
                level += (step == "/*") - (step == "*/")
                i += 2 if step in ("/*", "*/") else 1
            comments.append((begin, i))
        elif c == "'" or (names and c == '"'):
            end = sql.find(c, i + 1)
            i = len(sql) if end < 0 else end + 1
        elif tag := re.match(r"\$(?:[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*)?\$", sql[i:]):
            end = sql.find(tag[0], i + len(tag[0]))
            i = len(sql) if end < 0 else end + len(tag[0])
        else:
            depth = max(0, depth + (c == "(") - (c == ")"))
            if c == ";" and not depth:
                cuts.append((i, i + 1))
            i += 1
    return cuts, comments


def _pieces(sql, cuts):
    edges = [0, *(x for cut in cuts for x in cut), len(sql)]
    return [sql[a:b] for a, b in zip(edges[::2], edges[1::2])]


def test_folds_equal_a_scan_letter_by_letter(spark):
    rng = random.Random(4)
    signs = ["'", "''", '"', "$", "$$", "$a$", "a", "b1", "1", "(", ")", "(x)", ";", "/*", "*/", "/",
             "*", "-", "--", "\n", " ", "é"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", "(" * 3000 + ";" + ")" * 2999 + ";", "/*" * 2000 + "*/" * 2000 + ";x"]
    assert apply(spark, texts, nesting.statements) == [_pieces(x, _scanned(x, False)[0]) for x in texts]
    for names in (False, True):
        assert apply(spark, texts, lambda c, n=names: nesting.without_comments(c, n)) == [
            " ".join(_pieces(x, _scanned(x, names)[1])) for x in texts]


def test_any_depth(spark):
    texts, want = [], []
    for n in (1, 13, 17, 60, 500):
        for more in (-1, 0, 1):
            texts += ["select " + "(a; " * n + ")" * (n + more) + "; drop table t",
                      "select 1 " + "/* ; " * n + "*/" * (n + more) + "; delete from t"]
            want += ["plain_select", "plain_select"] if more < 0 else ["ddl", "dml"]
    assert apply(spark, texts, S.classify_sql) == want == apply(spark, texts, S.classify_batch)
    opened = ["/* " * 40 + "*/ " * 40 + "commit", "/* " * 40 + "*/ " * 39 + "commit"]
    assert apply(spark, opened, S.is_transaction_control) == [True, False]


def test_patterns_end_lines_as_re2_does(spark):
    """CR, NEL and the separators are plain characters: neither a mask nor a filter stops at them."""
    import duckdb

    texts = [f"password = 'abc{sign}def' from secret_t{sign}" for sign in "\r\x85  \x0b\n \t"]
    patterns = ["password.*", r"abc\sdef", r"abc[\s]def", r"abc\Sdef", "password.*secret_t", "(?m)^def",
                "(?m)_t$", "secret_t.$"]
    con = duckdb.connect()
    for pattern in patterns:
        want = [con.execute("select regexp_matches($1, $2), regexp_replace($1, $2, '*', 'g')",
                            [x, pattern]).fetchone() for x in texts]
        found = apply(spark, texts, lambda c, p=pattern: S.matches_any(c, [p]))
        masked = apply(spark, texts, lambda c, p=pattern: F.regexp_replace(c, usable(p), "*"))
        assert list(zip(found, masked, strict=True)) == want, pattern


def test_nested_texts_are_split_once(spark, tmp_path, monkeypatch):
    """A query of several facts folds each text once for its statements and once for its tokens."""
    from sqltide.functions import nesting, sqltext
    from sqltide.plans import catalog

    spark.createDataFrame([(k, f'it\'s "{k}" (;) /* ; */') for k in range(6)],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    calls = []
    whole = nesting.statements
    monkeypatch.setattr(nesting, "statements", lambda sql: calls.append(1) or whole(sql))
    rows = catalog.deep_comments(spark, str(tmp_path)).collect()
    assert len(calls) == 1
    assert {(r.pos, r.statements, r.stmt_class, r.batch_class, r.command) for r in rows} == {
        (k, 1 if k % 3 == 2 else 2, *["plain_select" if k % 3 == 2 else "dml"] * 2, "select")
        for k in range(6)}
    # Views and statements made before give what the text alone gives.
    sql = F.lit("select 1; /* a /* b */ ; */ delete from \"t\"; commit")
    parts, tokens = sqltext.split_statements(sql), sqltext.tokens_view(sql)
    one = spark.range(1).select(
        (sqltext.classify_sql(sql) == sqltext.classify_sql(sql, tokens=tokens, statements=parts)),
        (sqltext.classify_batch(sql) == sqltext.classify_batch(sql, statements=parts)),
        (sqltext.primary_command(sql) == sqltext.primary_command(sql, tokens=tokens))).first()
    assert all(one)
