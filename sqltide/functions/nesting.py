"""Nesting of any depth: texts cut into pieces and folded by an automaton with depths.

A pattern follows only as many levels as are written into it. Here a text is cut at the signs
that matter, and one ``aggregate`` runs over the pieces. Its state says what the text is in
(plain text, line or block comment, literal, dollar quote, quoted name), how deep, and which
pieces were cuts so far; nothing is written per piece, so the fold is linear in the text.
Parts are put together again from slices of the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"A-Za-z0-9_\x{80}-\x{10FFFF}"
_SIGNS = r"\n'\"$();/*\-"
# A group without signs inside changes nothing; a word counts by itself behind a dollar sign.
_PIECE = rf"\([^{_SIGNS}]*+\)|(?<=\$)[{_WORD}]++|[{_SIGNS}]|[^{_SIGNS}]++"
_TOKEN_PIECE = r"\([^();]*+\)|[();]|[^();]++"

PLAIN, LINE, BLOCK, LITERAL, DOLLAR, NAME = range(6)
_SPANS = "array<struct<a:int,b:int>>"
_STATE = {"at": "int", "mode": "int", "depth": "int", "level": "int", "before": "string",
          "tag": "string", "dollar": "int", "start": "int", "cuts": _SPANS}


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def may_nest(sql: Column) -> Column:
    """Whether a comment sign follows another with none closed between, anywhere."""
    return sql.contains("/*") & sql.rlike(r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+/\*")


def _span(a: Column, b: Column) -> Column:
    return F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))


def _cuts(pieces: Column, names: bool, comments: bool) -> Column:
    """Pieces (from, to) that are comments, or semicolons outside parentheses."""
    start = F.struct(*[F.lit({"before": "", "tag": ""}.get(f, 0)).cast(kind).alias(f)
                       if f != "cuts" else F.array().cast(_SPANS).alias(f)
                       for f, kind in _STATE.items()])

    def step(s: Column, p: Column) -> Column:
        def then(**new) -> Column:
            """The next state: one piece on, marks of the last piece gone unless given."""
            new = {"at": s["at"] + 1, "before": F.lit(""), "dollar": F.lit(0)} | {
                k: v if isinstance(v, Column) else F.lit(v) for k, v in new.items()}
            return F.struct(*[new.get(f, s[f]).cast(kind).alias(f) for f, kind in _STATE.items()])

        add = lambda a, b: F.concat(s["cuts"], _span(a, b))
        sign = p.isin("/", "*", "-")
        held = then(before=F.when(sign, p).otherwise(""))

        plain = F.when(p == "'", then(mode=LITERAL))
        if names:
            plain = plain.when(p == '"', then(mode=NAME))
        plain = (
            plain.when((p == "*") & (s["before"] == "/"),
                       then(mode=BLOCK, level=1, start=s["at"] - 1))
            .when((p == "-") & (s["before"] == "-"), then(mode=LINE))
            .when((p == "$") & (s["dollar"] > 0), then(
                mode=DOLLAR, tag=F.when(s["dollar"] == 2, s["tag"]).otherwise("")))
            .when(p == "$", then(dollar=1))
            .when((s["dollar"] == 1) & p.rlike(rf"\A(?![0-9])[{_WORD}]"), then(dollar=2, tag=p))
            .when(p == "(", then(depth=s["depth"] + 1))
            .when(p == ")", then(depth=F.greatest(s["depth"] - 1, F.lit(0)))))
        if not comments:
            plain = plain.when((p == ";") & (s["depth"] == 0), then(cuts=add(s["at"], s["at"] + 1)))
        block = F.when((p == "*") & (s["before"] == "/"), then(level=s["level"] + 1)).when(
            (p == "/") & (s["before"] == "*"), F.when(s["level"] > 1, then(level=s["level"] - 1))
            .otherwise(then(level=0, mode=PLAIN, **(
                {"cuts": add(s["start"], s["at"] + 1)} if comments else {})))).otherwise(held)
        # A closing tag is a dollar sign, the tag's word and another dollar sign.
        closes = (p == "$") & (s["dollar"] == F.when(s["tag"] == "", 1).otherwise(2))
        dollar = F.when(closes, then(mode=PLAIN)).when(p == "$", then(dollar=1)).when(
            (s["dollar"] == 1) & (p == s["tag"]), then(dollar=2)).otherwise(then())
        # A longer piece is no sign, and only a dollar sign before it gives it a meaning.
        return (F.when((F.length(p) > 1) & (s["dollar"] == 0), then())
                .when(s["mode"] == PLAIN, plain.otherwise(held))
                .when(s["mode"] == BLOCK, block)
                .when(s["mode"] == DOLLAR, dollar)
                .when(p == F.when(s["mode"] == LINE, "\n").when(s["mode"] == NAME, '"').otherwise("'"),
                      then(mode=PLAIN)).otherwise(then()))

    def last(s: Column) -> Column:
        if not comments:
            return s["cuts"]
        return F.when(s["mode"] == BLOCK, F.concat(s["cuts"], _span(s["start"], s["at"]))) \
            .otherwise(s["cuts"])

    return F.aggregate(pieces, start, step, last)


def _between(pieces: Column, cuts: Column) -> Column:
    """What lies before, between and behind cuts, as texts."""
    def part(k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get(cuts, k - 1)["b"])
        end = F.when(k == F.size(cuts), F.size(pieces)).otherwise(F.get(cuts, k)["a"])
        return F.array_join(F.slice(pieces, begin + 1, end - begin), "")

    return F.transform(F.sequence(F.lit(0), F.size(cuts)), part)


def _parts(text: Column, pattern: str, cuts) -> Column:
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda pieces: let(cuts(pieces), lambda c: _between(pieces, c)))


def statements(sql: Column) -> Column:
    """Raw text cut at semicolons outside parentheses, literals and comments."""
    return _parts(sql, _PIECE, lambda p: _cuts(p, names=False, comments=False))


def without_comments(sql: Column, names: bool = False) -> Column:
    """Text with a blank for each block comment; ``names``: quoted names hide comment signs."""
    return F.array_join(_parts(sql, _PIECE, lambda p: _cuts(p, names, comments=True)), " ")


def token_statements(tokens: Column) -> Column:
    """A token view, which has no literals or comments, cut at semicolons outside parentheses."""
    def cuts(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"),
                         F.array().cast(_SPANS).alias("cuts"))

        def step(s: Column, p: Column) -> Column:
            depth = F.when(p == "(", s["depth"] + 1).when(
                p == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
            cut = (p == ";") & (s["depth"] == 0)
            return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), F.when(
                cut, F.concat(s["cuts"], _span(s["at"], s["at"] + 1))).otherwise(s["cuts"])
                .alias("cuts"))

        return F.aggregate(pieces, start, step, lambda s: s["cuts"])

    return _parts(tokens, _TOKEN_PIECE, cuts)


def without_groups(tokens: Column) -> Column:
    """A token view with a blank for each closed group: innermost ones go first, until a round
    changes nothing."""
    openings = F.length(F.regexp_replace(tokens, r"[^(]++", ""))
    start = F.struct(tokens.alias("text"), F.lit(True).alias("changed"))

    def round_(s: Column, _: Column) -> Column:
        return F.when(s["changed"], let(
            F.regexp_replace(s["text"], r"\([^()]*+\)", " "),
            lambda t: F.struct(t.alias("text"), (t != s["text"]).alias("changed")))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), openings), start, round_, lambda s: s["text"])
