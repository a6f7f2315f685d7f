"""SQL text functions as Spark column expressions.

Every function takes and returns a ``Column`` and runs inside the JVM. Statement texts
can be large, so each pattern uses possessive repetition: matching stays linear and
does not use the thread's stack. Patterns follow no nesting; where a text may nest comments
or parentheses, it is cut into pieces and folded with a depth as state (``nesting``).
"""

from __future__ import annotations

import re
from functools import cache, reduce
from string import ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqltide.functions import nesting
from sqltide.functions.nesting import let
from sqltide.functions.patterns import group_name, usable
from sqltide.functions.words import (
    BUILTIN_ROUTINES, CLASS_PRIORITY, KEYWORDS_BEFORE_PAREN,
)

_WIDE = r"\x{80}-\x{10FFFF}"
_NAME = rf"[A-Za-z_{_WIDE}][A-Za-z0-9_{_WIDE}]*+"
# Lower-case text is matched by listed characters, which the regex engine looks up at once.
_LOW = "_" + ascii_lowercase
_LOW_NAME = rf"[{_LOW}{_WIDE}][{_LOW}{digits}{_WIDE}]*+"
# In the token view a lone double quote stands for a quoted name that is no plain word.
_WORD = rf'(?:{_LOW_NAME}|")'
_NO_WORD = rf'[^{_LOW}{_WIDE}"]*+'
_WORD_STARTS = rf"(?<![{_LOW}{_WIDE}])"
_WORD_ENDS = rf"(?![{_LOW}{digits}{_WIDE}])"
_SPACE = r"[ \t\n\r\f\x0B]"


# Without a comment inside; nested ones are taken out before.
_COMMENT = r"--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"

# Comments vanish, a literal leaves its opening sign, a quoted plain word loses its quotes.
_TOKENS = "|".join([
    _COMMENT,
    r"(')[^']*+(?:''[^']*+)*+'?+",
    rf"(\$)((?:{_NAME})?+)\$(?s:.*?)(?:\$\3\$|\z)",
    rf'"({_NAME})(?:"(?!")|\z)',
    r'(")[^"]*+(?:""[^"]*+)*+"?+',
])

# Literals as the safeguards see them: tags may start with a digit, comments are no
# special text, and an unclosed dollar quote makes the rest of the text a literal.
_LITERAL = "|".join([
    r"(')[^']*+(?:''[^']*+)*+('?+)",
    r"(\$[A-Za-z0-9_]*+\$)(?s:.*?)(\3)",
    r"(\$[A-Za-z0-9_]*+\$(?s:.*))",
])


def _statement_pattern() -> str:
    """One statement of raw text without parentheses and nested comments."""
    opaque = "|".join([
        _COMMENT,
        r"'[^']*+(?:''[^']*+)*+'?+",
        rf"\$(?<tag>(?:{_NAME})?+)\$(?s:.*?)(?:\$\k<tag>\$|\z)",
    ])
    return rf"(?:[^;'$/\-]++|{opaque}|['$/\-])++"


_STATEMENT = _statement_pattern()


@cache
def _whole_word(words: frozenset) -> str:
    """A pattern for exactly these words, grouped by first letter."""
    groups: dict[str, list[str]] = {}
    for word in sorted(words):
        groups.setdefault(word[0], []).append(quoted(word[1:]))
    return r"\A(?:" + "|".join(
        f"{quoted(first)}(?:{'|'.join(rest)})" for first, rest in groups.items()) + r")\z"


def _is_any(c: Column, words) -> Column:
    """Membership in a long list as one literal, which keeps the plan small."""
    return c.rlike(_whole_word(frozenset(words)))


# --- token view and statements ---------------------------------------------------------

def _may_hide_text(sql: Column) -> Column:
    """Cheap test for comments, literals and quoted names."""
    return reduce(lambda acc, sign: acc | sql.contains(sign), ['"', "$", "--", "/*"],
                  sql.contains("'"))


def tokens_view(sql: Column) -> Column:
    """Text without comments and literal bodies; quoted names stay names."""
    flat = F.when(nesting.may_nest(sql), nesting.without_comments(sql, names=True)).otherwise(sql)
    return F.when(
        _may_hide_text(sql),
        F.regexp_replace(flat, _TOKENS, " $1$2$4$5 "),
    ).otherwise(sql)


def split_statements(sql: Column) -> Column:
    """Non-blank statements of a text, as an array in written order."""
    parts = F.when(~sql.contains(";"), F.array(sql)).when(
        sql.contains("(") | nesting.may_nest(sql), nesting.statements(sql),
    ).otherwise(F.regexp_extract_all(sql, F.lit(_STATEMENT), F.lit(0)))
    return F.filter(F.transform(parts, _trim_space), lambda s: s != "")


def _trim_space(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A{_SPACE}++|{_SPACE}++\z", "")


def depth_zero(tokens: Column) -> Column:
    """Token view without anything inside parentheses, for any depth of nesting."""
    return F.when(
        tokens.contains("("), F.regexp_replace(nesting.without_groups(tokens), r"(?s)\(.*", " "),
    ).otherwise(tokens)


def _first_word(lowered: Column) -> Column:
    return F.regexp_extract(lowered, rf'^{_NO_WORD}({_WORD})', 1)


def _second_word(lowered: Column) -> Column:
    return F.regexp_extract(
        lowered, rf'^{_NO_WORD}{_WORD}{_NO_WORD}({_WORD})', 1)


def call_names(tokens: Column) -> Column:
    """Lower-case names, qualified as written, that stand before an opening parenthesis."""
    return F.transform(_calls(F.lower(tokens)), _compact)


def _calls(lowered: Column) -> Column:
    dotted = rf"(?:{_SPACE}*+\.{_SPACE}*+{_WORD})*+"
    return F.regexp_extract_all(
        lowered, F.lit(rf"{_WORD_STARTS}({_WORD}{dotted}){_SPACE}*+\("), F.lit(1))


def _compact(name: Column) -> Column:
    """A call name without blanks, which only stand around dots."""
    return F.when(name.contains("."), F.regexp_replace(name, rf"{_SPACE}++", "")) \
        .otherwise(name)


def _calls_routine(lowered: Column, builtins) -> Column:
    known_last = KEYWORDS_BEFORE_PAREN | BUILTIN_ROUTINES \
        | {b.lower() for b in builtins if b}

    def is_routine(name: Column) -> Column:
        first = F.substring_index(_compact(name), ".", 1)
        last = F.substring_index(_compact(name), ".", -1)
        dotted = ~_is_any(first, KEYWORDS_BEFORE_PAREN) & ~_is_any(last, known_last)
        return F.when(name.contains("."), dotted).otherwise(~_is_any(name, known_last))

    return F.when(
        lowered.contains("("), F.exists(_calls(lowered), is_routine),
    ).otherwise(F.lit(False))


def _primary_of_with(lowered: Column) -> Column:
    return F.regexp_extract(
        depth_zero(lowered),
        rf"{_WORD_STARTS}(select|insert|update|delete){_WORD_ENDS}", 1)


def primary_command(sql: Column, tokens: Column | None = None) -> Column:
    """First of select/insert/update/delete outside parentheses, '' if there is none.
    ``tokens``: the text's token view, if there is one already."""
    return _primary_of_with(F.lower(tokens_view(sql) if tokens is None else tokens))


# --- classification --------------------------------------------------------------------

def _class_of_tokens(lowered: Column, builtins) -> Column:
    """Class by the leading word; WITH counts as the command it governs."""
    leading = let(_first_word(lowered), lambda w: F.when(
        w == "with", F.concat(F.lit("with "), _primary_of_with(lowered))).otherwise(w))
    from_word = rf"{_WORD_STARTS}from{_WORD_ENDS}"

    def by_word(word: Column) -> Column:
        return (
            F.when(word.isin("select", "with select"),
                   F.when(_calls_routine(lowered, builtins), "proc_select")
                    .otherwise("plain_select"))
             .when(word.rlike(r"\A(?:with )?(?:insert|update|delete)\z"), "dml")
             .when(word.isin("begin", "start"), "begin")
             .when(word.isin("commit", "end"), "commit_rollback")
             .when(word == "rollback",
                   F.when(_second_word(lowered) == "to", "utility")
                    .otherwise("commit_rollback"))
             .when(word.isin("savepoint", "release", "set", "reset", "discard"), "utility")
             .when(word.isin("create", "alter", "drop"), "ddl")
             .when(word == "call", "call")
             .when((word == "copy") & depth_zero(lowered).rlike(from_word), "copy_from")
             .otherwise("unknown"))

    return let(leading, by_word)


def _weightiest(classes: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in CLASS_PRIORITY.items() for x in kv])
    ranked = F.transform(
        classes,
        lambda c, i: F.struct(weights[c].alias("w"), (-i).alias("i"), c.alias("c")))
    return F.coalesce(F.array_max(ranked)["c"], F.lit("unknown"))


def classify_single(sql: Column, builtins=()) -> Column:
    """Class of a text that holds one statement."""
    return let(F.lower(tokens_view(sql)), lambda t: _class_of_tokens(t, builtins))


def classify_batch(sql: Column, builtins=(), statements: Column | None = None) -> Column:
    """Weightiest class among the statements of a text; the first wins a tie.
    ``statements``: the text's statements, if it is split already."""
    parts = split_statements(sql) if statements is None else statements
    return _weightiest(F.transform(parts, lambda s: classify_single(s, builtins)))


def has_several_statements(sql: Column) -> Column:
    """Cheap test that never misses: a semicolon with more text behind it."""
    return sql.contains(";") & sql.rlike(r";[ \t\n\r]*+[^ \t\n\r;]")


def classify_sql(sql: Column, builtins=(), tokens: Column | None = None,
                 statements: Column | None = None) -> Column:
    """Statement class of a text of one or several statements.

    The token view is split instead of the raw text, so each text is tokenised once. Only
    quoted names need the raw text, as they do not hide a semicolon. ``tokens``, ``statements``:
    the text's token view and its statements, if there are any already.
    """
    def pieces(t: Column) -> Column:
        several = F.when(t.contains("("), nesting.token_statements(t)).otherwise(F.split(t, ";"))
        return F.when(has_several_statements(t), several).otherwise(F.array(t))

    def tokenised(s: Column) -> Column:
        return F.lower(tokens_view(s))

    parts = F.when(
        sql.contains('"') & has_several_statements(sql),
        F.transform(split_statements(sql) if statements is None else statements, tokenised),
    ).otherwise(let(tokenised(sql) if tokens is None else F.lower(tokens), pieces))
    classes = F.transform(parts, lambda t: _class_of_tokens(t, builtins))
    return let(classes, lambda c: F.when(F.size(c) == 1, c[0]).otherwise(_weightiest(c)))


def is_proc_invoking(sql: Column, builtins=()) -> Column:
    """True for a SELECT or WITH..SELECT that calls a routine outside the lists."""
    def decide(t: Column) -> Column:
        word = _first_word(t)
        is_select = F.when(word == "select", True) \
            .when(word == "with", _primary_of_with(t) == "select").otherwise(False)
        return F.when(is_select, _calls_routine(t, builtins)).otherwise(False)

    return let(F.lower(tokens_view(sql)), decide)


def invokes_any(sql: Column, names) -> Column:
    """True if a call's last segment or full name is in ``names`` (a list, any case)."""
    wanted = sorted({n.strip().lower() for n in names if n.strip()})
    if not wanted:
        return F.lit(False)
    return F.exists(
        call_names(tokens_view(sql)),
        lambda c: _is_any(c, wanted) | _is_any(F.substring_index(c, ".", -1), wanted))


def matches_any(sql: Column, patterns) -> Column:
    """True if any pattern (RE2 syntax) is found in the raw text; unusable patterns raise."""
    return reduce(lambda acc, p: acc | sql.rlike(usable(p)), patterns, F.lit(False))


# --- leading words ---------------------------------------------------------------------

def leading_keyword(sql: Column) -> Column:
    """Lower-case leading letters after blanks and comments, '' if other text leads."""
    flat = F.when(nesting.may_nest(sql), nesting.without_comments(sql)).otherwise(sql)
    return F.lower(F.regexp_extract(
        flat, rf"\A(?:{_SPACE}++|{_COMMENT})*+([A-Za-z_]++)", 1))


def is_transaction_control(sql: Column) -> Column:
    return leading_keyword(sql).isin("begin", "start", "commit", "end", "rollback", "abort")


def is_session_command(sql: Column) -> Column:
    return sql.rlike(rf"(?i)\A{_SPACE}*+(?:SET|RESET|DISCARD) ")


def is_read_statement(sql: Column) -> Column:
    return sql.rlike(rf"(?i)\A{_SPACE}*+(?:SELECT|WITH|EXPLAIN)")


def is_pooler_reset(sql: Column) -> Column:
    """Session-reset statement that a connection pooler sends between clients."""
    return sql.rlike(
        rf"(?i)\A{_SPACE}*+(?:DISCARD|RESET|DEALLOCATE) ALL(?:;|{_SPACE}*+\z)")


# --- literals --------------------------------------------------------------------------

def has_literal(sql: Column) -> Column:
    return sql.contains("'") | sql.rlike(r"\$[A-Za-z0-9_]*+\$")


def strip_literals(sql: Column) -> Column:
    """Empty the bodies of quoted and dollar-quoted literals; comments stay."""
    return F.when(has_literal(sql), F.regexp_replace(sql, _LITERAL, "$1$2$3$4$5")) \
        .otherwise(sql)


def outside_literals(sql: Column, edit) -> Column:
    """Apply ``edit`` (Column -> Column) to the text between literals only."""
    pieces = F.zip_with(
        F.split(sql, _LITERAL, -1),
        F.regexp_extract_all(sql, F.lit(_LITERAL), F.lit(0)),
        lambda gap, lit: F.concat(edit(gap), F.coalesce(lit, F.lit(""))))
    return F.when(has_literal(sql), F.array_join(pieces, "")).otherwise(edit(sql))


def replace_outside_literals(sql: Column, pattern: str, replacement: str) -> Column:
    return outside_literals(
        sql, lambda gap: F.regexp_replace(gap, pattern, replacement))


# --- patterns given by a user ----------------------------------------------------------

def replacement_template(template: str) -> str:
    """Turn ``$1``, ``${1}``, ``${name}`` and ``$$`` into a Java replacement text."""
    out, at = [], 0
    for m in re.finditer(r"\$\$|\$\{(\w+)\}|\$(\w+)", template):
        out.append(re.sub(r"([\\$])", r"\\\1", template[at:m.start()]))
        name = m.group(1) or m.group(2)
        if name is None:
            out.append(r"\$")
        elif name.isdigit():
            following = template[m.end():m.end() + 1]
            out.append(f"${name}" + ("\\" if following.isdigit() else ""))
        elif not name[0].isdigit():
            out.append("${" + group_name(name) + "}")
        at = m.end()
    out.append(re.sub(r"([\\$])", r"\\\1", template[at:]))
    return "".join(out)


def quoted(text: str) -> str:
    """A pattern that matches ``text`` literally."""
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text)
