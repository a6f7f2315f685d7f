"""Users' patterns in RE2 syntax, rewritten for the JVM's engine; what can't be kept raises."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# The ASCII classes of RE2 by name.
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~",
    "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
#: Escapes that both engines read alike, outside of classes.
KEPT = set("AbBdDfnrstSvwWxz0aQE") | set("pP")


class UnusablePattern(ValueError):
    """A pattern that RE2 doesn't accept, or that the JVM can't be given."""


def group_name(name: str) -> str:
    """A name of the JVM's kind for any group name: it allows no underscore."""
    return "g" + name.replace("_", "U95") if "_" in name else name


def _class(pattern: str, at: int) -> tuple[str, int]:
    """The bracket class that begins at ``at``, and where it ends."""
    out, here = ["["], at + 1
    if pattern[here:here + 1] == "^":
        out.append("^")
        here += 1
    first = True
    while here < len(pattern):
        char = pattern[here]
        if char == "]" and not first:
            return "".join(out) + "]", here + 1
        first = False
        named = re.match(r"\[:(\^?)(\w+):\]", pattern[here:])
        if named:
            if named[2] not in CLASSES:
                raise UnusablePattern(f"no class {named[2]!r} in {pattern!r}")
            out.append(f"[{named[1]}{CLASSES[named[2]]}]" if named[1] else CLASSES[named[2]])
            here += named.end()
        elif char == "\\":
            blank = pattern.startswith(r"\s", here)
            text, here = _escape(pattern, here)
            out.append(BLANKS if blank else text)
        else:
            out.append("\\" + char if char in "[&]" else char)
            here += 1
    raise UnusablePattern(f"class without an end in {pattern!r}")


#: What ``\\s`` stands for in RE2: no vertical tab.
BLANKS = r"\t\n\f\r "


def _escape(pattern: str, at: int) -> tuple[str, int]:
    char = pattern[at + 1:at + 2]
    if not char:
        raise UnusablePattern(f"lone backslash at the end of {pattern!r}")
    if char in "pP":
        script = re.match(r"\\[pP]\{(\^?)(\w{3,})\}", pattern[at:])
        if script:
            letter = char if not script[1] else {"p": "P", "P": "p"}[char]
            return f"\\{letter}{{Is{script[2]}}}", at + script.end()
    elif char == "v":
        return r"\x0B", at + 2
    elif char in "sS":
        return f"[{'^' if char == 'S' else ''}{BLANKS}]", at + 2
    elif char in "123456789" or char.isalnum() and char not in KEPT:
        raise UnusablePattern(f"\\{char} can't be used in {pattern!r}")
    return pattern[at:at + 2], at + 2


def to_jvm(pattern: str) -> str:
    """The same language for the JVM: named classes and groups, brackets, and ends of text."""
    out, at = [], 0
    many_lines = bool(re.match(r"\(\?[a-z]*m", pattern))
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            if pattern.startswith(r"\Q", at):
                end = pattern.find(r"\E", at)
                end = len(pattern) if end < 0 else end + 2
                out.append(pattern[at:end])
                at = end
                continue
            text, at = _escape(pattern, at)
            out.append(text)
        elif char == "[":
            text, at = _class(pattern, at)
            out.append(text)
        elif pattern.startswith("(?", at):
            named = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[at:])
            flags = re.match(r"\(\?([a-zA-Z-]*)([:)])", pattern[at:])
            if named:
                out.append(f"(?<{group_name(named[1])}>")
                at += named.end()
            elif flags and set(flags[1]) <= set("ims-"):
                out.append(flags[0])
                at += flags.end()
            else:
                raise UnusablePattern(f"group {pattern[at:at + 4]!r} can't be used in {pattern!r}")
        elif char == "$":
            out.append(r"(?=\n|\z)" if many_lines else r"\z")
            at += 1
        elif char in "*+?}" and pattern[at + 1:at + 2] == "+":
            raise UnusablePattern(f"possessive repeat in {pattern!r}")
        else:
            out.append(char)
            at += 1
    return "".join(out)


def usable(pattern: str) -> str:
    """``pattern`` for the JVM, compiled there once to be sure; raises :class:`UnusablePattern`.

    Only a line feed ends a line, as in RE2, so a dot goes on behind CR, NEL and the like.
    """
    made = "(?d)" + to_jvm(pattern)
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(made)
    except (Py4JJavaError, PySparkException) as error:
        raise UnusablePattern(f"{pattern!r} doesn't compile") from error
    return made
