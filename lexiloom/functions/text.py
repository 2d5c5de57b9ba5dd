"""Column expressions on text. All of them stay inside the JVM and need no shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .fixed import BOS, EOS, FULLWIDTH_SEMICOLON, OCR_PATTERNS, WHITESPACE

# Characters and ranges; a hyphen in any other place would make a range with a neighbour.
_CLASS = re.compile(r"\[((?:[^\[\]\\^&-](?:-[^\[\]\\^&-])?)+)\]")
_ESCAPED = re.compile(r"\\[^\w\s]")
_LITERAL = re.compile(r"[^\\\[\](){}.*+?^$|]")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _class_member(pattern: str) -> str | None:
    """The pattern as the inside of a character class, if it matches exactly one character."""
    found = _CLASS.fullmatch(pattern)
    if found:
        return found.group(1)
    if _ESCAPED.fullmatch(pattern):
        return pattern
    if _LITERAL.fullmatch(pattern):
        return "\\-" if pattern == "-" else ("\\&" if pattern == "&" else pattern)
    return None


#: What Python takes for a word character and for white space, as members of a Java class.
_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x1c-\x1f"
_CLASSES = {"w": _WORD, "s": _SPACE, "d": r"\p{Nd}"}
_AFTER, _BEFORE = f"(?<=[{_WORD}])", f"(?=[{_WORD}])"
_NOT_AFTER, _NOT_BEFORE = f"(?<![{_WORD}])", f"(?![{_WORD}])"
_BORDERS = {"b": f"(?:{_AFTER}{_NOT_BEFORE}|{_NOT_AFTER}{_BEFORE})",
            "B": f"(?:{_AFTER}{_BEFORE}|{_NOT_AFTER}{_NOT_BEFORE})", "A": r"\A", "Z": r"\z", "z": r"\z"}
_CODED = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(0[0-7]{0,2}|[1-3][0-7]{2}))")
_COUNT = re.compile(r"\{(\d*)(,?)(\d*)\}")
_GROUP = re.compile(r"\(\?(?:P<(\w+)>|P=(\w+)\)|#[^)]*\)|([a-zA-Z]*)(?:-([a-zA-Z]*))?[:)]|\()")


def _escape(pattern: str, at: int, inside: bool) -> tuple[str, int]:
    """The escape at a place in Java's dialect, and where it ends."""
    coded = _CODED.match(pattern, at)
    if coded:
        digits, octal = coded[1] or coded[2] or coded[3], coded[4]
        return f"\\x{{{int(octal, 8) if octal else int(digits, 16):x}}}", coded.end()
    c = pattern[at + 1]
    if c.lower() in _CLASSES:
        members = _CLASSES[c.lower()]
        return (members if inside and c.islower() else f"[{'^' if c.isupper() else ''}{members}]"), at + 2
    if not inside and c in _BORDERS:
        return _BORDERS[c], at + 2
    if c == "N":
        raise ValueError(f"characters by name are not supported: {pattern}")
    return {"v": r"\x0B", "b": r"\x08"}.get(c, pattern[at:at + 2]), at + 2


def _group(pattern: str, at: int, names: dict[str, str]) -> tuple[str, int]:
    """The special group that begins at a place, and where its head ends."""
    found = _GROUP.match(pattern, at)
    if not found:
        return "(?", at + 2
    name, again, flags, off = found.groups()
    if name:
        return f"(?<{names.setdefault(name, f'g{len(names)}')}>", found.end()
    if again:
        return f"\\k<{names[again]}>", found.end()
    if found[0].startswith("(?#"):
        return "", found.end()
    if found[0] == "(?(" or set((flags or "") + (off or "")) & set("axL"):
        raise ValueError(f"neither conditions nor the flags a, x and L are supported: {pattern}")
    return found[0].replace("u", ""), found.end()


def java_pattern(pattern: str) -> str:
    r"""A Python regex in Java's dialect, refused where it has no counterpart there.

    Only a line feed ends a line; classes and word borders are Python's; names of groups, counts without a
    first number, braces that count nothing and ``\Z`` are written as Java wants them; inside brackets
    ``[`` and ``&`` are characters like others.
    """
    re.compile(pattern)
    out, names, inside, i = [], {}, False, 0
    while i < len(pattern):
        c, after = pattern[i], i + 1
        if c == "\\":
            c, after = _escape(pattern, i, inside)
        elif inside:
            inside = c != "]"
            c = "\\" + c if c in "[&" else c
        elif c == "[":
            inside = True
            if pattern.startswith("^", after):
                c, after = "[^", after + 1
            if pattern.startswith("]", after):  # first in a class it is a character
                c, after = c + "\\]", after + 1
        elif c == "{":
            count = _COUNT.match(pattern, i)
            if count and (count[1] or count[2]):
                c, after = f"{{{count[1] or 0}{count[2]}{count[3]}}}", count.end()
            else:
                c = "\\{"
        elif c == "}":
            c = "\\}"
        elif pattern.startswith("(?", i):
            c, after = _group(pattern, i, names)
        out.append(c)
        i = after
    return "(?Ud)" + "".join(out)


def clean_text(text: str | Column, patterns: Sequence[str] = OCR_PATTERNS) -> Column:
    """Delete every pattern, a Python regex, in order. One-character patterns fuse into a single pass."""
    result = col(text)
    members = [_class_member(p) for p in patterns]
    if patterns and all(m is not None for m in members):
        return F.regexp_replace(result, "[" + "".join(members) + "]+", "")
    for pattern in patterns:
        result = F.regexp_replace(result, java_pattern(pattern), "")
    return result


def split_semicolons(text: str | Column) -> Column:
    return F.translate(col(text), FULLWIDTH_SEMICOLON, "\n")


def wrap_document(text: str | Column) -> Column:
    return F.concat(F.lit(BOS), col(text), F.lit(EOS))


def plain_spaces(text: str | Column) -> Column:
    """All white space as spaces. ``replace`` looks at bytes, ``translate`` makes a string of every character."""
    flat = col(text)
    for space in WHITESPACE[1:]:
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return flat


def _split_at_spaces(text: str | Column) -> Column:
    """A plain-character split avoids the regex engine; it leaves empty strings between spaces."""
    return F.split(plain_spaces(text), " ")


def words(text: str | Column) -> Column:
    """The runs of non-whitespace, in order."""
    return F.filter(_split_at_spaces(text), lambda w: w != "")


def explode_words(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per word, with the columns to keep."""
    rows = df.select(*keep, F.explode(_split_at_spaces(text)).alias("word"))
    return rows.where(F.col("word") != "")


def hash_key(key: str | Column, seed: int = 42) -> Column:
    """32-bit number from md5, the same on every engine. Break its ties with the key itself."""
    digest = F.md5(F.concat_ws(":", col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _escaped_char(c: Column) -> Column:
    code = F.ascii(c)
    digits = F.lower(F.hex(code))
    hidden = (
        F.when(code <= 0xFF, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code <= 0xFFFF, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )
    return F.when(c.rlike(r"^[\p{C}\p{Z}&&[^ ]]$"), hidden).otherwise(c)


def python_text(value: Column) -> Column:
    """A string the way Python's ``repr`` writes it."""
    s = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(shown))
    s = F.when(
        s.rlike(r"[\p{C}\p{Z}&&[^ ]]"),
        F.array_join(F.transform(F.split(s, ""), _escaped_char), ""),
    ).otherwise(s)
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def python_list_text(values: str | Column) -> Column:
    """A list of strings the way Python's ``str`` writes it."""
    items = F.transform(col(values), lambda v: F.coalesce(python_text(v), F.lit("None")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
