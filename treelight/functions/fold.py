"""Case folding, one character to one character, and the name functions built on it."""

from __future__ import annotations

import re
import sys
from functools import lru_cache, reduce
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def fold_pairs() -> tuple[str, str]:
    """Characters that fold to another single character, and what they fold to, beyond ASCII too."""
    pairs = [(chr(c), chr(c).lower()) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    return str.maketrans(*fold_pairs())


def fold_str(text: str) -> str:
    return text.translate(_table())


def fold(text: Column) -> Column:
    """Folded text; pure ASCII takes the byte-wise path of lower()."""
    upper, lower = fold_pairs()
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def is_wildcard(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def like_pattern(pattern: str) -> str:
    """The LIKE form of a folded wildcard pattern: * is any run, ? one character, the rest literal; ! escapes."""
    out = []
    for c in fold_str(pattern):
        out.append({"*": "%", "?": "_"}.get(c) or ("!" + c if c in "%_!" else c))
    return "".join(out)


def matches(folded: Column, pattern: str) -> Column:
    """Whether folded text matches: wildcards cover the whole text, other patterns stand anywhere in it.

    Literal beginnings and ends are tested as such, because these tests reach a Parquet scan and LIKE with an escape doesn't.
    """
    literal = fold_str(pattern)
    if not is_wildcard(literal):
        return F.contains(folded, F.lit(literal))
    head, middle, tail = re.fullmatch(r"([^*?]*)(.*?)([^*?]*)", literal, re.S).groups()
    tests = [F.startswith(folded, F.lit(head))] * bool(head) + [F.endswith(folded, F.lit(tail))] * bool(tail)
    inner = middle.strip("*")
    if not inner and head and tail:
        tests.append(F.char_length(folded) >= len(head) + len(tail))
    elif inner and not head and not tail and middle[0] == middle[-1] == "*" and not is_wildcard(inner):
        tests.append(F.contains(folded, F.lit(inner)))
    elif inner:
        tests.append(F.like(folded, F.lit(like_pattern(pattern)), F.lit("!")))
    return reduce(lambda a, b: a & b, tests) if tests else folded.isNotNull()


def find(text: Column, pattern: str) -> Column:
    """Byte offset of the first match of a plain pattern, null if there's none."""
    at = F.locate(fold_str(pattern), fold(text)) if pattern else F.lit(1)
    return F.when(at > 0, F.octet_length(F.substr(text, F.lit(1), at - 1)).cast("long"))


def extension(name: Column) -> Column:
    """What follows the last dot; the empty text if there's none."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def plain_path(path: Column) -> Column:
    r"""The path without the verbatim prefix: \\?\UNC\host becomes \\host, \\?\C:\ becomes C:\."""
    path = F.regexp_replace(path, r"(?i)^\\\\\?\\UNC\\", r"\\\\")
    return F.regexp_replace(path, r"^\\\\\?\\", "")


def under_dir(path: Column, directory: str) -> Column:
    """Whether path lies strictly inside directory, ASCII case aside, at a component's border."""
    prefix = directory.rstrip("\\") + "\\"
    lowered = F.translate(plain_path(path), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = "".join(c.lower() if c.isascii() else c for c in prefix)
    return F.startswith(lowered, F.lit(low)) & (F.char_length(lowered) > len(prefix))


def quoted(text: str) -> str:
    """A regular expression for the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def highlight(text: Column, query: str) -> Column:
    """Marks every term of a query in text, ignoring case."""
    terms = [t[8:] if t.lower().startswith("content:") else t for t in query.split()]
    terms = [x for t in terms if (x := t.replace("*", "").replace("?", ""))]
    if not terms:
        return text
    return F.regexp_replace(text, "(?iu)" + "|".join(map(quoted, sorted(terms, key=len, reverse=True))), "<mark>$0</mark>")


def url_encode(text: str) -> str:
    return quote(text, safe="-_.~")
