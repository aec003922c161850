"""The query language: a conjunction of name terms, path terms, content terms and drives."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: The code points with the property White_Space.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_DRIVE = re.compile(r"[A-Za-z]:")
_CONTENT = "content:"


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    path_terms: list[str] = field(default_factory=list)
    content_terms: list[str] = field(default_factory=list)
    drives: list[str] = field(default_factory=list)

    @property
    def is_empty(self) -> bool:
        """Whether nothing restricts names, paths or drives; content terms don't count."""
        return not (self.terms or self.path_terms or self.drives)


def parse(text: str) -> Query:
    """Tokens at white space; X: is a drive, content:x a content term, a token with a slash a path term, others name terms."""
    out = Query()
    for token in filter(None, _SPACE.split(text)):
        if _DRIVE.fullmatch(token):
            out.drives.append(token[0].lower())
        elif len(token) > len(_CONTENT) and token[: len(_CONTENT)].lower() == _CONTENT:
            out.content_terms.append(token[len(_CONTENT) :])
        elif "\\" in token or "/" in token:
            out.path_terms.append(token)
        else:
            out.terms.append(token)
    return out
