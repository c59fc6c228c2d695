"""Path patterns in the manner of .gitignore, as regular expressions that Java and Python read alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """`*` and `?` stay within a segment, `**` spans segments, [..], [!..] and [^..] are classes. A slash in front or inside anchors the pattern at the folder; one at the end takes what is below, and nothing else does. A backslash is a slash, and a bracket without an end is itself."""
    body = glob.replace("\\", "/")
    below = body.endswith("/")
    body = body[:-1] if below else body
    anywhere = "/" not in body
    body = body.removeprefix("/")
    return ("^(?:.*/)?" if anywhere else "^") + _PART.sub(_part, body) + ("/.*$" if below else "$")


#: What a pattern consists of: a class may begin with its own closing bracket.
_PART = re.compile(r"(?P<folders>\*\*/)|(?P<all>\*\*)|(?P<some>\*)|(?P<one>\?)|\[(?P<none>[!^]?)(?P<members>\]?[^\]]*)\]|(?P<plain>.)", re.DOTALL)
_FIXED = {"folders": "(?:[^/]*/)*", "all": ".*", "some": "[^/]*", "one": "[^/]"}


def _part(m: re.Match) -> str:
    if m.lastgroup in _FIXED:
        return _FIXED[m.lastgroup]
    if m.lastgroup == "plain":
        return re.escape(m["plain"])
    return f"[{'^' if m['none'] else ''}{_members(m['members'])}]"


def _members(text: str) -> str:
    return re.sub(r"([\\\[\]^&])", r"\\\1", text)


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion wins; no include patterns take all."""
    inside = F.lit(not include)
    for g in include:
        inside = inside | path.rlike(glob_to_regex(g))
    for g in exclude:
        inside = inside & ~path.rlike(glob_to_regex(g))
    return inside


def selected_by(path: Column, include: Column, exclude: Column) -> Column:
    """As `selected`, with columns of regular expressions, each an array."""
    return ((F.size(include) == 0) | F.exists(include, lambda r: F.rlike(path, r))) & ~F.exists(exclude, lambda r: F.rlike(path, r))
