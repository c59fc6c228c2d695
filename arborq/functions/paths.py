"""Paths and URIs as columns. A folder's path has no slash at its end; the topmost folder is the empty string."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Of an escaped path, characters that stay as they are.
SAFE = "/-._~!$&'()*+,;=:@"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def depth(path: Column) -> Column:
    return F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def folders(path: Column, own: bool = False) -> Column:
    """All folders above a path, topmost first; with own, the path itself as the last."""
    parts = F.split(path, "/")
    counts = F.sequence(F.lit(1), F.size(parts))
    return F.transform(counts if own else F.slice(counts, 1, F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def uri_scheme(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def is_julia(uri: Column, language_id: Column) -> Column:
    """Files by their ending, case aside; other schemes by the language an editor gives."""
    return F.when(uri_scheme(uri) == "file", extension(uri) == ".jl").otherwise(F.coalesce(language_id == "julia", F.lit(False)))


def language_of(path: Column) -> Column:
    """Language by name: TOML files by their ending, manifests and projects among them."""
    ext = extension(path)
    return F.when(ext == ".jl", "julia").when(ext == ".md", "markdown").when(ext == ".jmd", "juliamarkdown").when(ext == ".toml", "toml")


def _normalised(path: str | None) -> str | None:
    if path is None:
        return None
    scheme, path = re.match(r"([A-Za-z][A-Za-z0-9+.-]*://)?(.*)", path, re.DOTALL).groups()
    out = posixpath.normpath(path) if path else ""
    return (scheme or "") + (out[1:] if out.startswith("//") else out)


def path_to_uri(path: str) -> str:
    """A drive letter is lower-cased and gets a slash before it."""
    path = path.replace("\\", "/")
    if m := re.match("([A-Za-z]):/", path):
        path = f"/{m[1].lower()}:{path[2:]}"
    return "file://" + quote(path, safe=SAFE)


def uri_to_path(uri: str) -> str | None:
    m = re.match(r"file://([^/]*)(/.*)?$", uri, re.DOTALL)
    if not m:
        return None
    path = unquote(m[2] or "")
    if re.match("/[A-Za-z]:", path):
        path = path[1:]
    return f"//{m[1]}{path}" if m[1] else path


normalised = F.udf(_normalised, StringType(), useArrow=True)
to_uri = F.udf(lambda p: None if p is None else path_to_uri(p), StringType(), useArrow=True)
from_uri = F.udf(lambda u: None if u is None else uri_to_path(u), StringType(), useArrow=True)

#: Names of the tools' configurations, and patterns of names by kind, all of lower-cased names.
LINT_CONFIG, FORMAT_CONFIG, TESTITEMS_CONFIG = "JuliaLint.toml", "JuliaFormat.toml", "JuliaTestItems.toml"
KINDS = {
    "julia": r"\.jl$",
    "markdown": r"\.md$",
    "juliamarkdown": r"\.jmd$",
    "project": r"^(julia)?project\.toml$",
    "manifest": r"^(julia)?manifest(-v\d+(\.\d+)*)?\.toml$",
    "lint_config": r"^julialint\.toml$",
    "format_config": r"^juliaformat\.toml$",
    "testitems_config": r"^juliatestitems\.toml$",
}
LANGUAGES = {k: k if k in ("julia", "markdown", "juliamarkdown") else "toml" for k in KINDS}
_KINDS = [(k, re.compile(v, re.ASCII)) for k, v in KINDS.items()]


def kind_of(path: str) -> str | None:
    """The kind of a file by its name, case aside; null for files that no tool reads."""
    name = posixpath.basename(path).lower()
    return next((k for k, r in _KINDS if r.search(name)), None)


def kind(path: Column) -> Column:
    """`kind_of` as a column."""
    name, out = F.lower(basename(path)), F.lit(None).cast("string")
    for k, r in reversed(KINDS.items()):
        out = F.when(name.rlike(r), k).otherwise(out)
    return out


def language(kind: Column) -> Column:
    return F.when(kind.isin("julia", "markdown", "juliamarkdown"), kind).when(kind.isNotNull(), "toml")
