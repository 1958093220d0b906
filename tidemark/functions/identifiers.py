"""Identifier normalizing (C8) and the strict identifier check."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import UnsafeIdentifierError

# Whitespace as Python's str.isspace() defines it (all such code points lie
# below U+3001); these are trimmed and folded when a raw name is normalized.
WHITESPACE_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# Separators folded to one underscore, besides whitespace, and
# the shape of a safe identifier.
SEPARATOR_CHARS = "-.:/"
SAFE_IDENT_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*"

_SAFE_RE = re.compile(SAFE_IDENT_PATTERN)


def _java_class(chars: str) -> str:
    return "".join(f"\\x{{{ord(ch):x}}}" if ord(ch) > 0x7F or not ch.isprintable() or ch == " "
                   else re.escape(ch) for ch in chars)


# whatever stands between the pieces of a name: separators and underscores
_BETWEEN = "[" + _java_class(WHITESPACE_CHARS) + _java_class(SEPARATOR_CHARS) + "_]+"
_PIECE_RE = re.compile("[^" + re.escape(WHITESPACE_CHARS + SEPARATOR_CHARS) + "_]+")


def normalize_ident(name: str) -> str:
    """The pieces of a raw name in lower case, joined by single underscores
    (``Trip.Distance`` -> ``trip_distance``); a name without any is an error."""
    pieces = _PIECE_RE.findall(str(name))
    if not pieces:
        raise UnsafeIdentifierError(f"identifier normalizes to empty: {name!r}")
    return "_".join(pieces).lower()


def normalize_ident_col(c: Column | str) -> Column:
    """Column form of :func:`normalize_ident`; an empty result is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    joined = F.btrim(F.regexp_replace(c, _BETWEEN, "_"), F.lit("_"))
    return F.nullif(F.lower(joined), F.lit(""))


def is_safe_ident(name: str) -> bool:
    return isinstance(name, str) and _SAFE_RE.fullmatch(name) is not None


def sanitize_ident(name: str) -> str:
    """Return ``name`` unchanged when it is a safe identifier, else raise."""
    if not is_safe_ident(name):
        raise UnsafeIdentifierError(f"unsafe identifier: {name!r}")
    return name


def is_safe_ident_col(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike("^" + SAFE_IDENT_PATTERN + r"\z")


def quote_ident(name: str) -> str:
    """Back-tick quote any column name for Spark SQL / ``F.col``."""
    return "`" + name.replace("`", "``") + "`"
