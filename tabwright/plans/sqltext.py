"""DuckDB SQL fragments mirroring the Spark column functions (oracle side only)."""

from __future__ import annotations

from ..functions import constants as K

LINE_SPLIT_RE = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+|[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+$', '', 'g')"


def snake(x: str) -> str:
    s = f"regexp_replace(lower(regexp_replace({strip(x)}, '[^A-Za-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g')"
    return f"(CASE WHEN {x} IS NULL OR {s} = '' THEN 'field' ELSE {s} END)"


def snake_plain(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({x}), '[^0-9a-zA-Z]+', '_', 'g'), '_+', '_', 'g')"
    return f"regexp_replace({s}, '^_+|_+$', '', 'g')"


def lines(x: str) -> str:
    """Python ``splitlines`` of ``x`` as a list."""
    parts = f"regexp_split_to_array({x}, '{LINE_SPLIT_RE}')"
    return (f"(CASE WHEN {x} IS NULL THEN []::VARCHAR[] WHEN {parts}[-1] = '' "
            f"THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)")


def missing(x: str) -> str:
    toks = ", ".join(lit(t) for t in K.MISSING_TOKENS)
    return f"({x} IS NULL OR lower({strip(x)}) IN ({toks}))"


def json_str(x: str) -> str:
    return f"CAST(to_json(CAST({x} AS VARCHAR)) AS VARCHAR)"
