"""Scalar column functions.

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen.  Regexes carry ``(?U)`` (Unicode ``\\d``/``\\s``, as in Python) and
``(?d)`` (only ``\\n`` ends a line, so ``$`` behaves as in Python).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

PY_FLAGS = "(?dU)"

# Python ``str.splitlines`` boundaries.
LINE_BREAK_RE = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once.

    A lambda of a higher-order function evaluates every mention of an expression
    anew, for each element; its variable is a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Characters Python's ``str.isspace()`` accepts (what ``str.strip()`` removes).
PY_WHITESPACE = ("\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(x) -> Column:
    """Python ``str.strip()``: a character-set trim (no regex) of Unicode whitespace."""
    return F.btrim(_c(x), F.lit(PY_WHITESPACE))


def py_lines(x) -> Column:
    """Python ``str.splitlines()`` as an array: one final line break is dropped
    before splitting, so each regex runs once.

    Text without rarer breaks than ``\\n`` (one scan for a few ranges tells) is split at
    that character alone, without a regex.
    """
    c = _c(x)
    body = F.regexp_replace(c, "(?:" + LINE_BREAK_RE + r")\z", "")
    plain = F.when(F.endswith(c, F.lit("\n")), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    return (F.when(c.isNull() | (c == ""), F.array().cast("array<string>"))
            .when(c.rlike("[\u000b-\u001e\u0085\u2028\u2029]"), F.split(body, LINE_BREAK_RE, -1))
            .otherwise(F.split(plain, "\n", -1)))


def drop_undecodable(x) -> Column:
    """Text without the bytes that are no UTF-8, as ``errors="ignore"`` decodes it.

    Invalid bytes become U+FFFD and are removed; the text's own U+FFFD are escaped
    meanwhile.  Valid text, nearly all, is only tested.  Runs in the JVM on bytes, so
    no Arrow batch ever holds an invalid string.
    """
    c = _c(x)
    mark, esc = "\ufffd", "\u0010"
    held = F.replace(F.replace(c, F.lit(esc), F.lit(esc + "a")), F.lit(mark), F.lit(esc + "b"))
    clean = F.replace(F.make_valid_utf8(held), F.lit(mark), F.lit(""))
    clean = F.replace(F.replace(clean, F.lit(esc + "b"), F.lit(mark)), F.lit(esc + "a"), F.lit(esc))
    return F.when(F.is_valid_utf8(c), c).otherwise(clean)


def percent_decoded(x) -> Column:
    """A URI path or an escaped partition value with its ``%XX`` decoded; ``+`` stays."""
    return F.url_decode(F.replace(_c(x), F.lit("+"), F.lit("%2B")))


# F1 ------------------------------------------------------------------------
def is_missing(x, na_token: str = "") -> Column:
    """Null, a missing token, or the NA token (trimmed, case-insensitive).

    Only text no longer than the longest token can match, so the lower-casing
    runs on short values only.
    """
    s = py_strip(_c(x))
    tokens = list(K.MISSING_TOKENS) + ([na_token.lower()] if na_token else [])
    short = F.length(s) <= max(len(t) for t in tokens)
    return _c(x).isNull() | (short & F.lower(s).isin(*tokens))


# F2 ------------------------------------------------------------------------
def normalize_cell(x) -> Column:
    return F.coalesce(py_strip(_c(x)), F.lit(""))


# F3 ------------------------------------------------------------------------
def snake_case(x) -> Column:
    """Non-alphanumerics to ``_``, lower, strip ``_``; empty -> ``field``."""
    s = F.lower(F.regexp_replace(py_strip(_c(x)), "[^A-Za-z0-9]+", "_"))
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(_c(x).isNull() | (s == ""), F.lit("field")).otherwise(s)


# F4 ------------------------------------------------------------------------
def snake_case_plain(x) -> Column:
    """Lower first, squash separators, strip ``_``; may be empty."""
    s = F.regexp_replace(F.lower(_c(x)), "[^0-9a-zA-Z]+", "_")
    s = F.regexp_replace(s, "_+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


# F5 ------------------------------------------------------------------------
def is_int_text(x) -> Column:
    return _c(x).rlike(PY_FLAGS + K.INT_PATTERN)


def is_float_text(x) -> Column:
    return _c(x).rlike(PY_FLAGS + K.FLOAT_PATTERN)


def is_date_text(x) -> Column:
    return _c(x).rlike(PY_FLAGS + K.DATE_PATTERN)


def is_bool_text(x) -> Column:
    return F.lower(_c(x)).isin(*(K.BOOL_TRUE + K.BOOL_FALSE))


def is_number_text(x) -> Column:
    """FLOAT or INT, and the number pattern matches the whole text
    (written as INT or (FLOAT and full match), the same predicate)."""
    full = _c(x).rlike("(?U)^(?:" + K.NUMBER_FULL_PATTERN + r")\z")
    return is_int_text(x) | (is_float_text(x) & full)


# F6 ------------------------------------------------------------------------
CELL_TYPE = "struct<kind:string,s:string,i:bigint>"


#: Every decimal digit beyond ASCII with its value, by rule: the characters of category Nd.
_DIGITS = {chr(c): str(unicodedata.digit(chr(c))) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"}


def convert_cell(x) -> Column:
    """Trimmed text -> null / integer / text, as a (kind, s, i) struct.

    Integers are a sign and any decimal digits (``1_000`` stays text).  ``i`` holds
    those of 64 bits; a larger one has its digits in ``s`` and a null ``i``.
    """
    null_cell = F.lit(None).cast(CELL_TYPE)

    def int_cell(plain: Column) -> Column:
        as_int = plain.try_cast("bigint")
        return F.struct(F.lit("int").alias("kind"), F.when(as_int.isNull(), plain).alias("s"), as_int.alias("i"))

    def cell(s: Column) -> Column:
        digits = F.when(s.rlike(r"[^\x00-\x7F]"), F.translate(s, "".join(_DIGITS), "".join(_DIGITS.values()))).otherwise(s)
        plain = F.regexp_replace(F.regexp_replace(digits, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
        str_cell = F.struct(F.lit("str").alias("kind"), s.alias("s"),
                            F.lit(None).cast("bigint").alias("i"))
        # most integers are plain: one regex and a cast that cannot fail (a failing one costs far more than a regex)
        return (F.when(s.rlike(r"\A(?:0|-?[1-9][0-9]{0,17})\z"),
                       F.struct(F.lit("int").alias("kind"), F.lit(None).cast("string").alias("s"),
                                s.cast("bigint").alias("i")))
                .when(s.isNull() | (s == "") | F.lower(s).isin(*K.NULL_CELL_TOKENS), null_cell)
                .when(s.rlike(r"^[+-]?\p{Nd}+$"), let(plain, int_cell))
                .otherwise(str_cell))
    return let(py_strip(_c(x)), cell)


def cell_text(cell) -> Column:
    """Render a cell struct back to text: null -> ``None``."""
    cell = _c(cell)
    return (F.when(cell.isNull(), F.lit("None"))
            .when(cell["kind"] == "int", F.coalesce(cell["i"].cast("string"), cell["s"]))
            .otherwise(cell["s"]))


# F7 ------------------------------------------------------------------------
def category_display_name(x) -> Column:
    """``player_stats`` -> ``Player Stats``; ``team``/``player`` fixed."""
    base = py_strip(F.regexp_replace(_c(x), "_", " "))
    nice = F.initcap(F.lower(F.regexp_replace(base, r"(?U)\s+", " ")))
    low = F.lower(_c(x))
    out = F.when(base == "", _c(x)).otherwise(nice)
    for k, v in K.FIXED_CATEGORY_NAMES.items():
        out = F.when(low == k, F.lit(v)).otherwise(out)
    return out


# F8 ------------------------------------------------------------------------
def safe_table_name(x) -> Column:
    return F.replace(F.lower(_c(x)), F.lit(" "), F.lit("_"))


# F9 ------------------------------------------------------------------------
def schema_id(example_id, structure, names) -> Column:
    base = F.concat_ws("|", F.coalesce(_c(example_id), F.lit("")), _c(structure),
                       F.array_join(_c(names), "|"))
    return F.concat(F.lit(K.SCHEMA_ID_PREFIX), F.substring(F.sha1(base), 1, K.SCHEMA_ID_HEX_LEN))


# F10 -----------------------------------------------------------------------
def unique_names(names) -> Column:
    """Suffix repeats ``_2, _3, ...`` counting earlier equal *inputs*."""
    arr = _c(names)

    def pick(x, i):
        earlier = F.size(F.filter(F.slice(arr, 1, i), lambda y: y == x))
        return F.when(earlier == 0, x).otherwise(F.concat(x, F.lit("_"), (earlier + 1).cast("string")))

    return F.transform(arr, pick)


# F11 -----------------------------------------------------------------------
def number_lines(arr) -> Column:
    return F.array_join(
        F.transform(_c(arr), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


# F13 -----------------------------------------------------------------------
def char_len(x) -> Column:
    return F.length(_c(x)).cast("bigint")


# F14 -----------------------------------------------------------------------
def json_string(x) -> Column:
    """A JSON string literal for ``x`` (non-ASCII kept, as ``ensure_ascii=False``).

    Text without quotes, backslashes or control characters needs no escaping
    and is quoted directly; the rest goes through Spark's JSON writer.
    """
    v = _c(x).cast("string")
    arr = F.to_json(F.array(v))
    plain = v.rlike(r'^[^"\\\u0000-\u001f]*\z')
    return (F.when(v.isNull(), F.lit("null"))
            .when(plain, F.concat(F.lit('"'), v, F.lit('"')))
            .otherwise(arr.substr(F.lit(2), F.length(arr) - 2)))


def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """``{"k": v, ...}`` with Python's default ``", "``/``": "`` separators.

    ``pairs`` holds (key, already-rendered JSON value) in output order.
    """
    parts = []
    for i, (k, v) in enumerate(pairs):
        parts.append(F.lit(("" if i == 0 else ", ") + '"' + k + '": '))
        parts.append(v)
    return F.concat(F.lit("{"), *parts, F.lit("}")) if parts else F.lit("{}")


def json_object_from_arrays(keys, values) -> Column:
    """``{"k1": "v1", ...}`` from parallel string arrays, order kept."""
    body = F.array_join(F.transform(F.arrays_zip(_c(keys).alias("k"), _c(values).alias("v")),
                                    lambda kv: F.concat(json_string(kv["k"]), F.lit(": "),
                                                        json_string(kv["v"]))), ", ")
    return F.concat(F.lit("{"), body, F.lit("}"))


def json_string_array(arr) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_c(arr), json_string), ", "), F.lit("]"))


# F15 -----------------------------------------------------------------------
def structure_schema_stage(names) -> Column:
    """Two columns, key-like then value-like -> ``kv_single``."""
    n = F.transform(_c(names), snake_case)
    return F.when((F.size(n) == 2) & F.get(n, 0).isin(*K.KV_KEY_NAMES) & F.get(n, 1).isin(*K.KV_VALUE_NAMES),
                  F.lit("kv_single")).otherwise(F.lit("flat_single_row"))


# F16 -----------------------------------------------------------------------
def structure_table_stage(names) -> Column:
    n = _c(names)
    return F.when((F.size(n) == 2) & (F.lower(F.get(n, 0)) == "slot") & (F.lower(F.get(n, 1)) == "value"),
                  F.lit("kv_multi")).otherwise(F.lit("flat_single_row"))


# F17 -----------------------------------------------------------------------
def guess_header_type(name) -> Column:
    pat = "|".join(K.STRING_HEADER_HINTS)
    return F.when(F.lower(_c(name)).rlike(pat), F.lit("string")).otherwise(F.lit("integer"))
