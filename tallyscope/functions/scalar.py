"""Column expressions shared by every operator (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    ACCOUNTING_NEGATIVE_PATTERN,
    DATE_SLOTS_PATTERN,
    NUMERIC_STRIP_PATTERN,
    NUMERIC_TEXT_PATTERN,
)

# a number pandas' coercion would accept (after symbols are stripped); Spark's
# cast alone is too lenient ("1d", "1f" -> 1.0)
_CASTABLE_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def canonicalize(df: DataFrame) -> DataFrame:
    """NaN and NULL are one "missing" value in the audit: turn float NaN into NULL."""
    if not any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema.fields):
        return df
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def nan_as_null(operator: Callable) -> Callable:
    """For operators on a DataFrame: NaN in it is missing, whoever calls."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        return operator(canonicalize(df), *args, **kwargs)

    return run


# whitespace as Python's str.strip() / re's \s see it (derived by rule: the
# characters for which str.isspace() holds); Spark's one-argument trim removes
# spaces only and Java's \s is ASCII-only
_WS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing whitespace of every kind."""
    return F.trim(c, F.lit(_WS))


# the characters NUMERIC_STRIP_PATTERN removes, for translate()
_STRIP_CHARS = "₹$€£,%" + _WS


def numeric_text_core(c: Column) -> Column:
    """Text with accounting negatives turned to '-x' and currency/percent/space removed.

    Same result as replacing ACCOUNTING_NEGATIVE_PATTERN by '-$1' and then
    deleting NUMERIC_STRIP_PATTERN, with plain string functions instead of two
    regexes per value."""
    s = strip_ws(c)
    n = F.length(s)
    acct = s.startswith("(") & s.endswith(")") & (n >= 2)
    s = F.when(acct, F.concat(F.lit("-"), F.substring(s, F.lit(2), n - 2))).otherwise(s)
    return F.translate(s, _STRIP_CHARS, "")


def looks_numeric(c: Column) -> Column:
    """The sniffing test of the numeric-text rule."""
    return numeric_text_core(c).rlike(NUMERIC_TEXT_PATTERN)


def coerce_number(text: Column) -> Column:
    """Guarded string -> DOUBLE: NULL unless the text is a plain decimal number."""
    return F.when(text.rlike(_CASTABLE_NUMBER), text.cast("double"))


def text_to_number(c: Column) -> Column:
    """Numeric conversion of the cleaner: strip, flag '%', (x) -> -x, coerce, /100 for '%'."""
    raw = strip_ws(c.cast("string"))
    value = coerce_number(numeric_text_core(raw))
    return F.when(raw.contains("%"), value / F.lit(100.0)).otherwise(value)


def date_slot(c: Column, i: int) -> Column:
    """Numeric value of the i-th leading slot of a d/m or m/d date, NULL if absent."""
    s = F.regexp_extract(strip_ws(c.cast("string")), DATE_SLOTS_PATTERN, i)
    return F.when(s != "", s.cast("int"))


#: English month names; a format's MMM reads the first three letters, MMMM the name.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: What stands for a T between digits in a shape (no other character becomes it).
_T_MARK = "\x01"


def _fields(fmt: str) -> list[str]:
    """A Spark datetime pattern as fields (``yyyy``, ``d``, ``MMM`` ...) and the characters between them."""
    quoted = fmt.replace("'T'", _T_MARK)
    return re.findall(r"yyyyMMdd|y+|M+|d+|H+|m+|s+|.", quoted)


#: What stands for a number in a shape: of four digits, of eight, and of one or two.
_FOUR, _EIGHT, _SHORT = "@", "%", "#"


def shape_of(fmt: str) -> str:
    """The shape (``value_shape``) of the text that a format reads."""
    marks = {"yyyy": _FOUR, "yyyyMMdd": _EIGHT, "MMM": "A", "MMMM": "A"}
    return "".join(marks.get(f) or (_SHORT if f[0] in "yMdHms" else f) for f in _fields(fmt))


def format_shape(fmt: str) -> str:
    """A regular expression for the text that a format reads."""
    to = {"yyyy": r"\d{4}", "yy": r"\d{2}", "yyyyMMdd": r"\d{8}", "MMM": "[A-Za-z]+", "MMMM": "[A-Za-z]+", _T_MARK: "T"}
    return "^" + "".join(to.get(f) or (r"\d{1,2}" if f[0] in "MdHms" else re.escape(f)) for f in _fields(fmt)) + "$"


def value_shape(c: Column) -> Column:
    """Text with each run of letters as A and each number as a mark of its length; a T between digits keeps a mark of its own."""
    out = F.regexp_replace(F.regexp_replace(c, "(?<=[0-9])T(?=[0-9])", _T_MARK), "[A-Za-z]+", "A")
    for digits, mark in (("{1,2}", _SHORT), ("{4}", _FOUR), ("{8}", _EIGHT)):
        out = F.regexp_replace(out, f"(?<![0-9])[0-9]{digits}(?![0-9])", mark)
    return out


def _reading(fmt: str) -> tuple[str, ...]:
    """Which field of a date or time each of the text's numbers and names is."""
    names = {"yyyy": "y", "yy": "y2", "d": "d", "dd": "d", "M": "m", "MM": "m", "MMM": "b", "MMMM": "B", "H": "H", "HH": "H", "m": "min", "mm": "min", "s": "s", "ss": "s", "yyyyMMdd": "ymd"}
    return tuple(names[f] for f in _fields(fmt) if f in names)


def _timestamp(s: Column, reading: tuple[str, ...], pivot: int) -> Column:
    """The naive timestamp that text of a known shape has under a reading, or null."""
    token = F.split(s, "[^0-9A-Za-z]+|(?<=[0-9])T(?=[0-9])")
    part = {f: F.get(token, F.lit(i)) for i, f in enumerate(reading)}
    if "ymd" in part:
        year, month, day = (F.substring(s, *at) for at in ((1, 4), (5, 2), (7, 2)))
    else:
        day = part["d"]
        if "y2" in part:
            short = part["y2"].cast("int")
            year = F.when(F.length(part["y2"]) == 2, F.when(short >= pivot, short + 1900).otherwise(short + 2000)).cast("string")
        else:
            year = part["y"]
        if "m" in part:
            month = part["m"]
        else:
            known = [m[:3] for m in MONTHS] if "b" in part else list(MONTHS)
            month = F.array_position(F.array(*map(F.lit, known)), F.lower(part.get("b", part.get("B")))).cast("string")
    date = F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date").cast("timestamp_ntz")
    if "H" not in part:
        return date
    hour, minute = part["H"].cast("int"), part["min"].cast("int")
    second = part["s"].cast("int") if "s" in part else F.lit(0)
    time = F.make_dt_interval(F.lit(0), hour, minute, second.cast("decimal(18,6)"))
    return F.when((hour < 24) & (minute < 60) & (second < 60), date + time)


def shape_readings(formats) -> dict[str, list[tuple[str, ...]]]:
    """For every shape that some format reads, the different readings in the order of the formats."""
    out: dict[str, list[tuple[str, ...]]] = {}
    for fmt in formats:
        seen = out.setdefault(shape_of(fmt), [])
        if _reading(fmt) not in seen:
            seen.append(_reading(fmt))
    return out


def parse_dates(c: Column, formats, pivot: int = 69) -> Column:
    """First format that parses wins, per value; a naive timestamp whatever the session's time zone.

    A value's shape says which formats can read it at all, and formats that would read it alike are one
    reading: a value is parsed as often as its shape has readings, that is once or (where day and month
    can change places, or a name be short or long) twice, however many formats there are. Two-digit
    years follow strptime (%y). No instant is formed: dates are DATEs, times of day are added by their numbers.
    """
    s = strip_ws(c.cast("string"))
    readings = shape_readings(formats)

    def turn(i: int) -> Column | None:
        """The ``i``-th reading of the value's shape."""
        by_reading: dict[tuple, list[str]] = {}
        for shape, ways in readings.items():
            if len(ways) > i:
                by_reading.setdefault(ways[i], []).append(shape)
        out = None
        for reading, shapes in by_reading.items():
            cond, value = shape_col.isin(sorted(shapes)), _timestamp(text, reading, pivot)
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    # text and shape are built once a value and named by a one-element transform
    def parsed(x: Column) -> Column:
        nonlocal text, shape_col
        text, shape_col = x.getField("s"), x.getField("shape")
        return F.coalesce(*[turn(i) for i in range(max(map(len, readings.values())))])

    text = shape_col = None
    return F.get(F.transform(F.array(F.struct(s.alias("s"), value_shape(s).alias("shape"))), parsed), F.lit(0))


def pct(k: Column, n: Column, decimals: int = 1) -> Column:
    """100*k/n rounded half-up on the exact rational value (integer arithmetic).

    Both engines compute the same integers, so the result is bit-identical
    across Spark and the SQL oracle. NULL when n = 0.
    """
    scale = 10 ** decimals
    num = k.cast("long") * F.lit(200 * scale) + n.cast("long")
    den = n.cast("long") * F.lit(2)
    q = F.when(n.cast("long") > 0, F.floor(num / den))
    return (q.cast("double") / F.lit(float(scale)))


def exact_mean_sql(sum_col: str, cnt_col: str, decimals: int = 6, scale: int = 10) -> str:
    """SQL text: sum/cnt rounded half-up (away from zero) to ``decimals``, exactly.

    ``sum_col`` is a DECIMAL(38, scale) sum (exact), ``cnt_col`` a row count;
    only integer arithmetic follows, so every engine gets the same double. Used
    where averages of few decimal values land exactly on rounding ties.
    """
    t = f"CAST({sum_col} * {10 ** scale} AS DECIMAL(38,0))"
    den = f"(CAST({cnt_col} AS DECIMAL(38,0)) * {10 ** (scale - decimals)})"
    mag = f"((abs({t}) * 2 + {den}) div ({den} * 2))"
    return f"(CAST(sign({t}) * {mag} AS DOUBLE) / {10 ** decimals})"


def rnd(c: Column, decimals: int | None) -> Column:
    return c if decimals is None else F.round(c, decimals)


def sample_order(key_cols, seed: int = 42) -> Column:
    """Deterministic pseudo-random order: md5 of the key text and the seed."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols])
    return F.md5(F.concat(key, F.lit(f":{seed}")))
