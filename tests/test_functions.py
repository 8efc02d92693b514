"""Scalar helpers: exact rounding, date shapes, name matching."""

from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyscope.config import AuditConfig
from tallyscope.functions.scalar import format_shape, pct


def _half_up(k, n, d):
    q = Fraction(100 * k, n) * 10 ** d
    return float((q * 2 + 1) // 2) / 10 ** d


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10 ** 12), st.integers(1, 10 ** 12)), min_size=1, max_size=40),
       st.integers(0, 3))
def test_pct_is_exact_half_up(spark, pairs, d):
    pairs = [(min(k, n), n) for k, n in pairs]
    df = spark.createDataFrame(pairs, "k bigint, n bigint")
    got = [r[0] for r in df.select(pct(F.col("k"), F.col("n"), d)).collect()]
    assert got == [_half_up(k, n, d) for k, n in pairs]


def test_format_shapes_are_supersets_of_valid_text():
    import re

    cases = {"d/M/yyyy": ["1/2/2024", "31/12/2024"], "yyyyMMdd": ["20240103"], "MMM d, yyyy": ["Jan 3, 2024"],
             "yyyy-M-d'T'H:m:s": ["2024-01-03T10:11:12"], "d/M/yy": ["12/05/69"]}
    for fmt, vals in cases.items():
        for v in vals:
            assert re.match(format_shape(fmt), v), (fmt, v)
    assert not re.match(format_shape("yyyy/M/d"), "01/05/2024")


def test_name_matching_modes():
    sub, tok, strict = AuditConfig(), AuditConfig(name_match="token"), AuditConfig(strict_parity=True)
    assert sub.name_has("percentage", "age") and not tok.name_has("percentage", "age")
    assert tok.name_has("customer_age", "age")
    assert not sub.name_has("discount_rate", "count") and strict.name_has("discount_rate", "count")
    assert sub.name_has("unit_count", "count")


def test_plain_string_coercion_equals_the_fixed_patterns():
    """translate()/startswith() replace two regexes; they must delete and rewrite
    exactly what the fixed patterns do."""
    import re

    from tallyscope.config import ACCOUNTING_NEGATIVE_PATTERN, NUMERIC_STRIP_PATTERN
    from tallyscope.functions.scalar import _STRIP_CHARS

    cls = {c for c in map(chr, range(0x110000)) if re.fullmatch(NUMERIC_STRIP_PATTERN, c)}
    assert cls == set(_STRIP_CHARS)
    for v in ["(5)", "()", "(1,2)", "((3))", "(4", "5)"]:
        want = re.sub(ACCOUNTING_NEGATIVE_PATTERN, r"-\1", v)
        got = "-" + v[1:-1] if len(v) >= 2 and v[0] == "(" and v[-1] == ")" else v
        assert got == want
