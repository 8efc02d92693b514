"""Fit/apply cleaning plan.

Steps run in suggestion order, as the audited tool applies them, but Spark sees
only a few jobs:

* the plan keeps, per output column, a Column *expression* over the current
  base frame; conversions, drops, fills and casts only rewrite expressions;
* values a step needs (date order, medians, modes, bad counts) are fitted in
  batches: consecutive fitting steps on distinct columns share one aggregate
  (and one exact-quantile pass, one frequency-table shuffle);
* ``drop_duplicates`` is the only barrier: the projected frame is deduplicated
  (one hash aggregate, combined map-side) and materialised once - reliable
  checkpoint into the shared folder when one is configured - because the later
  fits scan it several times.

The fitted plan is a list of literal-only operations, so ``transform`` is a
pure projection (plus the dedup) and re-runs anywhere, including on new data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    DAY_FIRST_FORMATS,
    DEFAULT,
    FALLBACK_FORMATS,
    MONTH_FIRST_FORMATS,
    UNAMBIGUOUS_FORMATS,
    AuditConfig,
)
from ..functions.scalar import canonicalize, coerce_number, date_slot, parse_dates, strip_ws, text_to_number
from ..operators import freq as freqmod
from ..operators.duplicates import drop_duplicates
from ..operators.kinds import q
from ..operators.quantiles import exact_quantiles
from ..session import materialize
from .rules import Suggestion

LOG_SCHEMA = ("step int, type string, col string, dim string, n_affected bigint, fitted_num double, "
              "fitted_text string, note string")

_PROJECTIONS = {"to_datetime", "to_numeric", "to_category", "drop_col", "to_integer", "range_flag"}
_FITS = {"fill_median", "fill_mode", "fix_range"}
#: Types that a number can be made of.
_NUMERIC_VIEW = (T.NumericType, T.StringType, T.BooleanType)


@dataclass
class Op:
    """One operation of a fitted plan, by name and literals only, so that it can be written to a file."""
    kind: str                     # a name of _OPERATIONS (column := expression), "drop" or "dedup"
    col: str | None = None
    args: dict = field(default_factory=dict)

    def apply(self, e: Column) -> Column:
        """The operation on its column's expression."""
        args = {k: T.DataType.fromDDL(v) if k == "dt" else v for k, v in self.args.items()}
        return _OPERATIONS[self.kind](e, **args)


@dataclass
class LogRow:
    step: int
    type: str
    col: str
    dim: str
    n_affected: int | None = None
    fitted_num: float | None = None
    fitted_text: str | None = None
    note: str = ""
    counter: str | None = None    # label of a pending count that fills n_affected


@dataclass
class FittedPlan:
    ops: list
    log: list
    canonical: bool = True
    formats: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        base = canonicalize(df) if self.canonical else df
        env = {c: F.col(q(c)) for c in base.columns}
        for op in self.ops:
            if op.kind == "drop":
                env.pop(op.col, None)
            elif op.kind == "dedup":
                base = drop_duplicates(base.select(*[e.alias(c) for c, e in env.items()]))
                env = {c: F.col(q(c)) for c in base.columns}
            else:
                env[op.col] = op.apply(env[op.col])
        return base.select(*[e.alias(c) for c, e in env.items()])

    def log_df(self, spark) -> DataFrame:
        rows = [(r.step, r.type, r.col, r.dim, r.n_affected, r.fitted_num, r.fitted_text, r.note) for r in self.log]
        return spark.createDataFrame(rows, LOG_SCHEMA)

    def log_lines(self) -> list[str]:
        out = []
        for r in self.log:
            fitted = (f" -> {r.fitted_text}" if r.fitted_text is not None
                      else f" -> {r.fitted_num:.4g}" if r.fitted_num is not None else "")
            n = "" if r.n_affected is None else f" ({r.n_affected} affected)"
            out.append(f"#{r.step:02d} {r.type} '{r.col}'{fitted}{n}. {r.note} [{r.dim}]".replace("  ", " "))
        return out

    def to_json(self) -> str:
        return json.dumps({"canonical": self.canonical, "ops": [o.__dict__ for o in self.ops], "log": [r.__dict__ for r in self.log],
                           "formats": self.formats, "categories": self.categories})

    @classmethod
    def from_json(cls, text: str) -> FittedPlan:
        """The plan that ``to_json`` has written; it transforms alike."""
        d = json.loads(text)
        return cls(ops=[Op(**o) for o in d["ops"]], log=[LogRow(**r) for r in d["log"]], canonical=d["canonical"],
                   formats=d["formats"], categories=d["categories"])


def _date_formats(convention: str | None) -> list[str]:
    primary = list(DAY_FIRST_FORMATS) if convention == "dmy" else list(MONTH_FIRST_FORMATS) if convention == "mdy" else []
    return primary + list(UNAMBIGUOUS_FORMATS)


def _filled(e: Column, dt: T.DataType, value: float) -> Column:
    """Nulls replaced by a median: whole columns stay whole only if the median is."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and float(value) % 1:
        return F.coalesce(e.cast("double"), F.lit(float(value)))
    return F.coalesce(e, F.lit(value).cast(dt))


def _materialize(df: DataFrame) -> DataFrame:
    return materialize(df, "cleaning-fit")


def _as_double(e: Column, dt: T.DataType) -> Column:
    """Numeric view of a column for fills and range fixes: text is coerced
    (unparseable -> NULL, as the audited tool's coercion does) instead of a
    cast that would fail under ANSI mode."""
    if isinstance(dt, T.StringType):
        return coerce_number(strip_ws(e))
    return e.cast("double")


def _bad(x: Column, lo: float | None, hi: float | None, sentinels: list) -> Column:
    """Numbers out of bounds or on the list of codes for missing."""
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (x < F.lit(float(lo)))
    if hi is not None:
        bad = bad | (x > F.lit(float(hi)))
    if sentinels:
        bad = bad | x.isin([float(v) for v in sentinels])
    return F.coalesce(bad, F.lit(False))


def _in_range(e: Column, dt: T.DataType, lo: float | None, hi: float | None, sentinels: list, to_int: bool, value: float | None) -> Column:
    """Bad numbers replaced by a fitted value, or left null without one."""
    x = _as_double(e, dt)
    kept = F.when(~_bad(x, lo, hi, sentinels), x)
    if value is None:
        return kept
    filled = F.coalesce(kept, F.lit(value))
    return F.bround(filled, 0).cast("bigint") if to_int else filled


#: What a fitted operation does to its column.
_OPERATIONS = {
    "to_datetime": lambda e, formats, pivot: parse_dates(e, [*formats, *FALLBACK_FORMATS], pivot),
    "to_numeric": lambda e: text_to_number(e),
    "to_integer": lambda e, dt: F.bround(_as_double(e, dt), 0).cast("bigint"),
    "fill_median": lambda e, dt, value: _filled(e, dt, value),
    "fill_mode": lambda e, dt, value: F.coalesce(e, F.lit(value).cast(dt)),
    "fix_range": _in_range,
}


def _flag(cond: Column) -> Column:
    """A per-row 0/1 term; the log's counts are sums of these."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


class CleaningPlan:
    """``CleaningPlan(suggestions).fit(df)`` -> :class:`FittedPlan`."""

    def __init__(self, suggestions: list[Suggestion], cfg: AuditConfig = DEFAULT, canonical: bool = True,
                 materialize: bool = True):
        self.suggestions = list(suggestions)
        self.cfg = cfg
        self.canonical = canonical
        self.materialize = materialize

    # -- helpers --------------------------------------------------------------
    def fit(self, df: DataFrame) -> FittedPlan:
        cfg = self.cfg
        base = canonicalize(df) if self.canonical else df
        env: dict[str, Column] = {c: F.col(q(c)) for c in base.columns}
        ops: list[Op] = []
        log: list[LogRow] = []
        # label -> (fn, exprs): the per-row 0/1 term fn(*exprs) over `base`, summed later.
        # Keeping the operands apart lets a barrier evaluate each costly operand
        # (a parsed date, say) once and build the term from column references.
        pending: dict[str, tuple] = {}
        counters: dict[str, int] = {}
        formats: dict = {}
        categories: dict = {}
        deferred_cats: list = []              # (step, suggestion, expression over `base`)
        dirty = False                         # costly conversions since the base was last materialised
        steps = list(enumerate(self.suggestions, start=1))

        def flush(extra: dict[str, Column] | None = None) -> dict:
            exprs = {k: F.sum(fn(*ops_)) for k, (fn, ops_) in pending.items()}
            if extra:
                exprs.update(extra)
            pending.clear()
            if not exprs:
                return {}
            row = base.agg(*[e.alias(f"__{i}") for i, e in enumerate(exprs.values())]).first()
            vals = {k: row[f"__{i}"] for i, k in enumerate(exprs)}
            counters.update({k: v for k, v in vals.items()})
            return vals

        def fit_categories(frame: DataFrame, items: list) -> None:
            """One frequency-table job for several category lists. A column with more
            values than rule R3 allows is no category: the step is logged as skipped."""
            if not items:
                return
            few = freqmod.few_values(frame, [c for _, _, c in items], cfg.category_max_distinct)
            top = freqmod.top_k(freqmod.frequency_table(frame, [c for c, n in few.items() if n is not None]),
                                cfg.category_max_distinct + 1, by="value").collect()
            found: dict = {}
            for r in top:
                found.setdefault(r["column"], []).append((r["rank"], r["value"]))
            for n2, s2, c in items:
                cats = [v for _, v in sorted(found.get(c, []))]
                if few[c] is None:
                    log.append(LogRow(n2, "to_category", s2.col, s2.dim, note=f"skipped: more than {cfg.category_max_distinct} values"))
                    continue
                categories[s2.col] = cats
                log.append(LogRow(n2, "to_category", s2.col, s2.dim, n_affected=len(cats),
                                  fitted_text="|".join(cats), note="stored as text; category list recorded"))

        def barrier(dedup: bool) -> None:
            """Materialise the projected frame once (with the log's per-row terms and
            pending category columns), take counts and categories from cheap scans
            of it, then optionally deduplicate and materialise again."""
            nonlocal base, env, dirty
            extra: dict[int, tuple] = {}

            def ref(e: Column) -> Column:
                for c, v in env.items():
                    if v is e:
                        return F.col(q(c))
                if id(e) not in extra:
                    extra[id(e)] = (f"__x{len(extra)}", e)
                return F.col(extra[id(e)][0])

            flags = {k: fn(*[ref(e) for e in ops_]) for k, (fn, ops_) in pending.items()}
            pending.clear()
            flags["__rows"] = F.lit(1)
            cats = [(n2, s2, ref(e)) for n2, s2, e in deferred_cats]
            # stage 1 evaluates every costly expression once; stage 2 only refers to it
            stage1 = base.select(*[e.alias(c) for c, e in env.items()], *[e.alias(nm) for nm, e in extra.values()])
            pre = stage1.select(*[F.col(q(c)) for c in env],
                                *[v.alias(f"__f{j}") for j, v in enumerate(flags.values())],
                                *[r.alias(f"__cat{n2}") for n2, _, r in cats])
            if self.materialize:
                pre = _materialize(pre)
            row = pre.agg(*[F.sum(f"__f{j}").alias(f"__f{j}") for j in range(len(flags))]).first()
            counters.update({k: int(row[f"__f{j}"] or 0) for j, k in enumerate(flags)})
            fit_categories(pre, [(n2, s2, f"__cat{n2}") for n2, s2, _ in cats])
            deferred_cats.clear()
            base = pre.select(*[F.col(q(c)) for c in env])
            if dedup:
                base = drop_duplicates(base)
                if self.materialize:
                    base = _materialize(base)
            env = {c: F.col(q(c)) for c in base.columns}
            dirty = False

        def fits(n: int, s: Suggestion) -> bool:
            """Whether a step can run on its column; if not, the log says why and the others go on."""
            if s.col not in env:
                return False  # a step on a column that is gone is no step, as in the audited tool
            dt = self._dtype(base, env, s.col)
            need = {"fill_median": _NUMERIC_VIEW, "fix_range": _NUMERIC_VIEW, "to_integer": _NUMERIC_VIEW}.get(s.type)
            plain = not isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))
            if s.type != "drop_col" and (not plain or need and not isinstance(dt, need)):
                log.append(LogRow(n, s.type, s.col, s.dim, note=f"skipped: not possible on {dt.simpleString()}"))
                return False
            return True

        i = 0
        while i < len(steps):
            n, s = steps[i]
            t, col = s.type, s.col
            if t == "to_datetime":
                # batch consecutive date conversions: one aggregate decides every column's order
                batch = []
                while i < len(steps) and steps[i][1].type == "to_datetime":
                    batch.append(steps[i])
                    i += 1
                live = [(n2, s2) for n2, s2 in batch if fits(n2, s2)]
                slot_aggs = {}
                for n2, s2 in live:
                    v = env[s2.col].cast("string")
                    a, b = date_slot(v, 1), date_slot(v, 2)
                    both = a.isNotNull() & b.isNotNull()
                    slot_aggs[f"f{n2}"] = F.coalesce(F.max(F.when(both, a)) > 12, F.lit(False))
                    slot_aggs[f"s{n2}"] = F.coalesce(F.max(F.when(both, b)) > 12, F.lit(False))
                got = flush(slot_aggs)
                for n2, s2 in live:
                    fgt, sgt = got[f"f{n2}"], got[f"s{n2}"]
                    conv = None if fgt and sgt else "dmy" if fgt else "mdy" if sgt else None
                    fmts = _date_formats(conv)
                    formats[s2.col] = {"convention": conv, "formats": fmts, "fallback": list(FALLBACK_FORMATS)}
                    raw = env[s2.col]
                    pivot = cfg.two_digit_year_pivot
                    parsed = parse_dates(raw, [*fmts, *FALLBACK_FORMATS], pivot)
                    pending[f"new_nulls{n2}"] = (lambda r, p: _flag(r.isNotNull() & p.isNull()), [raw, parsed])
                    dirty = True
                    note = ("day-first order detected" if conv == "dmy" else "month-first order detected"
                            if conv == "mdy" else "order could not be determined; leftovers parsed day-first")
                    ops.append(Op("to_datetime", s2.col, {"formats": fmts, "pivot": pivot}))
                    env[s2.col] = parsed
                    log.append(LogRow(n2, "to_datetime", s2.col, s2.dim, note=note, fitted_text=conv,
                                      counter=f"new_nulls{n2}"))
                continue
            i += 1
            if t in _PROJECTIONS or t == "drop_duplicates":
                if t not in ("drop_duplicates", "range_flag") and not fits(n, s):
                    continue
                if t == "to_numeric":
                    raw = env[col]
                    val = text_to_number(raw)
                    pending[f"pct{n}"] = (lambda r: _flag(r.cast("string").contains("%")), [raw])
                    dirty = True
                    ops.append(Op("to_numeric", col))
                    env[col] = val
                    log.append(LogRow(n, t, col, s.dim, note="'%' values divided by 100; symbols stripped",
                                      counter=f"pct{n}"))
                elif t == "to_category":
                    # fitted with the next pass over the data (the list is the column's
                    # distinct values at this step)
                    deferred_cats.append((n, s, env[col]))
                elif t == "drop_col":
                    pending[f"lost{n}"] = (lambda v: _flag(v.isNotNull()), [env[col]])
                    env.pop(col)
                    ops.append(Op("drop", col))
                    note = "constant column" if s.dim == "Tidiness" else "mostly null column"
                    log.append(LogRow(n, t, col, s.dim, note=note, counter=f"lost{n}"))
                elif t == "to_integer":
                    dt = self._dtype(base, env, col)
                    v = _as_double(env[col], dt)
                    pending[f"int{n}"] = (lambda x: _flag(x.isNotNull()), [v])
                    ops.append(Op("to_integer", col, {"dt": dt.simpleString()}))
                    env[col] = F.bround(v, 0).cast("bigint")
                    log.append(LogRow(n, t, col, s.dim, note="rounded to whole numbers, nulls kept",
                                      counter=f"int{n}"))
                elif t == "range_flag":
                    log.append(LogRow(n, t, col, s.dim, n_affected=0, note="flagged for manual review"))
                elif t == "drop_duplicates":
                    barrier(dedup=True)
                    ops.append(Op("dedup"))
                    pending[f"after{n}"] = (lambda: F.lit(1), [])
                    counters[f"before{n}"] = counters.pop("__rows")
                    log.append(LogRow(n, t, col, s.dim, note="exact duplicate rows removed", counter=f"dedup{n}"))
                continue
            if t in _FITS:
                # batch consecutive fits on distinct, present columns
                batch = [(n, s)]
                seen = {col}
                while i < len(steps) and steps[i][1].type in _FITS and steps[i][1].col not in seen:
                    seen.add(steps[i][1].col)
                    batch.append(steps[i])
                    i += 1
                batch = [(n2, s2) for n2, s2 in batch if fits(n2, s2)]
                if not batch:
                    continue
                if (dirty or deferred_cats) and self.materialize:
                    barrier(dedup=False)   # later fit passes then scan the converted columns
                self._fit_batch(batch, base, env, ops, log, pending, counters, flush)
                continue
            log.append(LogRow(n, t, col, s.dim, note=f"skipped: unknown step type '{t}'"))
        if deferred_cats:
            fit_categories(base.select(*[e.alias(f"__cat{n2}") for n2, _, e in deferred_cats]),
                           [(n2, s2, f"__cat{n2}") for n2, s2, _ in deferred_cats])
            deferred_cats.clear()
        flush()
        for r in log:
            if r.counter and r.n_affected is None:
                if r.counter.startswith("dedup"):
                    k = r.counter[5:]
                    r.n_affected = int(counters[f"before{k}"]) - int(counters[f"after{k}"])
                elif r.counter in counters:
                    r.n_affected = int(counters[r.counter])
        log.sort(key=lambda r: r.step)
        self._last_frame = base.select(*[e.alias(c) for c, e in env.items()])
        return FittedPlan(ops=ops, log=log, canonical=self.canonical, formats=formats, categories=categories)

    def fit_transform(self, df: DataFrame) -> tuple[DataFrame, "FittedPlan"]:
        """Fit on ``df`` and return (cleaned df, plan). The cleaned frame continues
        from the deduplicated frame materialised during fitting instead of
        recomputing conversions and the dedup shuffle."""
        plan = self.fit(df)
        return self._last_frame, plan

    def _fit_batch(self, batch, base, env, ops, log, pending, counters, flush):
        """Fit fills / range fixes of distinct columns together: one count aggregate,
        one exact-quantile pass, one frequency-table shuffle for the modes."""
        extra: dict[str, Column] = {}
        med_exprs: dict[str, Column] = {}
        for n, s in batch:
            v = env[s.col]
            if s.type in ("fill_median", "fill_mode"):
                extra[f"nulls{n}"] = F.count_if(v.isNull())
                if s.type == "fill_median":
                    vd = _as_double(v, self._dtype(base, env, s.col))
                    med_exprs[f"m{n}"] = vd
                    extra[f"m{n}"] = F.count(vd)
            else:
                x = _as_double(v, self._dtype(base, env, s.col))
                bad = _bad(x, s.lo, s.hi, s.sentinels)
                extra[f"bad{n}"] = F.count_if(bad)
                med_exprs[f"m{n}"] = F.when(~bad, x)
                extra[f"m{n}"] = F.count(F.when(~bad, x))
        got = flush(extra)
        counts = {k: int(got[k]) for k in med_exprs}
        meds = exact_quantiles(base, med_exprs, [0.5], counts, self.cfg) if med_exprs else {}
        mode_cols = [(n, s) for n, s in batch if s.type == "fill_mode" and got[f"nulls{n}"] > 0]
        modes = {}
        if mode_cols:
            proj = base.select(*[env[s.col].alias(f"c{n}") for n, s in mode_cols])
            for r in freqmod.exact_top_k(proj, [f"c{n}" for n, _ in mode_cols], 1).collect():
                modes[r["column"]] = r["value"]
        for n, s in batch:
            col = s.col
            if s.type == "fill_median":
                nulls = int(got[f"nulls{n}"])
                if nulls == 0:
                    log.append(LogRow(n, s.type, col, s.dim, n_affected=0, note="no nulls left"))
                    continue
                med = meds[f"m{n}"][0]
                if med is None:
                    log.append(LogRow(n, s.type, col, s.dim, n_affected=0, note="no median (all null)"))
                    continue
                dt = self._dtype(base, env, col)
                ops.append(Op("fill_median", col, {"dt": dt.simpleString(), "value": med}))
                env[col] = _filled(env[col], dt, med)
                log.append(LogRow(n, s.type, col, s.dim, n_affected=nulls, fitted_num=med,
                                  note="nulls filled with the median"))
            elif s.type == "fill_mode":
                nulls = int(got[f"nulls{n}"])
                m = modes.get(f"c{n}")
                if nulls == 0 or m is None:
                    log.append(LogRow(n, s.type, col, s.dim, n_affected=0,
                                      note="no nulls left" if nulls == 0 else "no mode (all null)"))
                    continue
                dt = self._dtype(base, env, col)
                ops.append(Op("fill_mode", col, {"dt": dt.simpleString(), "value": str(m)}))
                env[col] = F.coalesce(env[col], F.lit(m).cast(dt))
                log.append(LogRow(n, s.type, col, s.dim, n_affected=nulls, fitted_text=str(m),
                                  note="nulls filled with the mode"))
            else:
                med = meds[f"m{n}"][0]
                n_bad = int(got[f"bad{n}"])
                op = Op("fix_range", col, {"dt": self._dtype(base, env, col).simpleString(), "lo": s.lo, "hi": s.hi,
                                           "sentinels": [float(x) for x in s.sentinels], "to_int": bool(s.to_int), "value": med})
                ops.append(op)
                env[col] = op.apply(env[col])
                if med is None:
                    log.append(LogRow(n, s.type, col, s.dim, n_affected=n_bad,
                                      note="all values out of range: left null, nothing to impute"))
                    continue
                log.append(LogRow(n, s.type, col, s.dim, n_affected=n_bad, fitted_num=med,
                                  note="impossible values replaced by the median of valid ones"
                                  + ("; rounded to whole numbers" if s.to_int else "")))

    @staticmethod
    def _dtype(base: DataFrame, env: dict, col: str) -> T.DataType:
        return base.select(env[col].alias("x")).schema["x"].dataType


def clean(df: DataFrame, suggestions: list[Suggestion], cfg: AuditConfig = DEFAULT) -> tuple[DataFrame, FittedPlan]:
    """Fit on ``df`` and apply: (cleaned DataFrame, fitted plan with its log)."""
    return CleaningPlan(suggestions, cfg).fit_transform(df)


def category_codes(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """C4 re-aimed: ``<col>_code`` = position of the value in the fitted, sorted
    category list (NULL for NULL). The list is a literal (at most 25 entries by
    rule R3), so this is a projection - no join, no shuffle."""
    out = [F.col(q(c)) for c in df.columns]
    for c, cats in categories.items():
        if c not in df.columns:
            continue
        pos = F.array_position(F.array(*[F.lit(v) for v in cats]), F.col(q(c)).cast("string"))
        out.append(F.when(pos > 0, pos - 1).cast("bigint").alias(f"{c}_code"))
    return df.select(*out)


def before_after(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows, columns and total nulls of the raw and the cleaned frame."""
    def one(df, stage):
        nulls = sum((F.count_if(F.col(q(c)).isNull()) for c in df.columns), F.lit(0))
        return df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n_rows"),
                      F.lit(len(df.columns)).cast("bigint").alias("n_cols"), nulls.cast("bigint").alias("n_nulls"))
    return one(canonicalize(raw), "original").unionByName(one(cleaned, "cleaned"))
