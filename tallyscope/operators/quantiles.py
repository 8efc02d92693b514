"""Exact quantiles (linear interpolation, as pandas/quantile_cont) that scale.

Spark's exact ``percentile`` aggregate keeps a value->count map per column and
merges all maps of an ungrouped aggregate in one task, so it only ever sees a
band of at most ``exact_quantile_max_band`` (16,384) values:

* a column with at most that many non-null values is one band;
* a larger column is narrowed first: a KLL sketch (one a column, mergeable, a few
  ten KB) gives two values that bracket each wanted rank, an exact ``count_if``
  pass checks the bracket and counts what lies below it, and this repeats on the
  band. Each level shrinks a band about 200-fold, so 10^12 rows need four;
* a band that stays large because few values fill it is settled by its table of
  value counts (at most one row a value and task is shuffled): the table is dealt to
  ranges of the value, counts before each range are added up, and the rows that
  reach a wanted rank are picked. No task holds more than its range.

All targets (columns x probabilities) advance together: one aggregate per pass
over the input, never a per-column job, never a collect of column values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..session import written
from .rowindex import BUCKET, at_bucket, before_each, bucketed


@dataclass
class _Target:
    name: str
    prob: float
    n: int
    h: float
    r_lo: int
    r_hi: int
    lo: float | None = None      # band is lo <= v <= hi (None = unbounded)
    hi: float | None = None
    below: int = 0               # values strictly below the band
    m: int = 0                   # values inside the band

    def single(self) -> bool:
        """Whether the band is one value."""
        return self.lo is not None and self.lo == self.hi

    def bracket(self, delta: float) -> list[float]:
        """Parts of the band's ranks that hold the target between them."""
        return [max(0.0, (self.r_lo - self.below) / self.m - delta), min(1.0, (self.r_hi - self.below + 1) / self.m + delta)]

    def band(self, e: Column) -> Column:
        cond = e.isNotNull()
        if self.lo is not None:
            cond = cond & (e >= F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (e <= F.lit(self.hi))
        return cond


def exact_quantiles(
    df: DataFrame,
    exprs: dict[str, Column],
    probs: list[float],
    counts: dict[str, int] | None = None,
    cfg: AuditConfig = DEFAULT,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several column expressions.

    ``exprs`` maps a label to a numeric Column expression over ``df``.
    ``counts`` (non-null counts per label) saves one pass when the caller
    already aggregated them. Returns label -> list aligned with ``probs``
    (None for an empty column).
    """
    if not exprs:
        return {}
    exprs = {k: v.cast("double") for k, v in exprs.items()}
    if counts is None:
        row = df.agg(*[F.count(e).alias(f"n{i}") for i, e in enumerate(exprs.values())]).first()
        counts = {k: int(row[f"n{i}"]) for i, k in enumerate(exprs)}

    out: dict[str, list[float | None]] = {k: [None] * len(probs) for k in exprs}
    max_band = int(cfg.exact_quantile_max_band)

    small = [k for k in exprs if 0 < counts[k] <= max_band]
    if small:
        aggs = [F.percentile(exprs[k], F.lit(list(map(float, probs)))).alias(f"p{i}") for i, k in enumerate(small)]
        row = df.agg(*aggs).first()
        for i, k in enumerate(small):
            vals = row[f"p{i}"]
            out[k] = [None if v is None else float(v) for v in vals]

    big = [k for k in exprs if counts[k] > max_band]
    if big:
        targets = []
        for k in big:
            n = counts[k]
            for j, p in enumerate(probs):
                h = float(p) * (n - 1)
                t = _Target(k, float(p), n, h, int(math.floor(h)), int(math.ceil(h)), m=n)
                targets.append((k, j, t))
        _narrow(df, exprs, [t for _, _, t in targets], cfg)
        _finish(df, exprs, targets, out, cfg)
    return out


#: Size of a KLL sketch, and the part of all ranks by which its answers may be off (ten times its usual error is
#: far less; a bracket that misses is found by counting and taken again, twice as wide).
SKETCH, RANK_ERROR = 4096, 0.002
#: A band that does not shrink to this part of itself is filled by few values.
SHRINKS = 0.5


def _narrow(df: DataFrame, exprs: dict[str, Column], targets: list[_Target], cfg: AuditConfig) -> None:
    """Shrink the bands to ``max_band`` values, or to what repeats of few values leave."""
    max_band, delta, stuck = int(cfg.exact_quantile_max_band), RANK_ERROR, set()
    for _ in range(12):
        # a band holding one distinct value is resolved whatever its row count
        active = [t for t in targets if t.m > max_band and not t.single() and id(t) not in stuck]
        if not active:
            return
        # pass A: values that bracket the wanted ranks, from one sketch for each different band
        bands: dict[tuple, list[_Target]] = {}
        for t in active:
            bands.setdefault((t.name, t.lo, t.hi), []).append(t)
        aggs = []
        for i, group in enumerate(bands.values()):
            ranks = [r for t in group for r in t.bracket(delta)]
            sketch = F.kll_sketch_agg_double(F.when(group[0].band(exprs[group[0].name]), exprs[group[0].name]), F.lit(SKETCH))
            aggs.append(F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, ranks))).alias(f"a{i}"))
        found = df.agg(*aggs).first()
        brackets = {}
        for i, group in enumerate(bands.values()):
            for j, t in enumerate(group):
                brackets[id(t)] = (float(found[i][2 * j]), float(found[i][2 * j + 1]))
        # pass B: exact counts below / up to the new bracket
        aggs = []
        for i, t in enumerate(active):
            e, (lo, hi) = exprs[t.name], brackets[id(t)]
            inside = t.band(e)
            aggs += [F.count_if(inside & (e < F.lit(lo))).alias(f"lt{i}"), F.count_if(inside & (e <= F.lit(hi))).alias(f"le{i}")]
        row = {}
        for i in range(0, len(aggs), 80):  # each aggregate stays inside whole-stage codegen
            row.update(df.agg(*aggs[i:i + 80]).first().asDict())
        for i, t in enumerate(active):
            below, m = t.below + row[f"lt{i}"], row[f"le{i}"] - row[f"lt{i}"]
            if below <= t.r_lo and below + m > t.r_hi:
                if m > SHRINKS * t.m:
                    stuck.add(id(t))
                t.lo, t.hi, t.below, t.m = *brackets[id(t)], below, m
        delta *= 2  # only matters if a bracket missed


def _by_counts(df: DataFrame, exprs: dict[str, Column], targets: list[_Target], rows_per_bucket: int | None = None) -> dict[tuple, float]:
    """The values at each target's two ranks, from range-partitioned value counts of the bands."""
    items = [F.when(t.band(exprs[t.name]), F.struct(F.lit(i).alias("i"), exprs[t.name].alias("v"))) for i, t in enumerate(targets)]
    counts = (df.select(F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
              .groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
    with written(counts, "value-counts") as table:
        tagged, sizes = bucketed(table, ["i", "v"], rows_per_bucket=rows_per_bucket)
        sums = {r[BUCKET]: r["n"] for r in tagged.groupBy(BUCKET).agg(F.sum("n").alias("n")).collect()}
        offsets = before_each([sums.get(b) or 0 for b in range(len(sizes))])
        upto = F.sum("n").over(Window.partitionBy(BUCKET).orderBy("i", "v").rowsBetween(Window.unboundedPreceding, 0))
        run = tagged.select("i", "v", "n", (upto + at_bucket(offsets, "bigint")).alias("upto"))
        # the bands lie one after the other in this order, so a rank is a position among all counts
        wanted, start = {}, 0
        for t in targets:
            for rank in {t.r_lo, t.r_hi}:
                wanted[start + rank - t.below] = (id(t), rank)
            start += t.m
        places = F.array(*[F.lit(p) for p in sorted(wanted)])
        hit = F.filter(places, lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))
        got = run.select("v", F.explode(hit).alias("p")).collect()  # two rows a target
        return {wanted[r["p"]]: float(r["v"]) for r in got}


def _finish(df: DataFrame, exprs: dict[str, Column], targets, out, cfg: AuditConfig) -> None:
    todo = []
    for k, j, t in targets:
        if t.single():
            out[k][j] = t.lo
        else:
            todo.append((k, j, t))
    small = [x for x in todo if x[2].m <= int(cfg.exact_quantile_max_band)]
    if small:
        aggs = []
        for i, (_, _, t) in enumerate(small):
            e = exprs[t.name]
            q = 0.0 if t.m <= 1 else min(1.0, max(0.0, (t.h - t.below) / (t.m - 1)))
            aggs.append(F.percentile(F.when(t.band(e), e), F.lit(q)).alias(f"f{i}"))
        inside = reduce(or_, [t.band(exprs[t.name]) for _, _, t in small])
        row = df.where(inside).agg(*aggs).first()  # few rows are in any band
        for i, (k, j, _) in enumerate(small):
            out[k][j] = float(row[f"f{i}"])
    large = [x for x in todo if x[2].m > int(cfg.exact_quantile_max_band)]
    if large:
        got = _by_counts(df, exprs, [t for _, _, t in large])
        for k, j, t in large:
            lo, hi = got[(id(t), t.r_lo)], got[(id(t), t.r_hi)]
            out[k][j] = lo if lo == hi else (t.r_hi - t.h) * lo + (t.h - t.r_lo) * hi
