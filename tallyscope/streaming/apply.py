"""A fitted cleaning plan applied to a Structured Streaming DataFrame.

Every fitted step is a projection with literal values (formats, medians,
modes, bounds), so the same plan cleans rows as they arrive. The one stateful
step, ``drop_duplicates``, needs an event-time column and a delay: it becomes
``dropDuplicatesWithinWatermark`` so the dedup state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonicalize
from ..operators.kinds import q
from ..plans.cleaning import FittedPlan


def clean_stream(plan: FittedPlan, stream: DataFrame, event_time: str | None = None,
                 delay: str = "1 hour") -> DataFrame:
    """Apply ``plan`` to ``stream`` (batch frames work too)."""
    base = canonicalize(stream) if plan.canonical else stream
    env = {c: F.col(q(c)) for c in base.columns}
    for op in plan.ops:
        if op.kind == "drop":
            env.pop(op.col, None)
        elif op.kind == "dedup":
            if event_time is None:
                raise ValueError("drop_duplicates on a stream needs an event-time column (bounded state)")
            base = (base.select(*[e.alias(c) for c, e in env.items()])
                    .withWatermark(event_time, delay).dropDuplicatesWithinWatermark())
            env = {c: F.col(q(c)) for c in base.columns}
        else:
            env[op.col] = op.apply(env[op.col])
    return base.select(*[e.alias(c) for c, e in env.items()])


def run_available_now(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything available now into ``path`` and stop (restartable from
    ``checkpoint``, which must sit in the shared folder on a cluster)."""
    q_ = (stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
          .outputMode("append").trigger(availableNow=True).start())
    q_.awaitTermination()
