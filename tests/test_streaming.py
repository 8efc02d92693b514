"""The fitted plan cleans a file stream exactly as it cleans the batch table."""

from tallyscope.plans.cleaning import CleaningPlan
from tallyscope.plans.rules import assess
from tallyscope.session import new_scratch_path
from tallyscope.sources.tables import dirty_orders_from, read_table
from tallyscope.streaming.apply import clean_stream, run_available_now

SF = "/root/testdata/sf0.001"


def test_plan_on_stream_equals_batch(spark):
    batch = dirty_orders_from(read_table(spark, SF, "orders"), duplicate_every=None)
    a = assess(batch, ["row_id"])
    plan = CleaningPlan([s for s in a.suggestions if s.type != "drop_duplicates"]).fit(batch)
    schema = read_table(spark, SF, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(SF)
    cleaned = clean_stream(plan, dirty_orders_from(stream, duplicate_every=None))
    out = new_scratch_path(spark, "stream-out")
    run_available_now(cleaned, out, new_scratch_path(spark, "stream-ckpt"))
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r) for r in plan.transform(batch).collect())
    assert got == want and len(got) == 1500
