"""The bucketed touch table: same pairs, no exchange of touches, pruned months."""

import re
import tempfile
import uuid
from datetime import date

from creditline.operators.journeys import eligible_pairs
from creditline.plans.pipeline import Pipeline
from creditline.sources.layout import pairs_from_layout, write_touches
from tests.conftest import MEDIUM


def test_pairs_from_the_layout(spark):
    p = Pipeline(spark, MEDIUM)
    name = f"touches_{uuid.uuid4().hex[:8]}"
    write_touches(p.deduped, name, n_buckets=6, path=tempfile.mkdtemp(prefix="creditline-layout-", dir="/tmp") + "/t")
    try:
        lo, hi = date(2024, 1, 10), date(2024, 1, 20)
        got = pairs_from_layout(spark, name, p.conversions, lo, hi, 7)
        from pyspark.sql import functions as F

        conv = p.conversions.where(F.to_date("converted_at").between(F.lit(lo), F.lit(hi)))
        want = eligible_pairs(p.deduped, conv, 7)
        cols = want.columns
        a, b = sorted(map(tuple, got.select(cols).collect())), sorted(map(tuple, want.collect()))
        assert a == b and len(a) > 100
        plan = got._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"(?s)\+- == Initial Plan ==.*", "", plan)
        scan = plan[plan.index(name) - 400:]
        # the branch that reads the table has no exchange between scan and join
        lines = plan.splitlines()
        at = next(i for i, x in enumerate(lines) if name in x)
        depth = re.match(r"[\s:|+-]*", lines[at])[0]
        above = []
        for x in reversed(lines[:at]):
            d = re.match(r"[\s:|+-]*", x)[0]
            if len(d) < len(depth):
                above.append(x)
                depth = d
        assert any("SortMergeJoin" in x for x in above)
        below = above[: next(i for i, x in enumerate(above) if "SortMergeJoin" in x)]
        assert not any("Exchange" in x for x in below), plan
        assert "event_month" in scan and "PartitionFilters: [isnotnull(event_month" in plan
        assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_null_times_and_empty_orders(spark):
    from pyspark.sql import functions as F

    p = Pipeline(spark, MEDIUM)
    name = f"touches_{uuid.uuid4().hex[:8]}"
    t = p.deduped.withColumn("event_timestamp", F.when(F.col("event_id") % 9 != 0, F.col("event_timestamp")))
    write_touches(t, name, n_buckets=2, path=tempfile.mkdtemp(prefix="creditline-layout-", dir="/tmp") + "/t")
    try:
        assert spark.table(name).count() == t.count()
        assert pairs_from_layout(spark, name, p.conversions.limit(0), date(2024, 1, 1), date(2024, 2, 1)).count() == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
