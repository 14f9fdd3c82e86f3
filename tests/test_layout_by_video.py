"""Tables by batch and video: what a scope reads."""

import re

from pyspark.sql import functions as F

from glimpse.sources.layout import write_by_video


def test_a_scope_reads_its_videos_folders(spark, tmp_path):
    rows = [(f"v{k % 40}", k, f"b{k % 2}") for k in range(400)] + [(None, 900, "b0"), ("v1", 901, None)]
    df = spark.createDataFrame(rows, "video_id string, frame_id long, b string")
    table = write_by_video(df, f"file://{tmp_path}/t", F.col("b"), 16)
    assert table.all().count() == 402
    one = table.scoped(spark.createDataFrame([("v7",), ("nowhere",), (None,)], "video_id string"))
    assert sorted(r.frame_id for r in one.collect()) == [k for k in range(400) if k % 40 == 7] and one.columns == df.columns
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket#\d+ IN \(\d+,\d+\)|PartitionFilters: \[[^\]]*_bucket#\d+ = \d+", plan)
    both = table.scoped(spark.createDataFrame([("v1", "b1"), ("v2", "b1")], "video_id string, batch string"))
    assert sorted(r.frame_id for r in both.collect()) == [k for k in range(400) if k % 40 == 1]
    assert "_batch" in re.search(r"PartitionFilters: \[([^\]]*)\]", both._jdf.queryExecution().executedPlan().toString())[1]
