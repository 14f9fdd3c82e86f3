"""Tables laid out by batch and video, so that what is asked of a few videos reads their files alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many buckets of videos, or batches, are named in the scan; more are met by a join.
NAMED = 1000


@dataclass(frozen=True)
class VideoTable:
    """A table at ``path``: folders ``_batch`` and ``_bucket`` (of the video's name), rows sorted by video."""

    spark: SparkSession
    path: str
    buckets: int

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("video_id"), F.lit(self.buckets)).cast("int")

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def scoped(self, scopes: DataFrame) -> DataFrame:
        """The rows of the videos of ``scopes`` (video_id, and batch if it is known). The buckets and batches asked for are filters of the scan,
        found when the table of scopes is; a null or unknown video has no rows."""
        batch = "batch" in scopes.columns
        asked = scopes.select("video_id", *(["batch"] if batch else [])).where("video_id is not null").distinct()
        rows = self.all()
        for column, value in (("_bucket", self._bucket()), *((("_batch", F.col("batch")),) if batch else ())):
            named = [r[0] for r in asked.select(value.alias("x")).distinct().limit(NAMED + 1).collect()]
            if len(named) <= NAMED:
                rows = rows.where(F.col(column).isin(named))
        on = rows["video_id"] == asked["video_id"]
        return rows.join(asked, on & (rows["_batch"] == asked["batch"]) if batch else on, "left_semi").drop("_batch", "_bucket")


def write_by_video(rows: DataFrame, path: str, batch: Column, buckets: int = 64) -> VideoTable:
    """``rows`` (video_id, ...) at ``path``. Rows of a large video are spread over several files of its folder; a null batch or video has a folder of its own."""
    table = VideoTable(rows.sparkSession, path, buckets)
    r = rows.withColumns({"_batch": batch.cast("string"), "_bucket": F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"), "_row": F.monotonically_increasing_id()})
    r = r.repartitionByRange("_batch", "_bucket", "video_id", "_row").sortWithinPartitions("_batch", "_bucket", "video_id").drop("_row")
    r.write.partitionBy("_batch", "_bucket").parquet(path)
    return table
