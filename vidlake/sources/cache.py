"""A cache of frame features keyed by content (V7): a frame is extracted once, however often it is asked for.

The cache is a folder of Parquet batches of (digest, features). A refresh
extracts only frames whose digest no batch holds, one frame a digest, and
adds them as a new batch under a name of its own, so two writers never touch
each other's files; what both extracted at the same time is equal, and readers
take one row a digest. Compaction writes all batches as one and then removes
those it has read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _content() -> F.Column:
    """What names a frame in the cache: its size and its plane."""
    return F.sha2(F.concat_ws("/", F.sha2("y", 256), "height", "width"), 256)


class FeatureCache:
    """Features in ``path``; ``extract`` turns (video_id, frame_no, height, width, y) into rows with video_id and ``columns``.

    What is extracted has its digest for video_id.
    """

    def __init__(self, spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame], columns: T.StructType):
        self.spark, self.path, self.extract = spark, path.rstrip("/"), extract
        self.schema = T.StructType([T.StructField("digest", T.StringType()), *columns.fields])

    def _batches(self) -> list:
        """Finished batches: those whose writer has committed."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        store = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = [f.getPath() for f in store.listStatus(at)] if store.exists(at) else []
        return [(store, p) for p in found if p.getName().startswith("batch-") and store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _add(self, rows: DataFrame) -> None:
        rows.write.mode("errorifexists").parquet(f"{self.path}/batch-{uuid.uuid4().hex}")

    def stored(self) -> DataFrame:
        """One row a digest."""
        paths = [p.toString() for _, p in self._batches()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).dropDuplicates(["digest"])

    def refresh(self, frames: DataFrame) -> int:
        """Extract what is not stored yet; how many frames that were. A null plane is never extracted."""
        keyed = frames.where("y is not null").select(_content().alias("video_id"), F.lit(0).alias("frame_no"), "height", "width", "y")
        stored = self.stored().select(F.col("digest").alias("video_id"))
        folder = f"{self.path}/work-{uuid.uuid4().hex}"
        new = keyed.dropDuplicates(["video_id"]).join(stored, "video_id", "left_anti")
        new.write.parquet(folder)
        held = self.spark.read.schema(new.schema).parquet(folder)
        n = held.count()
        if n:
            self._add(self.extract(held).withColumnRenamed("video_id", "digest").select(*self.schema.names))
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        return n

    def features(self, frames: DataFrame) -> DataFrame:
        """The frames' columns but ``y``, with their stored features."""
        return frames.withColumn("digest", _content()).drop("y").join(self.stored(), "digest").drop("digest")

    def compact(self) -> None:
        """All batches as one; a reader in between sees both, and one row a digest."""
        old = self._batches()
        if len(old) > 1:
            self._add(self.stored())
            for store, p in old:
                store.delete(p, True)
