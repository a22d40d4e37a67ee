"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # from Spark 4.1 on; earlier ones ignore it
_local: dict[str, str] = {}  # temporary folders of local applications


class Scratch:
    """Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

    Written tables cut lineage and survive lost executors, and the shuffle files of the query that made one go at once: else
    they would stay until the driver happens to collect its garbage, all steps side by side. Where the setting is absent, a new temporary folder takes its
    place in local mode, as in tests; on a cluster that would be another folder on each machine, so it is an error.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)  # whoever keeps tables sends code to the workers as well
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            app = spark.sparkContext.applicationId
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            if app not in _local:
                _local[app] = tempfile.mkdtemp(prefix="spark-")
            base = _local[app]
        self.root = f"{base.rstrip('/')}/{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        path, conf = self.path(name), self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later plan reads."""
        for t in tables:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
