"""Tables that cut lineage, written to the folder that the whole cluster shares.

``spark.checkpoint.dir`` names that folder. Only where it is unset and Spark runs on
this machine alone (tests, notebooks) a temporary folder of this machine is used. A table written here
outlives lost executors, and later plans see its true size.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="kvartal-")
    return _OWN[sc.applicationId]


class Scratch:
    """Parquet tables under one private folder; ``drop`` frees those no plan reads any more.

    The folder goes when the driver's Python ends, as results may be read until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kvartal-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kvartal_path = path
        return out

    def size(self, df: DataFrame) -> int:
        """Bytes of a saved table: what a broadcast decision is checked against."""
        return self._fs(df._kvartal_path, lambda fs, p: int(fs.getContentSummary(p).getLength()))

    def drop(self, df: DataFrame) -> None:
        self._fs(df._kvartal_path, lambda fs, p: fs.delete(p, True))

    def close(self) -> None:
        try:
            self._fs(self.root, lambda fs, p: fs.delete(p, True))
        except Exception:  # the JVM is gone already: nothing left to ask
            pass

    def _fs(self, path: str, f):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return f(p.getFileSystem(sc._jsc.hadoopConfiguration()), p)
