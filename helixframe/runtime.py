"""Session-level helpers: reading tables, cutting lineage, shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application), wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "helixframe_pkg.zip"  # served to executors by the driver
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: spark.checkpoint.dir of the session; a folder of our own only in local mode where that is unset."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _OWN_DIRS.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="helixframe-"))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/hf-{uuid.uuid4().hex}"
    atexit.register(_quiet_delete, spark, path)
    return path


class Stored:
    """A DataFrame written once to the shared folder and read back, so that its lineage ends at replicated files.

    Unlike checkpoint() the plan is computed once and the result stays columnar."""

    def __init__(self, df: DataFrame):
        self.path = scratch(df.sparkSession)
        df.write.parquet(self.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _quiet_delete(self.df.sparkSession, self.path)


def _quiet_delete(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session is gone or the folder is
        pass


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """Session for tests and bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("helixframe")
    base = {
        "spark.sql.shuffle.partitions": os.environ.get("HF_PARTS", "8"),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
