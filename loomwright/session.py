"""Session set-up and staged tables.

A staged table is an intermediate result written once, as Parquet, into the folder that all executors share
(``spark.checkpoint.dir``). Reading it back cuts the lineage, so a lost executor costs a re-read and never a
recomputation of everything before, and expensive features are computed once however often they are used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, set[str]] = {}


def build_session(app: str = "loomwright", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings that the operators are written for; ``conf`` (dots as ``__``) overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    checkpoint_folder(spark)
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that it need not be installed on them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="loomwright-")) / "loomwright.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one is set only where none is named.

    The fallback serves local sessions (tests, notebooks). A cluster must name a folder that every node sees.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomwright-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named


def _clear() -> None:
    """Deletes the staged tables of sessions that are still up when the driver ends."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for paths in _folders.values():
            for p in paths:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 - the session is going away; a folder that stays is only disk
        pass


def keep_until_end(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    if not _folders:
        atexit.register(_clear)
    _folders.setdefault(spark.sparkContext.applicationId, set()).add(path)


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again. Deterministic: the write is the only evaluation."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/loomwright-{name}-{uuid.uuid4().hex}"
    keep_until_end(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mine = _folders.get(spark.sparkContext.applicationId, set())
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        for p in list(mine):
            if path.toUri().getPath() == jvm.org.apache.hadoop.fs.Path(p).toUri().getPath():
                path.getFileSystem(conf).delete(path, True)
                mine.discard(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
