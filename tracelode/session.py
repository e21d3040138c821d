"""Session settings and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Set in every session that tables are loaded with: what results depend on, and the length beyond which HotSpot
#: never compiles a method (such stages run operator by operator instead of being interpreted as a whole).
PINNED = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}
#: Set only in sessions made here.
TUNED = {"spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def build_session(app: str = "tracelode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the pinned settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PINNED, **TUNED, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Give this package to the Python workers once per application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tracelode-")) / "tracelode.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def pin(spark: SparkSession) -> SparkSession:
    """Set the time zone of a session made elsewhere and ship the package to its workers."""
    _ship(spark)
    for key, value in PINNED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is named, a temporary one if all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tracelode-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the application ends; the path itself isn't created yet."""
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return f"{parent.toString()}/data"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch data."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
