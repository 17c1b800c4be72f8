"""Session helpers: the shared work folder, and a local session for tests and bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "trajmill") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session may go without the setting: it gets a temporary folder, the same
    one for all of its calls.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="trajmill-")
    return _LOCAL_FOLDERS[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for one written table, unused so far."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
