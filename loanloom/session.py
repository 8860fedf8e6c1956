"""Session settings for local runs, and the checkpoint folder."""

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "loanloom", memory: str = "16g") -> SparkSession:
    """Single-JVM session for tests and the benchmark.

    On a cluster the session comes from outside; nothing in the package needs
    these settings.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        # The JVM compiles no method above 8000 bytes; wide rows exceed that in one
        # fused method and then run interpreted.  Split code is far faster there.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names in ``spark.checkpoint.dir``.

    Only in local mode, and only where none is configured, is a private folder
    set; a cluster needs a folder all its machines share.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loanloom-checkpoint-"))
    return context.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut.

    Iterative work reads its input many times; a reliable checkpoint keeps it
    from being recomputed, also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Functions that run in tasks are found by their module's name, which needs
    the package on every machine; Spark's own file transfer brings it there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="loanloom-package-"), "loanloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    context.addPyFile(path)
