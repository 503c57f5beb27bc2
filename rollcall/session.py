"""Session helper for local runs; on a cluster the caller's own session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("rollcall")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of an Arrow batch given to Python, where the session has Spark's own default.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT, BATCH_BYTES = 64 << 20, 4 << 20
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Ready a session for operators with Python workers: the package is with them, and their batches stay small beside an executor's memory."""
    ship_package(spark)
    if spark.conf.get(BATCH, f"{BATCH_DEFAULT}b").removesuffix("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each application, so that Python workers can import it wherever they run."""
    import tempfile
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="rollcall-")) / "rollcall.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
