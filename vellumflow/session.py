"""Session builder and the settings every plan of this library relies on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app_name: str = "vellumflow", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC clocks, AQE and skew-join handling; ``conf`` overrides any key (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the Python workers of ``spark``, once a context, so that they need no installation of it.

    The archive is built on the driver and handed to Spark's own file server; executors fetch it from there.
    """
    context = spark.sparkContext
    if getattr(context, "_vellumflow_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vellumflow-code-")) / "vellumflow_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, str(Path("vellumflow") / path.relative_to(package)))
    context.addPyFile(str(target))
    context._vellumflow_shipped = True
