"""Session factory with the settings the engine is tuned for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shared: set[str] = set()


def share_package(spark: SparkSession) -> None:
    """Sends this package to the executors of an application, once, so that Python workers can import it anywhere.

    The archive is made by the driver and fetched from it by Spark; no executor reads the driver's disk.
    """
    app = spark.sparkContext.applicationId
    if app in _shared:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="textquarry-")  # on the driver alone, as long as it lives: Spark serves it from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "textquarry.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.join("textquarry", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(archive)
    _shared.add(app)


def get_session(app: str = "textquarry", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session; on a cluster pass the session that the cluster made instead.

    AQE coalesces and splits shuffle partitions at run time, so the partition
    count is only an upper bound for the first plan.
    """
    builder = SparkSession.builder.appName(app).master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TEXTQUARRY_DRIVER_MEMORY", "8g"),
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_package(spark)
    return spark
