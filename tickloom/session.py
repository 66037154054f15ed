"""The session settings that the library's results rest on, and how its code reaches Python workers."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=CONF | conf).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once, unless they find it by themselves."""
    top = Path(__file__).resolve().parent
    found = [os.path.abspath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."]]
    context = spark.sparkContext
    if str(top.parent) in found or any(os.path.basename(p) == "tickloom.zip" for p in context.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tickloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(path)
    sys.path[:] = [p for p in sys.path if not p.endswith("tickloom.zip")]


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="spark-")
        top = _own["dir"]
    return top.rstrip("/")
