"""SparkSession helpers shared by tests, the bench and the driver entry."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tabwright") -> SparkSession:
    """A local session tuned like the cluster one: AQE on, UI off, UTC."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABWRIGHT_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; without that setting only a
    ``local[...]`` session, as in tests, gets a fresh scratch folder.
    Sessions without a SparkContext (Spark Connect) use the conf value.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (no SparkContext on Spark Connect)
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tabwright-ckpt-", dir="/tmp")
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabwright`` importable by executor Python workers.

    Arrow UDFs and ``mapInPandas`` functions live in this package, and
    workers import them by name.  Like ``--py-files``, the package is zipped
    on the driver once per application and added with ``addPyFile``, which
    Spark distributes to every executor.
    """
    import os
    import zipfile

    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001  (Spark Connect: no SparkContext)
        sc, app = None, "connect"
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="tabwright-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app)
