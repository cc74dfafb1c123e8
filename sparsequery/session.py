"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def create_session(app: str = "sparsequery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC; ``conf`` overrides any of these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one when running locally."""
    sc = spark.sparkContext
    # getOption reads the JVM conf's option; an unset one must not raise
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and sc._jsc.sc().getCheckpointDir().isDefined():
        d = sc._jsc.sc().getCheckpointDir().get()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sparsequery-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system holds it; a stopped session or missing path is no error."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        if path.startswith(("/", "file:")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


_SHIPPED: set[str] = set()


def workers(spark: SparkSession) -> None:
    """Let Python workers import this package: locally from where the driver has it, on a cluster from an archive sent to them."""
    sc = spark.sparkContext
    env, root = sc.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    if not sc.master.startswith("local") and sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        folder = tempfile.mkdtemp(prefix="sparsequery-")  # on the driver, which serves the archive
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{folder}/sparsequery", "zip", root, os.path.basename(os.path.dirname(os.path.abspath(__file__)))))


def stage(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` (with the writer's ``options``) as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            drop_path(t.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that the shuffle files of finished stages are deleted from the executors."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
