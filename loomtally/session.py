"""Session helpers shared by every module."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings used by tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomtally")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the workers this package where their path lacks it, once per application."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.applicationId in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(sc.applicationId)
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "loomtally"), "zip", root, "loomtally"))


_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as the cluster has cores.

    Tables below a few megabytes a core come in fewer; only those are dealt out anew, as Python stages
    would leave most cores idle. Larger tables stay as they are read. For scans only: a plan with a
    shuffle would run to be counted.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary folder; on a cluster that is an error, as every
    executor would write its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else spark.conf.get("spark.loomtally.shared", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loomtally-")
    spark.conf.set("spark.loomtally.shared", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    The plan is computed once and its lineage ends here, so a lost executor never loses the cut. The
    table goes with ``release``, at the end of ``scope``, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if spark.sparkContext.applicationId not in _CUTS:
        atexit.register(_drop_cuts, spark.sparkContext.applicationId, spark)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(schema).parquet(path)
    out._loomtally_cut = path
    return out


def cut_by(df: DataFrame, column: str) -> DataFrame:
    """As ``cut``, laid out by ``column``: later sums and joins on it need no shuffle.

    Where the session's catalog takes no tables the rows are the same without the layout.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"cut_{uuid.uuid4().hex}", scratch(spark)
    rows = df.repartition(n, column)
    try:
        rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, column).saveAsTable(name)
    except PySparkException:  # a failure of the rows themselves comes again with the plain table
        return cut(rows)
    _NAMES[path] = name
    out = spark.table(name)
    out._loomtally_cut = path
    return out


_CUTS: dict[str, list[str]] = {}
_NAMES: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder, which goes when a cut table would."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    if spark.sparkContext.applicationId not in _CUTS:
        atexit.register(_drop_cuts, spark.sparkContext.applicationId, spark)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(*tables: DataFrame | None) -> None:
    """Delete cut tables that no later plan reads: those a loop has replaced by newer ones."""
    for t in tables:
        path = getattr(t, "_loomtally_cut", None)
        if path is not None:
            spark = t.sparkSession
            _CUTS.get(spark.sparkContext.applicationId, []).remove(path)
            _delete(spark, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Cut tables made inside go at the end: for long sessions, around a query and its action."""
    app = spark.sparkContext.applicationId
    before = set(_CUTS.get(app, []))
    try:
        yield
    finally:
        for path in [p for p in _CUTS.get(app, []) if p not in before]:
            _CUTS[app].remove(path)
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _NAMES:
        spark.sql(f"DROP TABLE IF EXISTS {_NAMES.pop(path)}")
    if path.startswith(("/", "file:")):
        shutil.rmtree(re.sub("^file:/+", "/", path), ignore_errors=True)
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_cuts(app: str, spark: SparkSession) -> None:
    for path in _CUTS.pop(app, []):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone already; whoever owns the folder clears it
            return


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two frames of one row each as one row: a union and an aggregate, no join."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def small_side(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` stay within ``most``; else unchanged."""
    return F.broadcast(df) if rows <= most else df


def _part(df: DataFrame, salts: int) -> Column:
    """A row's part by its values, so that a task run again deals its rows out alike."""
    return F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")


def join_hot(big: DataFrame, small: DataFrame, key: str, hot: list, salts: int = 32, how: str = "inner") -> DataFrame:
    """Join on ``key`` where the keys in ``hot`` hold a large part of ``big``.

    Rows of hot keys are spread over ``salts`` tasks; the matching rows of ``small`` (one or few per
    key) are repeated ``salts`` times, for hot keys only. Null keys never match, as in a plain join.
    """
    if not hot:
        return big.join(small, key, how)
    is_hot: Column = F.coalesce(F.col(key).isin(hot), F.lit(False))
    left = big.withColumn("_salt", F.when(is_hot, _part(big, salts)).otherwise(F.lit(0)))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def join_both_hot(a: DataFrame, b: DataFrame, key: str, hot: list, salts: int = 8) -> DataFrame:
    """Inner join on ``key`` where hot keys hold many rows on both sides.

    A hot key's rows are dealt into ``salts`` parts on each side and every part of one side meets every
    part of the other once, so a key's pairs come from salts x salts tasks and every pair comes once.
    """
    if not hot:
        return a.join(b, key)
    is_hot: Column = F.coalesce(F.col(key).isin(hot), F.lit(False))
    every = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    left = a.withColumn("_i", F.when(is_hot, _part(a, salts)).otherwise(F.lit(0))).withColumn("_j", every)
    right = b.withColumn("_j", F.when(is_hot, _part(b, salts)).otherwise(F.lit(0))).withColumn("_i", every)
    return left.join(right, [key, "_i", "_j"]).drop("_i", "_j")


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys holding more than ``share`` of the rows: at most 1/share of them, so the list is bounded."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return [r[0] for r in counts.where(F.col("n") > max(1000, total * share)).collect()]
