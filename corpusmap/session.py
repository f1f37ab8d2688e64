"""Session set-up and small plan helpers shared by every job.

Nothing here moves data through the driver except ``bounded_rows``, which
refuses to return more than a stated number of rows: it is used only for
tables whose size is fixed by configuration (category labels, one block of
query vectors), never for data that grows with the corpus.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def get_session(master: str | None = None, app: str = "corpusmap",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the jobs assume.

    AQE stays on so shuffle partitions are coalesced and skewed join
    partitions are split at run time; the UI is off (no server port).
    """
    master = master or os.environ.get("CORPUSMAP_MASTER", "local[8]")
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusmap`` importable on the executors' Python workers.

    Arrow jobs reference module-level functions of this package, so workers
    must be able to import it. The package is zipped once per process and
    added with ``addPyFile`` (Spark copies it to every executor); repeated
    calls for the same SparkContext are no-ops.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="corpusmap-pkg-"), "corpusmap.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    The setting is read from the session. Only a local-mode session (tests)
    without one gets a private scratch folder; a cluster session without the
    setting is an error, because a machine-local folder would not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="corpusmap-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, name: str = "snapshot") -> DataFrame:
    """Write ``df`` once as a Parquet table under the session's shared
    checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` (a lost executor re-reads the
    files instead of recomputing the plan), and unlike an RDD checkpoint the
    table is columnar: later readers prune columns and push filters into the
    scan, and the planner sees its real size.
    """
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/corpusmap-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    table._cut_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from ``cut_lineage`` that nothing reads any
    more, so that a job of many batches does not keep those of all of them."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_rows(df: DataFrame, max_rows: int, what: str):
    """Collect a table whose size is bounded by configuration, or fail."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; refusing to move it through the driver")
    return rows


def dense_index(df: DataFrame, order_cols: list, group_cols: list | None = None,
                name: str = "idx", start: int = 0, whole_rows: bool = False) -> DataFrame:
    """``row_number() - 1 + start`` within ``group_cols`` ordered by ``order_cols``,
    computed without gathering a group into one task.

    The rows are written once to the shared checkpoint folder, range-partitioned
    by ``group_cols + order_cols`` (a hot group spans many tasks) and sorted,
    with their partition and position. The offsets are summed over the small
    (partition, group) count table, which is joined back; rows are never joined
    on their keys, so equal keys get consecutive numbers and no row is
    multiplied. ``whole_rows=False`` first writes the input, so that it is not
    computed again for the range bounds.
    """
    group_cols = list(group_cols or [])
    keys = group_cols + list(order_cols)
    rows = df if whole_rows else cut_lineage(df, "rows")
    numbered = (rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mono", F.monotonically_increasing_id()))
    numbered = cut_lineage(numbered, "index")
    counts = (numbered.groupBy("_pid", *group_cols)
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first")))
    base = Window.partitionBy(*group_cols) if group_cols else Window
    w = base.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that the planner sees its size: the rows then need no shuffle to meet it
    counts = cut_lineage(counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))), "offsets")
    cj = counts.select(F.col("_pid").alias("_c_pid"), *[F.col(g).alias(f"_c_{g}") for g in group_cols],
                       "_off", "_first")
    cond = [numbered["_pid"] == cj["_c_pid"]] + [numbered[g].eqNullSafe(cj[f"_c_{g}"]) for g in group_cols]
    pos = (F.col("_off") + F.col("_mono") - F.col("_first") + F.lit(start)).cast("long")
    return (numbered.join(cj, cond).withColumn(name, pos)
            .drop("_pid", "_mono", "_c_pid", *[f"_c_{g}" for g in group_cols], "_off", "_first"))


def spread_small_input(df: DataFrame, min_bytes: int = 4 << 20) -> DataFrame:
    """Rebalance a scan that cannot use the cluster: when a Parquet input has
    fewer row groups than the session's parallelism (a row group is the unit a
    scan task reads), CPU-heavy text work would run in a handful of tasks, so
    the rows are spread round-robin first. Inputs with enough row groups (any
    real corpus) are returned untouched -- no shuffle is added. Only file
    footers are read, and only when there are fewer files than task slots."""
    try:
        files = df.inputFiles()
    except Exception:
        return df
    par = df.sparkSession.sparkContext.defaultParallelism
    if not files or len(files) >= par:
        return df
    try:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq
        groups, size = 0, 0
        for uri in files:
            fs, path = pafs.FileSystem.from_uri(uri)
            md = pq.ParquetFile(fs.open_input_file(path)).metadata
            groups += md.num_row_groups
            size += sum(md.row_group(i).total_byte_size for i in range(md.num_row_groups))
    except Exception:
        return df
    if groups >= par or size < min_bytes:
        return df
    return df.repartition(par)
