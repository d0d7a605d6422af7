"""Session helpers: checkpoint folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of at most so many bytes (as JSON) is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder: on
    a cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-prosemetrics-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def configure(spark: SparkSession) -> SparkSession:
    """Settings the jobs rely on.

    Spark 4.1 may keep the partitioning of a union's inputs.  Some unions then
    failed because the inputs disagreed on the number of partitions.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives executor loss."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, and read it back.

    This cuts the lineage and survives a lost executor, and the step is
    computed once, where ``checkpoint()`` would compute it twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def steps_stored() -> int:
    """How many steps this process has stored; a mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the steps stored since a mark, but for the last ``keep``.

    Frames that read a deleted step can't be used afterwards.
    """
    stop = len(_written) - keep
    for name in filter(None, _written[since:stop]):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written[since:stop] = [""] * max(0, stop - since)


def fits_broadcast(dim: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``dim`` is small enough for a broadcast; its rows are measured where they are."""
    size = dim.agg(F.sum(F.length(F.to_json(F.struct(*[dim[c] for c in dim.columns]))))).first()[0]
    return (size or 0) <= max_bytes


def sized_broadcast(dim: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring that ``dim`` is small enough.

    Beyond the bound the frame is returned without a hint, so the join is shuffled and adaptive
    execution splits skewed partitions.
    """
    return F.broadcast(dim) if fits_broadcast(dim, max_bytes) else dim


def spread(docs: DataFrame) -> DataFrame:
    """Deal rows over all cores when they come from fewer files than there are cores.

    Text work is bound by the processor, and the splits of a small file are no help: its rows often
    stand in one row group, which one task reads.  A corpus of many files is left as it is.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.isStreaming or len(docs.inputFiles()) >= cores:
        return docs
    return docs.repartition(cores)
