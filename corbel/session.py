"""Table access, record keys and staged tables shared by all operators."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Unicode white space: what Java's (?U)\s knows, and the four ASCII separators.
_BLANK = r"[\s\x1c-\x1f]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(col):
    """The text without leading and trailing Unicode white space; null stays null."""
    return F.regexp_replace(col, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: a redelivered row counts once.

    Rows in which every key column is null can't be told to be deliveries of one
    record, so they count as one record for each distinct content.
    """
    anonymous = F.lit(True)
    for k in keys:
        anonymous = anonymous & F.col(k).isNull()
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return (
        df.withColumn("_content", F.when(anonymous, content))
        .dropDuplicates([*keys, "_content"])
        .drop("_content")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    own = getattr(sc, "_corbel_shared", None)
    if own is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="corbel-")
        sc._corbel_shared = own
    return own


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once a session, wherever they were started."""
    sc = spark.sparkContext
    if getattr(sc, "_corbel_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="corbel-"), "corbel-package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._corbel_shipped = True


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corbel-{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Delete all tables that this application has staged; results not yet written can't be read after it."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends here.

    Unlike an in-memory copy it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks_for(spark: SparkSession, rows: int, per_block: int) -> int:
    """Number of blocks of about per_block rows, at most four per shuffle partition."""
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(math.ceil(rows / per_block), most))
