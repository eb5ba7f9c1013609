"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """A folder of its own in the shared folder. ``keep`` cuts a frame's lineage by a written table."""

    #: all that the driver has opened and not cleared
    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.uri, self.n = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}", 0
        Scratch.opened.append(self)
        atexit.register(_quiet_delete, spark, self.uri)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.uri}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def clear(self) -> None:
        """Delete the folder and all its tables."""
        _quiet_delete(self.spark, self.uri)
        Scratch.opened.remove(self)

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete kept tables that nothing reads any more."""
        for df in frames:
            if df is not None and getattr(df, "_scratch_path", None):
                delete(self.spark, df._scratch_path)


def delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _quiet_delete(spark: SparkSession, uri: str) -> None:
    try:
        delete(spark, uri)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def file_system(uri: str):
    """pyarrow's file system and path for a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def replace(fs, part: str, path: str) -> None:
    """Move a finished file to its name; what an earlier run of the task left there goes, as some stores move onto
    nothing."""
    from pyarrow import fs as kinds

    if fs.get_file_info(path).type != kinds.FileType.NotFound:
        fs.delete_file(path)
    fs.move(part, path)


def write_whole(uri: str, data: bytes) -> None:
    """Write a file so that it appears at once; a repeated task replaces it by the same bytes."""
    out, path = file_system(uri)
    out.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with out.open_output_stream(part) as f:
        f.write(data)
    replace(out, part, path)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many _ before it as make it none of the taken ones (names differ by more than case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def join_hot(big: DataFrame, small: DataFrame, key: str, alone: Column, hot: Column) -> DataFrame:
    """Left join of ``big`` with ``small`` (one row per key) where a few keys may hold most of big's rows.

    ``hot`` marks the keys with at least a fixed share of all rows, so their number is bounded by the inverse of
    that share whatever the input. They are broadcast; the other rows meet by a shuffle in which rows that the
    broadcast has answered, or that have no key, are spread by ``alone``, a string of their own.
    """
    names = [c for c in small.columns if c != key]
    top = small.filter(hot).select(F.col(key).alias("_k"), F.struct(*names).alias("_hot"))
    rest = small.filter(~F.coalesce(hot, F.lit(False))).select(
        F.concat(F.lit("k"), F.col(key).cast("string")).alias("_s"), F.struct(*names).alias("_cold")
    )
    out = big.join(F.broadcast(top), F.col(key) == F.col("_k"), "left").drop("_k")
    out = out.withColumn(
        "_s",
        F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(
            F.concat(F.lit("a"), alone)
        ),
    )
    out = out.join(rest, "_s", "left").withColumn("_small", F.coalesce("_hot", "_cold"))
    return out.select(*[F.col(f"`{c}`") for c in big.columns], *[F.col("_small")[c].alias(c) for c in names])
