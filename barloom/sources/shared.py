"""Files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import SparkSession


def folder(spark: SparkSession, what: str) -> str:
    """A new folder in the one named by spark.checkpoint.dir, deleted when the driver ends; where none is named a local
    session gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    uri = f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    atexit.register(_clear, spark, uri)
    return uri


def delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear(spark: SparkSession, uri: str) -> None:
    try:
        delete(spark, uri)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def file_system(uri: str):
    """pyarrow's file system and path for a URI or a plain path."""
    from pyarrow import fs

    # signs that a URI must not have, as the spaces of a market's name, are escaped, and read as they were
    return fs.FileSystem.from_uri(quote(uri, safe=":/?=&@+,%")) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_text(uri: str) -> str | None:
    """A file's text; none if there is no such file."""
    fs, path = file_system(uri)
    try:
        with fs.open_input_stream(path) as f:
            return f.read().decode()
    except FileNotFoundError:
        return None


def write_text(uri: str, text: str) -> None:
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(text.encode())
