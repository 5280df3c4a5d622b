"""The folder that all executors share, and reading files of any file system from tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; one of our own only where none is named and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='eventloom-')).rstrip('/')}/eventloom/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as written to the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """The file system of a URI, as tasks see it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(uri if re.match(r"\w+:", uri) else f"file://{uri}", safe="/:@"))


def folders(uri: str) -> list[str]:
    """Names of the folders in a folder, in order."""
    from pyarrow import fs

    system, path = file_system(uri)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory)


def by_value(uri: str, name: str) -> dict[str, str]:
    """The values of a partition column in a folder, with the folders that hold them."""
    return {unquote(f.partition("=")[2]): f for f in folders(uri) if f.startswith(f"{name}=")}


def text_of(uri: str) -> str:
    """The text of a file, or of the files that a writer put into a folder, in order of their names."""
    from pyarrow import fs

    system, path = file_system(uri)
    files = [path]
    if system.get_file_info(path).type == fs.FileType.Directory:
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name[0] not in "._")
    out = []
    for file in files:
        with system.open_input_stream(file) as stream:
            out.append(stream.read().decode())
    return "".join(out)
