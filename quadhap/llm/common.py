"""Small helpers the corpus operators share."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quadhap.session import cut_lineage  # noqa: F401


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application; where it is installed they have it anyway."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        with tempfile.TemporaryDirectory() as folder:
            shutil.copytree(package, f"{folder}/{package.name}/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
            held = tempfile.mkdtemp()
            spark.sparkContext.addPyFile(shutil.make_archive(f"{held}/{package.name}", "zip", f"{folder}/{package.name}"))
        _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, for tasks that run this package."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of its own where that is unset and the master is local."""
    cut_lineage(spark.range(1))
    return spark.sparkContext.getCheckpointDir()


def vocabulary_file(name: str) -> str:
    """Where a public vocabulary lies; only its path is ever shipped."""
    import public_tokenizers

    return public_tokenizers.path(name)


def class_ranges(test) -> str:
    """The code points for which ``test(char)`` holds, as ranges for a character class."""
    ranges, start = [], None
    for cp in range(0x110000):
        if not 0xD800 <= cp <= 0xDFFF and test(chr(cp)):
            if start is None:
                start = cp
        elif start is not None:
            ranges.append((start, cp - 1))
            start = None
    if start is not None:
        ranges.append((start, 0x10FFFF))
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in ranges)


def local_path(folder: str):
    """A file system and a path in it, for tasks that read or write files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9]+:", folder) else (fs.LocalFileSystem(), os.path.abspath(folder))
