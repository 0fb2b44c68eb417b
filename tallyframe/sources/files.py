"""File listings and object-store access."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import scratch_path

#: Schemes that tasks can list by themselves, and what their library calls them.
LISTED_IN_TASKS = {"file": "file", "s3a": "s3", "s3": "s3", "gs": "gs"}
#: Where the driver lists, so many entries are in its memory at once.
CHUNK = 50_000
FOUND = "path string, folder boolean, modified bigint, bytes bigint"


def list_files(
    spark: SparkSession,
    path: str,
    pattern: str | None = None,
    options: dict[str, str] | None = None,
    filesystem: Callable | None = None,
) -> DataFrame:
    """``path``, ``modified`` and ``bytes`` of every file below ``path``.

    The folders of each level are rows of a frame, and tasks list them: what
    reaches the driver is one count per level. Names and folders that begin
    with ``_`` or ``.`` are listed too, which Spark's file sources leave out.
    File contents are never opened. ``pattern`` is a glob for file names. The
    files of one folder are listed by one task.

    ``filesystem`` makes the pyarrow file system that tasks use, for paths as
    it knows them; without it the scheme of ``path`` decides. Other schemes,
    and paths that need ``options`` (Hadoop settings), are listed by the
    driver, a bounded number of entries at a time.
    """
    scheme = urlsplit(path).scheme
    if filesystem is None:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        qualified = root.getFileSystem(_settings(spark, options)).makeQualified(root).toString()
        scheme = urlsplit(qualified).scheme
        if options or scheme not in LISTED_IN_TASKS:
            found = _listed_by_driver(spark, path, options)
            return _shown(found, pattern, "")
        place = qualified.split(":", 1)[1]
        prefix = "file:" if scheme == "file" else f"{scheme}://"
        base = place if scheme == "file" else place.removeprefix("//")
        known = LISTED_IN_TASKS[scheme]

        def filesystem():
            from pyarrow import fs

            if known == "file":
                return fs.LocalFileSystem()
            return fs.FileSystem.from_uri(f"{known}://{quote(base)}")[0]
    else:
        prefix, base = "", path
    found = _listed_by_level(spark, base, filesystem)
    if scheme == "file":  # the checksums that Hadoop keeps beside local files are not files to it
        found = found.where("NOT element_at(split(path, '/'), -1) rlike '^[.].*[.]crc$'")
    return _shown(found, pattern, prefix)


def _settings(spark: SparkSession, options: dict[str, str] | None):
    settings = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    for key, value in (options or {}).items():
        settings.set(key, value)
    return settings


def _shown(found: DataFrame, pattern: str | None, prefix: str) -> DataFrame:
    files = found.where("NOT folder")
    if pattern is not None:
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(f"(?s){_regex(pattern)}"))
    return files.select(F.concat(F.lit(prefix), "path").alias("path"), F.timestamp_millis("modified").alias("modified"), "bytes")


def _regex(glob: str) -> str:
    """A glob of ``*``, ``?``, ``[...]`` and ``[!...]`` as a regular expression for whole names."""
    parts = []
    for part in re.findall(r"\[!?\]?[^\]]*\]|.", glob, re.DOTALL):
        if len(part) > 1:
            inner = part[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            parts.append(f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]")
        else:
            parts.append({"*": ".*", "?": "."}.get(part) or re.escape(part))
    return f"^{''.join(parts)}\\z"


def _listed_by_level(spark: SparkSession, base: str, filesystem: Callable) -> DataFrame:
    from pyarrow import fs

    kind = filesystem().get_file_info(base).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(base)

    def entries(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system = filesystem()
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                single = kind == fs.FileType.File
                infos = [system.get_file_info(folder)] if single else system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                for at in range(0, len(infos), CHUNK):
                    some = infos[at : at + CHUNK]
                    columns = [
                        pa.array([x.path for x in some], pa.string()),
                        pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_()),
                        pa.array([x.mtime_ns // 1_000_000 if x.mtime_ns is not None else None for x in some], pa.int64()),
                        pa.array([x.size for x in some], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "folder", "modified", "bytes"])

    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, n = spark.createDataFrame([(base,)], "path string"), 1
    levels = []
    while n:
        path = scratch_path(spark, "listing")
        # Each folder is little data and much waiting, so they are dealt to all tasks.
        folders.repartition(min(n, most), "path").mapInArrow(entries, FOUND).write.parquet(path)
        levels.append(spark.read.schema(FOUND).parquet(path))
        folders = levels[-1].where("folder").select("path")
        n = folders.count()
    return reduce(DataFrame.union, levels)


def _listed_by_driver(spark: SparkSession, path: str, options: dict[str, str] | None) -> DataFrame:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(_settings(spark, options)).listFiles(root, True)
    stored, rows, more = scratch_path(spark, "listing"), [], True
    while more:
        more = found.hasNext()
        if more:
            file = found.next()
            rows.append((file.getPath().toString(), False, file.getModificationTime(), file.getLen()))
        if len(rows) == CHUNK or not more:
            spark.createDataFrame(rows, FOUND).write.mode("append").parquet(stored)
            rows = []
    return spark.read.schema(FOUND).parquet(stored)


def public_bucket_options(bucket: str | None = None) -> dict[str, str]:
    """Reader options for anonymous ``s3a://`` access, for one bucket or for all.

    To set them for a whole session, put ``spark.hadoop.`` before each name.
    """
    scope = f"fs.s3a.bucket.{bucket}" if bucket else "fs.s3a"
    return {
        f"{scope}.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    }
