"""Overwriting writes to a directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter

# The CSV writer trims blanks at both ends unless told not to.
KEEP_BLANKS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def input_roots(df: DataFrame) -> set[str]:
    """The root paths of the file relations in a frame's plan; no file is listed."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    roots = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and hasattr(leaf.relation(), "location"):
            paths = leaf.relation().location().rootPaths()
            roots |= {paths.apply(k).toString() for k in range(paths.size())}
    return roots


def refuse_own_input(df: DataFrame, path: str) -> None:
    """Raise if ``path`` is, holds or lies in a place that ``df`` reads.

    Spark would delete files there before reading them. Write to a new path and
    switch readers over instead.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")
    for root in input_roots(df):
        root = root.rstrip("/")
        if f"{root}/".startswith(f"{target}/") or f"{target}/".startswith(f"{root}/"):
            raise ValueError(f"{path} is an input of the frame to be written there")


def replace_directory(df: DataFrame, path: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    """Let ``write`` fill a folder beside ``path``, then put it in the place of what is there.

    The old data is moved aside by a rename, and deleted last. A write that
    fails leaves it untouched; a switch that fails moves it back. A driver that dies
    in between leaves it under a name that begins with ``_`` and ends with ``_old``.
    """
    refuse_own_input(df, path)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    target = files.makeQualified(target)
    beside = f"_{target.getName()}_{uuid.uuid4().hex}"
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"{beside}_{kind}") for kind in ("new", "old"))
    try:
        write(df.write, new.toString())
        present = files.exists(target)
        if present:
            _rename(files, target, old)
        try:
            _rename(files, new, target)
        except Exception:
            if present:
                _rename(files, old, target)
            raise
    except Exception:
        files.delete(new, True)
        raise
    if present:
        files.delete(old, True)


def _rename(files, source, target) -> None:
    if not files.rename(source, target):
        raise OSError(f"{source.toString()} could not be renamed to {target.toString()}")


def _csv(sep: str, header: bool, options: dict[str, str] | None) -> Callable[[DataFrameWriter, str], None]:
    settings = {**KEEP_BLANKS, **(options or {})}
    return lambda writer, path: writer.options(**settings).option("sep", sep).option("header", header).csv(path)


def write_csv(
    df: DataFrame, path: str, sep: str = ",", header: bool = True, options: dict[str, str] | None = None
) -> None:
    """One CSV file per task, with a header line and no row index.

    CSV does not keep the difference between an empty string and null. What
    was at ``path`` goes only when the new files are whole.
    """
    replace_directory(df, path, _csv(sep, header, options))


def write_single_csv(
    df: DataFrame, path: str, *order: str | Column, sep: str = ",", header: bool = False
) -> None:
    """One CSV file in a directory, for reports small enough to be one file.

    The rows meet in one task only after an exchange, so the aggregate behind
    a report keeps its own parallelism, which ``coalesce(1)`` would take away.
    Lines are sorted by ``order``; an order that ``df`` had before is lost.
    """
    refuse_own_input(df, path)
    single = df.repartition(1)
    replace_directory(single.sortWithinPartitions(*order) if order else single, path, _csv(sep, header, None))


def write_directory(df: DataFrame, path: str, fmt: str = "parquet", options: dict[str, str] | None = None) -> None:
    """Replace the data set at ``path``, old files last.

    ``fmt`` may be ``delta`` where installed; such a table replaces its rows by itself.
    """
    if fmt == "delta":
        refuse_own_input(df, path)
        df.write.format(fmt).mode("overwrite").options(**(options or {})).save(path)
        return
    replace_directory(df, path, lambda writer, place: writer.format(fmt).options(**(options or {})).save(place))
