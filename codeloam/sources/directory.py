"""A directory as a relation: the driver walks and prunes, executors read."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def list_directory(spark: SparkSession, root: str, skip: Callable[[str], bool], label: str = "directory") -> DataFrame:
    """rev, path, oid, size of regular files; links are left out, skipped directories are never entered."""
    top, rows = os.path.realpath(root), []
    for folder, names, files in os.walk(top):
        inner = os.path.relpath(folder, top).replace(os.sep, "/")
        under = lambda n: n if inner == "." else f"{inner}/{n}"  # noqa: E731, B023
        names[:] = sorted(n for n in names if not os.path.islink(os.path.join(folder, n)) and not skip(under(n)))
        for n in sorted(files):
            full = os.path.join(folder, n)
            if os.path.isfile(full) and not os.path.islink(full):
                rows.append((label, under(n), f"file:{under(n)}", os.path.getsize(full)))
    return spark.createDataFrame(rows, "rev string, path string, oid string, size long")


def read_files(listing: DataFrame, root: str, limit: int) -> DataFrame:
    """listing with content, bounded; size grows to what was read if the file did."""
    top = os.path.realpath(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content = []
            for path in frame["path"]:
                with open(os.path.join(top, path), "rb") as f:
                    content.append(f.read(limit) if limit else f.read())
            yield frame.assign(content=content, size=[max(s, len(c)) for s, c in zip(frame["size"], content)])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema)
    return listing.mapInPandas(run, f"{fields}, content binary")
