"""File types by name, lists of files, and raw lines."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ_TYPES = {".fasta": "fasta", ".fa": "fasta", ".fastq": "fastq", ".fq": "fastq", ".fofn": "list", ".txt": "list"}
OVERLAP_TYPES = {".m4": "m4", ".m4a": "m4a", ".paf": "paf", ".sam": "sam", ".txt": "list"}


def file_type(path: str, types: dict[str, str], default: str | None = None) -> str:
    """The type by suffix, with .gz looked through; an unknown suffix is ``default`` or an error."""
    stem = path.removesuffix(".gz")
    got = types.get(posixpath.splitext(stem)[1].lower(), default)
    if got is None:
        raise ValueError(f"unknown file type: {path}")
    return got


def expand(spark: SparkSession, path: str, types: dict[str, str], default: str | None = None) -> list[tuple[str, str]]:
    """(file, type) of a file or of the files that a list names, lists within lists included; relative names count from
    the list's folder. A list is read on the driver: it holds names only."""
    out, todo, seen = [], [path], set()
    while todo:
        p = todo.pop(0)
        if p in seen:
            continue
        seen.add(p)
        kind = file_type(p, types, default)
        if kind != "list":
            out.append((p, kind))
            continue
        folder = posixpath.dirname(p)
        names = [r[0].strip() for r in spark.read.text(p).collect()]
        todo = [n if n.startswith("/") or "://" in n else posixpath.join(folder, n) for n in names if n] + todo
    return out


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lines (value) of text files, .gz included, without a carriage return at their end."""
    return spark.read.text(paths).select(F.regexp_replace("value", "\r$", "").alias("value"))
