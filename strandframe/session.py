"""Session access, table loading and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The most rows and bytes (in files or as estimated by the optimizer) a side may have before it is no longer broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: A key counts as heavy from this share of the rows on, so there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 1 / 1000
#: Rows below which a table is joined without a look for heavy keys; this changes the plan, not the result.
SMALL_ROWS = 200_000

_SHIPPED: set[str] = set()
_ROOTS: dict[tuple[str, str], str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        here = pathlib.Path(__file__).resolve().parent
        staged = tempfile.mkdtemp(prefix="strandframe-")
        atexit.register(shutil.rmtree, staged, True)
        path = pathlib.Path(staged, "strandframe.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f"{here.name}/{f.relative_to(here)}")
        sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; one is chosen only where that is unset in local mode.

    On a cluster a missing setting is an error: a folder of one machine would not be seen by the others."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandframe-")
        sc.setCheckpointDir(base)
    key = (sc.applicationId, base)
    if key not in _ROOTS:
        _ROOTS[key] = f"{base}/strandframe-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, _ROOTS[key])
    return _ROOTS[key]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already; the cluster clears its shared folder
        pass


def cut(df: DataFrame, **counts: Column) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files: lineage is cut, and they survive lost executors.

    As Parquet the table keeps column pruning and a known size, and its reader packs small files into few partitions, so
    loops keep plans and task numbers constant. Its rows are counted while it is written, see ``n_rows`` and ``drop``, and
    so are the rows for which each condition in ``counts`` holds, see ``n_where``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in counts.items()]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandframe_path = path
    got = seen.get
    out._strandframe_rows = got["n"]
    out._strandframe_counts = {k: got[f"n_{k}"] for k in counts}
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no frame will read again."""
    for t in tables:
        if path := getattr(t, "_strandframe_path", None):
            _delete(t.sparkSession, path)


def drop_all(spark: SparkSession) -> None:
    """Delete every table of ``cut`` of this application. For long applications, between runs whose results are written."""
    _delete(spark, shared_folder(spark))


def n_rows(df: DataFrame) -> int:
    """Rows of ``df``, without a job if it comes from ``cut``."""
    n = getattr(df, "_strandframe_rows", None)
    return df.count() if n is None else n


def sized(df: DataFrame, n: int) -> DataFrame:
    """``df`` with a number of rows that follows from the tables it was made of."""
    df._strandframe_rows = n
    return df


def n_where(df: DataFrame, name: str) -> int:
    """Rows of a table of ``cut`` for which the condition of that name held."""
    return df._strandframe_counts[name]


def is_empty(df: DataFrame) -> bool:
    n = getattr(df, "_strandframe_rows", None)
    return df.isEmpty() if n is None else n == 0


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint behind a check of rows and bytes: a table of ``cut`` knows its rows and its files; another frame
    (materialised beforehand) is counted up to ``max_rows`` + 1 rows.

    Beyond either bound the frame is returned as it is and the join shuffles."""
    n = getattr(df, "_strandframe_rows", None)
    if n is None:
        n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows and _estimated_bytes(df) <= max_bytes else df


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> DataFrame | None:
    """Keys, without nulls, that hold at least ``share`` of the rows of ``df``: by construction at most 1 / share rows.

    None if there are none or the table is too small for any key to matter."""
    total = n_rows(df)
    if total < SMALL_ROWS:
        return None
    some = df.select(*keys).where(" and ".join(f"`{k}` is not null" for k in keys))
    rows = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= int(total * share)).drop("_n")
    held = rows.collect()
    return df.sparkSession.createDataFrame(held, rows.schema) if held else None


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a large ``left`` with heavy keys to a ``right`` that has one row per key.

    Rows of heavy keys meet their few right rows by broadcast (at most 1 / HEAVY_SHARE keys), the others are shuffled.
    ``left`` should be materialised (see ``cut``). Null keys match nothing. ``how`` is inner or left."""
    heavy = heavy_keys(left, keys)
    if heavy is None:
        return left.join(right, keys, how)
    mark = F.broadcast(heavy)
    hot = left.join(mark, keys, "left_semi").join(F.broadcast(right.join(mark, keys, "left_semi")), keys, how)
    cold = left.join(mark, keys, "left_anti").join(right, keys, how)
    return hot.unionByName(cold)


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )

