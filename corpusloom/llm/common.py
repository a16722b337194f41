"""What several operators share: row identity, checkpoints, word hashes and groups."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the vectorised text kernels hold at a time; bounds a Python worker's memory, not what is read.
SLAB_CHARS = 1_000_000
#: Rows in an Arrow batch. Documents are long, so the default of 10,000 would hold too much text at once.
ARROW_ROWS = 512
#: A side of a join is broadcast if it is known to have at most so many rows, of a few hundred bytes; beyond, Spark shuffles.
BROADCAST_ROWS = 50_000
#: Rows of one key that a task of a join gets, about; more are spread over several.
HOT_ROWS = 100_000
#: Names of a row's identity in tables whose other names are chosen here.
FID, ROW = KEY = ("_loom_file", "_loom_row")
#: Folders that this process has made.
_MADE: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local folder is made only in local mode, where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ready_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, if they have it nowhere else."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as rows hold whole documents, unless the session's user has chosen a size."""
    ready_workers(spark)
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(ARROW_ROWS))


def scratch(spark: SparkSession, name: str = "") -> str:
    """A new path in the shared folder, below the application's own, which ``clear_scratch`` deletes."""
    mine = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"
    if mine not in _MADE:
        _MADE.add(mine)
        atexit.register(clear_scratch, spark)
    return f"{mine}/{name or uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch`` named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application wrote to the shared folder; results that read them are void then. Runs by itself when Python ends."""
    if spark._jsc.sc().isStopped():
        return
    for path in list(_MADE):
        remove(spark, path)
        _MADE.discard(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if its number of rows, which the caller has counted, allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread_join(rows: DataFrame, groups: DataFrame, key: list[str], size: str = "size") -> DataFrame:
    """``rows`` joined with ``groups``, a row for each key, which says in ``size`` how many rows have it; ``size`` goes.

    Rows are spread by their identity over as many parts as HOT_ROWS of a key need, and the group's row is repeated for each
    part, so that a key of a third of all rows fills no task. The keys for which there is more than one part are at most a
    HOT_ROWS-th of all rows, few enough to be broadcast.
    """
    groups = checkpoint(groups)
    hot = groups.where(F.col(size) > HOT_ROWS).select(*key, F.ceil(F.col(size) / HOT_ROWS).cast("int").alias("_parts"))
    if hot.isEmpty():
        return rows.join(groups.drop(size), key)
    hot = F.broadcast(checkpoint(hot))
    parts = F.coalesce("_parts", F.lit(1))
    many = groups.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts", size)
    return rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(FID, ROW), parts).cast("int")).drop("_parts").join(many, [*key, "_part"]).drop("_part")


def named(column: str) -> str:
    """The column's name in backticks, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def spare(columns: list[str], many: int) -> list[str]:
    """So many names that none of the columns has in any case of letters."""
    taken, found, k = {c.lower() for c in columns}, [], 0
    while len(found) < many:
        if f"_loom{k}" not in taken:
            found.append(f"_loom{k}")
        k += 1
    return found


def _is_scan(df: DataFrame) -> bool:
    """Whether the plan only selects from files, so that no row has been made twice."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def is_anchored(df: DataFrame) -> bool:
    """Whether the rows have a place in a file."""
    try:
        if _is_scan(df):
            df.select(df.metadataColumn("_metadata")["row_index"])
            return True
    except AnalysisException:
        pass
    return False


def anchored(df: DataFrame) -> DataFrame:
    """A DataFrame with the rows of ``df`` that reads them from files, so that each row has a lasting identity.

    That is ``df`` itself if it is a scan; else its rows are written to the shared folder, as a recomputed
    shuffle may order them otherwise.
    """
    if is_anchored(df):
        return df
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable_rows(df: DataFrame, *columns: Column | str, key: Sequence[str] = KEY) -> DataFrame:
    """Of an anchored DataFrame, the columns and the row's identity (file hash, row index) under two names, the same in every job."""
    at = df.metadataColumn("_metadata")
    return df.select(*columns, F.xxhash64(at["file_path"]).alias(key[0]), at["row_index"].alias(key[1]))


def slabs(texts: list[str], limit: int = SLAB_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters in total; a longer text makes a range by itself."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLAB_CHARS + 4096)
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            both.append(p)
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs in which ``inside`` holds."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    power, inverse = _powers(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of longs: ``node, root``, root being the least node.

    Alternates large-star and small-star steps; each halves the depth at least, and no task ever holds
    a whole component. Nodes without an edge to another node are absent.
    """
    edges = checkpoint(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == before:
            break
        before = (state.n, state.s)
        # large star: neighbours above a node point to the least of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lower neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = checkpoint(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def lowest_hashed(rows: DataFrame, group: str, key: Sequence[str], many: int, seed: int) -> DataFrame:
    """``group``, the columns of ``key`` and ``order``: of each group the ``many`` rows of the lowest seeded hash of the key, which tells all rows apart.

    Groups are counted first; then only rows whose hash is below what so many rows need, with six standard
    deviations to spare, are sorted, so that neither a task nor the driver gets more than a small multiple of them.
    """
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 1)
    slim = rows.select(group, *key, order.alias("order"))
    counts = [(r[0], r[1]) for r in slim.groupBy(group).count().collect()]
    enough = many + 6 * many**0.5 + 20
    below = [(g, (1 << 63) - 1 if n <= enough else int((1 << 63) * enough / n)) for g, n in counts]
    bounds = rows.sparkSession.createDataFrame(below, f"{group} {dict(rows.dtypes)[group]}, below long")
    few = slim.join(small_side(bounds, len(below)), group).where("order <= below")
    place = F.expr(f"row_number() OVER (PARTITION BY `{group}` ORDER BY order, {', '.join(key)})")
    return few.withColumn("_place", place).where(F.col("_place") <= many).select(group, *key, "order")
