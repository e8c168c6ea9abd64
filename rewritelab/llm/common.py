"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words, as a Java pattern: space and 0x09 to 0x0D.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id: nulls sort before every other id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer by underscores until ``df`` has no column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def with_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable.

    The cluster names a shared folder in spark.checkpoint.dir.  Only where that is unset (tests on one
    machine) a folder of our own is made.
    """
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared checkpoint folder."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


#: A key is heavy with over 1/HEAVY of the rows; so there are fewer than HEAVY heavy keys, whatever the input.
HEAVY = 1000


def join_unique(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``side`` (at most one a key) that has its ``key``; ``how``: inner or left.

    ``counts``: (key, __n), the rows by key; ``n``: the number of rows.  Rows of heavy keys meet a broadcast of fewer
    than HEAVY rows where they are, so that no task gets a key's rows all; the others are shuffled.  Keys aren't null.
    """
    heavy = F.broadcast(counts.filter(F.col("__n") * HEAVY > n).select(key))
    near = F.broadcast(side.join(heavy, key, "left_semi"))
    return rows.join(heavy, key, "left_semi").join(near, key, how).unionByName(rows.join(heavy, key, "left_anti").join(side, key, how))


#: Rows of a side that is broadcast after they are counted, of a few numbers each.
MOST_BROADCAST = 1_000_000


def small(side: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``side``, computed once, marked for a broadcast if it has ``most`` rows at most (they should be short)."""
    side = cut(side)
    return F.broadcast(side) if side.count() <= most else side


def most_frequent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``counts`` (column ``n``, positive) in two parts: ``most`` rows or fewer of the largest n, and the rest.

    The cut is at a step of 1/16 of a doubling, so that only a histogram reaches the driver.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 1024 rows at most
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    often = step >= least if least is not None else F.lit(False)
    return counts.filter(often), counts.filter(~often)


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def row_id(name: str = "doc_id", text: str = "text") -> Column:
    """The id; for a null one, a number of 62 bits above 2**62 that the text gives, so that rows without ids stay apart."""
    return F.coalesce(F.col(name).cast("long"), F.lit(2**62) + F.shiftrightunsigned(F.xxhash64(F.col(text).cast("string")), 2))


def number_rows(rows: DataFrame, order: list[str], name: str = "__row") -> tuple[DataFrame, int]:
    """``rows`` with their rank by ``order`` (from 0, a long), and their number.

    Rows are dealt to ranges of the whole ``order``, so that many rows of one id are split by what tells them apart;
    one count for each range reaches the driver.  Rows equal in all of ``order`` are interchangeable.
    """
    at = free(rows, "__at")[0]
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(at, F.monotonically_increasing_id())
    counts = dealt.groupBy(F.shiftright(at, 33).cast("int").alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["part"], total))
        total += r["count"]
    start = F.broadcast(dealt.sparkSession.createDataFrame(starts, "__part int, __start long"))  # one row for each partition
    met = dealt.join(start, F.shiftright(at, 33).cast("int") == F.col("__part"))
    return met.withColumn(name, F.col("__start") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, "__part", "__start"), total


def stored_rows(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df``, as read from Parquet, with each row's number in stored order (files by name, rows as they stand), and their number.

    Nothing is shuffled but a count for each file.  Where ``df`` is not a table of files, pyspark.errors.AnalysisException.
    """
    path, index = free(df, "__path", "__index")
    placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
    part = F.coalesce(F.try_to_number(F.regexp_extract(path, r"part-([0-9]{1,18})[^/]*$", 1), F.lit("9" * 18)).cast("long"), F.lit(-1))
    sizes = cut(placed.groupBy(path).agg((F.max(index) + 1).alias("__n")).withColumn("__part", part))
    before = Window.orderBy("__part", path).rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = sizes.select(F.col(path).alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    met = placed.join(small(starts), F.col(path) == F.col("__of"))
    return met.withColumn(name, F.col("__start") + F.col(index)).drop(path, index, "__of", "__start"), sizes.agg(F.sum("__n")).first()[0] or 0


def id_bounds(ids: DataFrame, key: str, rows: int, per_range: int = 200_000, least: int = 16, most: int = 2048) -> list[int]:
    """Ascending values of ``key`` that cut the rows into ranges of similar size; the first is the minimum.

    At most ``most`` values reach the driver, whatever the input.  All are values that occur.
    """
    n = min(most, max(least, rows // per_range))
    got = ids.agg(F.min(key).alias("low"), F.percentile_approx(key, [i / n for i in range(n)], 20 * n).alias("cuts")).first()
    if got is None or got["low"] is None:
        return []
    return sorted({got["low"], *(got["cuts"] or [])})


def range_of(key: Column, bounds: list[int]) -> Column:
    """Index of the last bound that is not above ``key``: a binary search over a literal array."""
    n, steps, step = len(bounds), [], 1
    while step < n:
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, s: F.when((low + s < F.lit(n)) & (F.get(cuts, low + s) <= key), low + s).otherwise(low),
    )
