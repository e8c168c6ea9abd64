"""Mixing sources to target weights by a time-varying curriculum.

Targets: sources in code point order (null last) weigh 3, 1, 2 and again; together they get 1.5 times the words
that there are; a source's target stops at twice its words and the excess goes to the others by weight, until none is
above.  That is one water level: target = min(2 * size, level * weight).

Which documents: a source runs through its documents in one order, whole passes first, then the part of a pass that is
left.  First in that order come those of the documents with over 1/200 of the source's words (fewer than 200) that fit into
the part, the largest first; then all smaller documents, by hash; then the other large ones.  A document is in the part if
the middle of its words is, so taken words miss the target by half a small document.  No document is taken more than twice.

Where they go: over training time t in [0, 1] a source's weight changes linearly, its schedule
w(t) = target * (1 + slope * (2t - 1)).  The integral target * (t + slope * (t*t - t)) is the source's cumulative
demand; inverting it at the words taken before a copy's middle gives the copy's training position.  Positions of all
sources interleave; ``mixed_documents`` range-sorts by them.

Scale: a source may hold a third of all rows, so running sums are taken in two steps: sums by (source, hash
bucket), combined map-side, then windows inside a bucket.  Texts are not shuffled for planning.

Defined results: null texts have size 0; documents without words are taken not at all; null is a source like any
other; repeated rows are separate documents (ties by id and size); empty tables give no rows; extra columns are
ignored by the plan and carried by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, cut, free, id_key, row_id, table, text_of

WEIGHTS, SHARE, MOST_PASSES = (3.0, 1.0, 2.0), 1.5, 2.0
#: Slopes of the schedules, by source in turn: rising, falling, flat.
SLOPES = (0.5, -0.5, 0.0)
#: Documents with over 1/LARGE of their source's words are chosen one by one, so that the cut is among small ones.
LARGE = 200
#: Buckets of large documents, before and after those of the others.
FIRST, LAST = -1, 1 << 40
#: Sources up to which their totals are broadcast (a few bytes each).
MOST_BROADCAST = 100_000
#: A word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
SEED = 8


def n_words(text: Column) -> Column:
    """Each word becomes one letter and the blanks between go: no array of words is made, however long the text."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")
    return F.length(marks).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES, slopes: tuple = SLOPES) -> DataFrame:
    """source, source_size, target, slope: one row a source.

    ``sizes``: (source, size) by document.  Windows without partitions run over one row for each source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")
    own = total.withColumn("__turn", turn)
    own = own.withColumn("__weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("__turn") % len(weights))).withColumn("slope", F.get(F.array(*[F.lit(float(s)) for s in slopes]), F.col("__turn") % len(slopes)))
    # sources stop in the order of cap / weight; the level that is left after the first k have stopped
    order = Window.orderBy(F.col("__cap") / F.col("__weight"), "__turn")
    everything = Window.partitionBy()
    own = own.withColumn("__cap", F.col("source_size") * F.lit(most))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("__left", F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    own = own.withColumn("__heavy", F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0)))
    level = F.col("__left") / F.col("__heavy")
    stops = level * F.col("__weight") >= F.col("__cap")
    first = F.struct(F.row_number().over(order).alias("place"), level.alias("level"))
    own = own.withColumn("__level", F.min(F.when(~stops, first)).over(everything)["level"])
    target = F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__level") * F.col("__weight")))
    return own.select("source", "source_size", target.cast("double").alias("target"), "slope")


def position(done: Column, target: Column, slope: Column) -> Column:
    """Time t at which the cumulative demand target*(t + slope*(t*t - t)) reaches ``done``."""
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / target))
    root = F.sqrt(F.pow(1 - slope, F.lit(2.0)) + 4 * slope * u)
    return F.when(slope == 0, u).otherwise((root - (1 - slope)) / (2 * slope))


def chosen_large(large: DataFrame, goals: DataFrame) -> DataFrame:
    """The rows of ``large`` (fewer than LARGE a source) with ``__bucket``: FIRST for those that fill the part of a pass, LAST for others.

    By falling size, each document that still fits into what is left of the part is chosen.
    """
    own = large.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "__order", "doc_id", "size"))).alias("__all"))
    met = own.join(goals.select(F.col("source").alias("__of"), (F.col("target") - F.floor(F.try_divide(F.col("target"), F.col("source_size")) + F.lit(1e-12)) * F.col("source_size")).alias("__part")), F.col("source").eqNullSafe(F.col("__of")))
    none = F.struct(F.col("__part").cast("double").alias("left"), F.expr("CAST(array() AS array<boolean>)").alias("fits"))

    def add(now: Column, x: Column) -> Column:
        fits = x["size"] <= now["left"]
        return F.struct((now["left"] - F.when(fits, x["size"]).otherwise(0)).cast("double").alias("left"), F.concat(now["fits"], F.array(fits)).alias("fits"))

    dealt = met.select("source", F.inline(F.arrays_zip("__all", F.aggregate("__all", none, add, lambda x: x["fits"]).alias("fits"))))
    return dealt.select(F.col("__all.doc_id").alias("doc_id"), "source", F.col("__all.size").alias("size"), F.col("__all.__order").alias("__order"), F.when(F.col("fits"), FIRST).otherwise(LAST).cast("long").alias("__bucket"))


def plan_mix(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rules) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken, positions (ascending training positions of the copies)."""
    order = F.xxhash64(F.lit(seed), id_key(id_col), F.col(text_col).cast("string"))  # rows without an id, or of one, are spread by their texts
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_of(text_col)).alias("size"), order.alias("__order"))
    rows = cut(rows)  # ids and sizes; the texts are read once
    n = rows.count()
    per = max(6, min(24, (max(1, n) // 20_000).bit_length()))
    goals = cut(targets(rows.select("source", "size"), **rules))
    total_of = goals.select(F.col("source").alias("__of"), F.col("source_size").alias("__total"))
    if goals.count() <= MOST_BROADCAST:
        total_of = F.broadcast(total_of)
    known = rows.join(total_of, F.col("source").eqNullSafe(F.col("__of"))).withColumn("__large", F.col("size") * LARGE > F.col("__total")).drop("__of", "__total")
    few = known.filter("NOT __large").select("doc_id", "source", "size", F.shiftleft("__order", per).alias("__order"), F.shiftrightunsigned("__order", 64 - per).alias("__bucket"))
    rows = cut(few.unionByName(chosen_large(known.filter("__large").drop("__large"), goals)))
    sums = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__source"), F.col("__bucket").alias("__at"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__base"))
    sums = sums.join(goals, F.col("__source").eqNullSafe(F.col("source"))).drop("source")
    inner = Window.partitionBy("source", "__bucket").orderBy(F.shiftrightunsigned("__order", 1), "__order", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__upto", F.sum("size").over(inner))
    own = summed.join(sums, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__at") == F.col("__bucket")))
    middle = F.col("__base") + F.col("__upto") - F.col("size") / F.lit(2.0)
    total, target, slope = F.col("source_size"), F.col("target"), F.col("slope")
    passes = F.floor(target / total + F.lit(1e-12)).cast("int")
    rest = target - passes * total
    copies = F.when((F.col("size") > 0) & (target > 0), passes + F.when(middle < rest, 1).otherwise(0)).otherwise(0)
    own = own.withColumn("copies", F.least(copies, F.lit(2)).cast("int")).withColumn("__middle", middle)
    at = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: position(F.col("__middle") + k * total, target, slope))
    positions = F.when(F.col("copies") > 0, at).otherwise(F.array().cast("array<double>"))
    return own.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), positions.alias("positions"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The documents' rows as the mix takes them, repeated, range-sorted by training position.

    Rows are told apart by id and text; rows equal in both are taken alike.
    """
    key, places, place = free(docs, "__key", "__positions", "__position")
    keyed = docs.withColumn(key, F.xxhash64(row_id(id_col, text_col), F.col(text_col).cast("string")))
    plan = plan_mix(keyed, id_col=key, text_col=text_col, **rules).filter("copies > 0").groupBy("doc_id").agg(F.min("positions").alias(places))
    met = keyed.join(plan.withColumnRenamed("doc_id", key), key).withColumn(place, F.explode(places))
    return met.repartitionByRange(place, key).sortWithinPartitions(place, key).select(*columns_of(docs))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "positions")
