"""Canonical exact digests of documents.

A text is folded (NFKC, lower case, white space runs to one space, trimmed) and hashed to 128 bits by two
seeded xxhash64.  Texts that meet in one bucket are then compared byte by byte; should a bucket hold different
folded texts, its members' digests are extended by SHA-256, so equal digests mean equal folded texts.

Scale: buckets are counted on hashes alone; only texts of buckets with two rows or more are shuffled for the
comparison.  A bucket with a third of all rows is no hot spot: the rows of heavy buckets (fewer than HEAVY, by
counting) are dealt over SALTS parts, each part compared by itself as a minimum and a maximum, then the parts.

Defined results: null text counts as empty; rows with equal ids are separate rows; a null id sorts before the
others; empty tables give no rows; extra columns are ignored (or carried along, by ``fingerprint``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HEAVY, NULL_ID, columns_of, cut, id_bounds, id_key, range_of, table, text_of

#: White space after NFKC: Java's \s and the separators that NFKC leaves.
SPACE = r"[\s\x85\x{1680}\x{2028}\x{2029}]+"
#: Digests of buckets (of several rows, or that clash) up to which they are broadcast, 32 bytes each.
MOST_BROADCAST = 1_000_000
#: Parts of a heavy bucket.
SALTS = 256


def fold(text: Column) -> Column:
    """NFKC by the ICU that Spark ships, lower case, one space for white space, trimmed."""
    ascii_only = F.octet_length(text) == F.length(text)
    nfkc = F.when(ascii_only, text).otherwise(F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))
    return F.trim(F.regexp_replace(F.lower(nfkc), SPACE, " "))


def digest(folded: Column) -> Column:
    """128 bits as 32 hex digits; the second half is seeded by the length and a tag."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(folded)), half(F.xxhash64(F.lit("second half"), F.octet_length(folded), folded)))


def collisions(rows: DataFrame, folded: str, mark: str) -> DataFrame:
    """Digests (column ``mark``) whose bucket holds different folded texts; as a rule none."""
    several = cut(rows.groupBy(mark).agg(F.count("*").alias("__n")).filter("__n > 1"))
    size = several.agg(F.sum("__n").alias("rows"), F.count("*").alias("buckets")).first()
    several = several.select(F.col(mark).alias("__mark"), (F.col("__n") * HEAVY > (size["rows"] or 0)).alias("__heavy"))
    part = F.when(F.col("__heavy"), F.spark_partition_id() % SALTS).otherwise(0)
    own = rows.select(F.col(mark).alias("__mark"), folded)
    if size["buckets"] <= MOST_BROADCAST:  # texts of single buckets aren't shuffled
        met = own.join(F.broadcast(several), "__mark").withColumn("__part", part)
    else:
        own = own.join(F.broadcast(several.filter("__heavy")), "__mark", "left").withColumn("__part", part).drop("__heavy")
        parts = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        met = own.join(several.withColumn("__part", F.explode(parts)), ["__mark", "__part"])
    by_part = met.groupBy("__mark", "__part", "__heavy").agg(F.min(folded).alias("__a"), F.max(folded).alias("__b"))
    # most buckets have one part and need no second comparison
    return by_part.filter("__heavy OR __a <> __b").groupBy("__mark").agg(F.min("__a").alias("__a"), F.max("__b").alias("__b")).filter("__a <> __b").select("__mark")


def told_apart(rows: DataFrame, folded: str, mark: str, clashing: DataFrame) -> DataFrame:
    """Extend the digests of buckets whose folded texts differ; without such buckets nothing is joined."""
    n = clashing.count()
    if n == 0:
        return rows
    clash = clashing.select(F.col("__mark"), F.lit(True).alias("__clash"))
    if n <= MOST_BROADCAST:
        clash = F.broadcast(clash)
    long = F.concat(F.col(mark), F.lit("-"), F.sha2(F.col(folded), 256))
    return rows.join(clash, F.col(mark) == F.col("__mark"), "left").withColumn(mark, F.when(F.col("__clash"), long).otherwise(F.col(mark))).drop("__mark", "__clash")


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the exact digest of its text in ``out`` (in place of a column of that name); other columns stay, whatever their names."""
    kept = [c for c, name in zip(columns_of(docs), docs.columns) if name.lower() != out.lower()]
    packed = docs.select(F.struct(*kept).alias("__all"), fold(text_of(text_col)).alias("__folded"))
    rows = packed.withColumn("__digest", digest(F.col("__folded")))
    marked = told_apart(rows, "__folded", "__digest", cut(collisions(rows, "__folded", "__digest")))
    return marked.select("__all.*", F.col("__digest").alias(out))


def next_ids(ids: DataFrame, key: str) -> DataFrame:
    """``ids`` (distinct in ``key``) with the next larger key as ``__next``; after the last comes the first.

    Ranges cut at values that occur, so the next of a range's last key is the next range's first.
    """
    bounds = id_bounds(ids, key, ids.count())
    if not bounds:
        return ids.withColumn("__next", F.col(key))
    firsts = F.array(*[F.lit(b).cast("long") for b in [*bounds[1:], bounds[0]]])
    ranged = ids.withColumn("__range", range_of(F.col(key), bounds))
    after = F.lead(key).over(Window.partitionBy("__range").orderBy(key))
    return ranged.withColumn("__next", F.coalesce(after, F.get(firsts, F.col("__range")))).drop("__range")


def with_next(docs: DataFrame, clashing: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ``mark`` (its digest), ``next_mark`` (the next id's) and ``next_head``: the next id's text, cut to a
    quarter of the own text's code points.

    (Its smallest text, should the next id repeat.)  Texts are folded and shuffled once, by id; both sides of the join
    read that exchange, and only heads are shuffled again.  The rows of heavy ids (fewer than HEAVY, by counting; rows
    without an id are one) are dealt over SALTS parts by their texts.
    """
    rows = docs.select(id_key(id_col).alias("__key"), text_of(text_col).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    ids = cut(rows.select("__key", quarter.alias("__q")).groupBy("__key").agg(F.max("__q").alias("__q"), F.count("*").alias("__n")))
    n = ids.agg(F.sum("__n")).first()[0] or 0
    heavy = [r["__key"] for r in ids.filter((F.col("__n") * HEAVY > n) & (F.col("__n") > 1)).select("__key").collect()]  # HEAVY at most
    hot = lambda key: F.col(key).isin(heavy) if heavy else F.lit(False)
    order = next_ids(ids.drop("__n"), "__key").select(F.col("__key").alias("__of"), "__q", "__next")
    folded = rows.withColumn("__folded", fold(F.col("text"))).withColumn("mark", digest(F.col("__folded")))
    folded = told_apart(folded, "__folded", "mark", clashing).select("__key", "text", "mark")
    if heavy:
        folded = folded.withColumn("__part", F.when(hot("__key"), F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).otherwise(0))
    keys = ["__key", "__part"] if heavy else ["__key"]
    dealt = folded.repartition(*keys)
    first = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("text")))
    if heavy:  # compared with the window's output, so that no filter gets below the exchange, which is shared
        of_part = first.filter(F.col("__n") == F.when(hot("__key"), 1).otherwise(-1))  # fewer than HEAVY * SALTS rows
        parts = of_part.groupBy("__key").agg(F.min(F.struct("text", "mark")).alias("x")).select("__key", "x.text", "x.mark")
        first = first.filter(F.col("__n") == F.when(hot("__key"), -1).otherwise(1)).select("__key", "text", "mark").unionByName(parts)
    else:
        first = first.filter("__n = 1")
    heads = first.join(order, F.col("__key") == F.col("__next")).select("__of", F.substring("text", F.lit(1), F.col("__q")).alias("__head"), F.col("mark").alias("next_mark"))
    on = F.col("__key") == F.col("__of")
    if heavy:
        heads = heads.withColumn("__to", F.explode(F.when(hot("__of"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        on = on & (F.col("__part") == F.col("__to"))
    met = dealt.join(heads, on)
    return met.select(F.nullif("__key", F.lit(NULL_ID)).alias("doc_id"), "text", "mark", F.substring("__head", F.lit(1), quarter).alias("next_head"), "next_mark")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text and of its edited form; likeness is 1 where folded bytes are equal, else 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = docs.select(fold(text_of()).alias("__folded")).withColumn("__digest", digest(F.col("__folded")))
    clashing = cut(collisions(own, "__folded", "__digest"))
    rows = with_next(docs, clashing).withColumn("n_chars", F.length("text").cast("long"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    rows = rows.withColumn("__edited", F.concat(F.substring("text", F.lit(1), kept), F.col("next_head")))
    rows = rows.select("doc_id", "n_chars", "text", "next_mark", F.col("mark").alias("fingerprint"), F.sha2("__edited", 256).alias("edited_sha256"), fold(F.col("__edited")).alias("__edited_folded"))
    rows = told_apart(rows.withColumn("edited_fingerprint", digest(F.col("__edited_folded"))), "__edited_folded", "edited_fingerprint", clashing)
    # bytes are compared, but only where digests are equal
    near_edited = F.when(F.col("fingerprint") == F.col("edited_fingerprint"), (fold(F.col("text")) == F.col("__edited_folded")).cast("double")).otherwise(0.0)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        near_edited.alias("near_edited"),
        (F.col("fingerprint") == F.col("next_mark")).cast("double").alias("near_next"),
    )
