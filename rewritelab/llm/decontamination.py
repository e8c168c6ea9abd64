"""Benchmark decontamination by size-partitioned MinHash containment search.

Shingles are five words (the whole sequence, of fewer).  An item is in a document if at least 0.8 of its
distinct shingles are.  The search sketches the items, which are short, and probes with the documents, which
are long:

* Items are partitioned by the size of their shingle set.  All of a partition (m to 2m-1 shingles) get
  sketches of one size, k = floor(0.2 * (2m-1)) + 1 smallest MinHash values (at most all there are).  An item
  of a partition has at most floor(0.2 * size) shingles outside a document that contains it, fewer than k, so
  one value at least is met in the document: no contained item is missed, however long the document.
* Every shingle hash of every document probes the sketches, in one pass without a shuffle while the sketches
  are few (their number is counted first), by a shuffled join of hashes beyond.  What probes is a row of two
  numbers, so time is linear in a text's length.
* Documents that meet a sketch are read again, and their shingles, as words, are counted against the items':
  exact containment.

Scale: documents' texts are shuffled only if more than BROADCAST_KEYS documents meet a sketch, and then only theirs.
Documents are found again by a 64-bit hash of id and text; should two share one, both are counted exactly.

Defined results: null texts count as empty; items without words match nothing; documents without words match
nothing; a null id is an id; repeated ids give one row for each pair of ids, with the largest containment; extra
columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, cut, table, text_of

WORDS, SHARE = 5, 0.8
#: Up to this number of sketch values, and of bytes of the items' shingles, the items go to every executor.
BROADCAST_VALUES, BROADCAST_BYTES = 400_000, 128 << 20
#: Documents that meet a sketch, up to which their keys (a long each) go to every executor.
BROADCAST_KEYS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case words; an empty array without any."""
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def runs_of(items: Column) -> Column:
    """Structs 0 to 4 of all runs of five items; of fewer, one run with nulls behind; none without items."""
    n = F.greatest(F.size(items) - (WORDS - 1), F.lit(1))
    return F.arrays_zip(*[F.slice(items, F.lit(i + 1), n).alias(str(i)) for i in range(WORDS)])


def run_hash(run: Column | None = None) -> Column:
    """MinHash base value of a run of word hashes: a struct, or columns 0 to 4."""
    return F.xxhash64(*[F.col(str(i)) if run is None else run[str(i)] for i in range(WORDS)])


def run_text(run: Column) -> Column:
    return F.concat_ws(" ", *[run[str(i)] for i in range(WORDS)])


def sketches(items: DataFrame, item_id: str, text_col: str, share: float = SHARE) -> DataFrame:
    """__of (a number for each row of ``items``), __item, __n (its shingles), __shingles (distinct strings), __sketch (values)."""
    words = items.select(F.col(item_id).alias("__item"), words_of(text_of(text_col)).alias("__words")).filter(F.size("__words") > 0)
    hashed = words.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    sized = hashed.select(
        F.monotonically_increasing_id().alias("__of"),
        "__item",
        F.array_distinct(F.transform(runs_of(F.col("__words")), run_text)).alias("__shingles"),
        F.array_sort(F.array_distinct(F.transform(runs_of(F.col("__hashes")), lambda r: run_hash(r)))).alias("__values"),
    )
    size_class = F.floor(F.log2(F.size("__values"))).cast("int")
    largest = F.pow(F.lit(2), size_class + 1) - 1
    k = F.floor(F.lit(1 - share) * largest + F.lit(1e-9)).cast("int") + 1
    return sized.select("__of", "__item", F.size("__shingles").alias("__n"), "__shingles", F.slice("__values", F.lit(1), k).alias("__sketch"))


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_found, containment) with containment of at least ``share``."""
    sized = cut(sketches(items, item_id, text_col, share))
    size = sized.agg(F.sum(F.size("__sketch")).alias("n"), F.sum(F.octet_length(F.array_join("__shingles", " "))).alias("bytes")).first()
    few = (size["n"] or 0) <= BROADCAST_VALUES and (size["bytes"] or 0) <= BROADCAST_BYTES
    rows = docs.select(F.col(doc_id).alias("__doc"), text_of(text_col).alias("__text"))
    rows = rows.withColumn("__key", F.xxhash64("__doc", "__text"))

    hashed = rows.select("__key", F.transform(words_of(F.col("__text")), lambda w: F.xxhash64(w)).alias("__hashes"))
    probes = hashed.select("__key", F.inline(runs_of(F.col("__hashes")))).select("__key", run_hash().alias("__value"))
    values = sized.select("__of", F.explode("__sketch").alias("__value"))
    shingles = sized.select("__of", "__item", "__n", F.explode("__shingles").alias("__shingle"))
    if few:
        pairs = None
        keys = probes.join(F.broadcast(values.select("__value").distinct()), "__value", "left_semi").select("__key").distinct()
    else:
        pairs = cut(probes.distinct().join(values, "__value").select("__key", "__of").distinct())
        keys = pairs.select("__key").distinct()
    keys = cut(keys)
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    near = rows.join(keys, "__key").select(F.monotonically_increasing_id().alias("__row"), "__key", "__doc", words_of(F.col("__text")).alias("__words"))
    near = near.select("__row", "__key", "__doc", F.explode(F.array_distinct(F.transform(runs_of(F.col("__words")), run_text))).alias("__shingle"))
    if few:
        met = near.join(F.broadcast(shingles), "__shingle")
    else:  # a shingle that many items and documents share meets only within candidate pairs
        met = near.join(pairs, "__key").join(shingles, ["__of", "__shingle"])
    found = met.groupBy("__row", "__of").agg(F.first("__doc").alias("__doc"), F.first("__item").alias("__item"), F.first("__n").alias("__n"), F.count("*").cast("int").alias("__found"))
    return (
        found.filter(F.col("__found") >= F.lit(share) * F.col("__n"))
        .groupBy("__doc", "__item")
        .agg(F.max(F.struct(F.col("__found") / F.col("__n"), "__n", "__found")).alias("__best"))
        .select(
            F.col("__doc").alias(doc_id),
            F.col("__item").alias(item_id),
            F.col("__best.__n").alias("n_shingles"),
            F.col("__best.__found").alias("n_found"),
            (F.col("__best.__found") / F.col("__best.__n")).alias("containment"),
        )
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS f FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(f AS INTEGER) AS n_found, f / n AS containment
FROM m JOIN bn USING (item_id) WHERE f >= 0.8 * n
"""
