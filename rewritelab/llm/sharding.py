"""Sharding by a keyed permutation of global row numbers.

Every row gets a global number (rank of its id, ties by content), a Feistel network permutes the numbers
and a permuted number p goes to shard p mod S, slot p div S.  The law that holds is ``rows``: shards differ
by one row at most and slots have no gaps.  The place of any row follows from its number, the number of
rows and the seed alone, so a trainer computes it, or its inverse, without a table.

A table that is stored in a meaningful order (the pipeline's, which is sorted by training position) is numbered as it
stands and permuted within windows, so that slots follow that order: see shard_stored.

Scale: only ids, sizes and checksums are shuffled, never texts, to ranges of (id, checksum, size); a count for each
range reaches the driver.  A stored order needs no shuffle at all.

Defined results: null text counts as empty; a null id sorts before the others; rows with equal ids are
numbered by checksum and size, and rows equal in these too are interchangeable; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, id_key, number_rows, stored_rows, table, text_of

ROUNDS = 6
#: For n <= 256 every cycle leaves the surplus within this many steps; beyond, all rows do but for a chance of n**-7.
WALKS = 16
SEED = 20240229
#: Slots of a window of a stored order.
WINDOW = 1024


def domain(n: int) -> tuple[int, int]:
    """Factors a, b of the smallest near-square domain that holds n numbers; a*b - n < a."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute_once(x: Column, a: int, b: int, seed: Column) -> Column:
    """One pass of a Feistel network over [0, a*b): the halves are x div b and x mod b, and take turns."""
    keys = F.array(*[F.struct(F.lit(i % 2 == 0).alias("left"), F.xxhash64(seed, F.lit(i)).alias("key")) for i in range(ROUNDS)])
    halves = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).cast("long").alias("r"))

    def step(s: Column, k: Column) -> Column:
        left = (s["l"] + F.pmod(F.xxhash64(k["key"], s["r"]), F.lit(a))) % F.lit(a)
        right = (s["r"] + F.pmod(F.xxhash64(k["key"], s["l"]), F.lit(b))) % F.lit(b)
        return F.struct(F.when(k["left"], left).otherwise(s["l"]).alias("l"), F.when(k["left"], s["r"]).otherwise(right).alias("r"))

    return F.aggregate(keys, halves, step, lambda s: s["l"] * F.lit(b) + s["r"])


def feistel(x: Column, n: int, seed: Column) -> Column:
    """A permutation of [0, n): values that leave [0, n) walk on along their cycle until they are back."""
    if n < 2:
        return x
    a, b = domain(n)
    walk = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), permute_once(x, a, b, seed), lambda y, _: F.when(y < F.lit(n), y).otherwise(permute_once(y, a, b, seed)))
    return F.when(walk < F.lit(n), walk).otherwise(F.raise_error(F.lit("cycle walking did not end: use another seed")).cast("long"))


def feistel_in_windows(x: Column, n: int, window: int, seed: int = SEED) -> Column:
    """A permutation of [0, n) that keeps every number in its window of ``window`` numbers; each window has its own keys."""
    whole = n // window * window
    own = F.floor(x / F.lit(window)).cast("long")
    inside = own * F.lit(window) + feistel(x % F.lit(window), window, F.xxhash64(F.lit(seed), own))
    last = F.lit(whole) + feistel(x - F.lit(whole), n - whole, F.lit(seed))
    return F.when(x < F.lit(whole), inside).otherwise(last) if whole else last


def placed(numbered: DataFrame, n: int, shards: int, row: str, seed: int = SEED, window: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, position (the permuted row number) of rows numbered 0 to n-1 in ``row``.

    Without ``window`` the permutation is over all rows.  With it, rows are permuted within windows of so many rows
    (a multiple of the shards), so that slots follow the order of the rows from window to window.
    """
    position = feistel(F.col(row), n, F.lit(seed)) if window is None else feistel_in_windows(F.col(row), n, window, seed)
    rows = numbered.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text_of(text_col)).cast("long") + 8).alias("size"),
        F.crc32(text_of(text_col)).alias("text_crc32"),
        position.alias("position"),
    )
    return with_shard(rows, shards)


def with_shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "position",
    )


def shard_rows(docs: DataFrame, shards: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``placed``; rows are numbered by id, then by checksum and size."""
    rows = docs.select(
        id_key(id_col).alias("__key"),
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text_of(text_col)).cast("long") + 8).alias("size"),
        F.crc32(text_of(text_col)).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["__key", "text_crc32", "size"])
    return with_shard(numbered.withColumn("position", feistel(F.col("__row"), n, F.lit(seed))), shards)


def shard_stored(docs: DataFrame, shards: int, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The columns of ``placed``, for a table whose stored order means something, say a curriculum: slots follow it.

    Rows are numbered as they are stored and permuted within windows of ``window`` slots of all shards.  Rows that
    come from no files are numbered by id.
    """
    row = free(docs, "__row")[0]
    try:
        numbered, n = stored_rows(docs, row)
    except AnalysisException:  # not a table of files: no stored order
        return shard_rows(docs, shards, seed)
    return placed(numbered, n, shards, row, seed, window * shards)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 24)


# The multipliers of XXH64, the table of CRC-32 by half bytes, and the hash states of the six round keys of SEED.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_CRC = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]
_STATES = [4024402156280981605, 5400790572861747350, 11585981684176798143, 1990837119967392506, 13834567707116448004, 1828109323872164131]


def _sql_add(x: str, y: int) -> str:
    return f"(({x}::UHUGEINT + {y}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _sql_times(x: str, y: int) -> str:
    return f"(({x}::UHUGEINT * {y}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _sql_turned(x: str, bits: int) -> str:
    return f"({_sql_times(x, 1 << bits)} | ({x} >> {64 - bits}))"


def _sql_hash(rows: str) -> str:
    """``rows`` with h7: the 64-bit hash of the unsigned x, from state s; one step a layer."""
    steps = [
        _sql_times("x", _P2),
        _sql_times(_sql_turned("h1", 31), _P1),
        f"xor({_sql_add('s', _P5 + 8)}, h2)",
        _sql_add(_sql_times(_sql_turned("h3", 27), _P1), _P4),
        _sql_times("xor(h4, h4 >> 33)", _P2),
        _sql_times("xor(h5, h5 >> 29)", _P3),
        "xor(h6, h6 >> 32)",
    ]
    for i, step in enumerate(steps, 1):
        rows = f"SELECT *, {step} AS h{i} FROM ({rows})"
    return rows


def _sql_mod(m: str) -> str:
    """h7 as a signed number, modulo m, not negative."""
    return f"(((h7::HUGEINT - CASE WHEN h7 >= 9223372036854775808::UBIGINT THEN 18446744073709551616::HUGEINT ELSE 0 END) % {m} + {m}) % {m})::BIGINT"


_WALKING = "SELECT walk.*, turn, s, (CASE WHEN turn % 2 = 0 THEN r ELSE l END)::UBIGINT AS x FROM walk JOIN states ON turn = i % 6 WHERE NOT (i > 0 AND i % 6 = 0 AND l * b + r < n)"

#: The same rows by DuckDB: a recursive query walks the rounds, six a pass, until the number is below n.
OP2_SQL = f"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
sums AS (
  SELECT doc_id::BIGINT AS doc_id, octet_length(encode(t))::BIGINT + 8 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all(hex(encode(t)), '..'),
      lambda p: [strpos('0123456789ABCDEF', p[2]) - 1, strpos('0123456789ABCDEF', p[1]) - 1]))),
      lambda c, x: xor(c >> 4, ({_CRC}::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM texts),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS nr, count(*) OVER () AS n FROM sums),
sides AS (SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM numbered),
states AS (SELECT unnest({_STATES}::UBIGINT[]) AS s, unnest(range(6)) AS turn),
walk AS (
  SELECT nr, n, a, (n + a - 1) // a AS b, nr // ((n + a - 1) // a) AS l, nr % ((n + a - 1) // a) AS r, 0 AS i FROM sides
  UNION ALL
  SELECT nr, n, a, b, CASE WHEN turn % 2 = 0 THEN (l + {_sql_mod("a")}) % a ELSE l END, CASE WHEN turn % 2 = 1 THEN (r + {_sql_mod("b")}) % b ELSE r END, i + 1
  FROM ({_sql_hash(_WALKING)}))
SELECT doc_id, size, text_crc32, 'rows' AS law, ((l * b + r) % 24)::INTEGER AS shard, (l * b + r) // 24 AS slot, NULL::INTEGER AS grown_shard, l * b + r AS position
FROM numbered JOIN (SELECT nr, l, r, b FROM walk WHERE i > 0 AND i % 6 = 0 AND l * b + r < n) USING (nr)
"""
