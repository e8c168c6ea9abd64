"""Overlap of a draft and an output as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

WORDS, CHARACTERS = 5, 6


def _character_runs(t: Column) -> Column:
    letters = F.filter(F.split(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", ""), ""), lambda c: c != "")
    return F.filter(F.transform(text.windows(letters, CHARACTERS), lambda g: F.concat(F.lit("c:"), F.array_join(g, ""))), text.has_cjk)


def grams(t: Column, cjk: Column) -> Column:
    """Word 5-grams; with ``cjk`` also 6-character windows that hold a CJK character.  Prefixes keep the kinds apart."""
    own = F.transform(text.windows(text.words(t), WORDS), lambda g: F.concat(F.lit("w:"), F.array_join(g, " ")))
    return F.when(cjk, F.concat(own, _character_runs(t))).otherwise(own)


def gram_hashes(t: Column, cjk: Column) -> Column:
    """64-bit hashes, one for each of ``grams``; words are hashed once and a 5-gram is the hash of its words' hashes."""
    none = F.array().cast("array<int>")
    five = lambda x: lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(WORDS)])
    runs = lambda x: F.transform(F.when(F.size(x) >= WORDS, F.sequence(F.lit(0), F.size(x) - WORDS)).otherwise(none), five(x))
    own = text.let(F.transform(text.words(t), lambda w: F.xxhash64(w)), runs)
    return F.when(cjk, F.concat(own, F.transform(_character_runs(t), lambda g: F.xxhash64(g)))).otherwise(own)


def share_found(of: Column, among: Column) -> Column:
    """Share of the items of ``of``, repeats counted, that occur in ``among``; 0 without items."""
    share = lambda x, known: F.when(F.size(x) > 0, F.size(F.filter(x, lambda g: F.array_contains(known, g))) / F.size(x)).otherwise(0.0)
    return text.let(F.array_distinct(among), lambda known: text.let(of, lambda x: share(x, known)))


def share_met(of: Column, among: Column) -> Column:
    """``share_found`` for arrays of any length, none null: a binary search for each item in the sorted others."""

    def met(known: Column, steps: Column) -> Callable[[Column], Column]:
        below = lambda g: F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(known, low + s - 1) < g, low + s).otherwise(low))
        return lambda g: F.get(known, below(g)) == g

    def share(x: Column, known: Column) -> Column:
        powers = F.filter(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), lambda s: s <= F.size(known))
        return text.let(powers, lambda steps: F.when(F.size(x) > 0, F.size(F.filter(x, met(known, steps))) / F.size(x)).otherwise(0.0))

    return text.let(F.array_sort(F.array_distinct(among)), lambda known: text.let(of, lambda x: share(x, known)))


def copy_5gram(draft: Column, output: Column) -> Column:
    cjk = text.has_cjk(draft) | text.has_cjk(output)
    return share_found(grams(output, cjk), grams(draft, cjk))


def draft_coverage(draft: Column, output: Column) -> Column:
    cjk = text.has_cjk(draft) | text.has_cjk(output)
    return share_found(grams(draft, cjk), grams(output, cjk))


def skeleton_recall(draft: Column, output: Column) -> Column:
    a = F.transform(text.windows(text.skeleton(draft), WORDS), lambda g: F.array_join(g, " "))
    b = F.transform(text.windows(text.skeleton(output), WORDS), lambda g: F.array_join(g, " "))
    return F.when(~text.has_cjk(draft) & ~text.has_cjk(output), share_found(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def fact_recall(draft: Column, output: Column) -> Column:
    """Share of the draft's facts that are facts of the output, or stand in it without blanks; 1 without facts."""
    plain = F.regexp_replace(F.lower(F.coalesce(output, F.lit(""))), r"(?U)\s+", "")

    def share(own: Column, seen: Column) -> Column:
        kept = F.filter(own, lambda x: F.array_contains(seen["facts"], x) | F.contains(seen["plain"], F.replace(x, F.lit(","), F.lit(""))))
        return F.when(F.size(own) > 0, F.size(kept) / F.size(own)).otherwise(1.0)

    return text.let(F.struct(text.facts(output).alias("facts"), plain.alias("plain")), lambda seen: text.let(text.facts(draft), lambda own: share(own, seen)))


def para_kept(draft: Column, output: Column) -> Column:
    n = F.size(text.paragraphs(draft))
    return F.when(n < 2, 1.0).otherwise(F.least(F.lit(1.0), F.size(text.paragraphs(output)) / n))
