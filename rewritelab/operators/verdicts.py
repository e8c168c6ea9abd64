"""Verdicts of judges: merging two votes, predicates, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT = ("facts_all_kept", "greeting_signoff_kept", "format_kept")
BAD = ("meaning_changed", "added_content", "identity")
#: Flags of a vote on facts that say what was kept.
FACT_KEPT = ("register_kept", "format_kept", "greeting_signoff_kept")
REQUIRED = (*KEPT, *BAD, "reads_like_person")


def is_false(c: Column) -> Column:
    return c.eqNullSafe(F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _rank(severity: Column) -> Column:
    return F.when(F.lower(severity) == "critical", 2).when(F.lower(severity) == "minor", 1).otherwise(0)


def merge_reviews(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two votes a row (column ``verdict``, null where the judge failed) to one: the milder severity, and a fault only if both see it.

    What is not merged is the first vote's, nulls included; ``raw`` keeps both votes.
    """
    met = a.select(*keys, F.col("verdict").alias("x")).join(b.select(*keys, F.col("verdict").alias("y")), keys, "full")
    x, y = F.col("x"), F.col("y")
    both, one = x.isNotNull() & y.isNotNull(), F.coalesce(x, y)
    sx, sy = F.coalesce(x["severity"], F.lit("none")), F.coalesce(y["severity"], F.lit("none"))
    said = lambda v: F.when(F.lower(v["evidence"]) != "none", F.nullif(v["evidence"], F.lit("")))
    votes = F.when(both, 2).when(x.isNotNull() | y.isNotNull(), 1)
    return met.select(
        *keys,
        F.when(both, F.when(_rank(sx) <= _rank(sy), sx).otherwise(sy)).otherwise(one["severity"]).alias("severity"),
        *[F.when(both, ~(is_false(x[k]) & is_false(y[k]))).otherwise(one[k]).alias(k) for k in KEPT],
        *[F.when(both, truthy(x[k]) & truthy(y[k])).otherwise(one[k]).alias(k) for k in BAD],
        F.when(both, F.coalesce(said(x), said(y), F.lit("none"))).otherwise(one["evidence"]).alias("evidence"),
        one["reads_like_person"].alias("reads_like_person"),
        one["padding"].alias("padding"),
        votes.alias("votes"),
        F.when(both, F.array(x, y)).alias("raw"),
    )


def wrong(status: Column) -> Column:
    return truthy(F.lower(status).isin("changed", "dropped"))


def merge_facts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two votes on facts (column ``verdict``: facts, invented, flags; null where the judge failed) to one.

    A fact is wrong only if both votes say so, and minor if either does; inventions and faults need both votes.
    Without a second vote the first stays as it is; without a first there is none.
    """
    met = a.select(*keys, F.col("verdict").alias("x")).join(b.select(*keys, F.col("verdict").alias("y")), keys, "left")
    x, y = F.col("x"), F.col("y")
    grade = lambda f: F.lower(F.coalesce(f["severity"], F.lit("critical")))
    names = [f.name for f in a.schema["verdict"].dataType["facts"].dataType.elementType.fields]

    def fact(f: Column) -> Column:
        other = F.try_element_at(F.filter(y["facts"], lambda g: g["id"].eqNullSafe(f["id"]) & wrong(g["status"])), F.lit(-1))
        stays = wrong(f["status"]) & other.isNotNull()
        kind = F.when((grade(f) == "minor") | (grade(other) == "minor"), "minor").otherwise("critical")
        own = {"status": F.when(stays, f["status"]).otherwise("kept"), "severity": F.when(stays, kind).otherwise(f["severity"])}
        return F.struct(*[own.get(n, f[n]).alias(n) for n in names])

    some = lambda v: F.coalesce(F.size(v["invented"]), F.lit(0)) > 0
    none = F.filter(x["invented"], lambda _: F.lit(False))
    both = F.struct(
        F.transform(x["facts"], fact).alias("facts"),
        F.when(some(x) & some(y), x["invented"]).otherwise(none).alias("invented"),
        (truthy(x["reversed_meaning"]) & truthy(y["reversed_meaning"])).alias("reversed_meaning"),
        *[(~(is_false(x[k]) & is_false(y[k]))).alias(k) for k in FACT_KEPT],
    )
    plain = F.struct(*[x[k].alias(k) for k in ("facts", "invented", "reversed_meaning", *FACT_KEPT)])
    return met.select(*keys, F.when(x.isNotNull(), F.when(y.isNull(), plain).otherwise(both)).alias("verdict"))


def clean(tiers: bool = False) -> Column:
    """Good enough to choose; any missing required field says no."""
    c = F.col
    there = F.lit(True)
    for k in (*REQUIRED, *(["severity"] if tiers else [])):
        there = there & c(k).isNotNull()
    good = c("facts_all_kept") & ~c("meaning_changed") & ~c("added_content") & ~truthy(c("padding")) & c("greeting_signoff_kept") & c("format_kept") & ~c("identity") & (c("reads_like_person") >= 4)
    good = good & ~truthy(c("degenerate")) & (F.coalesce(c("copy"), F.lit(0.0)) < 0.85) & (F.coalesce(c("lcs_content"), F.lit(0.0)) < 0.9)
    if tiers:
        good = good & (c("severity") == "none")
    return F.coalesce(there & good, F.lit(False))


def bad(tiers: bool = False, identity_bad: bool = True) -> Column:
    """Bad enough to reject; null facts count as lost."""
    c = F.col
    out = truthy(c("degenerate"))
    if identity_bad:
        out = out | truthy(c("identity")) | (F.coalesce(c("copy"), F.lit(0.0)) >= 0.85) | (F.coalesce(c("lcs_content"), F.lit(0.0)) >= 0.9)
    if tiers:
        return out | truthy(c("severity") == "critical") | is_false(c("format_kept"))
    return out | truthy(c("meaning_changed")) | truthy(c("added_content")) | ~truthy(c("facts_all_kept"))


#: What an empty candidate gets without asking a judge.
EMPTY_VERDICT = {"facts_all_kept": False, "meaning_changed": True, "added_content": False, "padding": False, "greeting_signoff_kept": False, "format_kept": False, "identity": False, "reads_like_person": 1, "severity": "critical", "evidence": "empty"}


def default_verdict(candidate: Column, verdict: Column, fields: list[str]) -> Column:
    fixed = F.struct(*[F.lit(EMPTY_VERDICT[f]).alias(f) for f in fields])
    return F.when(F.coalesce(candidate, F.lit("")).rlike(r"(?U)^\s*$"), fixed).otherwise(verdict)


def report(merged: DataFrame) -> DataFrame:
    """Counts over one run; judge failures (votes null) are counted apart."""
    c = F.col
    ok = merged.filter("votes IS NOT NULL")
    n = lambda x, name: F.count_if(x).alias(name)
    own = truthy(c("facts_all_kept")) & ~truthy(c("meaning_changed")) & ~truthy(c("added_content"))
    passes = truthy(c("facts_all_kept")) & ~truthy(c("added_content")) & truthy(c("greeting_signoff_kept")) & F.coalesce(c("format_kept"), F.lit(True)) & ~truthy(c("identity"))
    return ok.agg(
        F.count("*").alias("judged"),
        n(c("facts_all_kept"), "facts_kept"),
        n(c("meaning_changed"), "changed"),
        n(c("added_content"), "added"),
        n(is_false(c("greeting_signoff_kept")), "greeting_lost"),
        n(is_false(c("format_kept")), "format_lost"),
        n(c("identity"), "identical"),
        n(own, "clean"),
        n(passes, "passed"),
        n(c("votes") == 1, "single_vote"),
        n(c("severity") == "critical", "critical"),
        n(c("severity") == "minor", "minor"),
    )


def is_chinese_case(name: Column) -> Column:
    return name.rlike("^[ghj]_|_zh")
