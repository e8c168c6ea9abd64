"""Rewards: verdicts and reuse folded into a number, and what training derives from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .positions import with_position
from .verdicts import FACT_KEPT, is_false, truthy, wrong


def copy_penalty(reuse: Column, weight: float = 8.0) -> Column:
    over = F.greatest(F.lit(0.0), (reuse.cast("double") - fixed.REUSE_FREE) / F.lit(1 - fixed.REUSE_FREE))
    return F.least(F.lit(weight), F.lit(weight) * F.pow(over, F.lit(fixed.COPY_POWER)))


def hard_check(draft: Column, output: Column, degenerate: Column, copy: Column) -> Column:
    """Reason of a hard failure, first match; null where there is none."""
    return (
        F.when(F.coalesce(output, F.lit("")).rlike(r"(?U)^\s*$"), "empty")
        .when(truthy(degenerate), "degenerate")
        .when(copy > fixed.COPY_SKIP, F.format_string("copy %.2f", copy))
        .when(text.is_cjk(draft) != text.is_cjk(output), "language_switch")
    )


def fact_weight() -> Column:
    return F.when(F.lower(F.coalesce("severity", F.lit("critical"))) == "critical", fixed.W_CRITICAL).otherwise(fixed.W_MINOR)


def fact_sums(facts: DataFrame, keys: list[str]) -> DataFrame:
    status, w = F.lower("status"), fact_weight()
    wrong = status.isin("changed", "dropped")
    return facts.groupBy(*keys).agg(
        F.count_if(status == "changed").alias("changed"),
        F.count_if(status == "dropped").alias("dropped"),
        F.count_if(wrong & (w == fixed.W_CRITICAL)).alias("critical"),
        F.count_if(wrong & (w == fixed.W_MINOR)).alias("minor"),
    )


def folded(merged: DataFrame) -> DataFrame:
    """``merged`` (column ``verdict``, see verdicts.merge_facts) with the columns of ``score`` that come from it; ``judged``: there is one."""
    v = F.col("verdict")
    grade = lambda f: F.when(F.lower(F.coalesce(f["severity"], F.lit("critical"))) == "critical", True).otherwise(False)
    count = lambda test: F.coalesce(F.size(F.filter(v["facts"], test)), F.lit(0)).cast("long")
    return merged.withColumns(
        {
            "changed": count(lambda f: F.lower(f["status"]) == "changed"),
            "dropped": count(lambda f: F.lower(f["status"]) == "dropped"),
            "critical": count(lambda f: wrong(f["status"]) & grade(f)),
            "minor": count(lambda f: wrong(f["status"]) & ~grade(f)),
            "n_invented": F.coalesce(F.size(v["invented"]), F.lit(0)).cast("long"),
            **{k: v[k] for k in ("reversed_meaning", *FACT_KEPT)},
            "judged": v.isNotNull(),
        }
    )


def online(rows: DataFrame) -> DataFrame:
    """Rewards as training sees them: where the judge failed, ``JUDGE_FAILED`` instead of none, and ``judge_failed`` says so."""
    return rows.withColumn("judge_failed", F.col("reward").isNull()).withColumn("reward", F.coalesce("reward", F.lit(fixed.JUDGE_FAILED)))


def span_penalties(facts: DataFrame, invented: DataFrame, keys: list[str]) -> DataFrame:
    """keys, span, penalty: spans of wrong facts and inventions, stripped, non-empty, added up."""
    wrong = facts.filter(F.lower("status").isin("changed", "dropped")).select(*keys, "span", fact_weight().alias("w"))
    made = invented.select(*keys, "span", F.lit(fixed.W_INVENTED).alias("w"))
    both = wrong.unionByName(made).withColumn("span", F.trim("span")).filter("span <> ''")
    return both.groupBy(*keys, "span").agg(F.sum("w").alias("penalty"))


def score(rows: DataFrame, weight: float = 8.0) -> DataFrame:
    """rows: critical, minor, n_invented, reversed_meaning, register_kept, format_kept, greeting_signoff_kept, reuse, hard (null or reason), judged."""
    c = F.col
    lost = lambda k, w: F.when(is_false(c(k)), w).otherwise(0.0)
    total = 0.0 - (
        c("critical") * fixed.W_CRITICAL
        + c("minor") * fixed.W_MINOR
        + c("n_invented") * fixed.W_INVENTED
        + F.when(truthy(c("reversed_meaning")), fixed.W_REVERSED).otherwise(0.0)
        + lost("register_kept", fixed.W_REGISTER)
        + lost("format_kept", fixed.W_FORMAT)
        + lost("greeting_signoff_kept", fixed.W_GREETING)
        + c("copy_pen")
    )
    out = rows.withColumn("copy_pen", copy_penalty(c("reuse"), weight))
    return out.withColumn("reward", F.when(c("hard").isNotNull(), fixed.HARD_FAIL).when(c("judged"), total))


def renest(rows: DataFrame) -> DataFrame:
    """key, rewards: one array a key, in order of i."""
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "reward"))).alias("r")).select("key", F.col("r.reward").alias("rewards"))


def group_advantage(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("key")
    sd = F.stddev_samp("reward").over(w)
    return rows.withColumn("advantage", (F.col("reward") - F.avg("reward").over(w)) / (F.coalesce(sd, F.lit(0.0)) + F.lit(1e-4)))


def nll_floor(warm_up: DataFrame, nll: str = "nll") -> DataFrame:
    """The element at n div 2 of the sorted warm-up: the upper median, found by position; no task holds them all."""
    rows = warm_up.filter(F.col(nll).isNotNull()).select(F.col(nll).alias("floor"))
    return with_position(rows, ["floor"]).filter(F.col("position") == rows.count() // 2).select("floor")


def floor_penalty(rows: DataFrame, floor: DataFrame, weight: float = 1.0) -> DataFrame:
    """rows (key, nll): one-sided penalty, centred in its group."""
    p = rows.crossJoin(F.broadcast(floor)).withColumn("__p", F.greatest(F.lit(0.0), F.col("floor") - F.col("nll")))
    return p.withColumn("penalty", (F.col("__p") - F.avg("__p").over(Window.partitionBy("key"))) * weight).drop("__p", "floor")


def span_weights(tokens: DataFrame, spans: DataFrame, beta: float = 1.0) -> DataFrame:
    """tokens (key, t, start, end), spans (key, from, to, penalty): weights that add up to the number of tokens.

    A token counts with the largest relative penalty of the spans it overlaps.
    """
    top = Window.partitionBy("key")
    own = spans.withColumn("__rel", F.col("penalty") / F.max("penalty").over(top)).select(F.col("key").alias("__key"), "from", "to", "__rel")
    met = tokens.join(own, (F.col("key") == F.col("__key")) & (F.col("end") > F.col("from")) & (F.col("start") < F.col("to")), "left")
    hit = met.groupBy("key", "t").agg((1 + beta * F.coalesce(F.max("__rel"), F.lit(0.0))).alias("raw"))
    return hit.select("key", "t", (F.col("raw") * F.count("*").over(top) / F.sum("raw").over(top)).alias("weight"))


def sentence_span(low: Column, span: Column) -> Column:
    """struct(from, to) of the text from a span's first place to the end of its sentence (0-based, end exclusive); null if absent."""
    at = F.instr(low, F.lower(F.trim(span))) - 1
    n = F.length(F.trim(span))
    rest = F.substring(low, at + n + 1, F.length(low))
    ends = [F.when(F.contains(rest, F.lit(m)), at + n + F.position(F.lit(m), rest) - 1 + len(m)) for m in (". ", "! ", "? ", "\n", "。", "!", "?")]
    return F.when(at >= 0, F.struct(at.alias("from"), F.least(F.length(low), *ends).alias("to")))
