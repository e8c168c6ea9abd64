"""Data sets: candidate merging, preference pairs, splits, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .pairs import all_metrics as pair_metrics
from .positions import with_position
from .verdicts import bad, clean, default_verdict


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last in ``order``; combines map-side."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def merge_candidates(rows: DataFrame) -> DataFrame:
    """rows (key, src, cands, file, line): arrays of a key joined in order of file and line; src from the first."""
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("file", "line", "cands"))).alias("__a"), F.min_by("src", F.struct("file", "line")).alias("src")).select("key", "src", F.flatten(F.col("__a.cands")).alias("cands"))


def not_done(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.join(done.select(*keys), keys, "left_anti")


def struct_score() -> Column:
    c = F.col
    return c("align_sim") + c("copy") + 0.5 * c("one_to_one") + 0.5 * (1 - c("coverage")) + (1 - c("format_recall"))


def in_band(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """rows (src, text, ...) with ``in_band``: by the profile of src or of its alias; without a profile, true."""
    alias = F.create_map(*[F.lit(x) for pair in fixed.STYLE_ALIASES.items() for x in pair])
    own = lambda tag: profile.select(F.col("src").alias(f"__{tag}"), F.struct("msl_q1", "msl_q3", "long_q3", "short_q3").alias(f"__p{tag}"))
    met = rows.join(own("a"), F.col("src") == F.col("__a"), "left").join(own("b"), F.get(F.array(alias[F.col("src")]), F.lit(0)) == F.col("__b"), "left")
    p, s = F.coalesce("__pa", "__pb"), F.col("__s")
    inside = s["mean"].between(p["msl_q1"], p["msl_q3"]) & (s["long"] <= F.greatest(p["long_q3"], F.lit(0.05))) & (s["short"] <= F.greatest(p["short_q3"], F.lit(0.05)))
    return met.withColumn("__s", text.style_stats(F.col("text"))).withColumn("in_band", F.when(p.isNull(), True).otherwise(inside)).drop("__a", "__b", "__pa", "__pb", "__s")


def choose(rows: DataFrame, structure: bool = False) -> DataFrame:
    """rows (key, i, clean, bad, in_band, fact_recall, metrics, verdict flags) to (key, chosen, rejected, band): positions i.

    One shuffle by key.  Chosen: among clean rows (those in band, if any), those within .05 of the best fact recall,
    the least copied; rejected: the worst of the bad ones.  Ties go to the smallest i.
    """
    key = Window.partitionBy("key")
    c = F.col
    pooled = rows.withColumn("__band", F.max(F.when(c("clean"), c("in_band").cast("int")).otherwise(0)).over(key))
    pooled = pooled.withColumn("__pool", c("clean") & ((c("__band") == 0) | c("in_band")))
    pooled = pooled.withColumn("__pool", c("__pool") & (c("fact_recall") >= F.max(F.when(c("__pool"), c("fact_recall"))).over(key) - 0.05))
    value = struct_score() if structure else c("copy")
    false = lambda k: F.coalesce(c(k), F.lit(False))
    worst = F.struct((F.coalesce(c("severity"), F.lit("")) == "critical").alias("a"), false("identity").alias("b"), false("meaning_changed").alias("c"), (~F.coalesce(c("facts_all_kept"), F.lit(True))).alias("d"), false("added_content").alias("e"), (-c("i")).alias("f"))
    got = pooled.groupBy("key").agg(
        F.min(F.when(c("__pool"), F.struct(value.alias("v"), c("i").alias("i")))).alias("best"),
        F.max(F.when(c("bad"), worst)).alias("worst"),
        F.max("__band").alias("__band"),
    )
    return got.select("key", c("best.i").alias("chosen"), (-c("worst.f")).alias("rejected"), (c("__band") == 1).alias("band"))


def preference_pairs(chosen: DataFrame) -> DataFrame:
    return chosen.filter("chosen IS NOT NULL AND rejected IS NOT NULL").select("key", "chosen", "rejected")


def build_preferences(cands: DataFrame, inputs: DataFrame, verdicts: DataFrame, tag: str, profile: DataFrame | None = None, tiers: bool = False, identity_bad: bool = False, structure: bool = False) -> tuple[DataFrame, DataFrame]:
    """Preference pairs with their texts and metrics, and the choice by key that ``funnel`` counts.

    cands: key, src, cands (an array); inputs: key, draft; verdicts: key, i, verdict (a struct).  Candidates without a
    verdict take no part; keys without an input
    neither; a blank candidate needs no verdict to be bad; a key without candidates that take part has no clean one.
    """
    drafts = cands.select("key", "src", "cands").join(inputs.select("key", "draft"), "key")
    rows = drafts.select("key", "src", "draft", F.posexplode("cands").alias("i", "text")).join(verdicts.select("key", "i", "verdict"), ["key", "i"], "left")
    rows = rows.select("key", "src", "draft", "i", "text", default_verdict(F.col("text"), F.col("verdict"), verdicts.schema["verdict"].dataType.names).alias("verdict")).filter("verdict IS NOT NULL")
    measured = pair_metrics(rows.select(F.struct("key", "i", "src", "text", "verdict").alias("pair_id"), "draft", F.col("text").alias("output")))
    flat = measured.select("pair_id.key", "pair_id.i", "pair_id.src", "pair_id.text", "pair_id.verdict.*", *[c for c in measured.columns if c != "pair_id"])
    flat = in_band(flat, profile) if profile is not None else flat.withColumn("in_band", F.lit(False))
    judged = flat.withColumns({"clean": clean(tiers), "bad": bad(tiers, identity_bad)})
    choice = drafts.select("key").distinct().join(choose(judged, structure), "key", "left")
    own = judged.select("key", "i", "src", "text", "copy", "align_sim", "one_to_one", "coverage", "fact_recall", "format_recall", "evidence")
    best = own.select("key", F.col("i").alias("chosen"), "src", F.col("text").alias("__chosen"), F.col("copy").alias("chosen_copy"), F.col("align_sim").alias("chosen_align"), F.col("one_to_one").alias("chosen_1to1"), F.col("coverage").alias("chosen_cov"), F.col("fact_recall").alias("chosen_facts"), F.col("format_recall").alias("chosen_fmt"))
    worst = own.select("key", F.col("i").alias("rejected"), F.col("text").alias("__rejected"), F.left(F.coalesce("evidence", F.lit("")), F.lit(120)).alias("rejected_reason"))
    pairs = preference_pairs(choice).join(best, ["key", "chosen"]).join(worst, ["key", "rejected"]).join(inputs.select("key", "draft"), "key")
    numbers = ["chosen_copy", "chosen_align", "chosen_1to1", "chosen_cov", "chosen_facts", "chosen_fmt"]
    return pairs.select(text.prompt(F.col("draft")).alias("prompt"), F.col("__chosen").alias("chosen"), F.col("__rejected").alias("rejected"), "key", "src", *numbers, "rejected_reason", F.lit(f"dpo:{tag}").alias("provider")), choice


def funnel(chosen: DataFrame) -> DataFrame:
    """Counters; a key without clean rows is counted there only, and all_clean always equals no_bad."""
    c = F.col
    no_bad = c("chosen").isNotNull() & c("rejected").isNull()
    pair = c("chosen").isNotNull() & c("rejected").isNotNull()
    return chosen.agg(F.count_if(pair).alias("pairs"), F.count_if(c("chosen").isNull()).alias("no_clean"), F.count_if(no_bad).alias("no_bad"), F.count_if(no_bad).alias("all_clean"), F.count_if(pair & c("band")).alias("style_band"))


def shard(df: DataFrame, order: list[str], k: int, m: int) -> DataFrame:
    return with_position(df, order, "__at").filter(F.col("__at") % m == k).drop("__at")


def shuffled(df: DataFrame, key: str, seed: int, limit: int | None = None) -> DataFrame:
    """``df`` with ``position`` in a reproducible order by the MD5 of seed and key, and only the first ``limit`` rows if given.

    Not the permutation of any other library.
    """
    mark = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.lit(15)), 16, 10).cast("long")
    rows = with_position(df.withColumn("__mark", mark), ["__mark", key]).drop("__mark")
    return rows if limit is None else rows.filter(F.col("position") < limit)


def row_split(df: DataFrame, order: list[str]) -> DataFrame:
    """``side``: the first min(300, max(40, n div 20)) rows are for evaluation."""
    n = df.count()
    return with_position(df, order, "__at").withColumn("side", F.when(F.col("__at") < min(300, max(40, n // 20)), "eval").otherwise("train")).drop("__at")


def group_split(df: DataFrame, order: str, group_text: str) -> DataFrame:
    """``side`` by groups of equal normalised text, in order of first sight; a group is never split.

    At most 500 groups go to evaluation, so their keys are few.
    """
    rows = df.withColumn("__g", text.group_key(F.col(group_text)))
    groups = rows.groupBy("__g").agg(F.min(order).alias("__first"))
    n, n_groups = rows.count(), groups.count()
    wanted = min(500, max(40, n // 20))
    take = min(n_groups, -(-wanted // max(1, n // max(1, n_groups)))) if n else 0
    chosen = groups.orderBy("__first", "__g").limit(take).select("__g", F.lit("eval").alias("__side"))
    return rows.join(F.broadcast(chosen), "__g", "left").withColumn("side", F.coalesce("__side", F.lit("train"))).drop("__g", "__side")


def leaks(split: DataFrame, group_text: str) -> DataFrame:
    """Normalised texts on both sides; must be none."""
    side = lambda s: split.filter(F.col("side") == s).select(text.normalised(F.col(group_text)).alias("t"))
    return side("eval").intersect(side("train"))


def check_split(split: DataFrame, group_text: str, least: int = 40) -> DataFrame:
    """Raise if a text is on both sides, or evaluation has under ``least`` rows."""
    if not leaks(split, group_text).isEmpty():
        raise ValueError("texts on both sides of the split")
    if (n := split.filter("side = 'eval'").count()) < least:
        raise ValueError(f"{n} rows for evaluation, fewer than {least}")
    return split


def check_filled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Raise if a column is null or empty in any row."""
    lacking = F.lit(False)
    for c in cols:
        lacking = lacking | F.coalesce(F.col(c).cast("string"), F.lit("")).eqNullSafe("")
    if not df.filter(lacking).isEmpty():
        raise ValueError(f"rows without {cols}")
    return df


def ledger_filter(df: DataFrame) -> DataFrame:
    return df.filter(F.size("facts").between(2, 30) & (F.length("draft") <= 6000))


def drop_over_length(df: DataFrame, cols: list[str], most: int) -> DataFrame:
    """Words stand in for the tokens of a tokenizer."""
    n = sum((F.size(F.split(F.trim(F.col(c)), r"\s+")) for c in cols), F.lit(0))
    return df.filter(n <= most)


def step_log(log: DataFrame) -> DataFrame:
    return log.groupBy("step").agg(F.avg("reward").alias("mean_reward"), F.min("reward").alias("min_reward"), F.max("reward").alias("max_reward"), F.count_if(F.col("hard").isNotNull()).alias("hard_fails"), F.count_if(F.col("judge_failed") if "judge_failed" in log.columns else F.col("reward").isNull()).alias("judge_fails"), F.sum("critical").alias("critical"), F.sum("minor").alias("minor"))
