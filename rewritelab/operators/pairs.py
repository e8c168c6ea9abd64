"""(draft, output) pairs: where they come from and their metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import align, overlap, segment, text

METRICS = (
    "align_sim double, order_agree double, one_to_one double, coverage double, degenerate boolean, n_out int, n_draft int, copy_5gram double, draft_coverage double, verbatim_out double, verbatim_draft double, "
    "lcs_content double, fact_recall double, format_recall double, format_presence double, para_kept double, frag_coverage double, frag_density double, verbatim_sent double, copy double, skeleton_recall double, reuse double"
)


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, draft, output: each user turn with the assistant turn that follows it."""
    asked = conversations.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("draft"))
    answered = conversations.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("output"))
    return asked.join(answered, ["conv_id", "turn"]).select((F.col("conv_id") * 100_000 + F.col("turn")).alias("pair_id"), "draft", "output")


def swapped_halves(documents: DataFrame) -> DataFrame:
    """pair_id, draft, output: every document, and the same with its halves swapped."""
    half = F.floor(F.length("text") / 2).cast("int")
    return documents.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("draft"), F.concat(F.substring("text", half + 1, F.length("text")), F.lit(" "), F.left("text", half)).alias("output"))


def cheap_metrics(pairs: DataFrame) -> DataFrame:
    """The metrics that plain expressions compute, for short texts; unused ones are pruned."""
    d, o = F.col("draft"), F.col("output")
    return pairs.select(
        "pair_id",
        overlap.copy_5gram(d, o).alias("copy_5gram"),
        overlap.draft_coverage(d, o).alias("draft_coverage"),
        overlap.skeleton_recall(d, o).alias("skeleton_recall"),
        overlap.jaccard(text.content_tokens(d), text.content_tokens(o)).alias("jaccard"),
        overlap.fact_recall(d, o).alias("fact_recall"),
        overlap.para_kept(d, o).alias("para_kept"),
    )


def overlap_by_grams(pairs: DataFrame) -> DataFrame:
    """pair_id, copy_5gram, draft_coverage for texts of any length: grams meet by 64-bit hash inside the row, n log n, without a shuffle."""
    cjk = text.has_cjk(F.col("draft")) | text.has_cjk(F.col("output"))
    both = F.struct(overlap.gram_hashes(F.col("draft"), cjk).alias("d"), overlap.gram_hashes(F.col("output"), cjk).alias("o"))
    shares = text.let(both, lambda g: F.struct(overlap.share_met(g["o"], g["d"]).alias("copy_5gram"), overlap.share_met(g["d"], g["o"]).alias("draft_coverage")))
    return pairs.select("pair_id", shares.alias("s")).select("pair_id", "s.copy_5gram", "s.draft_coverage")


def all_metrics(pairs: DataFrame, body_only: bool = True) -> DataFrame:
    """pairs with the 22 metrics, by one Arrow pass."""

    @F.pandas_udf(METRICS)
    def metrics(draft: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for d, o in draft:
            yield pd.DataFrame([align.all_metrics(x, y, body_only) for x, y in zip(d, o)], columns=[c.split()[0] for c in METRICS.split(", ")])

    return pairs.withColumn("m", metrics("draft", "output")).select("pair_id", "m.*")


def copy_rate(metrics: DataFrame) -> DataFrame:
    """The eight-field summary; its copy_5gram is the composite."""
    novel = F.round(1 - F.col("copy"), 3).alias("novel_ratio")
    return metrics.select("pair_id", F.col("copy").alias("copy_5gram"), F.col("copy_5gram").alias("copy_5gram_raw"), "verbatim_sent", novel, F.col("n_out").alias("n_sent_out"), "align_sim", "order_agree", "one_to_one")


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, i, sentence."""

    @F.pandas_udf("array<string>")
    def cut(t: pd.Series) -> pd.Series:
        return t.map(segment.sentences)

    return docs.select(id_col, F.posexplode(cut(text_col)).alias("i", "sentence"))


def prose_and_structure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, prose, structure lines, and the older format lines."""

    @F.pandas_udf("prose string, structure array<string>, format_lines array<string>")
    def parts(t: pd.Series) -> pd.DataFrame:
        rows = [(*segment.split_prose(x), segment.split_format(x)[0]) for x in t]
        return pd.DataFrame(rows, columns=["prose", "structure", "format_lines"])

    return docs.withColumn("p", parts(text_col)).select(id_col, "p.*")


def align_structure(pairs: DataFrame) -> DataFrame:
    """Structure metrics on sentences cut at marks and line ends, all in SQL: joins, first argmax, neighbours.

    Sentences here end at [.!?] and blanks, or at a line end, and have three words.
    """
    from pyspark.sql import Window

    def cut(col: str, name: str) -> DataFrame:
        parts = F.filter(F.split(col, r"(?<=[.!?])\s+|\n+"), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 3)
        return pairs.select("pair_id", F.posexplode(parts).alias(name, "s")).select("pair_id", name, F.array_distinct(text.align_tokens(F.col("s"))).alias(f"{name}_bag"))

    drafts, outputs = cut("draft", "j"), cut("output", "i")
    score = overlap.jaccard(F.col("i_bag"), F.col("j_bag"))
    best = outputs.join(drafts, "pair_id").groupBy("pair_id", "i").agg(F.max(F.struct(score.alias("v"), (-F.col("j")).alias("back"))).alias("b")).select("pair_id", "i", F.col("b.v").alias("v"), F.when(F.col("b.v") > 0, -F.col("b.back")).alias("j"))
    near = best.withColumn("after", F.lead("j").over(Window.partitionBy("pair_id").orderBy("i")))
    hits = near.groupBy("pair_id", "j").agg(F.count("*").alias("n")).filter("j IS NOT NULL").groupBy("pair_id").agg(F.count("*").alias("matched"), F.count_if(F.col("n") == 1).alias("once"))
    rest = near.groupBy("pair_id").agg(F.avg("v").alias("align_sim"), F.coalesce(F.avg(F.when(F.col("j") != F.col("after"), (F.col("after") > F.col("j")).cast("double"))), F.lit(1.0)).alias("order_agree"))
    n = drafts.groupBy("pair_id").agg(F.count("*").alias("n_draft"))
    return rest.join(n, "pair_id").join(hits, "pair_id", "left").select("pair_id", "align_sim", "order_agree", F.coalesce(F.col("once") / F.col("matched"), F.lit(0.0)).alias("one_to_one"), (F.coalesce("matched", F.lit(0)) / F.col("n_draft")).alias("coverage"))
