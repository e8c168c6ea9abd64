"""Guards against copying: prefix index, probe, resampling decisions, key-set difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

N = 4


def prefix_index(drafts: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """id, prefix (n-1 words), next: sorted distinct words that follow it in the draft; n-grams with a digit are exempt."""
    grams = drafts.select(F.col(id_col), F.explode(text.windows(text.words(F.col(text_col)), n)).alias("g")).filter(~F.exists("g", lambda w: w.rlike("[0-9]")))
    pairs = grams.select(id_col, F.array_join(F.slice("g", 1, n - 1), " ").alias("prefix"), F.element_at("g", -1).alias("w"))
    return pairs.groupBy(id_col, "prefix").agg(F.array_sort(F.collect_set("w")).alias("next"))


def probe(index: DataFrame, generated: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """Penalised next words of what has been generated, by its last n-1 words."""
    w = text.words(F.col(text_col))
    tail = generated.filter(F.size(w) >= n - 1).select(F.col(id_col), F.array_join(F.slice(w, -(n - 1), n - 1), " ").alias("prefix"))
    return tail.join(index, [id_col, "prefix"])


def adaptive(first: Column, second: Column, copied: Column, threshold: float = 0.35) -> Column:
    """Over the threshold the second sample replaces the first, whatever it is."""
    return F.when(copied > threshold, F.coalesce(second, first)).otherwise(first)


def best_of_two(first: Column, second: Column, copied_first: Column, copied_second: Column, threshold: float = 0.35) -> Column:
    return F.when((copied_first > threshold) & (copied_second < copied_first), second).otherwise(first)


def without_keys(tensors: DataFrame, dropped: DataFrame, expected: int, key: str = "name") -> DataFrame:
    """Rows whose key isn't in the drop list; the number of keys found must be the expected one."""
    found = tensors.join(dropped.select(key), key, "left_semi").count()
    if found != expected:
        raise ValueError(f"{found} keys to drop, expected {expected}")
    return tensors.join(dropped.select(key), key, "left_anti")
