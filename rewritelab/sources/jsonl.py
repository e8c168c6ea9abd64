"""Sources and sinks: JSON lines, drafts in text files, whole JSON files, judges."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INPUTS = "key string, src string, draft string"
CANDIDATES = "key string, src string, cands array<string>, mode string"
REVIEW = "struct<facts_all_kept:boolean,meaning_changed:boolean,added_content:boolean,padding:boolean,greeting_signoff_kept:boolean,format_kept:boolean,identity:boolean,reads_like_person:int,severity:string,evidence:string>"
VERDICTS = f"key string, i int, verdict {REVIEW}"


def read_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with ``file`` and ``line``-order columns; malformed lines are dropped, or fail where ``strict``."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    df = spark.read.schema(schema).option("mode", mode).json(path)
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("line", F.monotonically_increasing_id())


def read_drafts(spark: SparkSession, folder: str) -> DataFrame:
    """case, draft: every .txt file as a row, stripped."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
    return df.select(name.alias("case"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("draft"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case, i, text, inv, copy, retried from a whole JSON object of arrays."""
    kind = "map<string,array<struct<text:string,inv:int,copy:double,retried:string>>>"
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", kind)).alias("case", "all"))
    return rows.select("case", F.posexplode("all").alias("i", "c")).select("case", "i", "c.*")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str, limit: int | None = None, order: list[str] | None = None) -> str:
    """Full results and limited ones never share a path.  A limit takes the first rows by ``order`` (by all columns, if none is named)."""
    target = path if limit is None else f"{path}_limit{limit}"
    (df if limit is None else df.orderBy(*(order or df.columns)).limit(limit)).write.mode("overwrite").json(target)
    return target


def backoff(attempt: int, reason: str) -> float | None:
    """Longer after an overloaded or failing server, shorter after an empty answer or a broken line; other refusals are final."""
    if reason.startswith("HTTP"):
        return 2.0 + 4 * attempt if reason[4:] in ("429", "500", "502", "503") else None
    return 1.0 + 2 * attempt


def judged(jobs: DataFrame, ask: Callable[[str], str | None], prompt_col: str = "prompt", tries: int = 3, workers: int | None = None, pause: Callable[[int, str], float | None] = backoff) -> DataFrame:
    """``jobs`` with ``answer``, by an injectable judge client (null after the last failure), and ``failures``, a reason for each.

    A reason is ``empty``, the error's status code as HTTP<code>, or the error's class; ``pause`` says by attempt and
    reason how many seconds to wait before the next one, or None to give up.  Counts of reasons are a group-by away.

    One client call a row inside mapInPandas; ``workers`` bounds concurrency by partitions.  Filter out
    rows that need no judge before this step: a CASE does not keep a Python stage from seeing them.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in jobs.dtypes) + ", answer string, failures array<string>"

    def once(p: str) -> tuple[str | None, list[str]]:
        failures: list[str] = []
        for attempt in range(tries):
            try:
                if a := ask(p):
                    return a, failures
                failures.append("empty")
            except Exception as e:  # a judge may fail in any way; the row then has no verdict
                code = getattr(e, "code", None)
                failures.append(type(e).__name__ if code is None else f"HTTP{code}")
            wait = pause(attempt, failures[-1])
            if wait is None:
                break
            if attempt + 1 < tries:
                time.sleep(wait)
        return None, failures

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [once(p) for p in b[prompt_col]]
            yield b.assign(answer=[a for a, _ in got], failures=[f for _, f in got])

    return (jobs.repartition(workers) if workers else jobs).mapInPandas(run, schema)
