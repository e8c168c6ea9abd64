"""Text functions as Spark columns: everything here stays on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _text(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def has_cjk(t: Column) -> Column:
    return _text(t).rlike(fixed.CJK)


def is_cjk(t: Column) -> Column:
    head = F.left(_text(t), F.lit(400))
    return F.regexp_count(head, F.lit(fixed.CJK)) > F.regexp_count(head, F.lit("[A-Za-z]{2,}"))


def strip_markup(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(t), fixed.BLOCK_TAG, "\n"), fixed.ANY_TAG, " ")


def words(t: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(_text(t)), "’‘`´", "''''"), F.lit("([a-z0-9']+)"), F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once: inside a lambda an outer expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(items: Column, n: int) -> Column:
    """All runs of n items; none where there are fewer (sequence would count down)."""
    empty = F.array().cast("array<int>")

    def runs(x: Column) -> Column:
        return F.transform(F.when(F.size(x) >= n, F.sequence(F.lit(1), F.size(x) - (n - 1))).otherwise(empty), lambda i: F.slice(x, i, n))

    return let(items, runs)


def content_tokens(t: Column) -> Column:
    """Words that are no stop words, then bigrams of all CJK characters in order."""
    own = F.filter(words(t), lambda w: ~w.isin(*fixed.STOP_WORDS))
    han = F.regexp_extract_all(_text(t), F.lit(f"({fixed.CJK})"), F.lit(1))
    return F.concat(own, F.transform(windows(han, 2), lambda p: F.array_join(p, "")))


def align_tokens(t: Column) -> Column:
    return F.filter(content_tokens(t), lambda w: ~w.rlike(f"^(?:{fixed.NUMBER_LIKE})$"))


def units(t: Column) -> Column:
    """What sentences are compared by: characters of CJK text, else words."""
    letters = F.filter(F.split(F.regexp_replace(F.lower(_text(t)), r"(?U)\s+", ""), ""), lambda c: c.rlike(r"^[\p{L}\p{N}]$"))
    return F.when(has_cjk(t), letters).otherwise(words(t))


def long_enough(t: Column) -> Column:
    return F.size(units(t)) >= F.when(has_cjk(t), 8).otherwise(5)


def skeleton(t: Column) -> Column:
    """Function words, punctuation and places of words (W) and numbers (N); null for CJK."""
    found = F.regexp_extract_all(_text(t), F.lit(r"([A-Za-z']+|[0-9][0-9,.%$]*|[^\sA-Za-z0-9])"), F.lit(1))
    kind = lambda w: F.when(w.rlike("^[A-Za-z']"), F.when(F.lower(w).isin(*fixed.STOP_WORDS), F.lower(w)).otherwise("W")).when(w.rlike("^[0-9]"), "N").otherwise(w)
    return F.when(~has_cjk(t), F.transform(found, kind))


def facts(t: Column) -> Column:
    """Hard facts: addresses, links, numbers (and the parts of ranges, times and fractions), capitals."""
    found = F.transform(F.regexp_extract_all(_text(t), F.lit(f"(?U)({fixed.FACT})"), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,;:)]+$", ""))
    number = lambda x: x.rlike(r"^(?U)\d+(?:[.,:/-]\d+)*%?$")
    plain = lambda x: F.when(number(x), F.replace(x, F.lit(","), F.lit(""))).otherwise(x)
    parts = lambda x: F.when(number(x), F.filter(F.split(F.regexp_replace(x, "%+$", ""), "[/:-]"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    each = F.transform(found, plain)
    return F.array_distinct(F.transform(F.concat(each, F.flatten(F.transform(each, parts))), F.lower))


def paragraphs(t: Column) -> Column:
    return F.filter(F.split(F.trim(strip_markup(t)), r"\n\s*\n"), lambda p: F.trim(p) != "")


def style_stats(t: Column) -> Column:
    """struct(mean, long, short): words a sentence, share over 30 words, share under 9; sentences have three words."""
    sizes = F.transform(F.split(_text(t), r"(?<=[.!?])\s+|\n+"), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    own = F.filter(sizes, lambda n: n >= 3)
    own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(0)))
    n = F.size(own)
    total = F.aggregate(own, F.lit(0), lambda a, x: a + x)
    return F.struct((total / n).alias("mean"), (F.size(F.filter(own, lambda x: x > 30)) / n).alias("long"), (F.size(F.filter(own, lambda x: x < 9)) / n).alias("short"))


def prompt(draft: Column) -> Column:
    return F.concat(F.lit(fixed.INSTRUCTION + "\n\n"), F.regexp_replace(_text(draft), r"(?U)^\s+|\s+$", ""), F.lit(fixed.SEPARATOR))


def prompt_fingerprint() -> Column:
    return F.left(F.sha2(prompt(F.lit("X")), 256), F.lit(16))


def salvage_json(t: Column) -> Column:
    """From the first { to the last }, parsed; null where that is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(_text(t), r"(?s)(\{.*\})", 1), F.lit("")))


def cut_at_stops(t: Column) -> Column:
    for stop in fixed.STOP_STRINGS:
        t = F.substring_index(t, stop, 1)
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def normalised(t: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(_text(t), r"(?U)\s+", " ")))


def group_key(t: Column) -> Column:
    """First normalised, then cut, then hashed: in this order twins meet."""
    return F.md5(F.left(normalised(t), F.lit(600)))


def generation_budget(t: Column) -> Column:
    n = F.size(F.filter(F.split(_text(t), r"(?U)\s+"), lambda w: w != ""))
    return F.greatest(F.lit(700), F.floor(n * F.lit(2.2)).cast("int") + 200)


def line_kind(line: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, pattern in fixed.LINE_KINDS:
        out = out.when(_text(line).rlike(pattern), kind)
    return out.when(_text(line).rlike(fixed.SIGNATURE), "signature").otherwise("other")


def line_shape(line: Column) -> Column:
    t = _text(line)
    return (
        F.when(t.rlike(fixed.SIGNATURE), "signature")
        .when(t.rlike("(?i)" + fixed.SIGN_OFF), "signoff")
        .when(t.rlike("(?i)" + fixed.GREETING), "greeting")
        .when(t.startswith("#") | (t.rlike(fixed.FIELD) & (F.length(t) <= 80)), "header")
        .when(t.rlike(fixed.LIST_ITEM), "list")
        .when(t.rlike(fixed.RULE_LINE) | (F.regexp_count(t, F.lit(r"\|")) >= 2), "table")
        .otherwise("other")
    )
