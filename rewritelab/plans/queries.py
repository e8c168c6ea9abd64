"""Registered queries, each over whole tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, overlap, text
from ..operators import datasets, guard, pairs, reward, verdicts
from ..operators.positions import with_position

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(items):
    return F.md5(F.array_join(items, "|"))


# ---- text ---------------------------------------------------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
_W = "regexp_extract_all(translate(lower(coalesce({t}, '')), '’‘`´', ''''''''''), '[a-z0-9'']+')"


def _of(template: str, t: str) -> str:
    return template.replace("{t}", t)


def _ascii(t: str) -> str:
    """For patterns with word edges: here they see ASCII only, so other letters become one."""
    return f"regexp_replace({t}, '[^\\x00-\\x7F]', 'z', 'g')"


_HAN = "[㐀-䶿一-鿿豈-﫿]"
_NUM = fixed.NUMBER_LIKE.replace("'", "''")


def _words(t: str = "text") -> str:
    return _of(_W, t)


def _content(t: str = "text") -> str:
    return f"list_concat(list_filter({_words(t)}, lambda w: w NOT IN ({_STOP})), [])"


@query(f"SELECT doc_id, len({_words()}) AS n_words, md5(array_to_string({_words()}, '|')) AS digest FROM documents")
def words(spark, sf):
    return _table(spark, sf, "documents").withColumn("w", text.words(F.col("text"))).select("doc_id", F.size("w").cast("long").alias("n_words"), _digest(F.col("w")).alias("digest"))


@query(f"SELECT doc_id, len({_content()}) AS n_tokens, md5(array_to_string({_content()}, '|')) AS digest, len(list_filter({_content()}, lambda w: NOT regexp_full_match(w, '{_NUM}'))) AS n_align FROM documents")
def content_tokens(spark, sf):
    d = _table(spark, sf, "documents").withColumn("w", text.content_tokens(F.col("text")))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), _digest(F.col("w")).alias("digest"), F.size(text.align_tokens(F.col("text"))).cast("long").alias("n_align"))


@query(f"""SELECT doc_id, regexp_matches(text, '{_HAN}') AS has_cjk,
 len(regexp_extract_all(left(text, 400), '{_HAN}')) > len(regexp_extract_all(left(text, 400), '[A-Za-z]{{2,}}')) AS is_cjk FROM documents""")
def text_flags(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.has_cjk(F.col("text")).alias("has_cjk"), text.is_cjk(F.col("text")).alias("is_cjk"))


_SKEL = f"""list_transform(regexp_extract_all({{t}}, '[A-Za-z'']+|[0-9][0-9,.%$]*|[^\\sA-Za-z0-9]'),
 lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z'']') THEN CASE WHEN lower(w) IN ({_STOP}) THEN lower(w) ELSE 'W' END WHEN regexp_matches(w, '^[0-9]') THEN 'N' ELSE w END)"""


_MIXED_SQL = "(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat(left(text, 60), '今天下午三点 we meet，第2次') WHEN 1 THEN concat('会议', chr(10), left(text, 20)) ELSE text END AS text FROM documents)"
_CJK_UNITS = f"CASE WHEN regexp_matches(text, '{_HAN}') THEN regexp_extract_all(lower(text), '[\\pL\\pN]') ELSE {_words()} END"


def _mixed(spark, sf) -> DataFrame:
    """Documents, some of which get Chinese words."""
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.left("text", F.lit(60)), F.lit("今天下午三点 we meet，第2次"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("会议\n"), F.left("text", F.lit(20)))).otherwise(F.col("text"))
    return _table(spark, sf, "documents").select("doc_id", t.alias("text"))


@query(f"""SELECT doc_id, regexp_matches(text, '{_HAN}') AS has_cjk, len(regexp_extract_all(left(text, 400), '{_HAN}')) > len(regexp_extract_all(left(text, 400), '[A-Za-z]{{{{2,}}}}')) AS is_cjk,
 md5(array_to_string({_CJK_UNITS}, '|')) AS units, len({_CJK_UNITS}) >= CASE WHEN regexp_matches(text, '{_HAN}') THEN 8 ELSE 5 END AS long_enough,
 CASE WHEN NOT regexp_matches(text, '{_HAN}') THEN md5(array_to_string({_of(_SKEL, 'text')}, ' ')) END AS skeleton,
 md5(array_to_string(list_concat(list_filter({_words()}, lambda w: w NOT IN ({_STOP})), list_transform(range(1, greatest(len(regexp_extract_all(text, '{_HAN}')), 1)), lambda i: regexp_extract_all(text, '{_HAN}')[i] || regexp_extract_all(text, '{_HAN}')[i + 1])), '|')) AS tokens FROM {_MIXED_SQL}""".replace("{{", "{").replace("}}", "}"))
def mixed_scripts(spark, sf):
    t = F.col("text")
    return _mixed(spark, sf).select(
        "doc_id",
        text.has_cjk(t).alias("has_cjk"),
        text.is_cjk(t).alias("is_cjk"),
        _digest(text.units(t)).alias("units"),
        text.long_enough(t).alias("long_enough"),
        F.md5(F.array_join(text.skeleton(t), " ")).alias("skeleton"),
        _digest(text.content_tokens(t)).alias("tokens"),
    )


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|blockquote)\b[^>]*>', chr(10), 'g'), '<[^<>]{1,60}>', ' ', 'g')) AS digest FROM pages""")
def strip_markup(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.md5(text.strip_markup(F.col("html"))).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN NOT regexp_matches(text, '{_HAN}') THEN md5(array_to_string({_of(_SKEL, 'text')}, ' ')) END AS digest FROM documents")
def skeleton(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(text.skeleton(F.col("text")), " ")).alias("digest"))


_FACTS_PATTERN = r"[\pL\pN_.+-]+@[\pL\pN_-]+\.[\pL\pN_.-]+|https?://\S+|www\.\S+|\d+(?:[.,:/-]\d+)*%?|\b[A-Z][A-Z0-9]{1,}\b"
_FACTS = rf"""list_distinct(list_transform(flatten(list_transform(
 list_transform(regexp_extract_all({{t}}, '{_FACTS_PATTERN}'), lambda x: regexp_replace(x, '[.,;:)]+$', '')),
 lambda x: CASE WHEN regexp_full_match(x, '\d+(?:[.,:/-]\d+)*%?') THEN list_concat([replace(x, ',', '')], list_filter(string_split_regex(rtrim(replace(x, ',', ''), '%'), '[/:-]'), lambda p: p <> '')) ELSE [x] END)), lambda x: lower(x)))"""


@query(f"SELECT doc_id, array_to_string(list_sort({_of(_FACTS, _ascii('text'))}), '|') AS facts FROM documents")
def facts(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(text.facts(F.col("text"))), "|").alias("facts"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))), lambda n: n >= 3) AS l FROM documents),
 t AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [0] END AS l FROM s)
 SELECT doc_id, list_sum(l) / len(l) AS mean_words, len(list_filter(l, lambda n: n > 30)) / len(l) AS long_share, len(list_filter(l, lambda n: n < 9)) / len(l) AS short_share FROM t""")
def style_stats(spark, sf):
    s = _table(spark, sf, "documents").select("doc_id", text.style_stats(F.col("text")).alias("s"))
    return s.select("doc_id", F.col("s.mean").alias("mean_words"), F.col("s.long").alias("long_share"), F.col("s.short").alias("short_share"))


@query(r"""SELECT doc_id, md5(left(lower(trim(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g'))), 600)) AS group_key,
 greatest(700, CAST(floor(len(list_filter(string_split_regex(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]+'), lambda w: w <> '')) * CAST(2.2 AS DOUBLE)) AS INTEGER) + 200) AS budget FROM documents""")
def text_keys(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.group_key(F.col("text")).alias("group_key"), text.generation_budget(F.col("text")).alias("budget"))


_PROMPT = fixed.INSTRUCTION.replace("'", "''")


@query(f"""SELECT doc_id, md5('{_PROMPT}' || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || '### Rewritten:' || chr(10) || chr(10)) AS prompt_md5,
 left(sha256('{_PROMPT}' || chr(10) || chr(10) || 'X' || chr(10) || chr(10) || '### Rewritten:' || chr(10) || chr(10)), 16) AS fingerprint FROM documents""")
def prompts(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(text.prompt(F.col("text"))).alias("prompt_md5"), text.prompt_fingerprint().alias("fingerprint"))


@query("""SELECT event_id, CASE WHEN json_valid(regexp_extract('said: ' || props || ' end', '(?s)(\\{.*\\})', 1)) THEN CAST(regexp_extract('said: ' || props || ' end', '(?s)(\\{.*\\})', 1) ->> '$.k' AS BIGINT) END AS k FROM events""".replace("\\\\", "\\"))
def json_salvage(spark, sf):
    raw = F.concat(F.lit("said: "), F.col("props"), F.lit(" end"))
    return _table(spark, sf, "events").select("event_id", F.try_variant_get(text.salvage_json(raw), "$.k", "bigint").alias("k"))


@query("""SELECT doc_id, md5(regexp_replace(left(t, CASE WHEN strpos(t, chr(10) || '### Rewritten:') > 0 THEN strpos(t, chr(10) || '### Rewritten:') - 1 ELSE length(t) END), '^\\s+|\\s+$', '', 'g')) AS digest
 FROM (SELECT doc_id, text || chr(10) || '### Rewritten:' || text AS t FROM documents)""")
def stop_cut(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(text.cut_at_stops(F.concat("text", F.lit("\n### Rewritten:"), "text"))).alias("digest"))


_LINES = """(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"""


def _sql_case(rules, other) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in rules) + f" ELSE {other} END"


_KIND_SQL = _sql_case([*fixed.LINE_KINDS, ("signature", fixed.SIGNATURE)], "'other'")
_SHAPE_SQL = (
    f"CASE WHEN regexp_matches(line, '{fixed.SIGNATURE}') THEN 'signature' WHEN regexp_matches(line, '(?i){fixed.SIGN_OFF}') THEN 'signoff' WHEN regexp_matches(line, '(?i){fixed.GREETING}') THEN 'greeting' "
    f"WHEN starts_with(line, '#') OR (regexp_matches(line, '{fixed.FIELD}') AND length(line) <= 80) THEN 'header' WHEN regexp_matches(line, '{fixed.LIST_ITEM}') THEN 'list' "
    f"WHEN regexp_matches(line, '{fixed.RULE_LINE}') OR length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' ELSE 'other' END"
)


@query(f"SELECT {_KIND_SQL} AS kind, {_SHAPE_SQL} AS shape, count(*) AS n FROM {_LINES} GROUP BY 1, 2")
def line_kinds(spark, sf):
    lines = _table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(text.line_kind(F.col("line")).alias("kind"), text.line_shape(F.col("line")).alias("shape")).agg(F.count("*").alias("n"))


# ---- pairs --------------------------------------------------------------------------------------------------
_PAIRS = """p AS (SELECT u.conv_id * 100000 + a.turn AS pair_id, u.text AS draft, a.text AS output FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _runs(items: str, n: int = 5) -> str:
    return f"list_transform(range(1, greatest(len({items}) - {n - 2}, 1)), lambda i: array_to_string({items}[i:i + {n - 1}], ' '))"


def _found(of: str, among: str) -> str:
    return f"CASE WHEN len({of}) > 0 THEN len(list_filter({of}, lambda x: list_contains({among}, x))) / len({of}) ELSE 0.0 END"


@query(f"""WITH {_PAIRS}, w AS (SELECT pair_id, {_words('draft')} AS dw, {_words('output')} AS ow FROM p), g AS (SELECT pair_id, {_runs('dw')} AS dg, {_runs('ow')} AS og FROM w)
SELECT pair_id, {_found('og', 'dg')} AS copy_5gram, {_found('dg', 'og')} AS draft_coverage FROM g""")
def copy_5gram(spark, sf):
    return pairs.cheap_metrics(pairs.turn_pairs(_table(spark, sf, "conversations"))).select("pair_id", "copy_5gram", "draft_coverage")


@query(f"""WITH {_PAIRS}, s AS (SELECT *, {_of(_SKEL, 'draft')} AS ds, {_of(_SKEL, 'output')} AS os, {_content('draft')} AS dc, {_content('output')} AS oc,
  {_of(_FACTS, _ascii('draft'))} AS df, {_of(_FACTS, _ascii('output'))} AS of, regexp_replace(lower(output), '\\s+', '', 'g') AS plain FROM p),
 g AS (SELECT *, {_runs('ds')} AS dg, {_runs('os')} AS og FROM s)
SELECT pair_id, {_found('dg', 'og')} AS skeleton_recall,
 len(list_intersect(dc, oc)) / greatest(1, len(list_distinct(list_concat(dc, oc)))) AS jaccard,
 CASE WHEN len(df) = 0 THEN 1.0 ELSE len(list_filter(df, lambda x: list_contains(of, x) OR contains(plain, replace(x, ',', '')))) / len(df) END AS fact_recall FROM g""")
def pair_overlap(spark, sf):
    return pairs.cheap_metrics(pairs.turn_pairs(_table(spark, sf, "conversations"))).select("pair_id", "skeleton_recall", "jaccard", "fact_recall")


_HALVES = "h AS (SELECT doc_id AS pair_id, text AS draft, substring(text, CAST(floor(length(text) / 2) AS BIGINT) + 1) || ' ' || left(text, CAST(floor(length(text) / 2) AS BIGINT)) AS output FROM documents)"


@query(f"""WITH {_HALVES}, w AS (SELECT pair_id, {_words('draft')} AS dw, {_words('output')} AS ow FROM h),
 g AS (SELECT pair_id, unnest({_runs('dw')}) AS g, 1 AS d, 0 AS o FROM w UNION ALL SELECT pair_id, unnest({_runs('ow')}), 0, 1 FROM w),
 c AS (SELECT pair_id, g, sum(d) AS d, sum(o) AS o FROM g GROUP BY 1, 2),
 s AS (SELECT pair_id, sum(d) AS d, sum(o) AS o, sum(CASE WHEN o > 0 THEN d END) AS dh, sum(CASE WHEN d > 0 THEN o END) AS oh FROM c GROUP BY 1)
SELECT pair_id, CASE WHEN o > 0 THEN CAST(coalesce(oh, 0) AS DOUBLE) / CAST(o AS DOUBLE) ELSE 0.0 END AS copy_5gram, CASE WHEN d > 0 THEN CAST(coalesce(dh, 0) AS DOUBLE) / CAST(d AS DOUBLE) ELSE 0.0 END AS draft_coverage FROM h LEFT JOIN s USING (pair_id)""")
def overlap_by_grams(spark, sf):
    return pairs.overlap_by_grams(pairs.swapped_halves(_table(spark, sf, "documents")))


@query(r"""SELECT d.page_id, CASE WHEN n < 2 THEN 1.0 ELSE least(1.0, m / n) END AS para_kept FROM
 (SELECT page_id, len(list_filter(string_split_regex(trim(s, ' ' || chr(10) || chr(9) || chr(13)), '\n\s*\n'), lambda x: trim(x) <> '')) AS n,
   len(list_filter(string_split_regex(trim(left(s, CAST(floor(length(s) / 2) AS BIGINT)), ' ' || chr(10) || chr(9) || chr(13)), '\n\s*\n'), lambda x: trim(x) <> '')) AS m
  FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|blockquote)\b[^>]*>', chr(10), 'g'), '<[^<>]{1,60}>', ' ', 'g') AS s FROM pages)) d""")
def para_kept(spark, sf):
    p = _table(spark, sf, "pages").withColumn("s", text.strip_markup(F.col("html")))
    return p.select("page_id", overlap.para_kept(F.col("s"), F.left("s", F.floor(F.length("s") / 2).cast("int"))).alias("para_kept"))


@query()
def all_metrics(spark, sf):
    return pairs.all_metrics(pairs.turn_pairs(_table(spark, sf, "conversations")))


@query()
def copy_rate(spark, sf):
    return pairs.copy_rate(pairs.all_metrics(pairs.turn_pairs(_table(spark, sf, "conversations"))))


@query()
def sentences(spark, sf):
    return pairs.sentences(_table(spark, sf, "documents"))


@query()
def prose_and_structure(spark, sf):
    return pairs.prose_and_structure(_table(spark, sf, "documents"))


_SPLIT = r"list_filter(string_split(regexp_replace({t}, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) >= 3)"


@query(f"""WITH {_PAIRS},
 d AS (SELECT pair_id, unnest(l) AS s, unnest(range(len(l))) AS j FROM (SELECT pair_id, {_of(_SPLIT, 'draft')} AS l FROM p)),
 o AS (SELECT pair_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT pair_id, {_of(_SPLIT, 'output')} AS l FROM p)),
 db AS (SELECT pair_id, j, list_distinct(list_filter({_content('s')}, lambda w: NOT regexp_full_match(w, '{_NUM}'))) AS b FROM d),
 ob AS (SELECT pair_id, i, list_distinct(list_filter({_content('s')}, lambda w: NOT regexp_full_match(w, '{_NUM}'))) AS b FROM o),
 x AS (SELECT pair_id, i, j, len(list_intersect(db.b, ob.b)) / greatest(1, len(list_distinct(list_concat(db.b, ob.b)))) AS v FROM db JOIN ob USING (pair_id)),
 r AS (SELECT pair_id, i, v, CASE WHEN v > 0 THEN j END AS j, row_number() OVER (PARTITION BY pair_id, i ORDER BY v DESC, j) AS n FROM x),
 y AS (SELECT pair_id, i, v, j, lead(j) OVER (PARTITION BY pair_id ORDER BY i) AS nj FROM r WHERE n = 1),
 c AS (SELECT pair_id, j, count(*) AS n FROM y WHERE j IS NOT NULL GROUP BY 1, 2),
 m AS (SELECT pair_id, count(*) AS matched, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS once FROM c GROUP BY 1),
 z AS (SELECT pair_id, avg(v) AS align_sim, coalesce(avg(CASE WHEN j <> nj THEN CASE WHEN nj > j THEN 1.0 ELSE 0.0 END END), 1.0) AS order_agree FROM y GROUP BY 1),
 k AS (SELECT pair_id, count(*) AS n FROM d GROUP BY 1)
SELECT pair_id, round(align_sim, 9) AS align_sim, CAST(order_agree AS DOUBLE) AS order_agree, CAST(coalesce(CAST(once AS DOUBLE) / matched, 0.0) AS DOUBLE) AS one_to_one, coalesce(matched, 0) / n AS coverage FROM z JOIN k USING (pair_id) LEFT JOIN m USING (pair_id)""")
def align_structure(spark, sf):
    return pairs.align_structure(pairs.turn_pairs(_table(spark, sf, "conversations"))).withColumn("align_sim", F.round("align_sim", 9))


# ---- verdicts: votes derived from labels by plain arithmetic -------------------------------------------------
def _vote(shift: int) -> dict[str, str]:
    x = f"(doc_id + {shift})"
    return {
        "facts_all_kept": f"CASE WHEN {x} % 29 = 0 THEN NULL ELSE quality = 1 OR {x} % 3 = 0 END",
        "meaning_changed": f"toxic = 1 AND {x} % 3 <> 1",
        "added_content": f"{x} % 5 = 0",
        "padding": f"CASE WHEN {x} % 23 = 0 THEN NULL ELSE {x} % 17 = 0 END",
        "greeting_signoff_kept": f"{x} % 7 <> 0",
        "format_kept": f"CASE WHEN {x} % 11 = 0 THEN NULL ELSE {x} % 4 <> 0 END",
        "identity": f"{x} % 13 = 0",
        "reads_like_person": f"CASE WHEN {x} % 37 = 0 THEN NULL ELSE CAST(3 + {x} % 3 AS INT) END",
        "severity": f"CASE WHEN quality = 0 AND {x} % 3 = 0 THEN 'critical' WHEN {x} % 4 = 0 THEN 'minor' WHEN {x} % 31 = 0 THEN NULL ELSE 'none' END",
        "evidence": f"CASE WHEN {x} % 4 = 0 THEN 'none' ELSE concat('said ', CAST({x} AS VARCHAR(20))) END",
    }


def _failed(shift: int) -> str:
    return f"(doc_id * 7 + {shift}) % 19 = 0"


def _votes(spark, sf, shift: int) -> DataFrame:
    fields = ", ".join(f"'{k}', {v}" for k, v in _vote(shift).items())
    rows = _table(spark, sf, "labels").selectExpr("doc_id AS key", f"CASE WHEN NOT ({_failed(shift)}) THEN named_struct({fields}) END AS verdict".replace("VARCHAR(20)", "STRING"))
    return rows


def _sql_votes(shift: int, name: str) -> str:
    return f"{name} AS (SELECT doc_id AS key, NOT ({_failed(shift)}) AS ok, " + ", ".join(f"{v} AS {k}" for k, v in _vote(shift).items()) + " FROM labels)"


def _reviews(spark, sf) -> DataFrame:
    return verdicts.merge_reviews(_votes(spark, sf, 0), _votes(spark, sf, 2), ["key"])


_RANK = "CASE WHEN coalesce({0}.severity, 'none') = 'critical' THEN 2 WHEN coalesce({0}.severity, 'none') = 'minor' THEN 1 ELSE 0 END"
_one = lambda k: f"CASE WHEN a.ok THEN a.{k} WHEN b.ok THEN b.{k} END"
_REVIEWS = (
    f"WITH {_sql_votes(0, 'a')}, {_sql_votes(2, 'b')}, merged AS (SELECT a.key, "
    f"CASE WHEN a.ok AND b.ok THEN CASE WHEN {_RANK.format('a')} <= {_RANK.format('b')} THEN coalesce(a.severity, 'none') ELSE coalesce(b.severity, 'none') END ELSE {_one('severity')} END AS severity, "
    + ", ".join(f"CASE WHEN a.ok AND b.ok THEN NOT (a.{k} IS NOT DISTINCT FROM false AND b.{k} IS NOT DISTINCT FROM false) ELSE {_one(k)} END AS {k}" for k in verdicts.KEPT)
    + ", "
    + ", ".join(f"CASE WHEN a.ok AND b.ok THEN coalesce(a.{k}, false) AND coalesce(b.{k}, false) ELSE {_one(k)} END AS {k}" for k in verdicts.BAD)
    + f", CASE WHEN a.ok AND b.ok THEN coalesce(nullif(a.evidence, 'none'), nullif(b.evidence, 'none'), 'none') ELSE {_one('evidence')} END AS evidence, "
    f"{_one('reads_like_person')} AS reads_like_person, {_one('padding')} AS padding, CASE WHEN a.ok AND b.ok THEN 2 WHEN a.ok OR b.ok THEN 1 END AS votes FROM a JOIN b USING (key))"
)


_CANDIDATE = "CASE key % 7 WHEN 0 THEN '' WHEN 1 THEN concat(chr(10), '  ') WHEN 2 THEN NULL ELSE 'text' END"
_BLANK = f"trim(coalesce({_CANDIDATE}, ''), concat(' ', chr(10))) = ''"
_BLANK_SQL = f"""c AS (SELECT *, {_BLANK} AS blank FROM a) SELECT key, CASE WHEN blank THEN 'empty' WHEN ok THEN evidence END AS evidence, CASE WHEN blank THEN 'critical' WHEN ok THEN severity END AS severity,
 CASE WHEN blank THEN true WHEN ok THEN meaning_changed END AS meaning_changed, CASE WHEN blank THEN false WHEN ok THEN facts_all_kept END AS facts_all_kept, CASE WHEN blank THEN 1 WHEN ok THEN reads_like_person END AS reads_like_person FROM c"""


@query(f"{_REVIEWS} SELECT * FROM merged")
def two_vote_review(spark, sf):
    return _reviews(spark, sf).drop("raw")


@query(f"WITH {_sql_votes(0, 'a')}, {_sql_votes(2, 'b')}, {_BLANK_SQL}")
def empty_verdicts(spark, sf):
    votes = _votes(spark, sf, 0).selectExpr("*", f"{_CANDIDATE} AS candidate")
    v = verdicts.default_verdict(F.col("candidate"), F.col("verdict"), votes.schema["verdict"].dataType.names)
    return votes.select("key", v.alias("v")).select("key", "v.evidence", "v.severity", "v.meaning_changed", "v.facts_all_kept", "v.reads_like_person")


_METRIC = {"copy": "(key * 37 % 100) / 100.0E0", "lcs_content": "(key * 53 % 100) / 100.0E0", "fact_recall": "(key * 71 % 100) / 100.0E0", "degenerate": "key % 41 = 0", "in_band": "key % 3 = 0", "align_sim": "(key * 13 % 100) / 100.0E0", "one_to_one": "(key * 17 % 100) / 100.0E0", "coverage": "(key * 19 % 100) / 100.0E0", "format_recall": "(key * 23 % 100) / 100.0E0"}


def _flagged(spark, sf) -> DataFrame:
    rows = _reviews(spark, sf).selectExpr("*", *[f"{v} AS {k}" for k, v in _METRIC.items()])
    return rows.withColumns({"clean": verdicts.clean(), "clean_tiers": verdicts.clean(tiers=True), "bad": verdicts.bad(), "bad_tiers": verdicts.bad(tiers=True)})


_REQ = " AND ".join(f"{k} IS NOT NULL" for k in verdicts.REQUIRED)
_GOOD = f"({_REQ} AND facts_all_kept AND NOT meaning_changed AND NOT added_content AND NOT coalesce(padding, false) AND greeting_signoff_kept AND format_kept AND NOT identity AND reads_like_person >= 4 AND NOT degenerate AND copy < 0.85 AND lcs_content < 0.9)"
_WORSE = "degenerate OR coalesce(identity, false) OR copy >= 0.85 OR lcs_content >= 0.9 OR "
_FLAGS = (
    f"{_REVIEWS}, m AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _METRIC.items()) + f" FROM merged), flagged AS (SELECT *, coalesce({_GOOD}, false) AS clean, coalesce({_GOOD} AND severity = 'none', false) AS clean_tiers, "
    f"{_WORSE} coalesce(meaning_changed, false) OR coalesce(added_content, false) OR NOT coalesce(facts_all_kept, false) AS bad, {_WORSE} coalesce(severity = 'critical', false) OR coalesce(NOT format_kept, false) AS bad_tiers FROM m)"
)


@query(f"{_FLAGS} SELECT key, clean, clean_tiers, bad, bad_tiers FROM flagged")
def clean_bad_flags(spark, sf):
    return _flagged(spark, sf).select("key", "clean", "clean_tiers", "bad", "bad_tiers")


_N = lambda cond, name: f"count(*) FILTER (WHERE {cond}) AS {name}"


@query(f"""{_REVIEWS} SELECT count(*) AS judged, {_N('facts_all_kept', 'facts_kept')}, {_N('meaning_changed', 'changed')}, {_N('added_content', 'added')}, {_N('NOT greeting_signoff_kept', 'greeting_lost')}, {_N('NOT format_kept', 'format_lost')},
 {_N('identity', 'identical')}, {_N('facts_all_kept AND NOT coalesce(meaning_changed, false) AND NOT coalesce(added_content, false)', 'clean')},
 {_N('facts_all_kept AND NOT coalesce(added_content, false) AND greeting_signoff_kept AND coalesce(format_kept, true) AND NOT coalesce(identity, false)', 'passed')},
 {_N('votes = 1', 'single_vote')}, {_N("severity = 'critical'", 'critical')}, {_N("severity = 'minor'", 'minor')} FROM merged WHERE votes IS NOT NULL""")
def eval_report(spark, sf):
    return verdicts.report(_reviews(spark, sf))


@query("SELECT count(*) FILTER (WHERE regexp_matches(c, '^[ghj]_|_zh')) AS chinese, count(*) AS n FROM (SELECT concat(chr(CAST(97 + doc_id % 12 AS INTEGER)), '_', CASE WHEN doc_id % 10 = 0 THEN 'x_zh' ELSE 'x' END) AS c FROM labels)")
def case_routing(spark, sf):
    c = F.concat(F.char(F.lit(97) + F.col("doc_id") % 12), F.lit("_"), F.when(F.col("doc_id") % 10 == 0, "x_zh").otherwise("x"))
    return _table(spark, sf, "labels").select(c.alias("c")).agg(F.count_if(verdicts.is_chinese_case(F.col("c"))).alias("chinese"), F.count("*").alias("n"))


def _fact_vote(shift: int) -> dict[str, str]:
    x = f"(doc_id * 3 + id * 5 + {shift})"
    return {
        "status": f"CASE {x} % 4 WHEN 0 THEN 'changed' WHEN 1 THEN 'Dropped' ELSE 'kept' END",
        "severity": f"CASE {x} % 7 WHEN 0 THEN 'minor' WHEN 1 THEN NULL ELSE 'critical' END",
        "span": f"CASE WHEN {x} % 5 < 2 THEN ' span one ' WHEN {x} % 5 = 2 THEN '' ELSE 'span two' END",
    }


def _fact_flags(shift: int) -> dict[str, str]:
    x = f"(doc_id + {shift})"
    return {
        "reversed_meaning": f"{x} % 8 < 4",
        "register_kept": f"CASE WHEN {x} % 9 = 0 THEN NULL ELSE {x} % 9 > 5 END",
        "format_kept": f"CASE WHEN {x} % 10 = 0 THEN NULL ELSE {x} % 4 > 1 END",
        "greeting_signoff_kept": f"{x} % 6 > 3",
    }


def _fact_failed(shift: int) -> str:
    return f"(doc_id * 5 + {shift}) % 17 = 0"


def _fact_rows(spark, sf, shift: int) -> DataFrame:
    made = [f"{v} AS {k}" for k, v in _fact_vote(shift).items()]
    return _table(spark, sf, "labels").selectExpr("doc_id", "explode(sequence(1, 4)) AS id").selectExpr("doc_id AS key", "id", *made)


def _fact_votes(spark, sf, shift: int) -> DataFrame:
    fact = ", ".join(f"'{k}', {v}" for k, v in _fact_vote(shift).items())
    flags = ", ".join(f"'{k}', {v}" for k, v in _fact_flags(shift).items())
    made = f"slice(array(named_struct('text', 'x', 'span', 'span one'), named_struct('text', 'y', 'span', 'span two')), 1, CAST((doc_id + {shift}) % 3 AS INT))"
    verdict = f"named_struct('facts', transform(sequence(1, 4), id -> named_struct('id', id, {fact})), 'invented', {made}, {flags})"
    return _table(spark, sf, "labels").selectExpr("doc_id AS key", f"CASE WHEN NOT ({_fact_failed(shift)}) THEN {verdict} END AS verdict")


def _sql_fact_votes(shift: int, name: str) -> str:
    facts_ = ", ".join(f"{v} AS {k}" for k, v in _fact_vote(shift).items())
    flags = ", ".join(f"{v} AS {k}" for k, v in _fact_flags(shift).items())
    return f"{name} AS (SELECT doc_id AS key, id, {facts_} FROM f), v{name} AS (SELECT doc_id AS key, NOT ({_fact_failed(shift)}) AS ok, (doc_id + {shift}) % 3 AS n_invented, {flags} FROM labels)"


_FACT_SQL = f"f AS (SELECT doc_id, unnest([1, 2, 3, 4]) AS id FROM labels), {_sql_fact_votes(0, 'a')}, {_sql_fact_votes(2, 'b')}"
_MERGED_FACTS = (
    f"""WITH {_FACT_SQL}, mf AS (SELECT a.key, a.id, CASE WHEN w OR NOT vb.ok THEN a.status ELSE 'kept' END AS status,
 CASE WHEN w AND vb.ok THEN CASE WHEN coalesce(a.severity, 'critical') = 'minor' OR coalesce(b.severity, 'critical') = 'minor' THEN 'minor' ELSE 'critical' END ELSE a.severity END AS severity
 FROM a JOIN b ON a.key = b.key AND a.id = b.id JOIN va ON va.key = a.key JOIN vb ON vb.key = a.key, LATERAL (SELECT lower(a.status) <> 'kept' AND lower(b.status) <> 'kept' AS w) l WHERE va.ok),
 mv AS (SELECT va.key, va.ok AS judged, CASE WHEN vb.ok AND NOT (va.n_invented > 0 AND vb.n_invented > 0) THEN 0 ELSE va.n_invented END AS n_invented, CASE WHEN vb.ok THEN va.reversed_meaning AND vb.reversed_meaning ELSE va.reversed_meaning END AS reversed_meaning, """
    + ", ".join(f"CASE WHEN vb.ok THEN NOT (va.{k} IS NOT DISTINCT FROM false AND vb.{k} IS NOT DISTINCT FROM false) ELSE va.{k} END AS {k}" for k in verdicts.FACT_KEPT)
    + " FROM va JOIN vb USING (key))"
)


def _merged_facts(spark, sf) -> DataFrame:
    return verdicts.merge_facts(_fact_votes(spark, sf, 0), _fact_votes(spark, sf, 2), ["key"])


@query(f"{_MERGED_FACTS} SELECT key, id, status, severity FROM mf")
def two_vote_facts(spark, sf):
    return _merged_facts(spark, sf).select("key", F.inline("verdict.facts")).select("key", "id", "status", "severity")


@query(f"{_MERGED_FACTS} SELECT key, n_invented, reversed_meaning, register_kept, format_kept, greeting_signoff_kept FROM mv WHERE judged")
def two_vote_flags(spark, sf):
    merged = reward.folded(_merged_facts(spark, sf)).filter("judged")
    return merged.select("key", "n_invented", "reversed_meaning", *verdicts.FACT_KEPT)


_SCORE_INPUT = {"reuse": "(key * 37 % 100) / 100.0E0", "hard": "CASE WHEN key % 43 = 0 THEN 'empty' END"}
_PEN = "least(8.0, 8.0 * pow(greatest(0.0, (reuse - 0.31) / 0.69), 1.61))"


def _scored(spark, sf) -> DataFrame:
    return reward.score(reward.folded(_merged_facts(spark, sf)).selectExpr("*", *[f"{v} AS {k}" for k, v in _SCORE_INPUT.items()]))


_SCORED = (
    f"{_MERGED_FACTS}, s AS (SELECT key, count(*) FILTER (WHERE lower(status) = 'changed') AS changed, count(*) FILTER (WHERE lower(status) = 'dropped') AS dropped, "
    "count(*) FILTER (WHERE lower(status) <> 'kept' AND coalesce(severity, 'critical') = 'critical') AS critical, count(*) FILTER (WHERE lower(status) <> 'kept' AND severity = 'minor') AS minor FROM mf GROUP BY 1), "
    "x AS (SELECT key, coalesce(changed, 0) AS changed, coalesce(dropped, 0) AS dropped, coalesce(critical, 0) AS critical, coalesce(minor, 0) AS minor, judged, n_invented, reversed_meaning, register_kept, format_kept, greeting_signoff_kept, "
    + ", ".join(f"{v} AS {k}" for k, v in _SCORE_INPUT.items())
    + f" FROM mv LEFT JOIN s USING (key)), scored AS (SELECT *, {_PEN} AS copy_pen, CAST(CASE WHEN hard IS NOT NULL THEN -8.0 WHEN judged THEN "
    f"0.0 - (critical * 3.0 + minor * 0.15 + n_invented * 2.0 + CASE WHEN reversed_meaning THEN 2.0 ELSE 0.0 END + CASE WHEN NOT register_kept THEN 1.0 ELSE 0.0 END + CASE WHEN NOT format_kept THEN 1.5 ELSE 0.0 END + CASE WHEN NOT greeting_signoff_kept THEN 1.5 ELSE 0.0 END + {_PEN}) END AS DOUBLE) AS reward FROM x)"
)


@query(f"""{_SCORED}, o AS (SELECT key % 10 AS step, hard, critical, minor, reward IS NULL AS failed, coalesce(reward, -1.0) AS reward FROM scored)
SELECT step, round(avg(reward), 9) AS mean_reward, min(reward) AS min_reward, max(reward) AS max_reward, count(hard) AS hard_fails, count(*) FILTER (WHERE failed) AS judge_fails, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(minor) AS BIGINT) AS minor FROM o GROUP BY 1""")
def online_reward(spark, sf):
    log = reward.online(_scored(spark, sf)).withColumn("step", F.col("key") % 10)
    return datasets.step_log(log).withColumn("mean_reward", F.round("mean_reward", 9))


@query(f"{_SCORED} SELECT key, changed, dropped, critical, minor, round(copy_pen, 9) AS copy_pen, round(reward, 9) AS reward FROM scored")
def reward_score(spark, sf):
    return _scored(spark, sf).select("key", "changed", "dropped", "critical", "minor", F.round("copy_pen", 9).alias("copy_pen"), F.round("reward", 9).alias("reward"))


@query(f"""WITH {_FACT_SQL}, r AS (SELECT key, span, CASE WHEN coalesce(severity, 'critical') = 'critical' THEN 3.0 ELSE 0.15 END AS w FROM a WHERE lower(status) <> 'kept' UNION ALL SELECT key, 'span two', 2.0 FROM a WHERE id = 1 AND key % 3 = 1)
SELECT key, trim(span) AS span, round(CAST(sum(w) AS DOUBLE), 9) AS penalty FROM r WHERE trim(span) <> '' GROUP BY 1, 2""")
def span_penalties(spark, sf):
    facts_ = _fact_rows(spark, sf, 0)
    made = facts_.filter("id = 1 AND key % 3 = 1").select("key", F.lit("span two").alias("span"))
    return reward.span_penalties(facts_, made, ["key"]).withColumn("penalty", F.round("penalty", 9))


@query(f"""{_SCORED}, g AS (SELECT key // 4 AS grp, key, reward FROM scored WHERE reward IS NOT NULL)
SELECT grp, key, round((reward - avg(reward) OVER (PARTITION BY grp)) / (coalesce(stddev_samp(reward) OVER (PARTITION BY grp), 0) + 0.0001), 6) + 0.0 AS advantage FROM g""")
def group_advantage(spark, sf):
    rows = _scored(spark, sf).filter("reward IS NOT NULL").select(F.col("key").alias("k"), "reward", F.floor(F.col("key") / 4).alias("key"))
    return reward.group_advantage(rows).select(F.col("key").alias("grp"), F.col("k").alias("key"), (F.round("advantage", 6) + 0.0).alias("advantage"))


@query("""WITH v AS (SELECT event_id, user_id, value AS nll FROM events), s AS (SELECT nll, row_number() OVER (ORDER BY nll) - 1 AS n, count(*) OVER () AS c FROM v WHERE event_id % 10 = 0), f AS (SELECT nll AS fl FROM s WHERE n = c // 2),
 p AS (SELECT event_id, user_id, greatest(0.0, fl - nll) AS p FROM v, f) SELECT event_id, round(p - avg(p) OVER (PARTITION BY user_id), 9) + 0.0 AS penalty FROM p""")
def nll_floor(spark, sf):
    e = _table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.col("value").alias("nll"))
    return reward.floor_penalty(e, reward.nll_floor(e.filter("event_id % 10 = 0"))).select("event_id", (F.round("penalty", 9) + 0.0).alias("penalty"))


@query("""WITH t AS (SELECT doc_id AS key, unnest(range(0, 12)) AS t FROM labels), s AS (SELECT doc_id AS key, doc_id % 20 AS f, doc_id % 20 + 15 AS g, 3.0 AS p FROM labels UNION ALL SELECT doc_id, 30, 41, 1.5 FROM labels),
 r AS (SELECT key, f, g, p / max(p) OVER (PARTITION BY key) AS rel FROM s), h AS (SELECT t.key, t.t, 1 + coalesce(max(r.rel), 0.0) AS raw FROM t LEFT JOIN r ON t.key = r.key AND t.t * 5 + 4 > r.f AND t.t * 5 < r.g GROUP BY 1, 2)
 SELECT key, CAST(t AS BIGINT) AS t, round(CAST(raw * count(*) OVER (PARTITION BY key) / sum(raw) OVER (PARTITION BY key) AS DOUBLE), 9) AS weight FROM h""")
def span_weights(spark, sf):
    k = _table(spark, sf, "labels").select(F.col("doc_id").alias("key"))
    tokens = k.select("key", F.explode(F.expr("sequence(0L, 11L)")).alias("t")).selectExpr("key", "t", "t * 5 AS start", "t * 5 + 4 AS end")
    spans = k.selectExpr("key", "key % 20 AS `from`", "key % 20 + 15 AS to", "3.0D AS penalty").unionByName(k.selectExpr("key", "30L AS `from`", "41L AS to", "1.5D AS penalty"))
    return reward.span_weights(tokens, spans).withColumn("weight", F.round("weight", 9))


_TURN_COPY = "(pair_id * 37 % 100) / 100.0E0"


@query(f"""WITH {_PAIRS}, x AS (SELECT pair_id, CASE pair_id % 6 WHEN 0 THEN '今天下午三点我们在会议室开会讨论' ELSE draft END AS draft, CASE pair_id % 11 WHEN 0 THEN chr(10) WHEN 1 THEN NULL ELSE output END AS output, pair_id % 7 = 0 AS degenerate, {_TURN_COPY} AS copy FROM p),
 y AS (SELECT *, len(regexp_extract_all(left(draft, 400), '{_HAN}')) > len(regexp_extract_all(left(draft, 400), '[A-Za-z]{{2,}}')) AS dc, len(regexp_extract_all(left(output, 400), '{_HAN}')) > len(regexp_extract_all(left(output, 400), '[A-Za-z]{{2,}}')) AS oc FROM x)
SELECT pair_id, CASE WHEN trim(coalesce(output, ''), concat(' ', chr(10))) = '' THEN 'empty' WHEN degenerate THEN 'degenerate' WHEN copy > 0.85E0 THEN printf('copy %.2f', copy) WHEN dc <> oc THEN 'language_switch' END AS hard FROM y""")
def hard_fail(spark, sf):
    p = pairs.turn_pairs(_table(spark, sf, "conversations"))
    x = p.selectExpr("pair_id", "CASE pair_id % 6 WHEN 0 THEN '今天下午三点我们在会议室开会讨论' ELSE draft END AS draft", "CASE pair_id % 11 WHEN 0 THEN chr(10) WHEN 1 THEN NULL ELSE output END AS output", "pair_id % 7 = 0 AS degenerate", f"{_TURN_COPY} AS copy")
    return x.select("pair_id", reward.hard_check(F.col("draft"), F.col("output"), F.col("degenerate"), F.col("copy")).alias("hard"))


# ---- data sets ----------------------------------------------------------------------------------------------
def _candidates(spark, sf) -> DataFrame:
    return _flagged(spark, sf).withColumn("i", F.col("key") % 4).withColumn("key", F.floor(F.col("key") / 4))


def _choice(value: str) -> str:
    return f"""{_FLAGS}, c AS (SELECT *, key // 4 AS k, key % 4 AS i FROM flagged),
 bd AS (SELECT *, max(CASE WHEN clean AND in_band THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS band FROM c),
 q AS (SELECT *, clean AND (band = 0 OR in_band) AS pool FROM bd),
 f AS (SELECT *, pool AND fact_recall >= max(CASE WHEN pool THEN fact_recall END) OVER (PARTITION BY k) - 0.05E0 AS pool2 FROM q),
 g AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY {value}, i) AS n FROM f WHERE pool2),
 w AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY coalesce(severity, '') = 'critical' DESC, coalesce(identity, false) DESC, coalesce(meaning_changed, false) DESC, NOT coalesce(facts_all_kept, true) DESC, coalesce(added_content, false) DESC, i) AS n FROM f WHERE bad),
 keys AS (SELECT k, max(band) = 1 AS band FROM f GROUP BY 1),
 choice AS (SELECT keys.k AS key, g.i AS chosen, w.i AS rejected, band FROM keys LEFT JOIN g ON g.k = keys.k AND g.n = 1 LEFT JOIN w ON w.k = keys.k AND w.n = 1)"""


@query(f"{_choice('copy')} SELECT * FROM choice")
def chosen_rejected(spark, sf):
    return datasets.choose(_candidates(spark, sf))


@query(f"{_choice('align_sim + copy + 0.5E0 * one_to_one + 0.5E0 * (1 - coverage) + (1 - format_recall)')} SELECT key, chosen, rejected FROM choice WHERE chosen IS NOT NULL AND rejected IS NOT NULL")
def preference_pairs(spark, sf):
    return datasets.preference_pairs(datasets.choose(_candidates(spark, sf), structure=True))


@query(f"{_choice('copy')} SELECT {_N('chosen IS NOT NULL AND rejected IS NOT NULL', 'pairs')}, {_N('chosen IS NULL', 'no_clean')}, {_N('chosen IS NOT NULL AND rejected IS NULL', 'no_bad')}, {_N('chosen IS NOT NULL AND rejected IS NULL', 'all_clean')}, {_N('chosen IS NOT NULL AND rejected IS NOT NULL AND band', 'style_band')} FROM choice")
def pref_funnel(spark, sf):
    return datasets.funnel(datasets.choose(_candidates(spark, sf)))


@query()
def preference_build(spark, sf):
    """Pairs with texts and metrics of turns: the answer, the draft itself, and a blank are the candidates."""
    turns = pairs.turn_pairs(_table(spark, sf, "conversations")).withColumnRenamed("pair_id", "key")
    cands = turns.select("key", F.lit("en").alias("src"), F.array("output", "draft", F.lit(" "), F.concat("output", F.lit(" And that is all there is to say."))).alias("cands"))
    fields = ", ".join(f"'{k}', {v}" for k, v in _vote(0).items()).replace("doc_id", "(key + i)").replace("quality", "1").replace("toxic", "0").replace("VARCHAR(20)", "STRING")
    votes = turns.selectExpr("key", "explode(sequence(0, 3)) AS i").filter("i <> 2").selectExpr("key", "i", f"named_struct({fields}) AS verdict")
    return datasets.build_preferences(cands, turns, votes, "turns", structure=True, identity_bad=True)[0]


@query("""SELECT key, src, array_to_string(cands, '|') AS cands FROM (SELECT user_id AS key, min_by(event_type, event_id) AS src, list(CAST(event_id AS VARCHAR) ORDER BY event_id) AS cands FROM events GROUP BY 1)""")
def merge_candidates(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("src"), F.array(F.col("event_id").cast("string")).alias("cands"), F.lit("a").alias("file"), F.col("event_id").alias("line"))
    return datasets.merge_candidates(rows).select("key", "src", F.array_join("cands", "|").alias("cands"))


@query("SELECT user_id AS key, max_by(event_type, event_id) AS src, max_by(value, event_id) AS value FROM events GROUP BY 1")
def last_wins(spark, sf):
    return datasets.last_wins(_table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("src"), "value", "event_id"), ["key"], "event_id")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, sf):
    return datasets.not_done(_table(spark, sf, "documents").select("doc_id", "lang"), _table(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def ledger_semi(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", "lang").join(_table(spark, sf, "labels"), "doc_id", "left_semi")


_PROFILE = [("en", 5.0, 12.0, 0.1, 0.6), ("email_short", 4.0, 9.0, 0.0, 0.9), ("de", 2.0, 30.0, 0.3, 0.4)]


@query(r"""WITH s AS (SELECT doc_id, CASE lang WHEN 'fr' THEN 'daily_email' ELSE lang END AS src, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))), lambda n: n >= 3) AS l FROM documents),
 t AS (SELECT doc_id, src, CASE WHEN len(l) > 0 THEN l ELSE [0] END AS l FROM s), m AS (SELECT doc_id, src, list_sum(l) / len(l) AS a, len(list_filter(l, lambda n: n > 30)) / len(l) AS b, len(list_filter(l, lambda n: n < 9)) / len(l) AS c FROM t)
 SELECT doc_id, CASE src WHEN 'en' THEN a BETWEEN 5 AND 12 AND b <= 0.1 AND c <= 0.6 WHEN 'daily_email' THEN a BETWEEN 4 AND 9 AND b <= 0.05 AND c <= 0.9 WHEN 'de' THEN a BETWEEN 2 AND 30 AND b <= 0.3 AND c <= 0.4 ELSE true END AS in_band FROM m""")
def style_band(spark, sf):
    profile = spark.createDataFrame(_PROFILE, "src string, msl_q1 double, msl_q3 double, long_q3 double, short_q3 double")
    rows = _table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "fr", "daily_email").otherwise(F.col("lang")).alias("src"), "text")
    return datasets.in_band(rows, profile).select("doc_id", "in_band")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 4 = 1")
def shard(spark, sf):
    return datasets.shard(_table(spark, sf, "documents").select("doc_id"), ["doc_id"], 1, 4)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents")
def positions(spark, sf):
    return with_position(_table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query("SELECT doc_id, CASE WHEN n < least(300, greatest(40, c // 20)) THEN 'eval' ELSE 'train' END AS side FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n, count(*) OVER () AS c FROM documents)")
def row_split(spark, sf):
    return datasets.row_split(_table(spark, sf, "documents").select("doc_id"), ["doc_id"])


_GROUPS = r"""g AS (SELECT doc_id, md5(left(lower(trim(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g'))), 600)) AS k FROM documents),
 f AS (SELECT k, row_number() OVER (ORDER BY min(doc_id)) AS r FROM g GROUP BY 1), c AS (SELECT (SELECT count(*) FROM g) AS n, (SELECT count(*) FROM f) AS m),
 split AS (SELECT doc_id, CASE WHEN r <= least(m, CAST(ceil(least(500, greatest(40, n // 20)) / greatest(1, n // m)) AS BIGINT)) THEN 'eval' ELSE 'train' END AS side FROM g JOIN f USING (k), c)"""


@query(f"WITH {_GROUPS} SELECT doc_id, side FROM split")
def group_split(spark, sf):
    return datasets.group_split(_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "side")


@query(f"WITH {_GROUPS}, t AS (SELECT side, lower(trim(regexp_replace(text, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g'))) AS t FROM split JOIN documents USING (doc_id)) SELECT count(*) AS n FROM (SELECT t FROM t WHERE side = 'eval' INTERSECT SELECT t FROM t WHERE side = 'train')")
def leak_check(spark, sf):
    split = datasets.group_split(_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return datasets.leaks(split, "text").agg(F.count("*").alias("n"))


@query("SELECT doc_id, p AS position FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('11:' || doc_id)) - 1 AS p FROM documents) WHERE p < 300")
def seeded_shuffle(spark, sf):
    return datasets.shuffled(_table(spark, sf, "documents").select("doc_id"), "doc_id", 11, 300)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 40 BETWEEN 2 AND 30 AND length(text) <= 6000")
def ledger_filter(spark, sf):
    rows = _table(spark, sf, "documents").selectExpr("doc_id", "text AS draft", "CASE WHEN doc_id % 40 = 0 THEN array() ELSE sequence(1L, doc_id % 40) END AS facts")
    return datasets.ledger_filter(rows).select("doc_id", F.length("draft").cast("long").alias("n"))


@query("SELECT doc_id, text IS NOT NULL AND text <> '' AS filled FROM documents WHERE text IS NOT NULL AND text <> ''")
def check_filled(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", "text").filter("text <> ''")
    return datasets.check_filled(rows, ["doc_id", "text"]).select("doc_id", F.lit(True).alias("filled"))


@query("SELECT doc_id FROM documents WHERE len(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) <= 400")
def over_length(spark, sf):
    return datasets.drop_over_length(_table(spark, sf, "documents").select("doc_id", "text"), ["text"], 400).select("doc_id")


@query("SELECT CAST(floor(user_id / 10) AS BIGINT) AS step, round(avg(value), 9) AS mean_reward, min(value) AS min_reward, max(value) AS max_reward, count(*) FILTER (WHERE event_type = 'error') AS hard_fails, count(*) FILTER (WHERE value IS NULL) AS judge_fails, CAST(sum(event_id % 3) AS BIGINT) AS critical, CAST(sum(event_id % 5) AS BIGINT) AS minor FROM events GROUP BY 1")
def step_log(spark, sf):
    log = _table(spark, sf, "events").select(F.floor(F.col("user_id") / 10).alias("step"), F.col("value").alias("reward"), F.when(F.col("event_type") == "error", "error").alias("hard"), (F.col("event_id") % 3).alias("critical"), (F.col("event_id") % 5).alias("minor"))
    return datasets.step_log(log).withColumn("mean_reward", F.round("mean_reward", 9))


# ---- guard --------------------------------------------------------------------------------------------------
_PREFIX = f"""w AS (SELECT item_id, {_words()} AS w FROM benchmark), g AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: w[i:i + 3])) AS g FROM w),
 x AS (SELECT item_id, array_to_string(g[1:3], ' ') AS prefix, g[4] AS n FROM g WHERE NOT regexp_matches(array_to_string(g, ' '), '[0-9]')), idx AS (SELECT item_id, prefix, array_to_string(list_sort(list(DISTINCT n)), ' ') AS next FROM x GROUP BY 1, 2)"""


@query(f"WITH {_PREFIX} SELECT * FROM idx")
def prefix_index(spark, sf):
    return guard.prefix_index(_table(spark, sf, "benchmark"), "item_id", "text").withColumn("next", F.array_join("next", " "))


@query(f"WITH {_PREFIX}, t AS (SELECT item_id, {_words('left(text, CAST(floor(length(text) / 2) AS BIGINT))')} AS w FROM benchmark), p AS (SELECT item_id, array_to_string(w[-3:], ' ') AS prefix FROM t WHERE len(w) >= 3) SELECT item_id, prefix, next FROM p JOIN idx USING (item_id, prefix)")
def prefix_probe(spark, sf):
    b = _table(spark, sf, "benchmark")
    said = b.select("item_id", F.left("text", F.floor(F.length("text") / 2).cast("int")).alias("text"))
    return guard.probe(guard.prefix_index(b, "item_id", "text"), said, "item_id", "text").select("item_id", "prefix", F.array_join("next", " ").alias("next"))


@query("SELECT doc_id, CASE WHEN (doc_id * 37 % 100) / 100.0E0 > 0.35E0 THEN 'second' ELSE 'first' END AS adaptive, CASE WHEN (doc_id * 37 % 100) / 100.0E0 > 0.35E0 AND (doc_id * 53 % 100) / 100.0E0 < (doc_id * 37 % 100) / 100.0E0 THEN 'second' ELSE 'first' END AS best FROM labels")
def resample(spark, sf):
    x = _table(spark, sf, "labels").selectExpr("doc_id", "(doc_id * 37 % 100) / 100.0D AS c1", "(doc_id * 53 % 100) / 100.0D AS c2")
    return x.select("doc_id", guard.adaptive(F.lit("first"), F.lit("second"), F.col("c1")).alias("adaptive"), guard.best_of_two(F.lit("first"), F.lit("second"), F.col("c1"), F.col("c2")).alias("best"))


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'es'")
def without_keys(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", "lang")
    dropped = d.filter("lang = 'es'").select("doc_id")
    return guard.without_keys(d, dropped, dropped.count(), "doc_id")
