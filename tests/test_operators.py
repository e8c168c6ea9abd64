import json

import pytest
from pyspark.sql import functions as F

from rewritelab.functions import overlap, text
from rewritelab.operators import datasets, guard, pairs, reward, verdicts
from rewritelab.sources import jsonl
from rewritelab.streaming import log


def test_expressions_agree_with_the_arrow_pass(spark):
    rows = [(0, "The plan is to meet on Monday at the old hall today", "The plan is to meet on Monday at noon"), (1, None, "a"), (2, "", ""), (3, "今天下午三点我们开会讨论预算", "今天下午三点我们开会"), (4, "a b c", "a b c")]
    df = spark.createDataFrame(rows, "pair_id int, draft string, output string")
    cheap = {r["pair_id"]: r for r in pairs.cheap_metrics(df).collect()}
    full = {r["pair_id"]: r for r in pairs.all_metrics(df, body_only=False).collect()}
    exploded = {r["pair_id"]: r for r in pairs.overlap_by_grams(df.na.fill("")).collect()}
    for i in cheap:
        for k in ("copy_5gram", "draft_coverage", "skeleton_recall", "fact_recall"):
            a, b = cheap[i][k], full[i][k]
            assert (a is None) == (b is None or b != b) and (a is None or a == pytest.approx(b, abs=1e-3)), (i, k)
        assert exploded[i]["copy_5gram"] == pytest.approx(cheap[i]["copy_5gram"])


def test_copy_penalty(spark):
    want = {0.31: 0, 0.35: 0.08, 0.40: 0.30, 0.50: 1.00, 0.65: 2.56, 0.80: 4.61, 0.85: 5.39, 1.0: 8}
    got = spark.createDataFrame([(k,) for k in want], "c double").select("c", reward.copy_penalty(F.col("c")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(want[r["c"]], abs=0.006) for r in got)


def test_hard_check(spark):
    df = spark.createDataFrame([("a draft", " ", False, 0.0), ("a draft", "x", True, 0.0), ("a draft", "x", False, 0.9), ("some words here", "今天下午三点", False, 0.0), ("some words", "other words", False, 0.1)], "d string, o string, g boolean, c double")
    assert [r[0] for r in df.select(reward.hard_check(F.col("d"), F.col("o"), F.col("g"), F.col("c"))).collect()] == ["empty", "degenerate", "copy 0.90", "language_switch", None]


def test_null_verdicts(spark):
    fields = "severity string, facts_all_kept boolean, greeting_signoff_kept boolean, format_kept boolean, meaning_changed boolean, added_content boolean, identity boolean, evidence string, reads_like_person int, padding boolean"
    v = (None, False, None, True, True, None, False, "none", 4, False)
    a = spark.createDataFrame([(1, v), (2, None), (3, None)], f"key int, verdict struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    b = spark.createDataFrame([(1, v), (2, v), (3, None)], a.schema)
    got = {r["key"]: r for r in verdicts.merge_reviews(a, b, ["key"]).collect()}
    assert got[1]["facts_all_kept"] is False and got[1]["greeting_signoff_kept"] is True and got[1]["severity"] == "none" and got[1]["votes"] == 2
    assert got[2]["votes"] == 1 and got[2]["severity"] is None and got[3]["votes"] is None


def test_check_filled(spark):
    df = spark.createDataFrame([("a", "b"), ("", "c")], "p string, q string")
    with pytest.raises(ValueError):
        datasets.check_filled(df, ["p", "q"])
    datasets.check_filled(df, ["q"])


def test_group_split_never_splits_a_group(spark):
    df = spark.createDataFrame([(i, f"Text  {i % 60}" if i % 2 else f"text {i % 60}") for i in range(600)], "n int, t string")
    split = datasets.group_split(df, "n", "t")
    assert datasets.leaks(split, "t").count() == 0 and split.filter("side = 'eval'").count() >= 40


def test_sources_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"key": "a", "src": "s", "draft": "d"}\n{bad\n{"key": "b", "src": "s", "draft": "e"}\n')
    assert jsonl.read_lines(spark, str(tmp_path / "in"), jsonl.INPUTS).select("key").count() == 2
    (tmp_path / "x_zh.txt").write_text(" hello \n")
    assert [tuple(r) for r in jsonl.read_drafts(spark, str(tmp_path)).collect()] == [("x_zh", "hello")]
    (tmp_path / "cases.json").write_text(json.dumps({"c": [{"text": "t", "inv": 0, "copy": 0.5, "retried": None}]}))
    assert jsonl.read_cases(spark, str(tmp_path / "cases.json")).first()["text"] == "t"
    run = lambda: log.process_new(spark, str(tmp_path / "in"), jsonl.INPUTS, str(tmp_path / "out"), str(tmp_path / "cp"), ["key"], lambda d: d.filter("key IS NOT NULL"))
    run()
    (tmp_path / "in" / "b.jsonl").write_text('{"key": "a", "src": "s", "draft": "again"}\n{"key": "c", "src": "s", "draft": "f"}\n')
    run()
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_judge_retries(spark):
    df = spark.createDataFrame([("x",), ("y",)], "prompt string")
    got = jsonl.judged(df, lambda p: None if p == "x" else '{"a": 1}', pause=lambda attempt, reason: 0.0).collect()
    assert {r["prompt"]: r["answer"] for r in got} == {"x": None, "y": '{"a": 1}'} and {r["prompt"]: r["failures"] for r in got} == {"x": ["empty"] * 3, "y": []}


def test_judge_backoff(spark):
    def ask(p):
        error = OSError(p)
        error.code = int(p)
        raise error

    df = spark.createDataFrame([("429",), ("404",)], "prompt string")
    quick = lambda attempt, reason: None if jsonl.backoff(attempt, reason) is None else 0.0
    got = {r["prompt"]: r["failures"] for r in jsonl.judged(df, ask, pause=quick).collect()}
    assert got == {"429": ["HTTP429"] * 3, "404": ["HTTP404"]}
    assert [jsonl.backoff(i, "HTTP503") for i in range(2)] == [2, 6] and [jsonl.backoff(i, "empty") for i in range(2)] == [1, 3]


def test_salvage_and_cut(spark):
    df = spark.createDataFrame([('so {"a": {"b": 2}} there',), ("no json",), ("{broken",), (None,)], "t string")
    assert [r[0] for r in df.select(F.try_variant_get(text.salvage_json(F.col("t")), "$.a.b", "int")).collect()] == [2, None, None, None]
    one = spark.createDataFrame([(" kept \n### Rewritten: x",)], "t string")
    assert one.select(text.cut_at_stops(F.col("t"))).first()[0] == "kept"


def test_prefix_guard(spark):
    drafts = spark.createDataFrame([(1, "one two three four one two three five in 2024 we met")], "id int, text string")
    index = guard.prefix_index(drafts, "id", "text")
    assert guard.probe(index, spark.createDataFrame([(1, "so one two three")], "id int, text string"), "id", "text").first()["next"] == ["five", "four"]
    assert index.filter(F.col("prefix").rlike("[0-9]")).count() == 0


def test_jaccard_of_nothing(spark):
    assert spark.range(1).select(overlap.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 0.0


FACTS = "key int, verdict struct<facts:array<struct<id:int,status:string,severity:string>>,invented:array<struct<text:string,span:string>>,reversed_meaning:boolean,register_kept:boolean,format_kept:boolean,greeting_signoff_kept:boolean>"


def test_fact_votes(spark):
    one = ([(1, "changed", "critical"), (2, "dropped", None), (3, "changed", "minor")], [("x", "s")], True, False, None, False)
    two = ([(1, "Dropped", "minor"), (2, "kept", None), (3, "changed", "critical")], [], True, False, None, True)
    a = spark.createDataFrame([(1, one), (2, one), (3, None), (4, one)], FACTS)
    b = spark.createDataFrame([(1, two), (2, None), (3, two)], FACTS)
    got = {r["key"]: r for r in reward.folded(verdicts.merge_facts(a, b, ["key"])).collect()}
    assert [(f["id"], f["status"], f["severity"]) for f in got[1]["verdict"]["facts"]] == [(1, "changed", "minor"), (2, "kept", None), (3, "changed", "minor")]
    assert (got[1]["n_invented"], got[1]["reversed_meaning"], got[1]["register_kept"], got[1]["format_kept"], got[1]["greeting_signoff_kept"], got[1]["minor"]) == (0, True, False, True, True, 2)
    for k in (2, 4):  # without a second vote the first stays as it is
        assert (got[k]["changed"], got[k]["dropped"], got[k]["critical"], got[k]["n_invented"], got[k]["format_kept"], got[k]["judged"]) == (2, 1, 2, 1, None, True)
    assert not got[3]["judged"] and got[3]["verdict"] is None
    rows = spark.createDataFrame([(1, None), (2, -3.0)], "key int, reward double")
    assert {(r["reward"], r["judge_failed"]) for r in reward.online(rows).collect()} == {(-1.0, True), (-3.0, False)}


def test_raw_votes_are_kept(spark):
    fields = "struct<severity:string,facts_all_kept:boolean,greeting_signoff_kept:boolean,format_kept:boolean,meaning_changed:boolean,added_content:boolean,identity:boolean,evidence:string,reads_like_person:int,padding:boolean>"
    x, y = ("none", True, True, True, False, False, False, "none", None, None), ("minor", True, True, True, False, False, False, "b", 5, False)
    a, b = (spark.createDataFrame([(1, v), (2, w)], f"key int, verdict {fields}") for v, w in ((x, None), (y, y)))
    got = {r["key"]: r for r in verdicts.merge_reviews(a, b, ["key"]).collect()}
    assert got[1]["reads_like_person"] is None and got[1]["padding"] is None and [v["evidence"] for v in got[1]["raw"]] == ["none", "b"]
    assert got[2]["reads_like_person"] == 5 and got[2]["raw"] is None and got[2]["votes"] == 1


def test_copy_rate_has_the_eight_fields(spark):
    got = pairs.copy_rate(pairs.all_metrics(spark.createDataFrame([(1, "One two three four five six seven.", "One two three four five six seven.")], "pair_id int, draft string, output string"))).first().asDict()
    assert got == {"pair_id": 1, "copy_5gram": 1.0, "copy_5gram_raw": 1.0, "verbatim_sent": 1.0, "novel_ratio": 0.0, "n_sent_out": 1, "align_sim": 1.0, "order_agree": 1.0, "one_to_one": 1.0}


def test_preferences_against_plain_python(spark):
    from rewritelab.functions import align

    fields = "facts_all_kept boolean, meaning_changed boolean, added_content boolean, padding boolean, greeting_signoff_kept boolean, format_kept boolean, identity boolean, reads_like_person int, severity string, evidence string"
    good, poor = (True, False, False, False, True, True, False, 5, "none", "none"), (False, True, False, False, True, True, False, 2, "critical", "e" * 200)
    draft = "The board met on Monday to review the budget of 2024. It approved a rise of 12% in spending."
    texts = ["On Monday members looked at what 2024 will cost. Spending goes up 12%.", "The board met on Monday to review the budget of 2024. Up 12%.", "Nobody met.", "  "]
    cands = spark.createDataFrame([("k", "s", texts), ("none", "s", texts[:1]), ("unjudged", "s", texts), ("stray", "s", texts)], "key string, src string, cands array<string>")
    inputs = spark.createDataFrame([(k, draft) for k in ("k", "none", "unjudged")], "key string, draft string")
    votes = spark.createDataFrame([("k", 0, good), ("k", 1, good), ("k", 2, poor), ("none", 0, good)], f"key string, i int, verdict struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    rows, choice = datasets.build_preferences(cands, inputs, votes, "t")
    got = rows.collect()
    m = [align.all_metrics(draft, t) for t in texts]
    best = max(x["fact_recall"] for x in m[:2])
    want = min((i for i in (0, 1) if m[i]["fact_recall"] >= best - 0.05), key=lambda i: m[i]["copy"])
    assert len(got) == 1 and got[0]["chosen"] == texts[want] and got[0]["rejected"] == texts[2] and got[0]["rejected_reason"] == "e" * 120
    assert got[0]["chosen_copy"] == m[want]["copy"] and got[0]["chosen_facts"] == m[want]["fact_recall"] and draft in got[0]["prompt"] and got[0]["provider"] == "dpo:t"
    assert datasets.funnel(choice).first().asDict() == {"pairs": 1, "no_clean": 1, "no_bad": 1, "all_clean": 1, "style_band": 0}


def test_leaks_and_small_splits_are_refused(spark):
    rows = [(i, f"text {i}", "eval" if i < 45 else "train") for i in range(200)]
    datasets.check_split(spark.createDataFrame(rows, "n int, t string, side string"), "t")
    for bad in (rows + [(999, " TEXT   3 ", "train")], rows[10:]):
        with pytest.raises(ValueError):
            datasets.check_split(spark.createDataFrame(bad, "n int, t string, side string"), "t")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in (3, 1, 2)], "n int, t string")
    at = jsonl.overwrite(df, str(tmp_path / "out"), 2, ["n"])
    assert at.endswith("_limit2") and sorted(r["n"] for r in spark.read.json(at).collect()) == [1, 2]
    assert jsonl.overwrite(df, str(tmp_path / "out")) == str(tmp_path / "out")
    jsonl.append_lines(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    (tmp_path / "whole.json").write_text(json.dumps({"a": {"b": [1, 2]}}, indent=2))
    assert jsonl.read_json(spark, str(tmp_path / "whole.json"), "a struct<b:array<int>>").first()["a"]["b"] == [1, 2]


def test_counters_of_a_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    line = lambda s, r: json.dumps({"step": s, "reward": r, "critical": 1, "minor": 2}) + "\n"
    for i, rows in enumerate([[(1, -2.0), (1, -4.0)], [(1, 0.0), (2, -1.0)]]):
        (tmp_path / "log" / f"{i}.jsonl").write_text("".join(line(*r) for r in rows))
        log.running_counters(spark, str(tmp_path / "log"), "step int, reward double, critical int, minor int", f"counters{i}", str(tmp_path / f"cp{i}"))
    got = {r["step"]: (r["n"], r["mean_reward"], r["critical"], r["minor"]) for r in spark.table("counters1").collect()}
    assert got == {1: (3, -2.0, 3, 6), 2: (1, -1.0, 1, 2)}
    df = spark.createDataFrame([("a",)], "x string")
    assert len({log.versioned(df, p).first()["prompt_hash"] for p in ("p", "p", "q")}) == 2


def test_span_of_a_sentence(spark):
    t = "one two. three four five! six"
    df = spark.createDataFrame([(t, "Three four"), (t, "absent"), (t, "six")], "low string, span string")
    got = [r[0] and t[r[0]["from"] : r[0]["to"]] for r in df.select(reward.sentence_span(F.col("low"), F.col("span"))).collect()]
    assert got[1] is None and got[0].startswith("three four five!") and got[2] == "six"


def test_positions_with_ties(spark):
    from rewritelab.operators.positions import with_position

    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a int, b int").repartition(5)
    got = [(r["a"], r["b"]) for r in with_position(df, ["a", "b"]).orderBy("position").collect()]
    assert got == sorted((i % 7, i) for i in range(500)) and with_position(df.limit(0), ["a"]).count() == 0
