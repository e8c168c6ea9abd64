import pytest

from rewritelab.functions import align, segment

D = (
    "The board met on Monday to review the yearly budget plan. It approved a 12% rise in spending for 2024. Critics said that the new plan lacked any detail. "
    "The mayor replied that more figures would follow very soon. A second vote is due to be held next week."
)


def test_identity():
    m = align.all_metrics(D, D)
    assert m["copy"] == m["reuse"] == m["lcs_content"] == m["fact_recall"] == 1.0
    assert m["one_to_one"] == m["coverage"] == 1.0 and m["n_out"] == 5


def test_shuffled_sentences_stay_copied():
    m = align.all_metrics(D, " ".join(reversed([s + "." for s in D[:-1].split(". ")])))
    assert m["verbatim_draft"] == 1.0 and m["copy"] == 1.0 and m["order_agree"] == 0.0 and m["coverage"] == 1.0


def test_padding_does_not_hide_a_copy():
    m = align.all_metrics(D, D + " " + "Nothing else of note was heard from anyone in the hall that day. " * 6)
    assert m["copy"] == 1.0 and m["copy_5gram"] < 0.6


def test_filler_keeps_verbatim_draft():
    m = align.all_metrics(D, D.replace(" the ", " the really ").replace(" that ", " that well "))
    assert m["verbatim_draft"] == 1.0


def test_dropping_sentences_lowers_coverage():
    assert align.all_metrics(D, D[: D.index("Critics")])["coverage"] == pytest.approx(0.4)


def test_tags_do_not_hide_a_copy():
    assert align.all_metrics(D, f"<p>{D}</p>")["copy"] == 1.0


@pytest.mark.parametrize("draft, output", [(None, None), ("", ""), ("a b", "c"), (D, ""), ("", D)])
def test_degenerate_inputs(draft, output):
    m = align.all_metrics(draft, output)
    assert len(m) == 22 and m["copy"] == 0.0


def test_abbreviations_and_soft_wraps():
    assert len(segment.sentences("Dr. Smith of the U.S. Dept. of Energy spoke. See Fig. 3 for more, e.g. the last row.")) == 2
    assert len(segment.sentences("this line is long enough to be wrapped\nand goes on here until its end.")) == 1


def test_facts():
    assert align.facts("12% of 1,200 in 2019-2021 by NASA, a.b@example.com") == {"12%", "12", "1200", "2019-2021", "2019", "2021", "nasa", "a.b@example.com"}


def test_structure_lines():
    prose, structure = segment.split_prose(f"Subject: plans\nDear all,\n{D}\n| a | b |\n```\nx = 1\n```\nBest regards,\nAnn")
    assert prose == D and "Ann" in structure and "x = 1" in structure and "| a | b |" in structure


def test_chinese():
    t = "今天下午三点我们在会议室开会讨论预算。请大家准时参加并带上材料。"
    assert align.all_metrics(t, t)["copy"] == 1.0 and align.all_metrics(t, t)["skeleton_recall"] is None
    assert len(segment.sentences(t)) == 2


SENTENCES = [s + "." for s in D[:-1].split(". ")]


@pytest.mark.parametrize(
    "output, want",
    [
        (" ".join(SENTENCES[1:] + SENTENCES[:1]), {"coverage": 1.0, "one_to_one": 1.0, "verbatim_out": 1.0, "copy": 1.0, "align_sim": 1.0, "order_agree": 0.75}),
        (" ".join([SENTENCES[0]] * 5), {"coverage": 0.2, "one_to_one": 0.0, "verbatim_out": 1.0, "verbatim_draft": 0.224, "copy": 1.0, "n_out": 5}),
        (" ".join(SENTENCES[:2]), {"coverage": 0.4, "copy_5gram": 1.0, "verbatim_out": 1.0, "n_out": 2, "frag_coverage": 1.0}),
    ],
)
def test_goldens(output, want):
    m = align.all_metrics(D, output)
    assert {k: m[k] for k in want} == want


def test_containment_and_fragments():
    assert align.contain(list("abcde"), list("xabyde")) == 0.8 and align.contain([], ["a"]) == 0.0 and align.contain(list("ab"), list("a"), 0.9) == 0.0
    # "a b c" and "d e" are copied, "z" is not: coverage 5/6, density (9 + 4) / 6
    assert align.fragments("a b c x d e", "a b c z d e") == (pytest.approx(5 / 6), pytest.approx(13 / 6))
    assert align.verbatim_pair("One two three four five six. Seven eight nine ten eleven.", "One two three four five six. All of it is new here.") == (0.5, pytest.approx(6 / 11))


LETTER = "Subject: the plan\n\nDear Ann,\n\nWe will meet in the old hall on Monday and talk about it at length.\n\nBest regards,\nBob"


def test_formats():
    assert segment.split_format(LETTER)[0] == ["Subject: the plan", "Dear Ann,", "Best regards,", "Bob"]
    assert align.format_recall(LETTER, LETTER) == 1.0 and align.format_recall(LETTER, LETTER.replace("Subject: the plan\n\n", "").replace("\nBob", "")) == 0.5
    assert align.format_presence(LETTER, LETTER) == 1.0 and align.format_presence("no structure in this text at all, none", "x") == 1.0
    assert align.format_presence(LETTER, LETTER.replace("Dear Ann,", "Hello Ann,")) == 1.0
    two = "first paragraph of text here\n\nsecond paragraph of text here"
    assert align.all_metrics(two, "only one paragraph of text here")["para_kept"] == 0.5


def test_line_shapes_of_both_forms(spark):
    from pyspark.sql import functions as F

    from rewritelab.functions import text

    lines = ["Dear all,", "Best regards,", "# title", "Name: x", "- item", "1) item", "| a | b |", "---", "plain words here", "a.b@example.com", "2024-01-02", "尊敬的老师：", "此致", "Subject: x", ""]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    got = [tuple(r) for r in df.select(text.line_shape(F.col("t")), text.line_kind(F.col("t"))).collect()]
    assert got == [(segment.line_shape(x), segment.line_kind(x)) for x in lines]


def test_chinese_overlap():
    t = "今天下午三点我们在会议室开会讨论预算。请大家准时参加并带上材料。"
    m = align.all_metrics(t, "请大家准时参加并带上材料。今天下午三点我们在会议室开会讨论预算。")
    assert m["verbatim_draft"] == 1.0 and m["copy"] == 1.0 and m["order_agree"] == 0.0
    assert align.all_metrics("In short: " + t, "Briefly, " + t)["copy"] > 0.8 and align.all_metrics(t, "明天早上再说别的事情，不用准备任何东西。")["copy"] == 0.0
