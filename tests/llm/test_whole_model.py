"""The language model learns from every word of every training document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewritelab.llm import scoring


@pytest.fixture
def frame(spark):
    return lambda texts: spark.createDataFrame([(i, i % 10 == 0, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")


def test_head_words_come_from_all_documents(frame, monkeypatch):
    monkeypatch.setattr(scoring, "HEAD", 3)
    monkeypatch.setattr(scoring, "HELD_WORDS", 5)
    long = "x" * 100
    docs = frame([f"w{i} w{i} b" if i < 4500 else f"{long} {long} c" for i in range(9000)])
    words = scoring.word_counts(docs)
    got = {r["key"]: r["n"] for r in words.collect()}
    key = lambda w: scoring.xxhash.xxh64_intdigest(w) - (1 << 64) * (scoring.xxhash.xxh64_intdigest(w) >> 63)
    assert got[key("b")] == got[key("c")] == 4050 and got[key(long)] == 8100 and got[key("w1")] == 2 and len(got) == 4053
    assert {int(x) for x in scoring.head_words(words).view(np.int64)} == {key(long), key("b"), key("c")}


def test_rare_words_are_told_apart_in_histories(frame, monkeypatch):
    monkeypatch.setattr(scoring, "HEAD", 0)
    ids = [np.frombuffer(r["ids"], "<u4") for r in scoring.encode(frame(["one b", "two b", "one b"]), np.zeros(0, np.uint64)).orderBy("doc_id").collect()]
    one, two, again = (scoring.history(x, np.array([0])) for x in ids)
    assert (one == again).all() and (one[1][1] != two[1][1]) and one[1][2] == two[1][2]


def test_words_beyond_the_closed_classes_see_the_history(frame):
    firsts = [f"a{i}" for i in range(300)]
    docs = frame([f"{a} {a.replace('a', 'b')} end" for i in range(30) for a in firsts] + ["a7 b7 end", "a7 b8 end"])
    got = {r["text"]: r["score"] for r in scoring.score_documents(docs).join(docs.select("doc_id", "text"), "doc_id").filter("doc_id >= 9000").collect()}
    assert got["a7 b7 end"] > got["a7 b8 end"] + 0.1


def test_the_model_is_a_distribution(frame):
    rows = [f"w{i % 700} v{i % 900} x" for i in range(3000)]
    vocabulary = sorted({w for t in rows for w in t.split()})
    docs = frame(rows + ["w3"] + [f"w3 {w}" for w in vocabulary])
    docs = docs.withColumn("held_out", F.col("doc_id") >= 3000)
    words = scoring.word_counts(docs)
    head = scoring.head_words(words)
    encoded = scoring.encode(docs, head)
    counts = scoring.head_counts(encoded)
    classes = scoring.Classes(counts)
    tree = scoring.Tree(words, head, counts, classes, words.count())
    weights, leaves = scoring.fit(encoded, counts, classes, tree)
    ids = [np.frombuffer(r["ids"], "<u4") for r in encoded.filter("doc_id > 3000").collect()]
    raw = scoring.history(np.array([*ids[0][:1], scoring.END], np.uint32), np.array([0]))[:, 1:]
    cells = np.arange(1 << tree.levels)
    assert np.exp(tree.descend(np.repeat(raw, len(cells), axis=1), cells, leaves)).sum() == pytest.approx(1, abs=1e-4)
    opened = [i for i in range(1, len(head) + 1) if classes.kind[i] == 0]
    mass = np.bincount(tree.cells(np.array(opened, np.uint32)), weights=counts[opened] + 0.1, minlength=len(cells)) + 0.1
    assert np.allclose(10**tree.bottom, mass) and np.abs(leaves).max() > 0


def test_the_model_grows_with_the_training_tokens():
    small, large = scoring.sizes(3_000_000), scoring.sizes(4_000_000_000)
    assert all(a < b for a, b in zip(small, large))


def test_sums_of_many_tasks_are_added_by_a_tree(frame, monkeypatch):
    docs = frame([f"w{i % 7} w{i % 5} x" for i in range(600)])
    words = scoring.word_counts(docs)
    head = scoring.head_words(words)
    encoded = scoring.cut(scoring.encode(docs.repartition(13), head))
    counts = scoring.head_counts(encoded)
    classes = scoring.Classes(counts)
    tree = scoring.Tree(words, head, counts, classes, words.count())
    fixed = encoded.sparkSession.sparkContext.broadcast((classes, tree))
    weights, leaves = scoring.first_weights(counts, classes, 1 << 14), np.zeros(1 << 8, np.float32)
    got = []
    for fan_in in (32, 2):
        monkeypatch.setattr(scoring, "FAN_IN", fan_in)
        monkeypatch.setattr(scoring, "TASK_TOKENS", 1 << 22 if fan_in == 32 else 100)
        got.append(scoring.round_counts(encoded.select("ids"), weights, leaves, fixed, 2400))
    assert all(np.allclose(a, b, rtol=0.03, atol=0.05) for a, b in zip(*got)) and got[0][1].sum() > 0
    assert scoring.tasks_of(0, 6) == 6 and scoring.tasks_of(10**12, 6) > 100_000


def test_gradient_and_curvature_come_from_every_token(frame):
    docs = frame([f"w{i % 11} v{i} u{i * 7 % 1000} x t{i % 999} s{i % 899} {'o n' if i < 3000 else 'n o'}" for i in range(6000)])
    words = scoring.word_counts(docs)
    head = scoring.head_words(words)
    encoded = scoring.cut(scoring.encode(docs.coalesce(1), head))
    counts = scoring.head_counts(encoded)
    classes = scoring.Classes(counts)
    tree = scoring.Tree(words, head, counts, classes, words.count())
    leaves = np.sin(np.arange(1 << 12)).astype(np.float32) / 4
    fixed = encoded.sparkSession.sparkContext.broadcast((classes, tree))
    got = scoring.round_counts(encoded.select("ids"), scoring.first_weights(counts, classes, 1 << 14), leaves, fixed, 4000)[2]
    texts = [np.frombuffer(r["ids"], "<u4") for r in encoded.collect()]
    ids, raw = np.concatenate(texts), np.concatenate([scoring.history(x, np.array([0])) for x in texts], axis=1)
    is_open = classes.kind[np.minimum(ids, scoring.RARE)] == 0
    cells, h = tree.cells(ids)[is_open].astype(np.uint64), raw[1:, is_open] >> np.uint64(20) & np.uint64(2**32 - 1)
    assert len(cells) > 3 * scoring.TREE_CHUNK
    want = np.zeros((2, len(leaves)))
    for level in range(tree.levels):
        node, right = (1 << level) + (cells >> np.uint64(tree.levels - level)), cells >> np.uint64(tree.levels - level - 1) & np.uint64(1)
        at = ((h ^ node * np.uint64(0x9E3779B1) & np.uint64(2**32 - 1)) * np.uint64(0x85EBCA6B) & np.uint64(2**32 - 1)) >> np.uint64(20)
        p = 1 / (1 + np.exp(-(tree.logit[node] + leaves[at].sum(axis=0, dtype=np.float64))))
        for f in at:
            want += [np.bincount(f.astype(np.int64), weights=x, minlength=len(leaves)) for x in (right - p, p * (1 - p))]
    assert np.allclose(got[0], want[0], rtol=0.01, atol=0.01) and np.allclose(got[1], want[1], rtol=0.01, atol=0.01)


def test_every_training_document_is_in_one_round(frame, monkeypatch):
    docs = frame([f"w{i % 7} w{i % 5} x" for i in range(600)])
    words = scoring.word_counts(docs)
    head = scoring.head_words(words)
    encoded = scoring.cut(scoring.encode(docs, head))
    counts = scoring.head_counts(encoded)
    classes = scoring.Classes(counts)
    seen, own = [], scoring.round_counts
    monkeypatch.setattr(scoring, "round_counts", lambda part, *rest: (seen.extend(r["uid"] for r in part.collect()), own(part, *rest))[1])
    scoring.fit(encoded, counts, classes, scoring.Tree(words, head, counts, classes, words.count()))
    assert sorted(seen) == sorted(r["uid"] for r in encoded.filter("NOT held_out").collect())
