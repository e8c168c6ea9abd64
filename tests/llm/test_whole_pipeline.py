"""Stages of the pipeline lose no document that they have no reason to drop."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ONE, TWO = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "quite other words that go on for a while here"


def test_rows_of_one_id_with_other_texts_stay(spark):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in [(1, ONE), (2, ONE), (2, TWO), (3, TWO), (2, TWO)]], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, ONE), (2, TWO)]


def test_without_labels_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(i, t, None, "a", 1) for i, t in enumerate([ONE, TWO, None, "", "12 34"])], SCHEMA)
    assert sorted(r["text"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [ONE, TWO]


def _table():
    """Documents with repeated ids, rows without ids, exact and near copies, passages of items, and texts without letters."""
    import random

    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", text(r.randint(3, 14))) for k in range(12)] + [("i98", None), ("i99", "")]
    rows = [(i, text(r.randint(15, 80)), "en", "a" if i < 300 else "b" if i < 350 else None) for i in range(380)]
    rows += [(500 + k, text(20) + " " + items[k][1] + " " + text(20), "de", "b") for k in range(6)]
    rows += [(600 + k, text(8) + " " + items[k][1].rsplit(" ", 2)[0] + " " + text(8), "de", "b") for k in range(12)]
    for i in range(0, 60, 3):  # one word of many changed, the same text in capitals, and the same row again
        w = (rows[i][1] + " " + rows[i + 1][1]).split()
        rows.append((700 + i, " ".join(w), "en", "a"))
        w[r.randrange(len(w))] = "changed"
        rows += [(800 + i, " ".join(w), "en", "b"), (i, rows[i + 2][1].upper(), None, None), rows[i + 1]]
    rows += [(None, text(30), None, "a") for _ in range(10)] + [(None, rows[5][1], "en", "b"), (900, None, "en", "a"), (901, "", "en", "a"), (902, "12 34", "en", None)]
    r.shuffle(rows)
    return rows, items


def test_run_against_plain_python(spark, tmp_path):
    import zlib

    import brute
    from rewritelab.llm import sharding

    rows, items = _table()
    spark.createDataFrame([(*x, 1) for x in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [x for x in rows if any(c.isalpha() for c in x[1] or "")]
    assert len(rows) - len(kept) == 3

    keys = {(brute.row_id(i, t), brute.spark_hash(("q", brute.row_id(i, t)), t)): (i, t, s) for i, t, _, s in kept}
    of = brute.classes({k: brute.fingerprint(x[1]) for k, x in keys.items()})
    least = {}
    for k, c in of.items():
        least[c] = min(least.get(c, k), k)
    alone = [keys[k] for k in least.values()]
    assert len(alone) < len(keys) - 20

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    tests = [g for _, t in items if (g := grams(t))]
    clean = [x for x in alone if not any(len(g & grams(x[1])) >= 0.8 * len(g) for g in tests)]
    assert len(clean) <= len(alone) - 5

    hashed = [(brute.spark_hash(("q", brute.row_id(i, t)), t), t, s) for i, t, s in clean]
    taken = sorted((p, k[0], i, t) for (i, t, _), k, (*_, places) in zip(clean, hashed, brute.mix(hashed)) for p in places)
    want = []
    for n, (_, _, i, t) in enumerate(taken):
        p = brute.permuted(n, len(taken), sharding.SEED)
        want.append((p % 24, p // 24, i, len(t.encode()) + 8, zlib.crc32(t.encode())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["shard"], r["slot"], r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(want)


def test_op8_against_plain_python(spark, tmp_path):
    import brute
    from rewritelab.llm import mixing

    rows, _ = _table()
    spark.createDataFrame([(*x, 1) for x in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    order = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    want = sorted(((i, n, total, round(target, 6), n * len(p), [round(x, 9) for x in p]) for (i, *_), (n, total, target, p) in zip(rows, brute.mix([(i, t, s) for i, t, _, s in rows]))), key=order)
    runs = [sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], [round(x, 9) for x in r["positions"]]) for r in mixing.op8_mixing(spark, str(tmp_path)).collect()), key=order) for _ in range(2)]
    assert runs[0] == runs[1] == want
    for total, target in {(x[2], x[3]) for x in want}:
        assert abs(sum(x[4] for x in want if x[2:4] == (total, target)) - target) <= 0.01 * target
