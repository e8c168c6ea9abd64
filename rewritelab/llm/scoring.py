"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history).  The CLASSES - 1 closed classes hold WIDTH frequent
words each; inside them the second factor is a softmax too.  Class 0 holds all other words, known and unknown.  Their
hashes deal them to the cells of a binary tree, whose number grows with the weights (one for each known word at most);
inside class 0 the factor is the product of the logistic choices on the way to the cell, each of which sees the
history, by the word's smoothed share of its cell's training tokens.  So every word's factor depends on the history,
and the model is a proper distribution over an open vocabulary.  All choices see the same hashed features of the
history: a bias, the last word, the last two, and two skips (the word before the last, and the one before that).

Learning runs over all training documents, in rounds, each over a part by hash.  Each round, tasks compute expected and
observed feature counts of their documents under the broadcast weights, and the gradient and curvature of the tree's
weights, over every token, and send sums (in blocks); a tree of sums, as deep as the number of tasks asks for, leaves one array, and the
driver takes a gradient step, scaled feature by feature.  Buckets, tree weights and rounds grow with the training tokens, see sizes().

Unigram counts are exact over all training tokens.  The HEAD most frequent words of all training documents are numbered
and counted in arrays, one a task; the closed classes hold the first of them.  Every other word is keyed by its
64-bit hash, shuffled once with its documents' counts, summed over its rows and sent back to its documents; in
histories it has 31 bits of its hash, so that every word is told from the others there.

Scale: texts are read twice (words are counted first) and kept as 32-bit ids, in the shared checkpoint folder; the
shuffles hold one row for each rare word of each document, and one array of sums for TASK_TOKENS tokens.  To the driver come HEAD
counts, the cells' masses and one array of sums a round, all of a bounded size.

Defined results: null text counts as empty: one end token; ids may repeat (rows are kept apart); a null id is in
training; without training documents every count is 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, most_frequent, table, text_of

HEAD = 60_000
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 400_000
CLASSES, WIDTH = 16, 16
FEATURES = 5
#: Most levels of the tree of cells.
MOST_LEVELS = 20
#: Weights for each node of the tree, at least, so that choices far down aren't made by weights that many nodes share.
WEIGHTS_A_NODE = 32
#: Numbers that one message of summed counts holds.
BLOCK = 1 << 16
#: Tokens of a task in a round, at least, where there are more tasks than cores; and tasks whose sums meet in one sum of the next level, about.
TASK_TOKENS, FAN_IN = 1 << 22, 32
STEP, FLOOR, TREE_FLOOR = 0.5, 4.0, 0.5
#: Ids: 0 ends a text, 1 to HEAD are head words; those of other words are 31 bits of their hashes above OTHER.
END, START, RARE, OTHER = 0, 65534, 65535, 1 << 31
#: Tokens whose probabilities are computed at a time.
CHUNK = 1 << 16
#: Tokens that go down the tree at a time, so that their arrays stay in cache.
TREE_CHUNK = 1 << 12
LN10 = float(np.log(10))


def word_counts(docs: DataFrame) -> DataFrame:
    """key (64-bit hash of a word), n: its tokens in all training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(found.values(), np.int64, len(found)))], names=["key", "n"])
            found.clear()
            return out

        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                found.update((t.as_py() or b"").lower().split())
                if len(found) >= HELD_WORDS:
                    yield rows()
        yield rows()

    return docs.filter("NOT held_out").select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def head_words(words: DataFrame) -> np.ndarray:
    """Keys (uint64) of HEAD words or fewer, the most frequent ones, by falling count."""
    best = most_frequent(words, HEAD)[0].toArrow()  # HEAD rows at most
    keys, n = best["key"].to_numpy().astype(np.int64), best["n"].to_numpy().astype(np.int64)
    return keys[np.lexsort((keys, -n))].view(np.uint64)


def encode(docs: DataFrame, head: np.ndarray) -> DataFrame:
    """uid, doc_id, held_out, ids (little-endian uint32, with the end), rare (hashes), times."""
    shared = docs.sparkSession.sparkContext.broadcast(head)  # HEAD keys at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {k: i + 1 for i, k in enumerate(shared.value.tolist())}
        known: dict[bytes, int] = {}  # head words met
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                b = whole.slice(first, 1000)
                ids, rare, times = [], [], []
                for t in b.column(3).cast(pa.binary()):
                    words = (t.as_py() or b"").lower().split()
                    own = np.array([known.get(w, RARE) for w in words] + [END], "<u4")
                    new = np.nonzero(own == RARE)[0]
                    at = [words[i] for i in new.tolist()]
                    keys = [xxhash.xxh64_intdigest(w) for w in at]
                    got = [index.get(k, 0) for k in keys]
                    known.update((w, i) for w, i in zip(at, got) if i)
                    keys, got = np.array(keys, np.uint64), np.array(got, np.uint32)
                    own[new] = np.where(got > 0, got, (keys >> np.uint64(32)).astype(np.uint32) | np.uint32(OTHER))
                    keys, n = np.unique(keys[got == 0].view(np.int64), return_counts=True)
                    ids.append(own.tobytes())
                    rare.append(keys)
                    times.append(n)
                offsets = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
                flat = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], kind))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary()), flat(rare, pa.int64()), flat(times, pa.int32())], names=["uid", "doc_id", "held_out", "ids", "rare", "times"])

    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(run, "uid long, doc_id long, held_out boolean, ids binary, rare array<long>, times array<int>")


def head_counts(encoded: DataFrame) -> np.ndarray:
    """Training tokens of each id below RARE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARE + 1, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.minimum(np.frombuffer(x.as_py(), "<u4"), RARE), minlength=RARE + 1)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["id", "n"])

    rows = encoded.filter("NOT held_out").select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # RARE + 1 rows at most
    out = np.zeros(RARE + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


class Classes:
    """Class and place of every id: the most frequent ids, the end among them, by falling count."""

    def __init__(self, counts: np.ndarray):
        n = counts.copy()
        n[START:] = 0
        order = np.argsort(-n, kind="stable")[: (CLASSES - 1) * WIDTH].tolist()
        order = [END, *(i for i in order if n[i] > 0 and i != END)][: (CLASSES - 1) * WIDTH]
        self.kind = np.zeros(RARE + 1, np.uint8)
        self.place = np.zeros(RARE + 1, np.uint8)
        for k, i in enumerate(order):
            self.kind[i], self.place[i] = 1 + k // WIDTH, k % WIDTH
        sizes = np.bincount(np.arange(len(order)) // WIDTH + 1, minlength=CLASSES)
        #: -inf where a class has fewer than WIDTH words
        self.mask = np.where(np.arange(WIDTH)[None, :] < sizes[:, None], 0, -np.inf).astype(np.float32)
        self.mask[0] = 0
        self.empty = np.where((sizes > 0) | (np.arange(CLASSES) == 0), 0, -np.inf).astype(np.float32)


def sizes(tokens: int) -> tuple[int, int, int]:
    """Buckets of the classes' features, weights of the tree, and gradient steps: they grow with the training tokens."""
    bits = tokens.bit_length()
    return 1 << min(17, max(14, 10 + bits // 5)), 1 << min(21, 8 + bits * 2 // 5), min(12, max(4, bits - 22))


def levels_of(known: int, weights: int) -> int:
    """Levels of a tree over ``known`` words: so many that each node has WEIGHTS_A_NODE of the ``weights``, and a cell a word at most."""
    return max(1, min(MOST_LEVELS, known.bit_length(), (weights // WEIGHTS_A_NODE).bit_length() - 1))


class Tree:
    """A binary tree over 2**levels cells of the words outside the closed classes; a word's hash names its cell.

    ``logit``: log odds of a node's right side by the cells' masses; ``bottom``: log10 of a cell's mass, its known
    words' counts plus 0.1 each and 0.1 for unknown ones; ``head``: cells of head ids.
    """

    def __init__(self, words: DataFrame, head: np.ndarray, counts: np.ndarray, classes: Classes, known: int):
        closed = np.nonzero(classes.kind[: len(head) + 1])[0]
        closed = closed[closed != END]
        self.levels = levels_of(known - len(closed), sizes(int(counts.sum()))[1])
        n = 1 << self.levels
        got = words.groupBy((F.shiftrightunsigned("key", 40) % F.lit(n)).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()  # 2**MOST_LEVELS rows of numbers at most
        mass = np.full(n, 0.1)
        mass[got["cell"].to_numpy()] += got["n"].to_numpy() + 0.1 * got["words"].to_numpy()
        self.head = np.zeros(RARE + 1, np.int32)
        self.head[1 : len(head) + 1] = head >> np.uint64(40) & np.uint64(n - 1)
        np.subtract.at(mass, self.head[closed], counts[closed] + 0.1)
        mass = np.maximum(mass, 0.1)
        self.bottom = np.log10(mass).astype(np.float32)
        self.logit = np.zeros(n, np.float32)
        while len(mass) > 1:
            self.logit[len(mass) // 2 : len(mass)] = np.log(mass[1::2] / mass[::2])
            mass = mass[::2] + mass[1::2]

    def cells(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= OTHER, (ids >> 8 & np.uint32((1 << self.levels) - 1)).astype(np.int32), self.head[np.minimum(ids, RARE)])

    def descend(self, raw: np.ndarray, cells: np.ndarray, weights: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """log P(cell | history) of tokens with history hashes ``raw``; or, given ``sums`` (complex, by weight), add every token's gradient and, as imaginary part, curvature."""
        down, out = np.uint32(33 - len(weights).bit_length()), np.zeros(len(cells), np.float64)
        for first in range(0, len(cells), TREE_CHUNK):
            own = slice(first, first + TREE_CHUNK)
            h, cell = (raw[1:, own] >> np.uint64(20)).astype(np.uint32), cells[own]
            for level in range(self.levels):
                node = (1 << level) + (cell >> self.levels - level)
                right = (cell >> self.levels - level - 1 & 1).astype(np.float32)
                at = (((h ^ node.astype(np.uint32) * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)) >> down).astype(np.intp)
                z = self.logit.take(node)
                for f in at:
                    z += weights.take(f)
                p = 1 / (1 + np.exp(-z))
                if sums is None:
                    out[own] += np.log(np.maximum(1 - np.abs(right - p), 1e-12))
                    continue
                both = np.empty(len(z), np.complex128)  # one pass over memory for two numbers
                both.real, both.imag = right - p, p * (1 - p)
                for f in at:
                    np.add.at(sums, f, both)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def history(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes [FEATURES, tokens] of the features of each token's history; their low bits are buckets, 0 is the bias."""
    x = ids.astype(np.uint64)
    at = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    back = []
    for k in (1, 2, 3):
        p = np.full(len(x), START, np.uint64)
        p[k:] = x[:-k]
        p[at < k] = START
        back.append(p)
    m1, m2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    one, two, three = back
    return np.stack([np.zeros(len(x), np.uint64), mix(one * m1 + np.uint64(1)), mix((one * m1 + two) * m2 + np.uint64(2)), mix(two * m1 + np.uint64(3 << 20)), mix(three * m1 + np.uint64(5 << 20))])


def documents_of(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Concatenated ids and starts of a few documents at a time."""
    some, n = [], 0
    for x in column:
        some.append(np.frombuffer(x.as_py(), "<u4"))
        n += len(some[-1])
        if n >= CHUNK:
            yield np.concatenate(some), np.cumsum([0, *map(len, some[:-1])])
            some, n = [], 0
    if some:
        yield np.concatenate(some), np.cumsum([0, *map(len, some[:-1])])


def halves(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outer and inner weights, [buckets, CLASSES] and [buckets, WIDTH]: a bucket's are one line of memory."""
    return np.ascontiguousarray(weights[:, :CLASSES]), np.ascontiguousarray(weights[:, CLASSES:])


def softmax(z: np.ndarray) -> np.ndarray:
    """Over the first axis: tokens are the long, contiguous one."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def gathered(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over the features of the table's rows: [buckets, width] at [FEATURES, n] gives [width, n]."""
    z = table.take(at[0], axis=0)
    for f in at[1:]:
        z += table.take(f, axis=0)
    return np.ascontiguousarray(z.T)


def forward(h: np.ndarray, kind: np.ndarray, outer: np.ndarray, inner: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P(class), then for tokens of closed classes (positions ``closed``) their buckets and P(word | class)."""
    p = softmax(gathered(outer, h) + classes.empty[:, None])
    closed = np.nonzero(kind)[0]
    k = kind[closed]
    # the same features, hashed again with the class
    hk = (h[:, closed] + 1) * 31 + k.astype(np.int32) * 1009 & outer.shape[0] - 1
    return p, closed, hk, softmax(gathered(inner, hk) + np.take(classes.mask.T, k, axis=1))


def add_columns(total: np.ndarray, f: np.ndarray, p: np.ndarray) -> None:
    """Add the columns of p to the columns f of ``total`` [width, buckets]."""
    f = f.astype(np.intp)
    for own, x in zip(total, p):
        own += np.bincount(f, weights=x, minlength=total.shape[1])


def packed(x: np.ndarray) -> bytes:
    """Numbers to 8 bits of precision; what is sent are gradients and their scales, so nothing large cancels."""
    return ((np.ascontiguousarray(x, np.float32).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype("<u2").tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return (np.frombuffer(x, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)


def buckets_of(raw: np.ndarray, buckets: int) -> np.ndarray:
    return (raw & np.uint64(buckets - 1)).astype(np.int32)


def tasks_of(tokens: int, cores: int) -> int:
    """Tasks that share ``tokens``: what a task sends is small beside what it reads, at any size."""
    return max(1, min(cores, 64), tokens // TASK_TOKENS)


def round_counts(docs: DataFrame, weights: np.ndarray, leaves: np.ndarray, fixed, tokens: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over ``docs`` (column ids, about ``tokens``), with the broadcast ``fixed`` (classes, tree): observed less expected feature counts [buckets, CLASSES + WIDTH], their means, and the tree's sums."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, leaves))  # of a bounded size, see sizes()
    wide, buckets = CLASSES + WIDTH, len(weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, w_tree), (c, tree) = shared.value, fixed.value
        outer, inner = halves(w)
        widths = (CLASSES, WIDTH)
        seen = [np.zeros(buckets * x, np.int64) for x in widths]
        due = [np.zeros((x, buckets), np.float64) for x in widths]
        bias = [np.zeros((CLASSES, x), np.float64) for x in widths]  # by class; its rows take every token
        sums = np.zeros(len(w_tree), np.complex128)
        n = 0
        for b in batches:
            for ids, starts in documents_of(b.column(0)):
                raw, cells = history(ids, starts), tree.cells(ids)
                h = buckets_of(raw, buckets)
                ids = np.minimum(ids, RARE)
                kind, place = c.kind[ids], c.place[ids]
                n += len(ids)
                some = np.nonzero(kind == 0)[0]
                tree.descend(raw[:, some], cells[some], w_tree, sums)
                p, closed, hk, q = forward(h, kind, outer, inner, c)
                k, own = kind[closed], place[closed]
                for i, (at, x, y) in enumerate(((h, p, kind), (hk, q, own))):
                    for f in at:
                        np.add.at(seen[i], f.astype(np.int64) * widths[i] + y, 1)
                    x64 = x.astype(np.float64)
                    for f in at[1:]:
                        add_columns(due[i], f, x64)
                bias[0][0] += p.sum(axis=1, dtype=np.float64)
                bias[1] += np.eye(CLASSES, dtype=np.float32)[:, k] @ q.T
        due = [x.T for x in due]
        due[0][0] += bias[0][0]
        for k in range(1, CLASSES):
            due[1][31 + k * 1009 & buckets - 1] += bias[1][k]
        seen = np.concatenate([x.reshape(buckets, -1) for x in seen], axis=1)
        due = np.concatenate(due, axis=1)
        if n:
            yield message(np.concatenate([(seen - due).ravel(), (0.5 * (seen + due)).ravel(), sums.real, sums.imag]))

    def message(flat: np.ndarray) -> pa.RecordBatch:
        mark = xxhash.xxh64_intdigest(flat.tobytes()) >> 1
        blocks = [packed(flat[i : i + BLOCK]) for i in range(0, len(flat), BLOCK)]
        return pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([mark] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["block", "mark", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(2)):
                got = unpacked(x.as_py())
                total[i] = total[i] + got if i in total else got.astype(np.float64)
        yield summed(total, 0)

    def add_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same for each group (column 1), which come one after another."""
        total: dict[int, np.ndarray] = {}
        now = None
        for b in batches:
            for i, group, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if group != now and total:
                    yield summed(total, now)
                    total = {}
                now = group
                got = unpacked(x.as_py())
                total[i] = total[i] + got if i in total else got.astype(np.float64)
        yield summed(total, now or 0)

    def summed(total: dict[int, np.ndarray], mark: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([mark] * len(total), pa.int64()), pa.array([packed(x) for x in total.values()], pa.binary())], names=["block", "mark", "sums"])

    kind = "block int, mark long, sums binary"
    docs = docs.coalesce(tasks_of(tokens, docs.sparkSession.sparkContext.defaultParallelism))
    sent = docs.select("ids").mapInArrow(count, kind)
    parts = docs.rdd.getNumPartitions()
    size = 2 * (buckets * wide + len(leaves))
    blocks = -(-size // BLOCK)
    while parts > FAN_IN:  # a tree of sums, as deep as the number of tasks asks for
        parts = -(-parts // FAN_IN)
        sent = sent.withColumn("group", F.pmod(F.xxhash64("mark"), F.lit(parts))).repartition(parts * 4, "block", "group").sortWithinPartitions("group").select("block", "group", "sums").mapInArrow(add_groups, kind)
    rows = sent.repartition(min(blocks, 16), "block").mapInArrow(add, kind).select("block", "sums").collect()  # ``blocks`` rows
    out = np.zeros(size)
    for r in rows:
        got = unpacked(r["sums"])
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(got)] += got
    shared.destroy()
    gap, mean, sums = np.split(out, [buckets * wide, 2 * buckets * wide])
    return gap.reshape(buckets, wide), mean.reshape(buckets, wide), sums.reshape(2, -1)


def first_weights(counts: np.ndarray, classes: Classes, buckets: int) -> np.ndarray:
    """The unigram model, in the bias rows."""
    weights = np.zeros((buckets, CLASSES + WIDTH), np.float32)
    by_class = np.bincount(classes.kind, weights=counts, minlength=CLASSES) + 0.5
    weights[0, :CLASSES] = np.log(by_class / by_class.sum())
    closed = np.nonzero(classes.kind)[0]
    k = classes.kind[closed].astype(np.int64)
    weights[(31 + k * 1009) & (buckets - 1), CLASSES + classes.place[closed].astype(np.int64)] = np.log((counts[closed] + 0.5) / by_class[k])
    return weights


def fit(encoded: DataFrame, counts: np.ndarray, classes: Classes, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Weights float32 [buckets, CLASSES + WIDTH] and the tree's after one pass over all training documents, a part each round."""
    buckets, cells, rounds = sizes(int(counts.sum()))
    weights, leaves = first_weights(counts, classes, buckets), np.zeros(cells, np.float32)
    training = encoded.filter("NOT held_out").select("uid", "ids")
    fixed = encoded.sparkSession.sparkContext.broadcast((classes, tree))
    for r in range(rounds):
        part = training.filter(F.pmod(F.xxhash64("uid"), F.lit(rounds)) == r)
        off, mean, (gap, bend) = round_counts(part, weights, leaves, fixed, int(counts.sum()) // rounds)
        step = STEP * off / (mean + FLOOR)
        weights += np.clip(step, -2, 2).astype(np.float32)
        leaves += np.clip(STEP * gap / (bend + TREE_FLOOR), -2, 2).astype(np.float32)
    return weights, leaves


def rare_counts(encoded: DataFrame) -> DataFrame:
    """uid, rare_known, rare_log (sum of log10(c + 0.1) over rare tokens), rare_new (distinct known words credited here)."""
    rows = encoded.select("uid", "held_out", F.inline(F.arrays_zip("rare", "times"))).select("uid", F.col("rare").alias("key"), "times", F.when(F.col("held_out"), 0).otherwise(F.col("times")).alias("own"))
    one = Window.partitionBy("key").orderBy("uid")
    met = rows.withColumn("place", F.row_number().over(one)).withColumn("c", F.sum("own").over(Window.partitionBy("key")))
    return met.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("rare_log"),
        F.sum(F.when((F.col("place") == 1) & (F.col("c") > 0), 1).otherwise(0)).alias("rare_new"),
    )


def score(encoded: DataFrame, counts: np.ndarray, classes: Classes, weights: np.ndarray, tree: Tree, leaves: np.ndarray) -> DataFrame:
    """uid, doc_id, held_out, n_tokens, and the parts of the scores that need no rare word's count."""
    shared = encoded.sparkSession.sparkContext.broadcast((counts, classes, weights, tree, leaves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, c, w, tree, w_tree = shared.value
        known = n > 0
        known[RARE] = False
        logs = np.log10(n + 0.1)
        logs[RARE] = 0
        outer, inner = halves(w)
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for ids, starts in documents_of(b.column(3)):
                raw, cells = history(ids, starts), tree.cells(ids)
                h = buckets_of(raw, len(w))
                ids = np.minimum(ids, RARE)
                kind, place = c.kind[ids], c.place[ids]
                p, closed, _, q = forward(h, kind, outer, inner, c)
                got = np.log10(np.maximum(p[kind, np.arange(len(kind))], 1e-30), dtype=np.float64)
                got[closed] += np.log10(np.maximum(q[place[closed], np.arange(len(closed))], 1e-30), dtype=np.float64)
                is_open = kind == 0
                some = np.nonzero(is_open)[0]
                got[some] += logs[ids[some]] + tree.descend(raw[:, some], cells[some], w_tree) / LN10 - tree.bottom[cells[some]]
                for col, x in zip(cols, (np.ones(len(ids), np.int64), known[ids].astype(np.int64), logs[ids], got)):
                    col.append(np.add.reduceat(x, starts))
            flat = [np.concatenate(x) if x else np.zeros(0) for x in cols]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.float64()), pa.array(flat[3], pa.float64())], names=["uid", "doc_id", "held_out", "n_tokens", "known", "logs", "model"])

    return encoded.select("uid", "doc_id", "held_out", "ids").mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double")


def score_documents(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, held_out, text.  Learns from rows that are not held out and scores all."""
    words = cut(word_counts(docs))
    head = head_words(words)
    encoded = cut(encode(docs, head))
    counts = head_counts(encoded)
    classes = Classes(counts)
    tree = Tree(words, head, counts, classes, words.count())
    weights, leaves = fit(encoded, counts, classes, tree)
    rare = cut(rare_counts(encoded))
    total = int(counts.sum())  # its last entry is the number of rare tokens
    known_rare = rare.agg(F.sum("rare_new")).first()[0] or 0
    known_head = int((counts[:RARE] > 0).sum())
    bottom = float(np.log10(total + 0.1 * (known_rare + known_head + 1)))
    met = score(encoded, counts, classes, weights, tree, leaves).join(rare, "uid", "left").na.fill(0, ["rare_known", "rare_log"])
    return met.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_log") - F.col("n_tokens") * F.lit(bottom)).alias("base_score"),
        (F.col("model") + F.col("rare_log")).alias("score"),
    )


def op1_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_of().alias("text")))
