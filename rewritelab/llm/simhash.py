"""Near-duplicate classes by SimHash, with pigeonring filtering.

Fingerprints: 64 bits, a bit is set where over half of the XXH64 values (seed 42, UTF-8) of a text's word
shingles have it.  Two fingerprints link at 4 differing bits or fewer; classes are the connected components.

Search over distinct fingerprints.  The 64 bits are a ring of 5 segments.  If two fingerprints differ in 4 bits
or fewer, some segment starts a chain whose every prefix of l segments differs in at most 4*l/5 bits: budgets
0, 1, 2, 3, 4.  So each fingerprint is filed under each segment i with the value of that segment (budget 0) and
of either half of the next (of two halves that differ in one bit together, one is equal): 10 keys of about 20
bits.  Pairs that meet under a key run along the chain, budget by budget, and only those that pass reach the
full Hamming test.  Nothing is capped: a key with many fingerprints is cut into blocks of BLOCK, and each
pair of blocks is one tile that some task handles by itself.  A tile returns a tree over each of its classes, not
the links, so a class of n fingerprints costs a multiple of n rows; the trees are binary, so that no fingerprint
becomes a hub with many edges.

Classes: hash-to-minimum label propagation over the tree edges with pointer jumping, checkpointed round by
round.  Nothing but counts reaches the driver.  Where many rows share a fingerprint, or many fingerprints a label,
they meet a broadcast of fewer than HEAVY rows (common.join_unique) instead of each other in one task.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link like any other;
rows with equal ids are merged (their fingerprints all belong to the id); a null id links like any other and is
the id of a component only if that has no other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_unique, table

WORDS, SEED, MOST = 4, 42, 4
#: Low bit and width of each segment of the ring.
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCK = 1024
#: Label of fingerprints that have null ids only: sorts after all others.
NO_LABEL = 2**63 - 1


def simhash(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer."""
    w = text.lower().split()  # of bytes: A-Z only, and exactly 0x20 and 0x09 to 0x0D
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash(t.as_py() or b"") for t in texts], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segment(x: np.ndarray, k: int) -> np.ndarray:
    low, width = RING[k % len(RING)]
    return (x >> np.uint64(low)) & np.uint64((1 << width) - 1)


def keys_of(fps: DataFrame) -> DataFrame:
    """fp, key: for each segment and each half of the next one, packed into a long."""
    keys = []
    for i, (low, width) in enumerate(RING):
        after, w = RING[(i + 1) % len(RING)]
        own = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        for half, (at, n) in enumerate(((after, w // 2), (after + w // 2, w - w // 2))):
            part = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1))
            keys.append(F.lit((2 * i + half) << 32).bitwiseOR(F.shiftleft(own, 8)).bitwiseOR(part))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _forest(x: np.ndarray, y: np.ndarray | None, start: int, most: int) -> list[tuple[int, int]]:
    """Trees over the classes that links make within x, or between x and y: the chain from segment ``start``, then the full test."""
    nodes = x if y is None else np.concatenate([x, y])
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    segments = [_segment(nodes, start + j) for j in range(1, len(RING))]
    members: dict[int, list[int]] = {}
    for i in range(len(x)):
        near = np.arange(i + 1, len(x)) if y is None else np.arange(len(x), len(nodes))
        spent = np.zeros(len(near), np.uint8)
        for length, s in enumerate(segments, 2):  # the first segment is equal: it is in the key
            spent = spent + np.bitwise_count(s[near] ^ s[i])
            stay = spent <= most * length // len(RING)
            near, spent = near[stay], spent[stay]
            if not len(near):
                break
        for j in near[np.bitwise_count(nodes[near] ^ nodes[i]) <= most].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    for i in range(len(nodes)):
        members.setdefault(root(i), []).append(i)
    ids = nodes.view(np.int64).tolist()
    return [(ids[m[(at - 1) // 2]], ids[m[at]]) for m in members.values() for at in range(1, len(m))]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, block, fp) sorted by tile; a tile may span batches and holds 2*BLOCK rows or so."""
    out: list[tuple[int, int]] = []
    now, sides = None, ([], [])

    def close() -> None:
        if now is not None and len(sides[0]) + len(sides[1]) > 1:
            x = np.array(sides[0], np.int64).view(np.uint64)
            y = None if now[1] == now[2] else np.array(sides[1], np.int64).view(np.uint64)
            if y is None or (len(x) and len(y)):
                out.extend(_forest(x, y, now[0] >> 33, MOST))

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["u", "v"])
        out.clear()
        return got

    for batch in batches:
        for key, a, b, block, fp in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, a, b) != now:
                close()
                now, sides = (key, a, b), ([], [])
            sides[0 if block == a else 1].append(fp)
        if len(out) > 50_000:
            yield flush()
    close()
    yield flush()


def links(fps: DataFrame) -> DataFrame:
    """Tree edges (u, v) over distinct fingerprints ``fp`` whose components are those of the link graph."""
    filed = keys_of(fps)
    hot = filed.groupBy("key").agg(F.count("*").alias("__n")).filter(F.col("__n") > BLOCK).select("key", F.ceil(F.col("__n") / BLOCK).cast("int").alias("__blocks"))
    blocked = filed.join(hot, "key", "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("__blocks")).cast("int"))
    dealt = blocked.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other"))
    dealt = dealt.select("key", F.least("block", "__other").alias("a"), F.greatest("block", "__other").alias("b"), "block", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b").select("key", "a", "b", "block", "fp").mapInArrow(_tiles, "u long, v long").distinct()


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest label of each node's component, for nodes with edges.

    ``labels``: (node, label).  Each round takes the smallest label of the neighbourhood, then links nodes to
    that label's own node (min-label hooking and a jump), so rounds grow with the logarithm of the diameter.
    """
    both = cut(edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("v", "u")).filter("node <> other").distinct())
    # at: the node whose label it is; following it is the jump
    now = cut(both.select("node").distinct().join(labels, "node").select("node", "label", F.col("node").alias("at")))
    while True:
        heard = both.join(now.select(F.col("node").alias("other"), F.struct("label", "at").alias("best")), "other").groupBy("node").agg(F.min("best").alias("heard"))
        nearer = now.join(heard, "node").select("node", F.col("label").alias("old"), F.least(F.struct("label", "at"), "heard").alias("best"))
        nearer = cut(nearer.select("node", "old", F.col("best.label").alias("label"), F.col("best.at").alias("at")))
        led = nearer.groupBy("at").agg(F.count("*").alias("__n"))
        jump = led.select("at").join(nearer.select(F.col("node").alias("at"), F.struct("label", F.col("at")).alias("far")), "at")
        new = cut(join_unique(nearer, jump, "at", led, nearer.count(), "left").select("node", "old", F.least(F.struct("label", "at"), F.coalesce("far", F.struct("label", "at"))).alias("best")).select("node", "old", F.col("best.label").alias("label"), F.col("best.at").alias("at")))
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        now = new.select("node", "label", "at")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component)."""
    marks = cut(fingerprints(docs, id_col, text_col))
    least = cut(marks.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_LABEL)).alias("label"), F.count("*").alias("__n")))
    classes = components(links(least.select("fp")), least.select(F.col("fp").alias("node"), "label"))
    class_of = least.join(classes.select(F.col("node").alias("fp"), F.col("label").alias("__class")), "fp", "left")
    class_of = class_of.select("fp", F.nullif(F.coalesce("__class", "label"), F.lit(NO_LABEL)).alias("component_id"))
    met = join_unique(marks, class_of, "fp", least, marks.count())
    return met.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
