"""Token counts by pre-token: pieces are counted once for each distinct pre-token, joined to frequencies, and summed.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum over its distinct pre-tokens of
frequency times pieces.  One pass collects the distinct pre-tokens of all texts, whose pieces are counted once each.  A
second pass meets the piece counts of the FREQUENT most frequent ones, which every task has, with each document's
pre-token frequencies; the other pre-tokens of a document, which are rare, are joined to their piece counts by a
shuffle, and the products are added up by document.  Ids of texts are never materialised.

Scale: what is shuffled is one row for each distinct pre-token of a task, and one for each rare pre-token of a
document; a rare pre-token has under 1/FREQUENT of all occurrences, so no key of the join is hot.

Special strings inside a text count as the library counts them by default, as one token that splits the text.

Defined results: null text counts as empty (0 tokens); ties and repeated rows are separate rows; extra columns are
ignored; an empty table gives no rows; a long text is split whole.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, most_frequent, table

#: Split of byte-level BPE before its merges (fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters outside these ranges may be newer than the library's character tables; each is compared when first met.
UNSETTLED = regex.compile(r"[^\x00-\u0557\u2010-\u2027\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]")
#: Distinct pre-tokens that a task holds before it sends their counts on.
HELD = 300_000
#: The most frequent pre-tokens, at most, whose piece counts every task gets; each of the others is under 1/FREQUENT of all.
FREQUENT = 200_000
#: Pre-tokens longer than this are joined by a 128-bit digest.
LONGEST = 64
#: Pre-tokens whose pieces are counted at a time.
BATCH = 4096


def key_of(token: str) -> str:
    """The pre-token, or for a long one, a string of 81 characters that only it has."""
    return token if len(token) <= LONGEST else "\0" + xxhash.xxh3_128_hexdigest(token.encode("utf-8", "surrogatepass")) + f"{len(token):048d}"


class PreTokens:
    """Splits texts as the library does; one for each Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [x["content"] for x in json.loads(self.library.to_str())["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(PATTERN)
        self.settled: dict[str, bool] = {}

    def splits_alike(self, text: str) -> bool:
        """Whether our split and the library's take every character of the text for the same kind."""
        for ch in set(UNSETTLED.findall(text)):
            if ch not in self.settled:
                probe = f"a{ch}1!{ch}!"
                self.settled[ch] = len(self.split.findall(probe)) == len(self.library.pre_tokenizer.pre_tokenize_str(probe))
            if not self.settled[ch]:
                return False
        return True

    def pieces_of_split(self, text: str) -> list[str]:
        """Pre-tokens, in order; by the library's own split where characters are newer than its tables."""
        if self.splits_alike(text):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies, and the number of special strings."""
        if self.special is None or not self.special.search(text):
            return Counter(self.pieces_of_split(text)), 0
        found: Counter = Counter()
        parts = self.special.split(text)
        for part in parts:
            found.update(self.pieces_of_split(part))
        return found, len(parts) - 1

    def count(self, tokens: list[str]) -> list[int]:
        """Pieces of distinct pre-tokens."""
        out: list[int] = []
        for at in range(0, len(tokens), BATCH):
            out += map(len, self.library.encode_batch_fast(tokens[at : at + BATCH], add_special_tokens=False))
        return out


_splitters: dict[str, PreTokens] = {}


def splitter(path: str) -> PreTokens:
    if path not in _splitters:
        _splitters[path] = PreTokens(path)
    return _splitters[path]


def piece_counts(texts: DataFrame, vocabulary: str) -> DataFrame:
    """key, n, pieces: every distinct pre-token of all ``texts`` (column text), its frequency, its pieces, counted once."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, found = splitter(vocabulary), Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])
            found.clear()
            return out

        for b in batches:
            for t in b.column(0):
                found.update(s.frequencies(t.as_py() or "")[0])
                if len(found) >= HELD:
                    yield rows()
        yield rows()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = splitter(vocabulary)
        for b in batches:
            own = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, own), pa.string()), b.column(1), pa.array(s.count(own), pa.int64())], names=["key", "n", "pieces"])

    distinct = texts.select("text").mapInArrow(tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(pieces, "key string, n long, pieces long")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit.  ``vocabulary``: path of a tokenizers file that every executor has."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    known = cut(piece_counts(rows, vocabulary))
    often, rest = most_frequent(known, FREQUENT)
    table_ = {r["key"]: r["pieces"] for r in often.select("key", "pieces").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(table_)  # FREQUENT keys of 81 characters at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, pieces = splitter(vocabulary), shared.value
        for b in batches:
            n, rare, times, ends = [], [], [], [0]
            for t in b.column(3):
                found, total = s.frequencies(t.as_py() or "")
                for token, v in found.items():
                    k = token if len(token) <= LONGEST else key_of(token)
                    if (p := pieces.get(k)) is not None:
                        total += p * v
                    else:
                        rare.append(k)
                        times.append(v)
                n.append(total)
                ends.append(len(rare))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), lists(rare, pa.string()), lists(times, pa.int64())], names=["uid", "doc_id", "n_bytes", "n", "rare", "times"])

    counted = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_bytes", "text").mapInArrow(run, "uid long, doc_id long, n_bytes long, n long, rare array<string>, times array<long>")
    counted = cut(counted)
    met = counted.select("uid", F.inline(F.arrays_zip("rare", "times"))).join(rest.select(F.col("key").alias("rare"), "pieces"), "rare")
    sums = met.groupBy("uid").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    whole = counted.select("uid", "doc_id", "n_bytes", "n").join(sums, "uid", "left")
    n = F.col("n") + F.coalesce("more", F.lit(0))
    return whole.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
