"""Personal data: a semi-Markov conditional random field over spans, on top of fixed patterns.

The patterns (email, ip, card, phone) are found first, over whole texts, in linear time.  The model then
segments the neighbourhoods of digits, at-signs and spelled-out at-signs: a segmentation is a sequence of outside
tokens and of typed segments of at most LONGEST tokens, scored by features of whole candidate spans (shape, digit
groups, checksums, ranges, neighbours).  Bounded-entity dynamic programming finds the best boundaries and types
jointly; segments that overlap no pattern span are added to them.

Learning: conditional log-likelihood by forward-backward over the segment lattice, stochastic gradient, on the
driver.  Examples are SAMPLE neighbourhoods of the corpus at most (those of smallest hash, labelled by the patterns, but
for those that hold what may be personal data and no pattern finds), variants of these in which at-signs are spelled out
and plus signs left out or written 00, and MADE written-out templates, of which some are no personal data (dates,
amounts, versions, long numbers).

Scale: one pass over the texts without a shuffle; the model is a few thousand weights.

Defined results: null text counts as empty; empty texts have no spans; repeated rows are separate rows; extra columns
are ignored; an empty table gives no rows; where a text has only digits its neighbourhood is the text, and time
grows with its length times LONGEST.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LONGEST = 22
#: Neighbourhoods of the corpus that the model learns from, at most, and their longest length in characters.
SAMPLE, SAMPLE_CHARS = 600, 400
#: Documents that neighbourhoods are sampled from, about.
SAMPLE_DOCS = 4000
EPOCHS, RATE, DECAY = 5, 0.3, 1e-4
#: Written-out examples.
MADE = 2500
#: A segment's least score over leaving its tokens outside, in nats.
MARGIN = 1.0
REACH = 40

# ---- patterns -----------------------------------------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(t, at + 1)):
            yield start, m.end()
            done = m.end()
        at = t.find("@", at + 1)


def addresses(t: str) -> Iterator[tuple[int, int]]:
    """Each run of dotted numbers gives its first four parts, its next four and so on."""
    for m in _DOTTED.finditer(t):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(t: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end()


def phones(t: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(t):
        if 9 <= sum(ch.isascii() and ch.isdigit() for ch in m[0]) <= 15:
            yield m.start(), m.end()


def pattern_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(s, 0, e) for s, e in emails(t)] if "@" in t else []
    if _DIGIT.search(t):
        out += [(s, 1, e) for s, e in addresses(t)] + [(s, 2, e) for s, e in cards(t)] + [(s, 3, e) for s, e in phones(t)]
    return sorted(out)


# ---- lattice ------------------------------------------------------------------------------------------------
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_TRIGGER = re.compile(r"[0-9@]+|[(\[{]\s?at\s?[)\]}]", re.I)
_AT_WORD = re.compile(r"\s*[(\[{]\s?at\s?[)\]}]\s*", re.I)
_DOT_WORD = re.compile(r"\s*[(\[{]\s?dot\s?[)\]}]\s*", re.I)


def neighbourhoods(t: str) -> list[tuple[int, int]]:
    """Stretches around triggers, REACH characters to either side, merged where they meet."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(t):
        a, b = max(0, m.start() - REACH), min(len(t), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: A host that goes on behind a span.
_GOES_ON = re.compile(r"\s?(?:\.|[(\[{]\s?dot\s?[)\]}])\s?[A-Za-z0-9]", re.I)


def bucket(n: int) -> int:
    return n if n < 8 else 8 + int(math.log2(n / 8) * 2)


def span_features(t: str, s: int, e: int, before: str, after: str) -> list[str]:
    """Features of the candidate span t[s:e] as a whole and of what stands beside it."""
    x = t[s:e]
    plain = _DOT_WORD.sub(".", _AT_WORD.sub("@", x))
    shape = re.sub(r"[^\W\d_]+", "a", plain)
    digits = "".join(re.findall(r"[0-9]+", x))
    groups = re.findall(r"[0-9]+", x)
    coarse = re.sub(r"[0-9]+", "9", shape)
    local, at, host = plain.partition("@")
    email = "no" if not at else "ok" if re.fullmatch(r"[\w.%+-]+", local) and re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", host) else "bad"
    out = [
        "len%d" % bucket(len(x)),
        "digits%d" % bucket(len(digits)),
        "groups%d" % bucket(len(groups)),
        "email:" + email,
        "email:%s+%s" % (email, after if after in ".@-_" else ""),
    ]
    if at:
        spelled = plain != x
        goes_on = _GOES_ON.match(t, e) is not None
        out += ["email:%s/%d/%d" % (email, spelled, goes_on), "email:%s-%d" % (email, goes_on), "host%d" % min(3, host.count(".")), "ends:" + ("word" if re.search(r"\.[A-Za-z]{2,}$", host) else "other"), "starts:%d%s" % (spelled, before)]
    if not at:
        out += ["lead:" + ("+" if x[0] == "+" else "00" if digits[:2] == "00" else "0" if digits[:1] == "0" else "(" if x[0] == "(" else "9") + "/%d" % (9 <= len(digits) <= 15)]
        out += ["marks:" + "".join(sorted(set(re.sub(r"[0-9]", "", x))))[:6], "phone:%d/%d" % (bucket(len(digits)), len(groups))]
        out += ["shape:" + re.sub(r"[0-9]", "9", shape)[:28], "coarse:" + coarse[:28]]
        out += ["luhn%d" % (12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 -]", x))]
        four = len(groups) == 4 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", plain) is not None
        out += ["ip%d%d" % (four, four and all(len(g) <= 3 and int(g) <= 255 for g in groups))]
        out += ["phone%d%d" % (x[0] == "+", 9 <= len(digits) <= 15), "letters%d" % (re.search(r"[^\W\d_]", x) is not None)]
        out += ["sizes:" + "-".join(str(len(g)) for g in groups[:6])]
    out += ["left:" + before, "right:" + after]
    return out


def side(ch: str) -> str:
    return "^" if not ch else "_" if ch.isspace() else "9" if ch.isdigit() else "a" if ch.isalpha() else ch


def lattice(t: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """Tokens of t[a:b], and candidate segments (first token, past last token, features)."""
    toks = [m.span() for m in _TOKEN.finditer(t, a, b)]
    kind = ["9" if t[s].isascii() and t[s].isdigit() else "a" if t[s].isalpha() else t[s] for s, _ in toks]
    out = []
    for i, (s, _) in enumerate(toks):
        if kind[i] not in "9a+(" or s > 0 and kind[i] in "9a" and side(t[s - 1]) == kind[i]:
            continue
        numbers = ats = 0
        for j in range(i, min(len(toks), i + LONGEST)):
            gap = t[toks[j - 1][1] : toks[j][0]] if j > i else ""
            if gap not in ("", " "):
                break
            numbers += kind[j] == "9"
            ats += kind[j] == "@" or kind[j] == "a" and t[toks[j][0] : toks[j][1]].lower() == "at"
            if kind[j] not in "9a@.+-()[]{}_% ":
                break
            # words are parts of spans only beside an at-sign and dots: a run of words and blanks ends the segment
            if gap and kind[j] == "a" and not ats and t[toks[j - 1][0]].isalpha():
                break
            if kind[j] in "9a" and (ats or numbers >= 1):
                e = toks[j][1]
                if e < len(t) and side(t[e]) == kind[j] or (not ats and (kind[i] == "a" or kind[j] == "a")):
                    continue
                out.append((i, j + 1, span_features(t, s, e, side(t[s - 1] if s else ""), side(t[e] if e < len(t) else ""))))
    return toks, out


class Model:
    """Weights by (kind, feature)."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}

    def score(self, features: list[str]) -> list[float]:
        total = [-4.0] * len(KINDS)  # bias: outside unless features say otherwise
        for f in features:
            if w := self.weights.get(f):
                for k in range(len(KINDS)):
                    total[k] += w[k]
        return total

    def decode(self, t: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """Best segmentation of t[a:b]: (start, kind, end) of its segments."""
        toks, cands = lattice(t, a, b)
        by_end: dict[int, list] = {}
        for i, j, f in cands:
            scores = self.score(f)
            k = max(range(len(KINDS)), key=scores.__getitem__)
            if scores[k] > MARGIN:
                by_end.setdefault(j, []).append((i, k, scores[k]))
        best: list[float] = [0.0] * (len(toks) + 1)
        back: list = [None] * (len(toks) + 1)
        for j in range(1, len(toks) + 1):
            best[j] = best[j - 1]
            for i, k, x in by_end.get(j, ()):
                if best[i] + x > best[j]:
                    best[j], back[j] = best[i] + x, (i, k)
        out, j = [], len(toks)
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((toks[i][0], k, toks[j - 1][1]))
                j = i
        return out[::-1]

    def learn(self, t: str, gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the conditional log-likelihood of the gold segmentation of t."""
        toks, cands = lattice(t, 0, len(t))
        where = {s: i for i, (s, _) in enumerate(toks)}, {e: i + 1 for i, (_, e) in enumerate(toks)}
        want = {(where[0].get(s), where[1].get(e)): k for s, k, e in gold}
        scored = [(i, j, f, self.score(f)) for i, j, f in cands]
        n = len(toks)
        ends: dict[int, list] = {}
        heads: dict[int, list] = {}
        for c in scored:
            ends.setdefault(c[1], []).append(c)
            heads.setdefault(c[0], []).append(c)

        def add(x: list[float]) -> float:
            top = max(x)
            return top + math.log(sum(math.exp(v - top) for v in x))

        alpha = [0.0] * (n + 1)
        for j in range(1, n + 1):
            alpha[j] = add([alpha[j - 1]] + [alpha[c[0]] + s for c in ends.get(j, ()) for s in c[3]])
        beta = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            beta[i] = add([beta[i + 1]] + [beta[c[1]] + s for c in heads.get(i, ()) for s in c[3]])
        for i, j, f, scores in scored:
            step = [-rate * math.exp(alpha[i] + s + beta[j] - alpha[n]) for s in scores]
            if (k := want.get((i, j))) is not None:
                step[k] += rate
            if max(map(abs, step)) > 1e-4:
                for x in f:
                    w = self.weights.setdefault(x, [0.0] * len(KINDS))
                    for k in range(len(KINDS)):
                        w[k] += step[k] - rate * DECAY * w[k]


# ---- learning examples --------------------------------------------------------------------------------------
#: Ways to write out an at-sign and a dot.
_AT = (" [at] ", "[at]", "(at)", " (at) ", " {at} ", " [AT] ", " ( at ) ")
_DOT = (".", ".", " (dot) ", " [dot] ", "(dot)", "[dot]", " {dot} ")


def _made(rng: random.Random, letters: str = "abcdefghilmnoprstu", what: int | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """A written-out neighbourhood: words, and one span of some kind (``what`` below 5) or a number that is none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    n = lambda k: rng.choice("123456789") + d(k - 1)
    w = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    what = rng.choice((0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9)) if what is None else what
    if what < 5:
        kind = min(what, 3)
        if kind == 0:
            at, dot = ("@", ".") if rng.random() < 0.3 else (rng.choice(_AT), rng.choice(_DOT))
            x = w() + rng.choice(["", "." + w(), d(2), "_" + w()]) + at + w() + rng.choice(["", d(1), "-" + w()]) + dot + rng.choice(["com", "org", "net", "de", "info", "example" + dot + "com"])
        elif kind == 1:
            x = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        elif kind == 2:
            body = d(15)
            x = next(body + c for c in "0123456789" if luhn(body + c))
            if rng.random() < 0.5:
                x = rng.choice(" -").join(x[i : i + 4] for i in range(0, 16, 4))
        else:
            a, b, c, cc = n(3), d(3), d(4), n(2)
            forms = [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{cc} {a} {b} {c}", f"1-{a}-{b}-{c}", f"+{cc} {d(2)} {d(7)}", f"+{cc}{d(10)}"]
            foreign = [f"00{cc} {d(2)} {d(7)}", f"00 {cc} {d(2)} {d(7)}", f"00{cc} {a} {b} {c}", f"00{cc}{d(rng.randint(9, 10))}", f"00 {cc} {a} {b}{c}", f"00{cc}-{a}-{b}-{c}", f"00{cc} {d(2)} {d(4)} {d(4)}", f"00 {cc} {d(3)} {d(7)}"]
            x = rng.choice(forms if what == 3 else foreign)
    else:
        kind = -1
        numbers = [
            *(f"{n(4)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(2)}:{d(2)}", f"{d(2)}.{d(2)}", n(rng.randint(1, 9)), f"{n(1)},{d(3)}", f"{d(2)}/{d(2)}/{n(4)}", n(3) + " " + d(2), f"{n(5)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}"),
            *("".join(rng.choice("0123456789abcdef") for _ in range(32)), f"{n(2)} {n(2)} {n(2)} {n(2)}", f"{n(4)}-{n(4)}", n(rng.randint(10, 14)), f"{n(1)},{d(3)},{d(3)},{d(3)}", f"{w()} [at] {w()}", f"{w()} (at) {w()} {w()}", f"{w()}@{w()}", f"{d(1)}.{d(6)}"),
        ]
        x = rng.choice(numbers)
    head = " ".join(w() for _ in range(rng.randint(0, 4)))
    head += rng.choice([" ", " ", ": "]) if head else ""
    tail = rng.choice([" ", ". ", ", ", ") "]) + " ".join(w() for _ in range(rng.randint(1, 3))) if rng.random() < 0.8 else ""
    return head + x + tail, [] if kind < 0 else [(len(head), kind, len(head) + len(x))]


#: What may be personal data that the patterns miss: a stretch that holds it is no example of what is none.
_LOOKALIKE = re.compile(r"(?:[0-9][\s().-]{0,2}){9,}|[(\[{]\s?at\s?[)\]}]", re.I)


def respelled(rng: random.Random, t: str, gold: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The stretch with at-signs of its addresses spelled out and plus signs of its phone numbers gone or written 00, and its spans."""
    out, spans, at = "", [], 0
    for s, k, e in gold:
        out += t[at:s]
        x = t[s:e]
        if k == 0:
            local, _, host = x.partition("@")
            x = local + rng.choice(_AT) + host.replace(".", rng.choice(_DOT))
        elif k == 3 and rng.random() < 0.7:
            x = ("00" if rng.random() < 0.5 else "") + x[1:]
        spans.append((len(out), k, len(out) + len(x)))
        out += x
        at = e
    return out + t[at:], spans


def _plain(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Without overlaps: the first span in order stays."""
    out: list[tuple[int, int, int]] = []
    for x in spans:
        if not out or x[0] >= out[-1][2]:
            out.append(x)
    return out


def fit(stretches: list[str], made: int = MADE, seed: int = 7) -> Model:
    rng = random.Random(seed)
    examples = [_made(rng) for _ in range(made)]
    for t in stretches:
        gold = _plain(pattern_spans(t))
        blank = list(t)
        for s, _, e in gold:
            blank[s:e] = "x" * (e - s)
        if not _LOOKALIKE.search("".join(blank)):
            examples.append((t, gold))
            if any(k in (0, 3) for _, k, _ in gold):
                examples.append(respelled(rng, t, gold))
    model = Model()
    for epoch in range(EPOCHS):
        rng.shuffle(examples)
        for t, gold in examples:
            model.learn(t, gold, RATE / (1 + epoch))
    return model


def sampled_stretches(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> list[str]:
    """At most SAMPLE neighbourhoods, those of smallest hash among about SAMPLE_DOCS documents."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [t[a:e][:SAMPLE_CHARS] for t in b.column(0).to_pylist() for a, e in neighbourhoods(t)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["stretch"])

    n = docs.count()
    one_in = max(1, n // SAMPLE_DOCS)
    some = docs.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(one_in)) == 0).select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL AND text RLIKE '[0-9@]'")
    rows = some.mapInArrow(cut_out, "stretch string").distinct().orderBy(F.xxhash64("stretch"), "stretch").limit(SAMPLE).collect()
    return [r["stretch"] for r in rows]


def all_spans(t: str, model: Model) -> tuple[list, list]:
    """Pattern spans, and all spans: these and the model's that overlap none of them."""
    base = pattern_spans(t)
    if not base and not _TRIGGER.search(t):
        return [], []
    found = [x for a, b in neighbourhoods(t) for x in model.decode(t, a, b)]
    taken = sorted((s, e) for s, _, e in base)
    out, at = list(base), 0
    for s, k, e in found:  # both in order
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if not any(a < e and s < b for a, b in taken[max(0, at - 4) : at + 4]):
            out.append((s, k, e))
    return base, sorted(out)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of SAMPLE short stretches: a few thousand weights
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    record = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            pairs = [all_spans(t or "", m) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([record(x) for x, _ in pairs], span), pa.array([record(y) for _, y in pairs], span)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, fit(sampled_stretches(docs)))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
