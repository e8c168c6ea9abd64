"""Sequence alignment of a draft and an output, for Arrow UDFs."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

from . import fixed
from . import segment as seg

FACT = re.compile(fixed.FACT)
_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*%?")


def contain(a: list[str], b: list[str], least: float = 0.0) -> float:
    """Share of a in matching blocks with b, in order.  Below ``least`` by size or by shared items alone, 0."""
    if not a or not b:
        return 0.0
    if least and (len(b) < least * len(a) or sum((Counter(a) & Counter(b)).values()) < least * len(a)):
        return 0.0
    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a)


def _long(t: str) -> list[tuple[str, list[str]]]:
    return [(s, u) for s in seg.sentences(t) if len(u := seg.units(s)) >= (8 if seg.CJK.search(s) else 5)]


def verbatim_pair(draft: str, output: str, share: float = 0.9) -> tuple[float, float]:
    """Shares, by units, of output sentences that come from the draft whole, and of draft sentences that come back whole."""
    drafts, outputs = [u for _, u in _long(draft)], [u for _, u in _long(output)]
    if not drafts or not outputs:
        return 0.0, 0.0
    whole = [[contain(d, o, share) >= share for d in drafts] for o in outputs]
    from_draft = sum(len(o) for o, row in zip(outputs, whole) if any(row) or any(contain(o, d, share) >= share for d in drafts))
    kept = sum(len(d) for j, d in enumerate(drafts) if any(row[j] for row in whole))
    return from_draft / sum(map(len, outputs)), kept / sum(map(len, drafts))


def fragments(draft: str, output: str) -> tuple[float, float]:
    """Greedy longest extractive fragments: coverage and density."""
    a, s = seg.words(draft), seg.words(output)
    if not s:
        return 0.0, 0.0
    places: dict[str, list[int]] = {}
    for j, w in enumerate(a):
        places.setdefault(w, []).append(j)
    i, sizes = 0, []
    while i < len(s):
        best, free = 0, 0
        for j in places.get(s[i], ()):
            if j < free:
                continue  # inside the run that was tried before
            n = 0
            while i + n < len(s) and j + n < len(a) and s[i + n] == a[j + n]:
                n += 1
            best, free = max(best, n), j + n
        if best:
            sizes.append(best)
        i += max(best, 1)
    return sum(sizes) / len(s), sum(n * n for n in sizes) / len(s)


def structure(draft: str, output: str) -> dict:
    """Each output sentence's most similar draft sentence, and what follows from these."""
    drafts, outputs = seg.sentences(draft), seg.sentences(output)
    sizes = {"n_out": len(outputs), "n_draft": len(drafts)}
    if not drafts:
        return {"align_sim": 0.0, "order_agree": 1.0, "one_to_one": 0.0, "coverage": 0.0, "degenerate": False} | sizes
    if not outputs:
        return {"align_sim": 1.0, "order_agree": 1.0, "one_to_one": 1.0, "coverage": 0.0, "degenerate": bool((output or "").strip())} | sizes
    bags = [seg.align_tokens(s) for s in drafts]
    best = []
    for s in outputs:
        own = seg.align_tokens(s)
        best.append(max((len(own & b) / max(1, len(own | b)), -j) for j, b in enumerate(bags)))
    at = [-j if x > 0 else None for x, j in best]
    steps = [b > a for a, b in zip(at, at[1:]) if a is not None and b is not None and a != b]
    hits = Counter(j for j in at if j is not None)
    return {
        "align_sim": round(sum(x for x, _ in best) / len(best), 3),
        "order_agree": round(sum(steps) / len(steps), 3) if steps else 1.0,
        "one_to_one": round(sum(n == 1 for n in hits.values()) / len(hits), 3) if hits else 0.0,
        "coverage": round(len(hits) / len(drafts), 3),
        "degenerate": False,
    } | sizes


def _lines(t: str) -> list[str]:
    return [x.strip() for x in seg.strip_markup(t).split("\n") if x.strip()]


def format_recall(draft: str, output: str) -> float:
    own = [x for x in seg.split_format(draft)[0] if not re.fullmatch("#+", x)]
    there = [seg.units(x) for x in _lines(output)]
    kept = [not (u := seg.units(x)) or any(contain(u, o, 0.8) >= 0.8 for o in there) for x in own]
    return sum(kept) / len(kept) if kept else 1.0


def format_presence(draft: str, output: str) -> float:
    own = [x for x in seg.split_prose(draft)[1] if x.strip() and not re.fullmatch(r"#+|[-*_\s]{3,}|```|~~~", x.strip())]
    if not own:
        return 1.0
    lines = _lines(output)
    there = [seg.units(x) for x in lines]
    shapes = {seg.line_shape(x) for x in lines + seg.split_prose(output)[1]}

    def kept(x: str) -> bool:
        u, shape = seg.units(x), seg.line_shape(x)
        if shape == "signature":
            return not u or any(contain(u, o, 0.8) >= 0.8 for o in there)
        return shape in shapes or bool(u) and any(contain(u, o, 0.5) >= 0.5 for o in there)

    return sum(map(kept, own)) / len(own)


def _grams(t: str, cjk: bool) -> list:
    w = seg.words(t)
    out: list = list(zip(*(w[i:] for i in range(5))))
    if cjk:
        s = re.sub(r"\s+", "", t)
        out += [g for i in range(len(s) - 5) if seg.CJK.search(g := s[i : i + 6])]
    return out


def _share(of: list, among: list) -> float:
    known = set(among)
    return sum(x in known for x in of) / len(of) if of else 0.0


def facts(t: str) -> set[str]:
    out = set()
    for x in FACT.findall(t):
        x = x.rstrip(".,;:)")
        if _NUMBER.fullmatch(x):
            x = x.replace(",", "")
            out.update(p for p in re.split("[/:-]", x.rstrip("%")) if p)
        out.add(x.lower())
    return out


def fact_recall(draft: str, output: str) -> float:
    own, there, plain = facts(draft), facts(output), re.sub(r"\s+", "", output.lower())
    return sum(x in there or x.replace(",", "") in plain for x in own) / len(own) if own else 1.0


def _skeleton(t: str) -> list[str]:
    out = []
    for w in re.findall(r"[A-Za-z']+|[0-9][0-9,.%$]*|[^\sA-Za-z0-9]", t):
        c = w[0]
        out.append("N" if c in "0123456789" else w if not (c == "'" or c.isascii() and c.isalpha()) else w.lower() if w.lower() in seg._STOP else "W")
    return out


def all_metrics(draft: str | None, output: str | None, body_only: bool = True) -> dict:
    """The 22 metrics of a pair.  Overlap and structure see prose only, unless either side has too little of it."""
    d = draft = draft or ""
    o = output = output or ""
    if body_only:
        prose = seg.split_prose(draft)[0], seg.split_prose(output)[0]
        if all(len(seg.content_tokens(x)) >= 6 for x in prose):
            d, o = prose
    cjk = bool(seg.CJK.search(d) or seg.CJK.search(o))
    a, b = _grams(d, cjk), _grams(o, cjk)
    verbatim = verbatim_pair(d, o)
    fragment = fragments(d, o)
    skeleton = None
    if not cjk:
        sk = [list(zip(*(s[i:] for i in range(5)))) for s in (_skeleton(d), _skeleton(o))]
        skeleton = _share(*sk)
    n_draft, n_out = (sum(bool(p.strip()) for p in re.split(r"\n\s*\n", seg.strip_markup(t).strip())) for t in (draft, output))
    m = structure(d, o) | {
        "copy_5gram": round(_share(b, a), 3),
        "draft_coverage": round(_share(a, b), 3),
        "verbatim_out": round(verbatim[0], 3),
        "verbatim_draft": round(verbatim[1], 3),
        "lcs_content": round(contain(seg.content_tokens(d), seg.content_tokens(o)), 3),
        "fact_recall": round(fact_recall(draft, output), 3),
        "format_recall": round(format_recall(draft, output), 3),
        "format_presence": round(format_presence(draft, output), 3),
        "para_kept": 1.0 if n_draft < 2 else round(min(1.0, n_out / n_draft), 3),
        "frag_coverage": round(fragment[0], 3),
        "frag_density": round(fragment[1], 2),
        "skeleton_recall": None if skeleton is None else round(skeleton, 3),
    }
    m["verbatim_sent"] = max(m["verbatim_out"], m["verbatim_draft"])
    m["copy"] = max(m["copy_5gram"], m["draft_coverage"], m["verbatim_sent"])
    m["reuse"] = m["copy"] if skeleton is None else round(max(m["copy"], skeleton), 3)
    return m
