"""One file and one task in plain Python, for table functions that are called row by row; batches go through plans.compile."""

from __future__ import annotations

import re
from collections import Counter
from math import log

from loomspark.functions import query as Q
from loomspark.functions.text import NO_HEADING
from loomspark.operators.chunking import HEADING, MOST_TOKENS
from loomspark.operators.ranking import B, HEADING_BOOST, K1, NEAR_TOP, RELEVANCE_FLOOR
from loomspark.operators.selection import Section, Selection, count_tokens, select

_HEADING = re.compile(HEADING)


def _blocks(lines: list[str]) -> list[str]:
    """Runs of lines between blank ones; a table is a run of its own."""
    table = lambda x: len(x) >= 2 and x.startswith("|") and x.endswith("|")
    out: list[list[str]] = []
    kind = None
    for line in lines:
        bare = line.strip()
        if bare and kind == table(bare):
            out[-1].append(line)
        elif bare:
            out.append([line])
        kind = table(bare) if bare else None
    return ["\n".join(b) for b in out]


def _merged(blocks: list[str], most: int) -> list[str]:
    parts: list[tuple[str, int]] = []
    for b in blocks:
        n = count_tokens(b)
        if parts and parts[-1][1] + n <= most:
            text, k = parts.pop()
            parts.append((f"{text}\n\n{b}", k + n))
        else:
            parts.append((b, n))
    return [text.strip() for text, _ in parts]


def chunk_text(markdown: str, most: int = MOST_TOKENS) -> list[Section]:
    """As chunking.chunk_markdown for one file."""
    held: list[tuple[list[str], str | None, list[str]]] = [([], None, [])]
    trail: dict[int, str] = {}
    for line in re.split(r"\r?\n", markdown or ""):
        if m := _HEADING.match(line):
            level = len(m[1])
            trail = {k: t for k, t in trail.items() if k < level} | {level: m[2].strip()}
            held.append((list(trail.values()), line, []))
        else:
            held[-1][2].append(line)
    out: list[Section] = []
    for crumbs, head, body in held:
        first = [] if head is None else [head]
        whole = "\n".join([*first, "\n".join(body).strip()]).strip()
        if whole:
            for text in [whole] if count_tokens(whole) <= most else _merged(_blocks(first + body), most):
                out.append(Section(f"s{len(out)}", len(out), " > ".join(crumbs) if crumbs else NO_HEADING, text, count_tokens(text)))
    return out


def scores(sections: list[Section], terms: list[str]) -> list[float]:
    """BM25 with the share for breadcrumbs."""
    found = [Counter(Q.tokens(s.text)) for s in sections]
    sizes = [sum(c.values()) for c in found]
    mean = (sum(sizes) / len(sizes) if sizes else 0) or 1
    out = [0.0] * len(sections)
    for t, n in Counter(terms).items():
        df = sum(t in c for c in found)
        idf = log((len(found) - df + 0.5) / (df + 0.5) + 1)
        for i, c in enumerate(found):
            if c[t]:
                out[i] += n * idf * c[t] * (K1 + 1) / (c[t] + K1 * (1 - B + B * sizes[i] / mean))
    top = max([0.0, *out])
    return [round(s + (HEADING_BOOST * top if set(Q.tokens(x.breadcrumb)) & set(terms) else 0.0), 9) for s, x in zip(out, sections, strict=True)]


def compile_text(markdown: str, task: str, budget: int, name: str = "document") -> Selection:
    """As plans.compile.compile_context for one file and task, but for names asked of it."""
    sections = chunk_text(markdown)
    asks = Q.split_aspects(task)
    terms = [Q.query_terms(a) for a in asks]
    rows = [scores(sections, t) for t in terms]
    best: list[str] = []
    if len(asks) > 1:
        tops = [max([0.0, *r]) for r in rows]
        rows = [[s / t if t > 0 else 0.0 for s in r] for r, t in zip(rows, tops, strict=True)]
        first: dict[int, tuple[int, int]] = {}
        for q, r in enumerate(rows):
            own = set(terms[q]) - {t for k, other in enumerate(terms) if k != q for t in other}
            near = [s for s in sections if max(r, default=0) <= 0 or r[s.ord] >= NEAR_TOP * max(r)]
            hits = lambda s, own=own, r=r: sum(t in s.text.lower() for t in own) if max(r) > 0 else 0
            lead = min(near, key=lambda s, r=r, hits=hits: (-hits(s), -r[s.ord], s.ord), default=None)
            if lead is None:
                continue
            best.append(lead.id)
            for place, s in enumerate(sorted(sections, key=lambda s, r=r, lead=lead: (s.ord != lead.ord, -r[s.ord], s.ord))):
                first[s.ord] = min(first.get(s.ord, (place, q)), (place, q))
        order = sorted(sections, key=lambda s: first[s.ord])
    merged = [max([0.0, *(r[s.ord] for r in rows)]) for s in sections]
    if len(asks) == 1:
        order = sorted(sections, key=lambda s: (-merged[s.ord], s.ord))
    matched = lambda s: tuple(q for q, r in enumerate(rows) if r[s.ord] >= max(RELEVANCE_FLOOR, NEAR_TOP * max(r))) if len(asks) > 1 else ()
    ranked = [Section(s.id, s.ord, s.breadcrumb, s.text, s.tokens, merged[s.ord], matched(s)) for s in order]
    return select(ranked, budget, name, Q.query_terms(task), best, task, content=True)
