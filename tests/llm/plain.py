"""Plain single-process forms of the operators' results, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
}


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def base_spans(text: str | None) -> list[str]:
    return [f"{kind}:{m.start()}:{m.end()}" for kind, (pattern, good) in BASE.items() for m in re.finditer(pattern, text or "") if good(m.group())]


def size(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), repeat: int = 3) -> dict[str | None, float]:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    done: dict[str | None, float] = {}
    while True:
        left, open_ = sum(sizes.values()) - sum(done.values()), [s for s in names if s not in done]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > repeat * sizes[s]]
        if not over:
            return done | share
        done |= {s: float(repeat * sizes[s]) for s in over}


def classes(n: int, links) -> list[int]:
    """The least member of each one's component."""
    label = list(range(n))

    def top(k: int) -> int:
        while label[k] != k:
            k = label[k]
        return k

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return [top(k) for k in range(n)]


def words(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def near_duplicates(docs: list[tuple]) -> dict:
    """doc_id -> (class_id, n_links), every pair compared."""
    docs = sorted((d[0], d[1]) for d in docs)
    sets = []
    for _, text in docs:
        w = words(text)
        n = min(5, len(w))
        sets.append({tuple(w[k: k + n]) for k in range(len(w) - n + 1)} if w else set())
    links = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    count = Counter(k for pair in links for k in pair)
    return {docs[k][0]: (docs[c][0], count[k]) for k, c in enumerate(classes(len(docs), links))}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dropped_lines(docs: list[tuple], min_chars: int = 20) -> dict:
    """doc_id -> places of lines that are within one edit of an earlier one, or linked to it by such."""
    found = [(d, k, x.strip(" ")) for d, text in sorted((d[0], d[1]) for d in docs) for k, x in enumerate((text or "").split("\n") if text is not None else [])]
    found = [x for x in found if len(x[2]) >= min_chars]
    lines = sorted({x[2] for x in found})
    shorter = defaultdict(set)  # lines one edit apart share themselves less one character, or one is that of the other
    for k, x in enumerate(lines):
        for at in range(len(x) + 1):
            shorter[x[:at] + x[at + 1:]].add(k)
    links = {(a, b) for group in shorter.values() if len(group) > 1 for a in group for b in group if a < b}
    label = classes(len(lines), [(a, b) for a, b in links if edits(lines[a], lines[b]) <= 1])
    at = {x: label[k] for k, x in enumerate(lines)}
    out, seen = defaultdict(list), set()
    for d, k, x in found:
        if at[x] in seen:
            out[d].append(k)
        seen.add(at[x])
    return dict(out)


def leaks(docs: list[tuple], items: list, threshold: float = 0.5, overlap: float = 0.5) -> set[tuple]:
    """(doc_id, item_id) over all passages and items; ``items`` are rows of ``item_postings``."""
    groups = defaultdict(list)
    for r in items:
        groups[max(6, r.band)].append(r)
    triples = lambda w: set(zip(w, w[1:], w[2:]))
    out = set()
    for rows in groups.values():
        half = max(32, max(len(r.question) + len(r.answer) for r in rows))
        for d, text in ((d[0], d[1]) for d in docs):
            w = words(text)
            for low in range(0, len(w), half):
                passage = w[low: low + 2 * half]
                have, held = set(passage), triples(passage)
                for r in rows:
                    if sum(x for t, x in zip(r.terms, r.weights) if t in have) < threshold - 1e-9:
                        continue
                    share = []
                    for part in (r.question, r.answer):
                        grams = triples(part)
                        share.append(len(grams & held) / len(grams) if grams else float(set(part) <= have))
                    if min(share) >= overlap:
                        out.add((d, r.item_id))
    return out


def all_cuts(word: str, logp: dict[str, float]) -> float:
    """Log of the summed probability of every way to cut ``word`` into pieces, one by one."""
    if not word:
        return 0.0
    ways = [logp[word[:k]] + all_cuts(word[k:], logp) for k in range(1, len(word) + 1) if word[:k] in logp]
    return float(np.logaddexp.reduce(ways)) if ways else -np.inf


def discovered(found: list, rounds: int, support: int, score: float, kinds: tuple) -> set[tuple]:
    """(doc_id, start, end, kind) by the scores of patterns; ``found`` are rows of ``pii.occurrences``."""
    edges = {(p, r.instance) for r in found for p in r.patterns}
    size = Counter(p for p, _ in edges)
    seeds = {(r.instance, r.kind): 1.0 for r in found if r.kind}
    conf, held = dict(seeds), {}
    for _ in range(rounds):
        total, sure = defaultdict(float), Counter()
        by = defaultdict(list)
        for (instance, kind), c in conf.items():
            by[instance].append((kind, c))
        for p, instance in edges:
            for kind, c in by[instance]:
                total[p, kind] += c
                sure[p, kind] += c >= score
        held = {(p, k): s / (size[p] + 1) for (p, k), s in total.items() if sure[p, k] >= support and s / (size[p] + 1) >= score}
        miss = defaultdict(lambda: 1.0)
        for p, instance in edges:
            for k in kinds:
                if (p, k) in held:
                    miss[instance, k] *= 1 - held[p, k]
        conf = {x: max(seeds.get(x, 0.0), 1 - miss[x] if x in miss else 0.0) for x in seeds.keys() | miss.keys()}
    out = set()
    for r in found:
        ways = [(held[p, k], -kinds.index(k)) for p in r.patterns for k in kinds if (p, k) in held and conf.get((r.instance, k), 0) >= score]
        if ways and r.kind in (None, "secret"):
            out.add((r.doc_id, r.start, r.end, kinds[-max(ways)[1]]))
    return out
