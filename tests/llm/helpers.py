"""Plain versions of the operators, and small texts."""

import random
import re
from collections import Counter, defaultdict

SPACE = " \t\n\r\x0b\x0c"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingle_set(text, k=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(docs, percent=80):
    """doc_id -> smallest id that links reach, over (doc_id, text) with distinct ids, held pair by pair."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def base_quality(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + o for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for o in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def dedup(docs):
    """doc_id -> (lines, removed, text) over (doc_id, text) with distinct ids."""
    first, cut = {}, defaultdict(set)
    for d, text in sorted(docs):
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if words(x)]
        for a, b, c in zip(full, full[1:], full[2:]):
            kept = first.setdefault((lines[a], lines[b], lines[c]), (d, a, c))
            if kept != (d, a, c):
                cut[d].update(range(max(a, kept[2] + 1) if kept[0] == d else a, c + 1))
    return {d: (len(t.split("\n")), len(cut[d]), "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut[d])) if t is not None else (0, 0, None) for d, t in docs}


def leaks(docs, items, masks, least=8, enough=13, share=0.7, penalty=2, piece=256, margin=64):
    """(doc_id, item_id) -> (first_word, n_aligned, n_match, n_item), every diagonal of every pair that a mask hits laid out word by word."""
    out = {}
    for d, text in docs:
        w = plain_words(text)
        for i, item in items:
            v = plain_words(item)
            if len(v) < least:
                continue
            hits = {(own, a - b) for m in masks for own in range(0, len(v), piece) for b in range(own, min(own + piece, len(v) - len(m) + 1)) for a in range(len(w) - len(m) + 1) if all(x == "0" or w[a + o] == v[b + o] for o, x in enumerate(m))}
            for own, shift in hits:
                lo, hi = max(0, own - margin), min(len(v), own + piece + margin)
                best, now, start, same = None, 0, None, 0
                for b in range(max(lo, -shift), min(hi, len(w) - shift)):
                    if now <= 0:
                        now, start, same = 0, b, 0
                    now += 1 if w[b + shift] == v[b] else -penalty
                    same += w[b + shift] == v[b]
                    if best is None or now > best[0]:
                        best = now, start, b + 1, same
                if best[3] >= min(enough, -(-7 * len(v) // 10)):
                    row = best[3], -(best[1] + shift), len(v), -(best[2] - best[1])
                    out[d, i] = max(out.get((d, i), row), row)
    return {k: (-f, -n, m, size) for k, (m, f, size, n) in out.items()}


def made_texts(n, seed=1, size=60, vocabulary=400):
    """n texts of random words, near copies of some among them."""
    r = random.Random(seed)
    some = [f"w{i}" for i in range(vocabulary)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(some)
            if r.random() < 0.2:
                w = w[: r.randint(max(1, len(w) - 6), len(w))]
        else:
            w = [r.choice(some) for _ in range(r.randint(1, size))]
        out.append(" ".join(w))
    return out
