"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return PLAIN.findall(text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def windows(words, width):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def quality_base(text):
    words = plain(text)
    lines = [line for line in (text or "").split("\n") if PLAIN.search(line)]
    found, marked = windows(words, 5), [False] * len(words)
    counts = Counter(found)
    for i, w in enumerate(found):
        if counts[w] > 1:
            marked[i : i + 5] = [True] * 5
    n, repeated = len(words), sum(marked)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n)


def suffix_dedup(docs, length=200):
    """docs: [(id, text)] -> [(id, n_bytes, n_removed, n_spans, kept_sha256)]."""
    texts = [(t or "").encode() for _, t in docs]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def substring_dedup(docs, width=13):
    """docs: [(id, text)] -> [(id, n_words, n_removed, kept words)]; ids may repeat, null ids lose nothing."""
    least = {}
    for doc_id, text in docs:
        if doc_id is not None:
            for w in windows(plain(text), width):
                least[w] = min(least.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        words = plain(text)
        gone = [False] * len(words)
        for i, w in enumerate(windows(words, width)):
            if doc_id is not None and least[w] < doc_id:
                gone[i : i + width] = [True] * width
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def near_classes(docs, threshold=0.8):
    """docs: [(id, text)] with distinct ids -> {id: smallest id of the class}."""
    sets = {}
    for doc_id, text in docs:
        words = alnum(text)
        sets[doc_id] = set(windows(words, 5)) if len(words) >= 5 else {tuple(words)} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    for a, s in sets.items():
        for b in set().union(*(holders[x] for x in s)) if s else ():
            both = len(s & sets[b])
            if b > a and both >= threshold * (len(s) + len(sets[b]) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in sets}


def contamination(docs, items, width=10):
    """-> [(id, n_words, n_hit, item ids as sorted strings)]."""
    wanted = defaultdict(set)
    for item_id, text in items:
        words = alnum(text)
        for w in windows(words, width) if len(words) >= width else [tuple(words)] if words else []:
            wanted[w].add(str(item_id))
    sizes, out = {len(w) for w in wanted}, []
    for doc_id, text in docs:
        words = alnum(text)
        hit, found = set(), set()
        for size in sizes:
            for i, w in enumerate(windows(words, size)):
                if w in wanted:
                    hit.update(range(i, i + size))
                    found |= wanted[w]
        out.append((doc_id, len(words), len(hit), sorted(found)))
    return out


def phrase_places(text, phrases):
    """(n_words, n_base, first, last, labels) of the base phrases."""
    words, places, labels = alnum(text), [], set()
    for phrase, label in phrases:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def fold(doc_id, n):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % n


def rebuilt_turns(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: [(role, text)]} with shared first turns."""
    import hashlib as h

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, h.md5((role or "").encode()).digest(), h.md5((text or "").encode()).digest(), role or "", text or ""))
    own = {c: [t[4:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        first = zlib.crc32(str(c).encode()) % 9
        other = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(other, [])[:first] + turns[first:]
    return out


def trie(convs):
    """{id: [turn]} -> (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                below[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = Counter(), Counter()
    for node, convs_here in members.items():
        value = (len(convs_here) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not below[node]
            saved[node[:d]] += value
    return [
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    ]


def collocations(rows, max_words=3, least=10, keep=50, top=2000):
    """rows: (lang, text) -> (lang, rank, phrase, a, l, r, n, score)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, max_words + 1):
                counts[lang].update(windows(words, m))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for q in windows(p, m):
                    longest[q] = max(longest[q], a)
        found = []
        for p, a in candidates.items():
            if q := longest[p]:
                if 100 * q >= keep * a:
                    continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, totals[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return out
