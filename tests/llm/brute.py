"""Plain Python versions of what the operators compute."""

import hashlib
import math
import re

import xxhash

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_ASCII)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, n):
    w = space_words(text)
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def simhash(text):
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def sketch(text, k):
    return sorted({xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 5)})[:k]


def likeness(a, b, k):
    both = sorted(set(a) | set(b))[:k]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items):
    windows = {}
    for i, t in items:
        w = bench_words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = bench_words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        names = sorted(str(i) for i in found if i is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def tokens(word, scores, unknown):
    best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            score, n = scores.get(word[i:j]), 1
            if score is None:
                if j - i > 1:
                    continue
                score, n = unknown, len(word[i:j].encode())
            best[j] = max(best[j], (best[i][0] + score, best[i][1] - n))
    return -best[-1][1]


def ngrams(text, sizes, bits):
    """Buckets of the character n-grams of a text's words, each followed by a space."""
    whole = "".join(w + " " for w in space_words(text))
    m64 = (1 << 64) - 1
    stir, base = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15
    number = [(int.from_bytes(c.encode(), "little") + 1) * stir & m64 for c in whole]
    out = set()
    for n in sizes:
        for i in range(len(whole) - n + 1):
            acc = 0
            for x in number[i : i + n]:
                acc = (acc * base + x) & m64
            out.add((acc ^ acc >> 29) * base % (1 << 64) >> (64 - bits))
    return out


def licenses(rows, templates, threshold):
    """path -> (licence, found, declared_in) by TF-IDF cosines of all stretches and whole texts."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t))
    flat = [(name, words(t)) for name, texts in templates.items() for t in texts]
    docs = {p: words(t) for p, t in rows}
    idf = lambda w: math.log((1 + len(docs)) / (1 + sum(w in set(d) for d in docs.values()))) + 1
    idf = {w: idf(w) for w in {w for d in docs.values() for w in d} | {w for _, t in flat for w in t}}

    def cosine(a, b):
        x, y = ({w: s.count(w) * idf[w] for w in s} for s in (a, b))
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / norm if norm else 0.0

    own, votes = {}, {}
    for path, d in docs.items():
        best = (0.0, 0, None)
        entire = {}
        for k, (name, t) in enumerate(flat):
            n = min(len(t), len(d))
            entire[k] = cosine(d, t)
            top = max([entire[k], *[cosine(d[i : i + n], t) for i in range(len(d) - n + 1)]], default=0.0)
            if top > best[0] + 1e-12:
                best = (top, k, name)
        if best[0] >= threshold:
            own[path] = (best[2], entire[best[1]] >= threshold)
            folder = path.rpartition("/")[0]
            votes.setdefault(folder, {}).setdefault((not own[path][1], best[2]), 0)
            votes[folder][not own[path][1], best[2]] += 1
    said = {f: min((late, -n, name) for (late, name), n in v.items())[2] for f, v in votes.items()}
    out = {}
    for path in docs:
        folder = path.rpartition("/")[0]
        parts = folder.split("/")
        near = next((f for f in ["/".join(parts[:i]) for i in range(len(parts), 0, -1)] + [""] if f in said), None)
        if path in own:
            out[path] = (own[path][0], "file" if own[path][1] else "notice", None)
        else:
            out[path] = (said.get(near), "inherited" if near is not None else "none", near)
    return out
