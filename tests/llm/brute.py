"""The operators' results by plain Python."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near_classes(rows):
    """{doc_id: class} by all pairs: shingle sets alike by 0.8, and words in order, by a full alignment."""
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    ids = sorted(texts)
    words = {i: tuple(WORD.findall(texts[i])) for i in ids}
    sets = {i: {w[j : j + 5] for j in range(max(1, len(w) - 4))} if (w := words[i]) else set() for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            alike = words[a] == words[b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if a < b and alike and find(a) != find(b) and edit_distance(words[a], words[b]) <= 0.2 * max(len(words[a]), len(words[b])) + 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def _confirmed(kind, m):
    digits = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def pii(text):
    spans = [(k, m.start(), m.end()) for k, p in PII for m in p.finditer(text or "") if _confirmed(k, m.group())]
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return [sum(s[0] == k for s in spans) for k, _ in PII], hashlib.sha256(listed.encode()).hexdigest()


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def targets(sizes, weights=(3, 1, 2)):
    """{source: target} by capping over and over."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        weight = sum(w[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * w[s] / weight > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else left * w[s] / weight for s in order}
        full |= over


def phrases(data: bytes):
    known, current = set(), b""
    for c in data:
        current += bytes((c,))
        if current not in known:
            known.add(current)
            current = b""
    return known


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
