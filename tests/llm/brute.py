"""Plain versions of the contracts, row by row, for small inputs.  docs: list of (doc_id, text)."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if n[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def lm(docs):
    train, tokens = Counter(), {}
    for i, t in docs:
        tokens[i] = [*WORD.findall((t or "").translate(ASCII_LOWER)), None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens[i])
    n, v = sum(train.values()), len(train)
    return {i: (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated(rows, width):
    """rows: (id, sequence).  For each id the covered places."""
    first, out = {}, {}
    for i, seq in sorted(rows):
        gone = set()
        for s in range(len(seq) - width + 1):
            key = seq[s:s + width] if isinstance(seq, bytes) else tuple(seq[s:s + width])
            if key in first:
                gone.update(range(s, s + width))
            else:
                first[key] = (i, s)
        out[i] = gone
    return out


def word_repeats(docs, width=20):
    seqs = {i: WORD.findall(t or "") for i, t in docs}
    gone = repeated(seqs.items(), width)
    return {i: (len(w), len(gone[i]), sha(" ".join(x for k, x in enumerate(w) if k not in gone[i]))) for i, w in seqs.items()}


def byte_repeats(docs, width=100):
    seqs = {i: (t or "").encode() for i, t in docs}
    gone = repeated(seqs.items(), width)
    return {i: (len(b), len(gone[i]), sum(k - 1 not in gone[i] for k in gone[i]), sha(bytes(x for k, x in enumerate(b) if k not in gone[i]))) for i, b in seqs.items()}


def decontaminate(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = TERM.findall((t or "").translate(ASCII_LOWER))
        for s in range(max(len(w) - 12, 1 if w else 0)):
            wins[tuple(w[s:s + 13])].add(i)
    sizes = sorted({len(k) for k in wins})
    out = {}
    for i, t in docs:
        w = TERM.findall((t or "").translate(ASCII_LOWER))
        hit, own = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in wins:
                    hit.update(range(s, s + n))
                    own |= wins[k]
        own = {str(x) for x in own if x is not None}
        out[i] = (len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    spans, n = [], []
    for order, (kind, pattern, ok) in enumerate(kinds):
        own = [m for m in re.finditer(pattern, text) if ok(m[0])]
        n.append(len(own))
        spans += [(m.start(), order, m.end(), kind) for m in own]
    return (*n, sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))))
