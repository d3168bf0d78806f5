"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from functools import cache


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def byte_repeats(texts, width):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        out.append((len(t), sum(gone), sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), sha(bytes(x for x, g in zip(t, gone, strict=True) if not g))))
    return out


def passages(rows, window):
    seen, out = set(), []
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [0] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [1] * window
            seen.add(x)
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def lines(rows, near_words, close):
    seen, known, out = [], set(), []
    for i, t in sorted(rows):
        kept, gone, near = [], 0, 0
        for line in (t or "").split("\n"):
            w = tuple(line.encode().split())
            if not w:
                kept.append(line)
                continue
            if w in known:
                gone += 1
                continue
            if len(w) >= near_words and any(len(o) >= near_words and close(b" ".join(w).decode(), b" ".join(o).decode()) for o in seen):
                gone, near = gone + 1, near + 1
            else:
                kept.append(line)
            seen.append(w)
            known.add(w)
        out.append((i, len((t or "").split("\n")), gone, near, sha("\n".join(kept).encode())))
    return out


def similar_pairs(texts, size, threshold):
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (t.encode().split() for t in texts)]
    return [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]


def language_model(rows, depth):
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count, words = defaultdict(lambda: [0, 0]), Counter()
    for i, t in rows:
        if not held(i):
            b = bytes(depth) + low(t) + b"\0"
            words.update([*low(t).split(), None])
            for p in range(depth, len(b)):
                for k in range(8):
                    for d in range(depth + 1):
                        count[b[p - d : p], 1 << k | b[p] >> (8 - k)][b[p] >> (7 - k) & 1] += 1
    below = defaultdict(list)
    for c, n in count:
        if c:
            below[c[1:], n].append((c, n))
    estimate = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @cache
    def weighted(c, n):
        own = estimate(*count.get((c, n), (0, 0)))
        if len(c) == depth:
            return own
        x, y = math.log(0.5) + own, math.log(0.5) + sum(weighted(*k) for k in below[c, n])
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    def chance(context, n, bit):
        p = None
        for d in range(depth, -1, -1):
            c = context[depth - d :]
            ab = count.get((c, n), (0, 0))
            own = (ab[bit] + 0.5) / (sum(ab) + 1)
            if d == depth:
                p = own
            else:
                stop = math.exp(math.log(0.5) + estimate(*ab) - weighted(c, n))
                p = stop * own + (1 - stop) * p
        return p

    total, distinct, out = sum(words.values()), len(words), []
    for i, t in rows:
        b, score = bytes(depth) + low(t) + b"\0", 0.0
        for p in range(depth, len(b)):
            score += sum(math.log10(chance(b[p - depth : p], 1 << k | b[p] >> (8 - k), b[p] >> (7 - k) & 1)) for k in range(8))
        tokens = [*low(t).split(), None]
        out.append((i, held(i), len(tokens), sum(words[x] > 0 for x in tokens), total, sum(math.log10((words[x] + 1) / (total + distinct + 1)) for x in tokens), score))
    return out
