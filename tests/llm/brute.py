"""Plain single-process versions of the operators, for small fixtures."""

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def words(text):
    return WORD.findall(lower(text))


def kneser_ney(train, texts):
    """[(n_tokens, n_known, base, score)] of each text under a bigram model of train."""
    seqs = [[None, *words(t), b" end"] for t in train]
    pairs = Counter((a, b) for s in seqs for a, b in zip(s, s[1:]))
    raw, kinds, ctx = Counter(), Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for (a, b), n in pairs.items():
        raw[b] += n
        kinds[b] += 1
        ctx[a][0] += n
        ctx[a][min(n, 3)] += 1

    def discounts(counts):
        n = [sum(1 for x in counts if x == k) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3)]

    d, e = discounts(pairs.values()), discounts(kinds.values())
    total, types, vocab = sum(raw.values()), len(pairs), len(raw)
    given = sum(e[min(k, 3)] for k in kinds.values()) / types if types else 1.0
    out = []
    for t in texts:
        s = [None, *words(t), b" end"]
        base = score = known = 0
        for a, b in zip(s, s[1:]):
            known += raw[b] > 0
            base += math.log10((raw[b] + 1) / (total + vocab + 1))
            low = max(kinds[b] - e[min(kinds[b], 3)], 0) / max(types, 1) + given / (vocab + 1)
            if a in ctx:
                c = ctx[a]
                p = max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / c[0] + sum(d[k] * c[k] for k in (1, 2, 3)) / c[0] * low
            else:
                p = low
            score += math.log10(p)
        out.append((len(s) - 1, known, base, score))
    return out


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def repeats(texts, length):
    """Removed byte flags of each text: covered by a string of `length` bytes that also starts elsewhere."""
    raw = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        flags = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if starts[r[i : i + length]] > 1:
                flags[i : i + length] = b"\1" * length
        out.append(flags)
    return out


def chroma_items(data, p):
    """[(item, bits that no threshold makes doubtful)] of one recording, from sums over single cells."""
    data = data + [p.silence] * (p.frame + (p.width - 1) * p.hop - len(data))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * (k + 1) / (p.frame + 1)) for k in range(p.frame)]
    rows = []
    for s in range(0, len(data) - p.frame + 1, p.hop):
        x, e = data[s : s + p.frame], [0.0] * 12
        if p.score:
            for v, w in zip(x, window):
                if v < 12:
                    e[v] += w
        else:
            mean = sum(x) / len(x)
            x = [(v - mean) * w for v, w in zip(x, window)]
            for b in range(p.frame // 2 + 1):
                hz = b * p.rate / p.frame
                if p.low_hz <= hz <= p.high_hz:
                    turn = [2 * math.pi * b * k / p.frame for k in range(p.frame)]
                    re_, im = sum(v * math.cos(a) for v, a in zip(x, turn)), sum(v * math.sin(a) for v, a in zip(x, turn))
                    e[round(12 * math.log2(hz / 440)) % 12] += re_ * re_ + im * im
        norm = math.sqrt(sum(v * v for v in e))
        rows.append([v / norm if norm > 1e-3 else 0.0 for v in e])
    out = []
    for t in range(len(rows) - p.width + 1):
        item = sure = 0
        for k in range(4):
            for shape in range(4):
                h = (4, 6, 8, 10)[(k + shape) % 4]
                y, w = (3 * k + 2 * shape) % (12 - h + 1), p.width >> (k % 2)
                part = rest = 0.0
                for i in range(w):
                    for c in range(h):
                        v = rows[t + i][y + c]
                        late, high = i >= w // 2, c >= h // 2
                        if shape == 3:
                            third = max(h // 3, 1)
                            inside, v = third <= c < 2 * third, v * (h - third if third <= c < 2 * third else third)
                        else:
                            inside = (late, high, late == high)[shape]
                        part, rest = (part + v, rest) if inside else (part, rest + v)
                r = math.log1p(part) - math.log1p(rest)
                level = (r > -0.15) + (r > 0) + (r > 0.15)
                item = item << 2 | (0, 1, 3, 2)[level]
                sure = sure << 2 | (0 if min(abs(r - c) for c in (-0.15, 0, 0.15)) < 1e-5 else 3)
        out.append((item, sure))
    return out


def alignment(a, b, p):
    """(offset of b in a, equal items, overlap, differing bits) if the rule links them, by trying every offset."""
    best = (0, 0)
    for off in range(1 - len(b), len(a)):
        x, y = a[max(off, 0) :], b[max(-off, 0) :]
        n = sum(i == j for i, j in zip(x, y))
        if n > best[1]:
            best = (off, n)
    off, n = best
    pairs = list(zip(a[max(off, 0) :], b[max(-off, 0) :]))
    errors = sum((i ^ j).bit_count() for i, j in pairs)
    same = [i == j for i, j in pairs]
    near = any(i and j for i, j in zip(same, same[1:])) or max(len(a), len(b)) <= 5
    need = max(min(p.least, p.agree * max(len(a), len(b))), p.agree * len(pairs))
    return (off, n, len(pairs), errors) if n and n >= need and errors <= p.max_error * 32 * len(pairs) and near else None


def components(nodes, edges):
    """The root of every node."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        up[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def poly_hash(raw):
    """The 64-bit hash of a byte string as its definition says."""
    mask, base, h, p = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1, 0, 1
    for b in raw:
        h = (h + (b + 1) * p) & mask
        p = p * base & mask
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 & mask
    h ^= h >> 29
    h = h * 0x94D049BB133111EB & mask
    return h ^ h >> 32


def byte_network(text, table, out, bias, shape):
    """One text's probability: filters at every byte (zeros follow the text), the largest response of each chunk, then its max, min and mean."""
    filters, width, half = shape.filters, shape.width, shape.half
    padded = text + bytes(width)
    places = range(len(text)) if text else range(1)
    response = [[sum(table[j][padded[i + j]][f] for j in range(width)) for f in range(filters)] for i in places]
    blocks = [response[i : i + half] for i in range(0, len(response), half)]
    chunks = [blocks[i] + blocks[i + 1] for i in range(len(blocks) - 1)] or blocks
    top = [[max(r[f] for r in c) for f in range(filters)] for c in chunks]
    z = [g([t[f] for t in top]) for g in (max, min, lambda x: sum(x) / len(x)) for f in range(filters)]
    return 1 / (1 + math.exp(-(bias + sum(w * math.tanh(v / 4) for w, v in zip(out, z)))))
