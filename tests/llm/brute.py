"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality_counts(text):
    text = text or ""
    words = words_of(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {at + k for at, w in enumerate(zip(words, words[1:], words[2:]))
               if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text)
            if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text):
    import xxhash

    words = words_of(lower_ascii(text))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius=4, roots=False):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for at, one in enumerate(ids):
        if one is not None:
            root = find(at)
            least[root] = min(one, least.get(root, one))
    if roots:
        return [find(at) for at in range(len(ids))]
    return [least.get(find(at)) for at in range(len(ids))]


def segmentations(text, pieces, spelled):
    """The probability of ``text`` as a sum over all ways to cut it."""
    if not text:
        return 1.0
    total, single = 0.0, False
    for size in range(1, len(text) + 1):
        p = pieces.get(text[:size])
        if p is not None:
            single = single or size == 1
            total += p * segmentations(text[size:], pieces, spelled)
    if not single:
        total += spelled(text[0]) * segmentations(text[1:], pieces, spelled)
    return total


def base_scores(rows):
    """``{row: (n_tokens, n_known, N, base)}`` of ``(held_out, text)`` rows."""
    counts = Counter()
    for held, text in rows:
        if not held:
            counts.update([*words_of(lower_ascii(text)), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for _, text in rows:
        tokens = [*words_of(lower_ascii(text)), None]
        out.append((len(tokens), sum(t in counts for t in tokens), n, sum(
            math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    return out
