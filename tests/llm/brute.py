"""Plain versions of what the corpus operators return, to hold them against."""

import hashlib
import re
import zlib

import numpy as np
import xxhash


def digest(spans):
    return hashlib.sha256(spans.encode()).hexdigest()


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def pii(text):
    """Base spans by the contract's own expressions."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, text) if holds(kind, m[0])]


def secrets(text):
    patterns = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least = {"assign": 6, "access": 20, "hex": 24}
    return [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, text) if len(m[2] if kind == "assign" else m[0]) >= least[kind]]


def fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, radius=2):
    """Smallest id reachable, by id."""
    parent = {d: d for d in fingerprints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(fingerprints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def word_shingles(text, size=5):
    """Word shingles of a text as a set; of fewer words the whole sequence."""
    words = text.encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {(len(words), *words)}


def similar(texts, p=4, q=5):
    """For each text the first one that links reach, by exact similarity of all pairs with a shingle in common."""
    sets, parent, by = [word_shingles(t) for t in texts], list(range(len(texts))), {}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for b, own in enumerate(sets):
        for a in {a for x in own for a in by.get(x, ())}:
            if len(sets[a] & own) * (p + q) >= (len(sets[a]) + len(own)) * p:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        for x in own:
            by.setdefault(x, []).append(b)
    return [find(k) for k in range(len(texts))]


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def url(u, rules):
    """host, path, rule, verdict."""
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, action) for h, p, action in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def packed(rows, ids_of, capacity=4096):
    """Asserts that rows of (doc_id, piece, start, length, ids_crc32, sequence_id, offset)
    hold every document's ids once, in gapless sequences. Returns sequences and ids."""
    by, sequences, total = {}, {}, 0
    for r in rows:
        by.setdefault(r[0], []).append(r)
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    assert by.keys() == ids_of.keys()
    for doc, pieces in by.items():
        ids, at = np.array(ids_of[doc], dtype="<u4"), 0
        total += len(ids)
        for k, (_, piece, start, length, crc, _, _) in enumerate(sorted(pieces, key=lambda r: r[1])):
            assert (piece, start) == (k, at)
            assert crc == zlib.crc32(ids[at : at + length].tobytes())
            assert length == capacity or k == len(pieces) - 1
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), total
