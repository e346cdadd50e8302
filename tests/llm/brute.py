"""Plain versions of the operators for small inputs."""

import re
from collections import Counter

import xxhash

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def lines(texts, least=10):
    """Per text: lines, dropped lines, what stays."""
    split = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(BLANKS).translate(TO_LOWER) for x in s] for s in split]
    often = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for s, ks in zip(split, keys):
        stay = [x for x, k in zip(s, ks) if often[k] < least]
        out.append((len(s), len(s) - len(stay), "\n".join(stay)))
    return out


def fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TO_LOWER))
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=3):
    """Least index reachable, by index."""
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(fps))]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TO_LOWER))


def contaminated(text, items, window=10):
    """Words, hit words, ids of the items found."""
    words, hit, found = item_words(text), set(), set()
    for item, body in items:
        w = item_words(body)
        n = min(window, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), found


def repeats(docs, length):
    """Per (id, bytes): the marks of the bytes that go. A string counts if a smaller id has it."""
    first = {}
    for doc, body in docs:
        for i in range(len(body) - length + 1):
            s = body[i : i + length]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, body in docs:
        mark = bytearray(len(body))
        for i in range(len(body) - length + 1):
            if first[body[i : i + length]] < doc:
                mark[i : i + length] = b"\1" * length
        out.append(bytes(mark))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _fine(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        twice = [int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def personal(text):
    """(start, kind, end) of the base findings, in order."""
    kinds = list(PATTERNS)
    found = [(m.start(), k, m.end()) for k in kinds for m in re.finditer(PATTERNS[k], text or "") if _fine(k, m.group())]
    return sorted(found, key=lambda s: (s[0], kinds.index(s[1])))
