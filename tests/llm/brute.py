"""The contracts once more, in plain Python and without regard to cost."""

import hashlib
import html
import re
from collections import Counter

import xxhash

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def decontamination(docs, items, n=13):
    windows = {}
    for item, text in items:
        words = ITEM_WORD.findall(lower(text))
        size = min(n, len(words))
        for k in range(len(words) - size + 1) if size else []:
            windows.setdefault((size, tuple(words[k : k + size])), set()).add(item)
    sizes = {s for s, _ in windows}
    out = []
    for doc, text in docs:
        words, hit, found = ITEM_WORD.findall(lower(text)), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if own := windows.get((size, tuple(words[k : k + size]))):
                    hit.update(range(k, k + size))
                    found |= own
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))),
                    bool(hit) and 20 * len(hit) >= len(words)))
    return out


def measures(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    again = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(again), len(lines))


def simhash(text):
    words = SPACE_WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fingerprints, distance=4):
    """Smallest reachable id for each (id, fingerprint)."""
    parent = {i: i for i, _ in fingerprints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(fingerprints):
        for b, g in fingerprints[i + 1 :]:
            if (f ^ g).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fingerprints}


def repeats(docs, length=100):
    """Per document in order of id: bytes, removed bytes, spans and what is left."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, sha(kept)))
    return out


def article(page):
    """The lines of text between <article> and </article>, by patterns over the given pages' tags."""
    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    inner = re.sub("<!--.*?-->|<(script|style).*?</\\1>", "", inner, flags=re.S)
    lines = re.split("</?(?:h[1-6]|p|div|ul|ol|li|table|tr|td|th|section|blockquote|pre|article)\\b[^>]*>", inner)
    lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br[^>]*>", " ", x))).split()) for x in lines)
    return "\n".join(x for x in lines if x)
