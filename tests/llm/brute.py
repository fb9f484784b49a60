"""Plain versions of the operators for small inputs: rows are (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

BLANK = " \t\n\x0b\x0c\r"
BLANK_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def order(row):
    return (row[0] is not None, row[0] or 0)


def covered(n: int, starts, width: int) -> list[bool]:
    out = [False] * n
    for s in starts:
        out[s : s + width] = [True] * width
    return out


def repeated_bytes(rows, width=100):
    seen, out = set(), []
    for i, text in sorted(rows, key=order):
        raw = (text or "").encode()
        again = []
        for s in range(len(raw) - width + 1):
            again += [s] if raw[s : s + width] in seen else []
            seen.add(raw[s : s + width])
        gone = covered(len(raw), again, width)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def repeated_words(rows, width=50):
    first = {}
    for i, text in sorted(rows, key=order):
        words = BLANK_WORD.findall((text or "").encode())
        for s in range(len(words) - width + 1):
            first.setdefault(tuple(words[s : s + width]), order((i,)))
    out = []
    for i, text in rows:
        words = BLANK_WORD.findall((text or "").encode())
        again = [s for s in range(len(words) - width + 1) if first[tuple(words[s : s + width])] < order((i,))]
        gone = covered(len(words), again, width)
        out.append((i, len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g))))
    return out


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def roots(n: int, pairs) -> list[int]:
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def kept_texts(rows, edits=2, least=20, per_edit=20):
    """(doc_id, lines that are not blank, lines that went, text that stays)"""
    lines = {}
    for i, text in sorted(rows, key=order):
        for number, line in enumerate((text or "").split("\n")):
            if line.strip(BLANK):
                lines.setdefault(line, (order((i,)), number))
    names = list(lines)
    counts = [Counter(x) for x in names]
    long = sorted((k for k, x in enumerate(names) if len(x) >= least), key=lambda k: len(names[k]))
    pairs = []
    for n, a in enumerate(long):
        for b in long[n + 1 :]:
            most = max(edits, len(names[a]) // per_edit)
            if len(names[b]) - len(names[a]) > most:
                break
            if (counts[a] - counts[b]).total() <= most and (counts[b] - counts[a]).total() <= most and distance(names[a], names[b]) <= most:
                pairs.append((a, b))
    first = {}
    for k, root in enumerate(roots(len(names), pairs)):
        first[root] = min(first.get(root, lines[names[k]]), lines[names[k]])
    stay, out = set(first.values()), []
    for i, text in rows:
        parts = (text or "").split("\n")
        keep = [p for k, p in enumerate(parts) if not p.strip(BLANK) or (order((i,)), k) in stay]
        out.append((i, sum(bool(p.strip(BLANK)) for p in parts), len(parts) - len(keep), text if len(keep) == len(parts) else "\n".join(keep)))
    return out


def near_links(rows, threshold=0.8, width=5):
    """(doc_id, class_id, n_links)"""
    sets = []
    for _, text in rows:
        words = BLANK_WORD.findall((text or "").encode().translate(LOWER))
        sets.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    links, pairs = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    root = roots(len(rows), pairs)
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, rows[k]), rows[k], key=order)
    return [(rows[k][0], least[r][0], links[k]) for k, r in enumerate(root)]


def benchmark_hits(rows, items, width=10):
    """(doc_id, words, hit words as a mask, sorted items, byte ranges of the hit runs)"""
    windows = {}
    for item, text in items:
        words = ALNUM_WORD.findall((text or "").encode().translate(LOWER))
        size = min(width, len(words))
        for s in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[s : s + size]), set()).add(item)
    out = []
    for i, text in rows:
        spots = list(ALNUM_WORD.finditer((text or "").encode().translate(LOWER)))
        words, hit, found = [m.group() for m in spots], [False] * len(spots), set()
        for size in {len(w) for w in windows}:
            for s in range(len(words) - size + 1):
                if names := windows.get(tuple(words[s : s + size])):
                    found |= names
                    hit[s : s + size] = [True] * size
        ranges = []
        for k, h in enumerate(hit):
            if h and k and hit[k - 1]:
                ranges[-1] = (ranges[-1][0], spots[k].end())
            elif h:
                ranges.append(spots[k].span())
        out.append((i, len(words), hit, sorted(str(x) for x in found if x is not None), ranges))
    return out


def without(text, ranges):
    if text is None or not ranges:
        return text
    raw, at, out = text.encode(), 0, b""
    for a, b in ranges:
        out, at = out + raw[at:a], b
    return (out + raw[at:]).decode()


def copies(rows):
    folded = [(text or "").encode().translate(LOWER) for _, text in rows]
    size, last = Counter(folded), {}
    for (i, _), f in zip(rows, folded):
        last[f] = max(last.get(f, (i,)), (i,), key=order)
    return [(i, last[f][0], size[f], i == last[f][0], sha(f)) for (i, _), f in zip(rows, folded)]


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
