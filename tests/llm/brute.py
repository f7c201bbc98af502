"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re


def near(rows, size, percent):
    """{row index: (n_shingles, component_id)} of (doc_id, text) rows."""
    sets = []
    for _, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()})
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def repeats(texts, size):
    """[(n_bytes, n_removed, n_spans, kept bytes)] of texts; a window counts once for each start."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - size + 1):
            seen.setdefault(b[i : i + size], []).append((d, i))
    gone = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + size] = b"\1" * size
    out = []
    for b, g in zip(raw, gone):
        spans = sum(1 for i in range(len(g)) if g[i] and not (i and g[i - 1]))
        out.append((len(b), sum(g), spans, bytes(x for x, y in zip(b, g) if not y)))
    return out


def leaks(docs, items, size):
    """[(n_words, n_hit, sorted item ids as strings)] of document texts."""

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), sum(hit), sorted(found)))
    return out


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_of(w, exponent=3, least=24):
    """Every run of a list of words as (start, length, period), by start and period."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            first = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - first + q
            own = w[first : first + length]
            if length >= max(least, exponent * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((first, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = set()
    for start, length, period in runs:
        gone.update(range(start + period, start + length))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def audits(rows, marked, orders):
    """{(part, order, step): counts} of (part, set of failed filters, set of marks) rows."""
    out, total = {}, {}
    for part in {p for p, _, _ in rows}:
        for order in orders:
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                mine = [r for r in left if f in r[1]]
                fail = [r for r in rows if r[0] == part and f in r[1]]
                kept = [r for r in left if f not in r[1]]
                total[part, f] = total.get((part, f), 0) + len(mine)
                out[part, "".join(order), step] = (len(kept), len(mine), len(fail) - len(mine), sum(r[1] == {f} for r in fail), *[sum(m in r[2] for r in mine) for m in marked])
                left = kept
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}
