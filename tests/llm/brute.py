"""The contracts in plain Python, for small inputs."""

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near(docs, size=5, share=75):
    sets = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def lines(docs, least_length=20, least_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, text in docs:
        parts = (text or "").split("\n")
        kept = [x for x in parts if not (len(key(x)) >= least_length and len(holders[key(x)]) >= least_docs and max(holders[key(x)]) != i)]
        out[i] = len(parts), len(parts) - len(kept), sha("\n".join(kept))
    return out


def passages(docs, window=50):
    words = {i: WORD.findall(text or "") for i, text in docs}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, w in words.items():
        hit = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                hit.update(range(s, s + window))
        out[i] = len(w), len(hit), sha(" ".join(x for k, x in enumerate(w) if k not in hit))
    return out


def contamination(docs, items, window=10):
    words = lambda text: LETTERS.findall((text or "").translate(LOWER))
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), []
        for item, other in items:
            b = words(other)
            n = min(len(b), window)
            runs = {tuple(b[s : s + n]) for s in range(len(b) - n + 1)} if n else set()
            at = [s for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in runs]
            hit.update(k for s in at for k in range(s, s + n))
            if at:
                found.append(str(item))
        out[i] = len(w), len(hit), sorted(found)
    return out


def jump(key, shards):
    at, there, step = 0, 0, 0
    while there < shards:
        at, step = there, step + 1
        there = int((at + 1) * 2.0**32 / (int(hashlib.md5(f"{key}:{step}".encode()).hexdigest()[:8], 16) + 1))
    return at


def crc(data):
    return zlib.crc32(data)


def cheapest_edits(rows):
    """rows: (initial, fault). Cost and audit by going through all edits from the last row to the first, up to two inserts at a place."""
    best = lambda ways: min(ways, key=lambda w: (w[0], w[1]))
    final = {"": (0, ""), "a": (0, ""), "u": (5, "I"), "s": (10, "II")}
    for initial, fault in reversed(rows):
        own = {}
        for state in ("", "s", "u", "a"):
            ways = [(2 + final[state][0], "D" + final[state][1])]
            after = "a" if state == "u" else "u"
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                if initial == after or initial == "s" and state == "":
                    ways.append((more + final[initial][0], "K" + final[initial][1]))
                ways.append((more + 1 + final[after][0], "R" + final[after][1]))
            own[state] = best(ways)
        final = {}
        for state in own:
            after = "a" if state == "u" else "u"
            then = "u" if after == "a" else "a"
            final[state] = best([own[state], (5 + own[after][0], "I" + own[after][1]), (10 + own[then][0], "II" + own[then][1])])
    return final[""]


def conversation(rows):
    """rows: (turn, role, text) of one conversation, damaged. The columns of op13 behind conv_id, and what is left."""
    strip = lambda t: t.strip(" \t\n\x0b\x0c\r")
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append("blank" if not strip(text) else "duplicate" if (role, text) in seen else "truncated" if strip(text)[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest_edits(list(zip(initials, faults, strict=True)))
    left, at, last = [], 0, ""
    for edit in audit:
        _, role, text = ("", "", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit != "D":
            role = role if edit == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            left.append((edit, role, text))
    assert at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in left))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for _, r, t in left))), left
