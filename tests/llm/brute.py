"""Plain-Python versions that the operators are held against."""

import hashlib
import re
import string

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def shingles(text, k=5):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_components(docs):
    """{id: (set size, smallest id reachable)} of [(id, text)] with unique ids."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def cut_passages(docs, window=13):
    """[(words, removed, kept bytes)] in input order of [(id, text)]."""
    words = [(i, (t or "").encode().split()) for i, t in docs]
    owner = {}
    for i, w in words:
        for k in range(len(w) - window + 1) if i is not None else ():
            g = tuple(w[k : k + window])
            owner[g] = min(owner.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if owner[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def digest(kept):
    return hashlib.sha256(kept).hexdigest()


def contaminated(text, items, span=13, allowed=2, shortest=5):
    """Ids of the items of which a window of ``span`` words stands in ``text`` with few substitutions."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    words, found = split(text), set()
    for i, item in items:
        w = split(item)
        if len(w) < span:
            if len(w) >= shortest and any(words[s : s + len(w)] == w for s in range(len(words))):
                found.add(i)
            continue
        for p in range(len(w) - span + 1):
            for s in range(len(words) - span + 1):
                if sum(a != b for a, b in zip(w[p : p + span], words[s : s + span])) <= allowed:
                    found.add(i)
    return found
