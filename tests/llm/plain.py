"""Plain versions of what the operators compute, and rows that are hard on them."""

import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Rows with nulls, empty texts, ties, repeated rows and odd characters.
HARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \t\n \x0b", "en", "a", 5),
    (4, "one", "en", "", 3),
    (5, "one", "en", "b", 3),
    (5, "one", "en", "b", 3),
    (None, "a row without an id, nor much else", "en", "b", 34),
    (None, "a row without an id, nor much else", "en", "b", 34),
    (7, "éÉß ÀZ 中文 😀  x", None, "ü", 12),
    (8, "long " * 3000, "en", "z", 15000),
    (9, "\n".join(["the same old line again and again"] * 5), "en", "z", 169),
]


def with_more_columns(df):
    """The rows with columns whose names operators use themselves."""
    names = ["row", "score", "version", "id", "size", "n", "key", "label", "gone", "taken", "h1", "part"]
    for name in names:
        df = df.selectExpr("*", f"'{name}' AS {name}")
    return df


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingle_set(text, n):
    w = blank_words(text)
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


class Groups:
    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def jaccard_groups(texts, n, percent):
    """{id: (set size, smallest id reachable)} by counting shared shingles of all pairs."""
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    groups, seen = Groups(texts), defaultdict(list)
    for a in sorted(texts):
        shared = Counter(b for g in sets[a] for b in seen[g])
        for b, k in shared.items():
            if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                groups.join(a, b)
        for g in sets[a]:
            seen[g].append(a)
    return {i: (len(sets[i]), groups.find(i)) for i in texts}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def contamination(texts, items, window=13):
    """{id: (n_words, n_hit, sorted items)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k : k + size])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in texts.items():
        w, hit, names = alnum_words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    names |= found
        out[i] = (len(w), len(hit), sorted(names))
    return out
