"""Brute-force versions of the rules on words, lines and near copies."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_kept(rows, min_docs=3):
    """The lines that each row (doc_id, text, ...) keeps."""
    norm = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    number = lambda i: i if i is not None else -1
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for k in {norm(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].add(number(i))
    last = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    return [[x for x in (t or "").split("\n") if last.get(norm(x), number(i)) == number(i)] for i, t, *_ in rows]


def kept_lines(rows):
    """The text that each document keeps, by doc_id."""
    return {i: "\n".join(k) for (i, *_), k in zip(rows, brute_kept(rows), strict=True)}


def brute_links(rows):
    sets = []
    for i, t, *_ in rows:
        w = words(t)
        n = min(5, len(w))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()))
    links, root = Counter(), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, least.get(find(a)), links[a]) for a, (i, _) in enumerate(sets)), key=repr)
