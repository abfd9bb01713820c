"""Plain versions of operators, for tests: no sharing of code with what they test."""

import re
from collections import Counter, defaultdict


def near_components(rows, width, percent):
    """doc_id to (set size, smallest doc_id that links reach). rows: doc_id, text; ids that are None have no component."""
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i].append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = [(i, s) for i in root for s in sets[i] if s]
    for n, (a, x) in enumerate(own):
        for b, y in own[:n]:
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: ([len(s) for s in sets[i]], find(i)) for i in root}


def line_dedup(rows):
    """text to (text without the lines of recurring templates, lines, dropped lines)."""
    texts = {t for t in rows if t is not None}
    form = lambda line: re.sub(r"\S*[0-9@]\S*|https?:\S+", "<*>", re.sub("[ \t-\r]+", " ", line).strip(" "))
    lines = {t: [form(x) for x in t.split("\n")] for t in texts}
    holders = defaultdict(set)
    for t, own in lines.items():
        for f in own:
            if f:
                holders[f].add(t)
    total = sum(any(own) for own in lines.values())

    def enough(n, fixed, least=None):
        return n >= (least or (3 if fixed >= 20 else 5)) and (fixed >= 3 or n * 200 >= total)

    template, fixed = {}, {}
    rest = defaultdict(list)
    for f, docs in holders.items():
        tokens = f.split(" ")
        count = len(tokens) - f.count("<*>")
        if enough(len(docs), count):
            template[f], fixed[f] = f, count
        elif len(tokens) > 2:
            rest[len(tokens), *tokens[:2]].append(f)
    for leaf, forms in rest.items():
        weight = sum(len(holders[f]) for f in forms)
        if weight < 5:
            continue
        stays = {}
        for at in range(leaf[0]):
            shown = Counter()
            for f in forms:
                shown[f.split(" ")[at]] += len(holders[f])
            token, n = shown.most_common(1)[0]
            if 2 * n > weight:
                stays[at] = token
        count = sum(t != "<*>" for t in stays.values())
        own = [f for f in forms if all(f.split(" ")[at] == t for at, t in stays.items())]
        if 2 * count >= leaf[0] and enough(sum(len(holders[f]) for f in own), count, 5):
            for f in own:
                template[f], fixed[leaf] = leaf, min(count, 19)
    size = lambda f: len(f.split(" "))
    plain = {t for t, own in lines.items() if 10 * sum(size(f) for f in own if f in template) < 6 * sum(size(f) for f in own if f)}
    evidence = defaultdict(set)
    for t in plain:
        for f in lines[t]:
            if f in template:
                evidence[template[f]].add(t)
    gone = {k for k, docs in evidence.items() if enough(len(docs), fixed[k])}
    out = {}
    for t, own in lines.items():
        kept = [x for x, f in zip(t.split("\n"), own, strict=True) if template.get(f) not in gone]
        out[t] = ("\n".join(kept), len(own), len(own) - len(kept))
    return out
