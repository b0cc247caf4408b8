"""Plain Python versions of the corpus operators, for small inputs."""

import collections
import hashlib
import math
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, n=5):
    words = SPACE.findall((text or "").translate(LOW))
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def components(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in nodes}


def near_duplicates(docs, percent=85):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    found = components(ids, links)
    return {i: (len(sets[i]), found[i], found[i] == i) for i in ids}


def near_vectors(rows, threshold=0.98):
    ok = {}
    for i, label, v in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = (label, v)
    links = []
    for a, (la, va) in ok.items():
        for b, (lb, vb) in ok.items():
            if a < b and la == lb and len(va) == len(vb):
                dot = math.fsum(x * y for x, y in zip(va, vb, strict=True))
                if dot / math.sqrt(math.fsum(x * x for x in va)) / math.sqrt(math.fsum(x * x for x in vb)) >= threshold:
                    links.append((a, b))
    count = collections.Counter(x for pair in links for x in pair)
    found = components([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], found[r[0]], found[r[0]] == r[0]) for r in rows}


def secrets(text):
    text = text or ""
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    told = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return tuple(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(told.encode()).hexdigest(), told


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    places = [(k, label) for label, p in phrases.items() for k in range(len(words)) if words[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def license_labels(text, templates, containment=0.8, window=64):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    found = set()
    for at in range(0, max(1, len(words) - window // 2), window // 2):
        block = set(words[at : at + window])
        for label, t in templates:
            tokens = set(t.split())
            if len(block & tokens) >= containment * len(tokens) - 1e-9:
                found.add(label)
    return found


def quality_votes(text):
    """Votes of the eight labellers on a text, spelt out."""
    text = text or ""
    words = SPACE.findall(text.translate(LOW))
    if not words:
        return (0,) * 8
    lines = [x for x in (y.strip(" \t\n\r\x0b\x0c") for y in text.split("\n")) if x]
    low = sum("a" <= c <= "z" or "A" <= c <= "Z" or ord(c) > 127 for c in text)
    runs = [words[k : k + 512] for k in range(0, len(words), 512)]
    values = [
        low / len(text), sum("A" <= c <= "Z" for c in text) / max(1, low),
        sum(33 <= ord(c) < 127 and not c.isalnum() and c not in ".,;:!?'\"()-" for c in text) / len(text),
        (sum(len(set(r)) for r in runs) + 6.75) / (len(words) + 15),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1),
        len(set(lines)) / max(1, len(lines)), sum(x[-1] in ".!?" for x in lines) / max(1, len(lines)), len(text) / len(words),
    ]
    rules = [(0.74, 0.77, 0), (0.06, 0.25, 1), (0.006, 0.02, 1), (0.35, 0.55, 0), (0.02, 0.10, 1), (0.55, 0.80, 0), (0.60, 0.95, 0), (5.0, 8.0, 1)]
    return tuple((1 - f if v >= high else f if v <= low_ else 2) for v, (low_, high, f) in zip(values, rules, strict=True))


def label_posteriors(votes, rounds=200):
    """Expectation maximisation over single documents: the posterior of class 1 of each."""
    q = [min(0.95, max(0.05, (sum(x == 1 for x in v) - 3 * sum(x == 0 for x in v) + 3) / 6)) for v in votes]
    k = len(votes[0])
    for _ in range(rounds):
        table = []
        for c in (0, 1):
            own = [x if c else 1 - x for x in q]
            each = [[1 + sum(o for o, v in zip(own, votes, strict=True) if v[j] == vote) for vote in range(3)] for j in range(k)]
            table.append([[x / sum(row) for x in row] for row in each])
        good = min(0.99, max(0.01, sum(q) / len(q)))
        new = []
        for v in votes:
            odds = math.log(good / (1 - good)) + sum(math.log(table[1][j][x]) - math.log(table[0][j][x]) for j, x in enumerate(v))
            new.append(1 / (1 + math.exp(-max(-40, min(40, odds)))))
        done = max(abs(a - b) for a, b in zip(new, q, strict=True)) < 1e-7
        if done:
            break
        q = new
    return new


def allocate(stock, budget, weights=None, epochs=1.0):
    """Budgets of leaves (tuples) by repeated passes: full subtrees first, then shares by weight."""
    weights = weights or {}

    def room(path):
        return epochs * sum(t for leaf, t in stock.items() if leaf[: len(path)] == path)

    out = {}

    def down(path, given):
        below = sorted({leaf[: len(path) + 1] for leaf in stock if leaf[: len(path)] == path and len(leaf) > len(path)}, key=str)
        if not below:
            out[path] = given
            return
        got = {c: 0.0 for c in below}
        for positive in (True, False):
            open_ = [c for c in below if (weights.get(c, 1.0) > 0) == positive]
            left = given - sum(got.values())
            while open_ and left > 1e-9:
                unit = left / sum(max(weights.get(c, 1.0), 0.0) or 1.0 for c in open_)
                full = [c for c in open_ if room(c) <= unit * (max(weights.get(c, 1.0), 0.0) or 1.0)]
                for c in full or open_:
                    got[c] = room(c) if full else unit * (max(weights.get(c, 1.0), 0.0) or 1.0)
                if not full:
                    break
                open_ = [c for c in open_ if c not in full]
                left = given - sum(got.values())
        for c in below:
            down(c, got[c])

    if stock:
        down((), min(budget, room(())))
    return out


def mixture(rows, budget, weights, epochs, order):
    """Copies of each row: ``rows`` has (key, leaf, tokens), ``order(key, full)`` its place in an epoch."""
    stock = {}
    for _, leaf, tokens in rows:
        stock[leaf] = stock.get(leaf, 0) + tokens
    gets = allocate({k: float(v) for k, v in stock.items()}, budget, weights, epochs)
    out = [0] * len(rows)
    for leaf, have in stock.items():
        full = int((gets[leaf] + 1e-6) // have) if have else 0
        rest = gets[leaf] - full * have
        own = {}
        for n, (key, at, tokens) in enumerate(rows):
            if at == leaf:
                out[n] = full
                own.setdefault(order(key, full), []).append((n, tokens))
        took = 0
        for place in sorted(own):
            size = sum(t for _, t in own[place])
            if rest <= 1e-6 or took + size > rest + 1e-6:
                break
            took += size
            for n, _ in own[place]:
                out[n] += 1
    return out


def minimax(sizes, shards):
    """Smallest largest sum of contiguous parts."""
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        parts, own = 1, 0
        for s in sizes:
            if own + s > middle:
                parts, own = parts + 1, 0
            own += s
        low, high = (low, middle) if parts <= shards else (middle + 1, high)
    return low
