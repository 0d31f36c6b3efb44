"""Plain versions of the operators' contracts, and small tables with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = words(fold(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def jaccard_classes(rows, percent=80):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeated_bytes(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, b in texts:
        for p in range(len(b) - window + 1):
            seen[b[p : p + window]] = seen.get(b[p : p + window], 0) + 1
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def earlier_words(rows, window):
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        gone = bytearray(len(w))
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < d:
                gone[p : p + window] = b"\1" * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def line_heads(rows, distance, min_chars):
    """Per line that is not blank: (doc_id, line) -> place of the first line of its class."""
    found = {}
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if s := line.strip(" \t\n\v\f\r"):
                found[d, n] = s
    texts = sorted(set(found.values()))
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {t: 0 for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= distance and edit_distance(a, b) <= distance:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    head = {}
    for p in sorted(found):
        head.setdefault(find(found[p]), p)
    return {p: (head[find(s)], links[s]) for p, s in found.items()}


def corpus(n=60, seed=5, vocabulary=400):
    """Documents with exact and near copies, shared passages and lines, edge cases."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ漢") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, common = line(70), line(9)
    out = []
    for i in range(n):
        kind = i % 10
        if kind < 4 or not out:
            t = "\n".join(line(r.randint(3, 30)) for _ in range(r.randint(1, 8)))
        elif kind == 4:
            t = r.choice(out)
        elif kind in (5, 6):
            w = r.choice(out).split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif kind == 7:
            t = line(r.randint(0, 30)) + "\n" + passage + "\n" + line(r.randint(1, 30))
        elif kind == 8:
            t = (line(12) + " ") * r.randint(2, 12)
        else:
            c = list(r.choice(out) or "x")
            for _ in range(2):
                c[r.randrange(len(c))] = r.choice("abc")
            t = "".join(c) + "\n" + common
        out.append(t)
    out += ["", None, " \t\n", "one", "One", "a b c d", "A B C D", "a b c d e f", "x" * 3000, "x" * 1200, common, common + " ", "\n\n" + common.upper()]
    return [(10 + 3 * i, t) for i, t in enumerate(out)]


def _sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(rows):
    """Rows of (doc_id, text, source, lang, n_chars) -> sorted result rows."""
    import zlib

    def leaf(d, t, s, g, n):
        return _sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, g, n, t))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([_sha(levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            yield i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None
            i >>= 1

    by = {}
    for d, t, s, g, n in rows:
        up = n if n is None or d is None or zlib.crc32(str(d).encode()) % 7 else n + 1
        by.setdefault((g is not None, (g or "").encode()), []).append((d is not None, d or 0, leaf(d, t, s, g, n), leaf(d, t, s, g, up), d))
    trees = {}
    for g in sorted(by):
        by[g].sort(key=lambda x: x[:3])
        trees[g] = tree([x[2] for x in by[g]])
    over = tree([trees[g][-1][0] for g in sorted(by)]) if by else []
    out = []
    for k, g in enumerate(sorted(by)):
        for i, (_, _, own, bad, d) in enumerate(by[g]):
            steps = [*path(trees[g], i), *path(over, k)]
            node = bad
            for right, other in steps:
                node = _sha([node] if other is None else [other, node] if right else [node, other])
            root = over[-1][0]
            out.append((d, own, trees[g][-1][0], root, _sha(o for _, o in steps if o), node, node == root))
    return sorted(out, key=str)


def cheapest_edits(rows):
    """(cost, audit, lines) for rows of (role, text, fault), by Dijkstra over (cost, audit)."""
    import heapq

    def after(q, c):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, c))

    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, lines
        if (i, q) in done:
            continue
        done.add((i, q))
        for c, name in (("u", "user"), ("a", "assistant")):
            if after(q, c):
                heapq.heappush(heap, (cost + 3, audit + "I", i, after(q, c), (*lines, name + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, lines))
            if fault not in ("b", "d"):
                more = 3 * (fault == "t")
                if after(q, role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, after(q, role[:1]), (*lines, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if after(q, c):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, after(q, c), (*lines, f"{name}:{text}")))


def repaired_conversations(table):
    """Rows of (conv_id, turn, role, text) -> sorted result rows."""
    import zlib

    by = {c: [] for c, *_ in table}
    for c, t, role, text in table:
        show = [" " if v is None else v for v in (c, t, role, text)]
        kind = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = show[2], show[3]
        row = (t is not None, t or 0, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        by[c] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, rows in by.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, faulty = set(), []
        for _, _, role, text in rows:
            last = re.sub("[\x20\x09-\x0d]+$", "", text)
            fault = "b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else "."
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for known, t, *_ in rows if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(f == k for *_, f in faulty) for k in "bdt"]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, lines = cheapest_edits(faulty)
        out.append((c, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)
