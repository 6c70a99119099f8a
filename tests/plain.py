"""The graph rules in plain Python, for small graphs: what the DataFrame operators are compared with."""

from __future__ import annotations

import math
import re


def sentences(text):
    return re.split(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s", text)


def spans(text):
    out, at = [], 0
    for t in sentences(text):
        if len(t) >= 10:
            out.append((at, at + len(t)))
            at += len(t) + 1
    return out


def generated(comments, max_time=1000):
    """(src, tgt) -> weights of the default generators; comments are dicts in order, with ``n`` sentences each."""
    out = {}

    def put(a, b, kind, w):
        if w:
            out.setdefault((a, b), {})[kind] = w

    for i, x in enumerate(comments):
        for si in range(x["n"]):
            for sj in range(si + 1, x["n"]):
                if sj == si + 1:
                    put((i, si), (i, sj), "SAME_COMMENT", 1.0)
                put((i, si), (i, sj), "TEMPORAL", 1.0)
        for j in range(i + 1, len(comments)):
            y = comments[j]
            gap = x["ts"] - y["ts"] if x["ts"] > y["ts"] else math.trunc(y["ts"] - x["ts"])
            for si in range(x["n"]):
                for sj in range(y["n"]):
                    if si == sj == 0 and x["article"] == y["article"]:
                        put((i, 0), (j, 0), "SAME_ARTICLE", 1.0)
                    if si == sj == 0 and (x["reply"] == y["id"] or y["reply"] == x["id"]):
                        put((i, 0), (j, 0), "REPLY_TO", 1.0)
                    if gap < max_time:
                        put((i, si), (j, sj), "TEMPORAL", 1 - gap / max_time)
    return out


def pagerank(nodes, edges, d=0.85, iterations=100, tolerance=1e-6):
    n = len(nodes)
    out = {v: 0.0 for v in nodes}
    for a, _, w in edges:
        out[a] += w
    x = {v: 1 / n for v in nodes}
    for _ in range(iterations):
        leak = ((1 - d) * sum(x[v] for v in nodes if out[v]) + sum(x[v] for v in nodes if not out[v])) / n
        new = dict.fromkeys(nodes, leak)
        for a, b, w in edges:
            new[b] += d * x[a] * w / out[a]
        change = math.sqrt(sum((new[v] - x[v]) ** 2 for v in nodes))
        x = new
        if change <= tolerance:
            break
    total = sum(x.values())
    return {v: r / total for v, r in x.items()}


def merge_ids(nodes, edges):
    own, counter = {}, 0
    for a, b in edges:
        if a not in own and b not in own:
            own[a] = own[b] = counter
            counter += 1
        elif a not in own or b not in own:
            own[a] = own[b] = own.get(a, own.get(b))
        elif own[a] != own[b]:
            gone = own[b]
            own = {v: own[a] if c == gone else c for v, c in own.items()}
    alone = 0
    for v in nodes:
        if v not in own:
            alone -= 1
            own[v] = alone
    return own


def edge_top(nodes, edges, weight, k, descending=True):
    """(edges in order, weight by edge) -> edges kept, in their new order."""
    kept = {}
    for v in nodes:
        mine = sorted((e for e in edges if v in e), key=lambda e: weight(e) or 0.0, reverse=descending)
        for e in mine[:k]:
            kept.setdefault(e, None)
    return list(kept)


def components(nodes, edges):
    near = {v: set() for v in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, out = set(), []
    for v in nodes:
        if v not in seen:
            part, queue = {v}, [v]
            while queue:
                for w in near[queue.pop()]:
                    if w not in part:
                        part.add(w)
                        queue.append(w)
            seen |= part
            out.append(sorted(part))
    return out


def betweenness(nodes, edges):
    """Of each edge, over all pairs of nodes: the share of their shortest paths that use it."""
    near = {v: [] for v in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)

    def from_(s):
        level, count, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in level:
                    level[w], count[w] = level[v] + 1, 0
                    order.append(w)
                if level[w] == level[v] + 1:
                    count[w] += count[v]
        return level, count

    found = {v: from_(v) for v in nodes}
    out = {}
    for a, b in edges:
        total = 0.0
        for s in nodes:
            for t in nodes:
                if s < t and t in found[s][0]:
                    for x, y in ((a, b), (b, a)):
                        if x in found[s][0] and y in found[t][0] and found[s][0][x] + 1 + found[t][0][y] == found[s][0][t]:
                            total += found[s][1][x] * found[t][1][y] / found[s][1][t]
        out[a, b] = total
    return out


def girvan_newman(nodes, edges):
    edges, before = list(edges), len(components(nodes, edges))
    while edges:
        b = betweenness(nodes, edges)
        most = max(round(v, 9) for v in b.values())
        edges.remove(next(e for e in edges if round(b[e], 9) == most))
        now = components(nodes, edges)
        if len(now) > before:
            return sorted(now)
    return sorted(components(nodes, edges))


def modularity(nodes, edges, parts):
    m, of = len(edges), {v: k for k, p in enumerate(parts) for v in p}
    degree = {v: sum(v in e for e in edges) for v in nodes}
    inside = sum(of[a] == of[b] for a, b in edges)
    return inside / m - sum(sum(degree[v] for v in p) ** 2 for p in parts) / (4 * m * m)
