"""Density clustering by brute force: all pairs, a sorted edge list, a dendrogram cut from the top."""

import numpy as np


def tree_edges(x, min_samples):
    """The spanning tree's edges (w, lower, higher) by Kruskal over all pairs, in order."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min(min_samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    group, out = list(range(n)), []
    for w, a, b in sorted((reach[a, b], a, b) for a in range(n) for b in range(a + 1, n)):
        if group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
            out.append((w, a, b))
    return out


def labels(x, min_cluster, min_samples, method="eom", epsilon=0.0, max_cluster=0):
    """(labels, probabilities)."""
    n = len(x)
    label, prob = np.full(n, -1), np.zeros(n)
    if n < max(2, min_cluster):
        return label, prob
    edges = tree_edges(x, min_samples)

    def parts(members, upto):
        """The two sides of a set of points when its tree loses its last edge."""
        near = {p: set() for p in members}
        for _, a, b in edges[:upto]:
            if a in near and b in near:
                near[a].add(b)
                near[b].add(a)
        seen, todo = {members[0]}, [members[0]]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        return sorted(seen), sorted(set(members) - seen)

    tops = []
    clusters = []  # birth, parent, members, points that fell and when

    def walk(members, birth, parent):
        me = len(clusters)
        clusters.append({"birth": birth, "parent": parent, "size": len(members), "members": members, "falls": {}, "kids": []})
        if parent is not None:
            clusters[parent]["kids"].append(me)
        while True:
            inside = set(members)
            k = max(i for i, (_, a, b) in enumerate(edges) if a in inside and b in inside)
            rate = 1 / edges[k][0] if edges[k][0] > 0 else np.inf
            sides = parts(members, k)
            big = [s for s in sides if len(s) >= min_cluster]
            for s in sides:
                if len(s) < min_cluster:
                    clusters[me]["falls"] |= dict.fromkeys(s, rate)
                    tops.append(rate)
            if len(big) == 2:
                for s in big:
                    walk(s, rate, me)
                return
            if not big:
                return
            members = big[0]

    walk(list(range(n)), 0.0, None)
    top = max((r for r in tops if np.isfinite(r)), default=1.0)
    for c in clusters:
        c["birth"] = min(c["birth"], top)
        c["falls"] = {p: min(r, top) for p, r in c["falls"].items()}
    chosen, value = {}, {}
    for i in reversed(range(len(clusters))):
        c = clusters[i]
        own = sum(r - c["birth"] for r in c["falls"].values()) + sum((clusters[k]["birth"] - c["birth"]) * clusters[k]["size"] for k in c["kids"])
        below = sum(value[k] for k in c["kids"])
        chosen[i] = i > 0 and (not c["kids"] or (method == "eom" and own >= below - 1e-9 * (abs(below) + c["birth"] * c["size"]) and (not max_cluster or c["size"] <= max_cluster)))
        value[i] = own if chosen[i] else below

    def above(i):
        while (i := clusters[i]["parent"]) is not None:
            yield i

    final = {i for i in chosen if chosen[i] and not any(chosen[a] for a in above(i))}
    if epsilon:
        final = {next((a for a in (i, *above(i)) if clusters[a]["parent"] in (0, None) or clusters[a]["birth"] <= 1 / epsilon), i) for i in final}
        final = {i for i in final if not any(a in final for a in above(i))}
    for name, i in enumerate(sorted(final)):
        falls = {p: r for j in chosen if j == i or i in above(j) for p, r in clusters[j]["falls"].items()}
        for p, r in falls.items():
            label[p], prob[p] = name, r / (max(falls.values()) or 1.0)
    return label, prob
