"""Small, obviously-correct reference implementations used only by the tests."""

import numpy as np


def standardise(X):
    mean = X.mean(axis=0)
    std = X.std(axis=0)
    const = X.max(axis=0) == X.min(axis=0)
    Z = np.where(const, 0.0, (X - mean) / np.where(const, 1.0, std))
    return Z


def sequential_dbscan(X, eps, min_samples):
    """Rows visited in lexsort order (last column primary); clusters grown by expansion;
    a border point keeps the first cluster that reaches it."""
    X = np.asarray(X, dtype=float)
    order = np.lexsort([X[:, i] for i in range(X.shape[1])])
    Z = standardise(X)[order]
    d2 = ((Z[:, None, :] - Z[None, :, :]) ** 2).sum(-1)
    nbr = d2 <= eps * eps
    core = nbr.sum(1) >= min_samples
    labels = np.full(len(Z), -1)
    current = 0
    for i in range(len(Z)):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i] = current
        stack = [i]
        while stack:
            p = stack.pop()
            for q in np.nonzero(nbr[p])[0]:
                if labels[q] == -1:
                    labels[q] = current
                    if core[q]:
                        stack.append(q)
        current += 1
    out = np.empty_like(labels)
    out[order] = labels
    return out, core[np.argsort(order)], nbr.sum(1)[np.argsort(order)]


def union_find_components(n, edges):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    roots = {}
    for v in range(n):
        r = find(v)
        roots.setdefault(r, []).append(v)
    return {v: min(members) for members in roots.values() for v in members}
