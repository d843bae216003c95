"""Brute-force definitions to compare with."""


def dominates(q, p):
    return all(a <= b for a, b in zip(q, p)) and any(a < b for a, b in zip(q, p))


def skyline(points):
    points = list(points)
    return sorted(p for p in points if not any(dominates(q, p) for q in points))


def rows(df):
    return sorted(tuple(r) for r in df.collect())
