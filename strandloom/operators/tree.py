"""Neighbour joining (Saitou and Nei, 1987) of the distances within a group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from strandloom.runtime import ship


def neighbour_join(names: list[str], distance: dict[tuple[str, str], float]) -> str:
    """Newick text. Ties go to the pair of smallest names; missing distances count as 0; a single name is a tree by itself."""
    names = sorted(names)
    if len(names) < 2:
        return f"{names[0]};" if names else ";"
    d = {a: {b: distance.get((a, b), distance.get((b, a), 0.0)) for b in names if b != a} for a in names}
    text = {a: a for a in names}
    while len(d) > 2:
        n, total = len(d), {a: sum(row.values()) for a, row in d.items()}
        a, b = min(((a, b) for a in d for b in d[a] if a < b), key=lambda p: ((n - 2) * d[p[0]][p[1]] - total[p[0]] - total[p[1]], p))
        to_a = d[a][b] / 2 + (total[a] - total[b]) / (2 * (n - 2))
        joined = {c: (d[a][c] + d[b][c] - d[a][b]) / 2 for c in d if c not in (a, b)}
        node = min(a, b) + "+"
        while node in d:
            node += "+"
        text[node] = f"({text.pop(a)}:{to_a:.6f},{text.pop(b)}:{d[a][b] - to_a:.6f})"
        del d[a], d[b]
        for c, x in joined.items():
            d[c].pop(a)
            d[c].pop(b)
            d[c][node] = x
        d[node] = joined
    a, b = sorted(d)
    return f"({text[a]}:{d[a][b] / 2:.6f},{text[b]}:{d[a][b] / 2:.6f});"


def trees(distances: DataFrame, group: str = "cluster_id") -> DataFrame:
    """(group, n, newick) of rows (group, t1, t2, distance); null distances count as 0. A tree needs its whole matrix, so a group is one task's work."""
    ship(distances.sparkSession)

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["t1"]) | set(pdf["t2"]))
        found = {(a, b): x for a, b, x in zip(pdf["t1"], pdf["t2"], pdf["distance"].fillna(0.0), strict=True)}
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [len(names)], "newick": [neighbour_join(names, found)]})

    kind = dict(distances.dtypes)[group]
    return distances.groupBy(group).applyInPandas(tree, f"{group} {kind}, n long, newick string")
