import pandas as pd


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    """Equal rows, in any order."""
    assert sorted(a.columns) == sorted(b.columns)
    k = sorted(a.columns)
    a, b = (x[k].sort_values(k, ignore_index=True) for x in (a, b))
    assert len(a) == len(b)
    for c in k:
        x, y = (v[c].astype(object).where(v[c].notna(), "~").astype(str) for v in (a, b))
        assert (x == y).all(), (c, a[x != y].head(3), b[x != y].head(3))
