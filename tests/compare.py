"""Rows of a DataFrame against those of DuckDB."""

from __future__ import annotations

import math


def plain(value):
    """A value as both engines would show it."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value if isinstance(value, (int, str)) else str(value)


def same(df, relation) -> None:
    """Equal names, and equal rows in any order; numbers within 1e-9."""
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    # Whatever isn't a float comes first, so that the last digits of floats don't change the order.
    key = lambda row: (repr([x for x in row if not isinstance(x, float)]), [round(x, 6) for x in row if isinstance(x, float)])
    left = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    at = [relation.columns.index(c) for c in names]
    right = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) or isinstance(y, float):
                assert x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (a, b)
            else:
                assert x == y, (a, b)
