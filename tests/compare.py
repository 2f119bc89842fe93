"""Results of two engines as sorted rows of comparable values."""

import math


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}" if abs(v) < 1e6 else f"{float(v):.12g}"
    if hasattr(v, "isoformat"):
        return str(v)[:19].removesuffix(" 00:00:00")
    if isinstance(v, (list, tuple)):
        return str([value(x) for x in v])
    return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(value(r[k]) for k in order) for r in records)


def same(frame, relation):
    assert sorted(frame.columns) == sorted(relation.columns)
    a, b = rows(frame.columns, [tuple(r) for r in frame.collect()]), rows(relation.columns, relation.fetchall())
    assert len(a) == len(b)
    different = [x for x in zip(a, b) if x[0] != x[1]]
    assert not different, different[:3]
