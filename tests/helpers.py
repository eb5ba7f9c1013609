import datetime as dt
import math


def value(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return "null" if isinstance(x, float) and math.isnan(x) else repr(round(float(x), 8) + 0.0)
    if isinstance(x, dt.datetime):
        return x.isoformat()
    return str(x)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)
