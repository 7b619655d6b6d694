from datetime import datetime, timedelta

T0 = datetime(2020, 1, 31, 18)


def at(hours):
    return T0 + timedelta(hours=hours)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def column(df, name, *order):
    return [r[name] for r in (df.orderBy(*order) if order else df).select(name, *[o for o in order if o != name]).collect()]
