import datetime as dt


def day(n: int) -> dt.date:
    """Day n of the test period; day 1 is Monday, 2024-01-01."""
    return dt.date(2024, 1, 1) + dt.timedelta(days=n - 1)


def at(n: int, hour: int = 12, minute: int = 0) -> dt.datetime:
    return dt.datetime.combine(day(n), dt.time(hour, minute))


def records(df, *order):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[c]) for c in (order or sorted(r))))
