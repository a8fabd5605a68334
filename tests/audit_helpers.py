"""Reading a validated row."""


def details(row):
    """Audit details of a row as plain tuples."""
    return [tuple(d) for d in row["__audit"]["__details"]]


def verdict(row):
    return row["__audit"]["__transformresult"]
