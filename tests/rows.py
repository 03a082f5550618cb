"""Comparison of result rows."""


def rows_of(df):
    """Rows as sorted tuples, in column order."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))
