"""Rows of a table as plain values that tests can compare."""

def rows(df, *columns):
    """Sorted plain tuples of the given columns, all by default."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
