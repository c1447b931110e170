"""Helpers of the test modules; not in a conftest, of which there are two."""


def collected(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())
