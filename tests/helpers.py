"""Helpers of the tests."""


def rows(df, *cols):
    """Collect as a list of dicts (optionally only some columns), sorted for stable checks."""
    out = [r.asDict(recursive=True) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(out, key=lambda d: repr(sorted(d.items(), key=lambda kv: kv[0])))


def one(df):
    got = df.collect()
    assert len(got) == 1, got
    return got[0].asDict(recursive=True)
