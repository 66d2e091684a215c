import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import local_session

    s = local_session("tests", partitions=8)
    yield s
    s.stop()


def rows_of(columns, rows):
    """Rows as sorted strings, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v):
        if isinstance(v, float):
            return repr(v)
        if isinstance(v, (bytes, bytearray)):
            return bytes(v).hex()
        return str(v)

    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def duck(sql, sf=SF):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = c.execute(sql)
    return [x[0] for x in r.description], r.fetchall(), [str(x[1]) for x in r.description]


def against_oracle(df, sql, sf=SF):
    names, rows, _ = duck(sql, sf)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    want = rows_of(names, rows)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:3]
