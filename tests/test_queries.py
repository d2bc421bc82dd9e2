"""Every query of the reference's operators against its SQL in DuckDB, on the tables at 0.01."""

import math
from pathlib import Path

import duckdb
import pytest

from regolith.plans import catalog

PATH = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(PATH).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    found = catalog.QUERIES[name](spark, PATH)
    names = sorted(found.columns)
    rows = in_order([tuple(r) for r in found.select(*names).collect()])
    assert rows
    if name not in catalog.SQL:
        return
    wanted = tables.execute(f"SELECT {', '.join(names)} FROM ({catalog.SQL[name]})")
    kinds = [str(d[1]) for d in wanted.description]
    wanted = in_order(wanted.fetchall())
    assert len(rows) == len(wanted)
    for a, b in zip(rows, wanted, strict=True):
        for n, x, y, kind in zip(names, a, b, kinds, strict=True):
            if isinstance(x, float):
                assert kind in ("DOUBLE", "NUMBER"), (n, kind)
                assert y is not None and math.isclose(x, float(y), rel_tol=1e-9, abs_tol=1e-9), (n, x, y, a, b)
            else:
                assert x == y, (n, x, y, a, b)
