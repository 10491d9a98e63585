"""Run a registered query and its SQL side by side and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _plain(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() else value)
    if isinstance(value, decimal.Decimal):
        return _plain(float(value)) if value != value.to_integral_value() else int(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    """``(ok, message)`` for one query."""
    start = time.time()
    frame = fn(spark, sf_dir)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {len(got[1])} rows {took:.1f}s"
    cursor = con.execute(sql)
    want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, f"row count {len(got[1])} != {len(want[1])}; sample {got[1][:2]} / {want[1][:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ of {len(got[1])}, cols {got[0]}: {bad[:2]}"
    return True, f"{len(got[1])} rows {took:.1f}s"


if __name__ == "__main__":
    from tokenloom.catalog import load
    from tokenloom.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    if os.environ.get("BLOCK_ROWS"):
        session.conf.set("tokenloom.scan.blockRows", os.environ["BLOCK_ROWS"])
    registry = load()
    names = sys.argv[1:] or list(registry.QUERIES)
    names = [n for n in registry.QUERIES if any(n == p or n.startswith(p.rstrip("*")) and p.endswith("*") for p in names)]
    con = duck(sf)
    failed = 0
    for name in names:
        try:
            ok, message = compare(session, con, sf, registry.QUERIES[name], registry.ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name, message, flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
