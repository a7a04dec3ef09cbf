"""Compare a query's rows with those of its SQL on DuckDB; also a command line check."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "\0"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    return str(value)


def _rows(table):
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table[n].to_pylist()] for n in names]
    return names, sorted(zip(*columns))


def _kind(arrow_type) -> str:
    text = str(arrow_type)
    return {"large_string": "string", "string_view": "string"}.get(text, text)


def differences(df, con, sql: str) -> list[str]:
    """What differs between Spark's and DuckDB's result; empty if nothing does."""
    left = df.toArrow()
    right = con.execute(sql).to_arrow_table()
    out = []
    (names, mine), (other_names, theirs) = _rows(left), _rows(right)
    if names != other_names:
        return [f"columns {names} != {other_names}"]
    for n in names:
        a, b = _kind(left.schema.field(n).type), _kind(right.schema.field(n).type)
        if a != b:
            out.append(f"type of {n}: {a} != {b}")
    if len(mine) != len(theirs):
        out.append(f"rows {len(mine)} != {len(theirs)}")
    odd = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if odd:
        out.append(f"{len(odd)} rows differ of {len(mine)}, first {odd[0][0]} != {odd[0][1]}")
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from rowloom.session import build_session

    sf, wanted = argv[1], argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted) and (wanted != ["sql"] or name not in sqls):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            if name in sqls:
                found = differences(df, con, sqls[name])
            else:
                found = [] if df.toArrow().num_rows else ["no rows"]
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        mark = "FAIL" if found else ("ok" if name in sqls else "rows")
        print(f"{mark:4} {time.time() - start:6.2f}s {name} {'; '.join(found)}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
