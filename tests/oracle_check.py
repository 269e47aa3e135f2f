"""Run registered queries against their SQL oracles in DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            if math.isnan(v):
                return "nan"
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple("\0" if r[i] is None else cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and the oracle's; empty when equal."""
    out = []
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    kinds = [str(c[1]) for c in rel.description]
    theirs = rel.fetchall()
    mine = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    spark_types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    for n, k in zip(names, kinds):
        if spark_types[n] != k:
            out.append(f"type of {n}: {spark_types[n]} vs {k}")
    if len(mine) != len(theirs):
        out.append(f"rows {len(mine)} vs {len(theirs)}")
    if not mine:
        out.append("no rows")
    a, b = _rows(mine, df.columns), _rows(theirs, names)
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        bad = sum(x != y for x, y in zip(a, b))
        out.append(f"values differ in {bad} rows; {sorted(names)}\n   spark {only_a}\n   sql   {only_b}")
    return out


def main() -> None:
    sys.path.insert(0, ".")
    from hazegrid.catalog import load_all
    from hazegrid.session import build_session

    sf_dir = sys.argv[1]
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = load_all()
    wanted = sys.argv[2:] or list(queries)
    failed = 0
    for name in wanted:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        took = time.time() - started
        failed += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in oracles else "rows")
        print(f"{mark:5}{name:32}{took:6.1f}s", *problems, sep=" ", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")


if __name__ == "__main__":
    main()
