"""Compare registered queries with their oracle SQL: names, types and values."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
KINDS = {"boolean": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.5f}"
    return "NULL" if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, folder):
    """None when equal, else a short description."""
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got or df.columns else "no columns"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    wrong = [(c, t, kinds[c]) for c, t in df.dtypes if KINDS.get(t) != kinds[c]]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:2]
        only_b = [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} <> {len(b)}; spark only {only_a}; sql only {only_b}"
    if wrong:
        return f"types {wrong}"
    return None if a else "EMPTY"


def main(folder, wanted):
    from sentrylake.session import build_session

    import __spark_entry__ as entry

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name == x or (x.endswith("*") and name.startswith(x[:-1])) for x in wanted):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, name, query, oracles.get(name), folder)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print("problems:", bad, "queries:", len(queries), "with sql:", len(oracles))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
