"""Compare registered queries with their SQL twins: python tests/check.py [sf] [name ...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(df, con, sql):
    """None if equal, else a short description."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = dict(zip(names, [str(d[1]) for d in cur.description]))
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for f in df.schema.fields:
        mine = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        theirs = {"NUMBER": "BIGINT", "STRING": "VARCHAR", "BOOL": "BOOLEAN"}.get(kinds[f.name], kinds[f.name])
        if mine != theirs:
            return f"type of {f.name}: {mine} != {theirs}"
    order = sorted(names)
    wanted = sorted((tuple(repr(r[names.index(c)]) for c in order) for r in cur.fetchall()))
    got = sorted(tuple(repr(r[c]) for c in order) for r in df.collect())
    if len(got) != len(wanted):
        return f"rows {len(got)} != {len(wanted)}"
    wrong = [(a, b) for a, b in zip(got, wanted) if a != b]
    return f"{len(wrong)} rows differ, first {order}: {str(wrong[0][0])[:1500]} <> {str(wrong[0][1])[:1500]}" if wrong else None


def main(argv):
    from leadloom.catalog import load
    from leadloom.session import build_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("check", master="local[8]", shuffle_partitions=8, spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    failed = []
    for name, e in load().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = e.build(spark, folder)
            problem = compare(df, con, e.sql) if e.sql else f"no SQL, {df.count()} rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        rows = con.execute(f"SELECT count(*) FROM ({e.sql})").fetchone()[0] if e.sql and not problem else ""
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - start:.1f}s {rows} {problem or ''}", flush=True)
        if problem and e.sql:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
