"""Run queries and their SQL side by side: python tests/compare.py [folder] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        name = f.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{f}{'/*' if os.path.isdir(f'{folder}/{f}') else ''}')")
    return con


def canon(rows):
    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "float64", "int64", "int32"):
            return f"{float(v):.6g}" if float(v) != int(float(v)) else str(int(float(v)))
        if hasattr(v, "tolist") or isinstance(v, (list, tuple)):
            return "[" + ",".join(one(x) for x in v) + "]"
        if hasattr(v, "asDict"):
            return one(list(v))
        if isinstance(v, dict):
            return one(list(v.values()))
        return str(v)

    return sorted("|".join(one(v) for v in r) for r in rows)


def compare(spark, con, folder, name, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = canon(tuple(r) for r in df.select(*[df[c] for c in cols]).collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = canon(tuple(r[i] for i in at) for r in res.fetchall())
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} rows against {len(want)}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from scriptorium.runtime import session

    folder, names = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:]
    spark = session(cores="8", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = views(folder)
    sql, bad = e.oracle_sql(), 0
    for name, q in e.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            said = compare(spark, con, folder, name, q, sql[name]) if name in sql else f"no SQL, {q(spark, folder).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(said) and not (said or "").startswith("no SQL")
        print(f"{'ok' if not said else said if said.startswith('no SQL') else 'BAD'} {name} {time.time() - t:.1f}s", "" if not said or said.startswith("no SQL") else said, flush=True)
    print("bad:", bad)
