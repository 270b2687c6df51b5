"""Run registered queries against the oracle: python tests/check.py [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle

import __spark_entry__ as entry
from hitmill.session import local_session

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = local_session(cpus="8")
con = oracle.connect(sf_dir)
queries, sql = entry.queries(), entry.oracle_sql()
bad = 0
for name, query in queries.items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    started = time.time()
    try:
        df = query(spark, sf_dir)
        got = oracle.spark_table(df)
        seconds = time.time() - started
        if name not in sql:
            print(f"{name:28} rows-only rows={len(got[1])} {seconds:.2f}s")
            continue
        want = oracle.duck_table(con, sql[name])
        types = con.execute(f"DESCRIBE {sql[name]}").fetchall()
        spark_types = dict(df.dtypes)
        shown = {t[0]: (t[1], spark_types.get(t[0])) for t in types}
    except Exception as e:
        bad += 1
        print(f"{name:28} ERROR {type(e).__name__}: {str(e)[:600]}")
        continue
    same = got == want
    bad += not same
    print(f"{name:28} {'ok' if same else 'DIFF'} rows={len(got[1])}/{len(want[1])} {seconds:.2f}s")
    if not same:
        print("   names", got[0] == want[0], got[0], want[0])
        for g, w in list((g, w) for g, w in zip(got[1], want[1]) if g != w)[:4]:
            print("   spark", g)
            print("   duck ", w)
    odd = {k: v for k, v in shown.items() if v[1] and (v[0].lower(), v[1]) not in {
        ("bigint", "bigint"), ("integer", "int"), ("smallint", "smallint"), ("varchar", "string"),
        ("double", "double"), ("date", "date"), ("boolean", "boolean"),
        ("timestamp", "timestamp_ntz"), ("varchar[]", "array<string>")}}
    if odd:
        print("   types", odd)
print("failures", bad)
