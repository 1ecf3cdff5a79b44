"""python tests/check.py [sf_dir] [name-prefix ...]: compare queries with their oracles."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, connect  # noqa: E402

from contrapunto.session import local_session  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
only = sys.argv[2:]
spark = local_session("8", 8, "check")
con = connect(folder)
bad = 0
queries, oracles = entry.queries(), entry.oracle_sql()
for name, fn in queries.items():
    if only and not any(name.startswith(p) for p in only):
        continue
    t = time.time()
    try:
        if name in oracles:
            problem = compare(con, name, fn(spark, folder), oracles[name])
        else:
            n = fn(spark, folder).count()
            problem = None if n >= 0 else "no rows"
            print(f"     {name}: {n} rows (no oracle)")
    except Exception as exc:  # noqa: BLE001
        problem = f"{name}: {type(exc).__name__} {str(exc)[:700]}"
    if problem:
        bad += 1
        print("BAD ", problem)
    else:
        print(f"ok   {name} {time.time() - t:.1f}s", flush=True)
print(f"{bad} bad of {len(queries)}")
