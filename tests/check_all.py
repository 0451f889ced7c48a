"""Compare every registered query with its SQL: python tests/check_all.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from sitesight.session import local_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    sql = entry.oracle_sql()
    bad = 0
    for name, q in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            if name in sql:
                problem = compare(q(spark, sf), con, sql[name])
                note = "same" if problem is None else f"DIFFERS {problem}"
            else:
                note = f"rows {len(q(spark, sf).collect())}"
        except Exception as e:  # noqa: BLE001
            note = f"FAILED {type(e).__name__} {str(e)[:600]}"
        bad += note.startswith(("DIFFERS", "FAILED"))
        print(f"{name:32s} {time.time() - t:6.2f}s {note}", flush=True)
    print("problems:", bad)
