"""Compare registered queries with their SQL by hand: run_oracles.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog import ORACLES, QUERIES  # noqa: E402
from nearfold.session import build_session  # noqa: E402
from tests.oracle import compare  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "oracles", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, QUERIES[name], ORACLES[name], sf_dir)
                note = "equal" if problem is None else "DIFF " + problem
            else:
                note = f"no SQL, {len(QUERIES[name](spark, sf_dir).collect())} rows"
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {note}", flush=True)
