"""Compare registered queries with their oracles: python check.py [name-prefix ...]"""
import os
import sys
import time

from tests.oracle import compare, connect
from wattloom.plans import ORACLE, QUERIES
from wattloom.session import session


def main(prefixes):
    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                          "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name, f in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = f(spark, folder)
            note = compare(df, con, ORACLE[name]) if name in ORACLE else f"rows-only {df.count()}"
        except Exception as e:  # report and go on
            note = "ERROR " + str(e).split("JVM stacktrace")[0][:900]
        ok = note == "" or note.startswith("rows-only")
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t0:5.1f}s {name} {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
