"""python tests/check.py [sf_dir] [name ...]: compare registered queries with their SQL."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from blockloom.session import get_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = oracle.connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if args and name not in args:
            continue
        began = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                problem = oracle.compare(df, con, sqls[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                problem, note = None, f"rows only: {df.count()}"
        except Exception as error:
            problem = note = f"ERROR {type(error).__name__}: {str(error)[:1200]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - began:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
