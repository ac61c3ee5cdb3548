"""python tests/run_oracles.py [SF_DIR] [NAME...]: compare registered queries with their SQL and print the time of each."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = ROOT


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from oracle import compare, connect
    from scholark.session import build_session

    spark = build_session("oracles", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, run in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                said = compare(df, con, oracles[name]) or f"equal, {df.count()} rows"
            else:
                said = f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            said = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += not said.startswith(("equal", "no SQL"))
        print(f"{name:32} {time.time() - began:6.1f}s {said}", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
