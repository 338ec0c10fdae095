"""Run every registered query against its SQL: ``python tests/check_all.py [folder] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from corpusloom.session import local_session  # noqa: E402
from tests.compare import connect, difference, rows_of_spark, rows_of_sql  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    con = connect(folder)
    sql = entry_module.oracle_sql()
    bad = 0
    for name, fn in entry_module.queries().items():
        if names and not any(n in name for n in names):
            continue
        try:
            t = time.time()
            got = rows_of_spark(fn(spark, folder))
            spent = time.time() - t
            if name not in sql:
                print(f"rows {name} {len(got[1])} {spent:.1f}s", flush=True)
                continue
            t = time.time()
            problem = difference(got, rows_of_sql(con, sql[name]))
            print(f"{'ok' if problem is None else 'DIFF'} {name} {len(got[1])} spark {spent:.1f}s sql {time.time() - t:.1f}s", flush=True)
            if problem:
                bad += 1
                print("  " + problem, flush=True)
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: {str(exc)[:1500]}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
