"""Run registered queries against their oracles: ``python tests/run_check.py [folder] [name part]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.compare import connect, difference  # noqa: E402
from vintara.plans import catalog  # noqa: E402
from vintara.session import local_session  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    spark = local_session()
    con, oracle, bad = connect(folder), catalog.oracle_sql(), 0
    for name, query in catalog.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            frame = query(spark, folder)
            if name in oracle:
                problem = difference(frame, con, oracle[name])
                count = con.execute(f"SELECT count(*) FROM ({oracle[name]})").fetchone()[0]
            else:
                rows, problem = frame.collect(), None
                count = f"{len(rows)} rows only, first {rows[:1]}"
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:900]}", "-"
            if "-v" in parts:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32} {time.time() - begin:6.2f}s {count}", flush=True)
        if problem:
            print("    ", problem[:1500], flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
