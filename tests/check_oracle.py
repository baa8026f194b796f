"""Command line: python tests/check_oracle.py [sf_dir] [name …]; prints one line per query."""

import faulthandler
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from tests.harness import compare, duck  # noqa: E402
from txnrisk.session import local_session  # noqa: E402

if __name__ == "__main__":
    faulthandler.dump_traceback_later(int(os.environ.get("STALL", "900")), exit=True)  # a stalled run ends with its stacks
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session(), duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        start = time.time()
        try:
            if name in oracle:
                ok, message = compare(spark, con, sf_dir, queries[name], oracle[name])
            else:
                ok, message = True, f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as e:  # report and go on with the next query
            ok, message = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
