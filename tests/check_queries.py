"""python -m tests.check_queries [--sf DIR] [name prefix ...]: compare queries with their oracles."""

from __future__ import annotations

import argparse
import time
import traceback

from tests.oracle import compare, connect
from tests.sessions import local_session


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = local_session()
    import __spark_entry__ as entry

    oracles = entry.oracle_sql()
    connection = connect(options.sf)
    failures = 0
    for name, query in entry.queries().items():
        if options.names and not any(name.startswith(p) for p in options.names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, query, oracles[name], options.sf, connection)
            else:
                rows = query(spark, options.sf).collect()
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001 - the report names every failure
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
            if options.names:
                traceback.print_exc()
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}"
              + ("" if name in oracles else " (rows only)"), flush=True)
    print("failures:", failures)
    return 1 if failures else 0


if __name__ == "__main__":
    raise SystemExit(main())
