"""``python -m millrace``: lists the queries, or runs one and writes its rows as Parquet or shows some of them.

Each run logs its events as JSON lines on standard error: what began, what ended, and how long it took.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from millrace.plans import catalogue


def log(event: str, **told) -> None:
    print(json.dumps({"at": round(time.time(), 3), "event": event, **told}), file=sys.stderr, flush=True)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description="Runs the core's queries over a folder of tables.")
    parser.add_argument("query", nargs="?", help="the query's name; without one, the names are listed")
    parser.add_argument("--folder", help="the folder of the tables")
    parser.add_argument("--out", help="where to write the rows as Parquet; without it, some are shown")
    parser.add_argument("--master", help="the cluster's master, if spark-submit does not name it")
    parser.add_argument("--no-log", action="store_true", help="log no events")
    args = parser.parse_args(arguments)
    queries = catalogue.queries()
    if args.query is None:
        print("\n".join(sorted(queries)))
        return 0
    if args.query not in queries or not args.folder:
        parser.error("a known query and --folder are needed")
    from millrace.session import get_session

    told = (lambda *_, **__: None) if args.no_log else log
    spark = get_session(master=args.master)
    began = time.time()
    told("began", query=args.query, folder=args.folder)
    rows = queries[args.query](spark, args.folder)
    if args.out:
        rows.write.mode("overwrite").parquet(args.out)
    else:
        rows.show()
    told("ended", query=args.query, seconds=round(time.time() - began, 3))
    return 0


if __name__ == "__main__":
    sys.exit(main())
