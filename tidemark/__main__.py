"""Command line: ``python -m tidemark ingest ...`` / ``python -m tidemark ingest-url ...``.

Exit codes: 0 loaded or skipped, 2 the table exists and ``--if-exists fail``,
1 any other error, a catalog that does not outlive the process included. Run it with spark-submit on a cluster; the session then
takes its master and resources from there.
"""

from __future__ import annotations

import argparse
import json
import sys

from tidemark.errors import TableExistsError
from tidemark.pipeline import POLICIES
from tidemark.sources.paths import DATASETS


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--database", default=None, help="catalog database (default: current)")
    common.add_argument("--if-exists", default="replace", choices=POLICIES)
    common.add_argument("--fail-on-outside-month", action="store_true")
    m = sub.add_parser("ingest", parents=[common], help="load one monthly file of a dataset")
    m.add_argument("--taxi", required=True, choices=DATASETS)
    m.add_argument("--year", required=True, type=int)
    m.add_argument("--month", required=True)
    m.add_argument("--file-format", default="parquet", choices=("parquet", "csv"))
    m.add_argument("--base", required=True, help="folder holding <taxi>/<taxi>_tripdata_<yyyy>-<mm>.<ext>")
    u = sub.add_parser("ingest-url", parents=[common], help="load one file (or folder) by path")
    u.add_argument("--url", required=True)
    u.add_argument("--table-name", default=None)
    u.add_argument("--format", default=None, choices=("csv", "tsv", "parquet"),
                   help="needed when the path has no data-file suffix (e.g. a folder)")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from tidemark.pipeline import ingest, ingest_month
    from tidemark.session import build_session, has_persistent_catalog

    spark = build_session()
    if not has_persistent_catalog(spark):
        print("ingest failed: this session's catalog ends with the process, so the table would be lost; configure a "
              "persistent one (spark.sql.catalogImplementation=hive, or a catalog plugin)", file=sys.stderr)
        return 1
    kw = dict(database=args.database, if_exists=args.if_exists,
              fail_on_outside_month=args.fail_on_outside_month)
    try:
        if args.command == "ingest":
            m = ingest_month(spark, args.taxi, args.year, args.month, base=args.base, fmt=args.file_format, **kw)
        else:
            m = ingest(spark, args.url, args.table_name, fmt=args.format, **kw)
    except TableExistsError as e:
        print(f"table exists: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001 - any failure is exit code 1, published table untouched
        print(f"ingest failed: {type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print(json.dumps(m, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
