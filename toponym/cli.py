"""python -m toponym.cli --root DIR import ARCHIVE [--activate] | update FOLDER | activate ID | list | prune [--keep N]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .sources.snapshot import newest_archive
from .sources.store import Store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="toponym")
    parser.add_argument("--root", required=True, help="folder of the versioned tables")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("import")
    p.add_argument("archive")
    p.add_argument("--activate", action="store_true")
    sub.add_parser("update").add_argument("folder")
    sub.add_parser("activate").add_argument("dataset_id", type=int)
    sub.add_parser("list")
    sub.add_parser("prune").add_argument("--keep", type=int, default=2)
    args = parser.parse_args(argv)
    store = Store(SparkSession.builder.getOrCreate(), args.root)
    try:
        if args.command == "import":
            print(store.import_archive(args.archive, args.activate))
        elif args.command == "update":
            print(store.import_archive(str(newest_archive(args.folder)), activate=True))
        elif args.command == "activate":
            store.activate(args.dataset_id)
        elif args.command == "list":
            for d in store.datasets():
                print(json.dumps(d, ensure_ascii=False))
        else:
            print(store.prune(args.keep))
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
