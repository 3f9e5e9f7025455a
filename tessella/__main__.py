"""Run a named query: ``python -m tessella NAME DIR [--out PATH | --stream]``; without arguments, list the names."""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tessella.plans.queries import QUERIES
from tessella.session import session


def stream_rows(df: DataFrame) -> Iterator[str]:
    """All rows as JSON lines, a partition at a time."""
    for row in df.toLocalIterator():
        yield json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    parser.add_argument("name", nargs="?", choices=sorted(QUERIES))
    parser.add_argument("dir", nargs="?", help="folder of the tables")
    parser.add_argument("--out", help="write Parquet here instead of showing rows")
    parser.add_argument("--stream", action="store_true", help="print every row as a JSON line")
    parser.add_argument("--master", default="local[*]")
    given = parser.parse_args(args)
    if not given.name or not given.dir:
        print("\n".join(sorted(QUERIES)))
        return
    df = QUERIES[given.name](session(given.master), given.dir)
    if given.out:
        df.write.mode("overwrite").parquet(given.out)
    elif given.stream:
        for line in stream_rows(df):
            print(line)
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
