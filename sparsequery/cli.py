"""Command line: convert, append, info, query, validate."""

from __future__ import annotations

import argparse
import re

from .dataset import Dataset
from .session import create_session
from .sources import ingest, layout
from .sources.readers import discover, read_any


def has_limit(sql: str) -> bool:
    """Whether the outermost statement ends with a LIMIT; text in strings, comments and sub-queries doesn't count."""
    s = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"", " ", sql, flags=re.S)
    while re.search(r"\([^()]*\)", s):
        s = re.sub(r"\([^()]*\)", " ", s)
    return bool(re.search(r"(?i)\blimit\s+(all|\d+)", s))


def limited(data: Dataset, sql: str, limit: int | None):
    df = data.sql(sql)
    return df if limit is None or has_limit(sql) else df.limit(limit)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparsequery")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"convert": ["source", "folder"], "append": ["source", "folder"], "info": ["folder"], "query": ["folder", "sql"], "validate": ["source"]}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name in ("convert", "append", "validate"):
            s.add_argument("--format", default="auto")
        if name == "query":
            s.add_argument("--limit", type=int, default=100)
            s.add_argument("--csv")
    a = p.parse_args(argv)
    spark = create_session()
    if a.command == "convert":
        print(ingest.convert(spark, a.source, a.folder, a.format).shape)
    elif a.command == "append":
        print(ingest.append(spark, a.source, a.folder, a.format).shape)
    elif a.command == "info":
        print(layout.load_config(spark, a.folder).dump())
    elif a.command == "validate":
        paths, fmt = discover(a.source)
        ingest.validate([read_any(spark, x, fmt) for x in paths])
        print(f"{len(paths)} inputs fit together")
    else:
        out = limited(Dataset.open(spark, a.folder), a.sql, a.limit)
        if a.csv:
            out.toPandas().to_csv(a.csv, index=False)
        else:
            out.show(a.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
