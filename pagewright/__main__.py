"""python -m pagewright PAGES OUT [--json] [--show N]: lay out pages, write blocks and sentences, show a sample."""

from __future__ import annotations

import argparse


def main() -> None:
    from .operators import layout, probe
    from .session import local_session
    from .sources import pages

    parser = argparse.ArgumentParser(prog="pagewright", description="Lay out pages: blocks and sentences as Parquet.")
    parser.add_argument("pages", help="Parquet of pages, or a folder of JSON files, one page each")
    parser.add_argument("out")
    parser.add_argument("--json", action="store_true", help="pages are JSON files")
    parser.add_argument("--first", type=int, default=1, help="first page")
    parser.add_argument("--last", type=int, default=2**31 - 1, help="last page")
    parser.add_argument("--show", type=int, default=0, help="print so many sentences, chosen by hash")
    args = parser.parse_args()
    spark = local_session()
    rows = pages.read_json_pages(spark, args.pages) if args.json else spark.read.parquet(args.pages)
    rows = rows.where(f"page between {args.first} and {args.last}")
    layout.blocks(rows).write.mode("overwrite").parquet(f"{args.out}/blocks")
    layout.sentences(rows).write.mode("overwrite").parquet(f"{args.out}/sentences")
    if args.show:
        probe.sample(spark.read.parquet(f"{args.out}/sentences"), "sent_id", args.show).select("paper_id", "sent_id", "role", "text").show(args.show, 100)
    spark.stop()


if __name__ == "__main__":
    main()
