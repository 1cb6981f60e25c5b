"""Command line: ``python -m litmine <job> ...``; on a cluster use ``spark-submit`` with this file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from litmine.operators import graph
from litmine.plans import workflows
from litmine.sources import metadata, pajek


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="litmine")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *arguments: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        for argument in arguments:
            sub.add_argument(argument)
        return sub

    mine = job("mine", "archives", "out")
    mine.add_argument("--files", help="table of file metadata")
    mine.add_argument("--last-updated", help="mine only files updated since, yyyy-mm-dd")
    for name, reader in _CONVERTERS.items():
        job(name, "path", "out")
    job("label", "work", "files", "articles").add_argument("entries", nargs="+")
    for name in ("train", "predict", "merge"):
        job(name, "work")
    job("analyse", "work", "articles")
    job("convert-xml", "link_xml", "summary_xml", "out")
    build = job("build", "link_text", "summary_text", "out")
    build.add_argument("--years", type=int, nargs=2, default=(0, 0))
    job("cocite", "network", "out")
    job("clean", "network", "out").add_argument("--rounds", type=int, default=1, help="0: until nothing changes")
    job("summary", "network")
    measure = job("measure", "network", "out")
    measure.add_argument("--alpha", type=float, default=0.5)
    measure.add_argument("--betweenness", action="store_true")
    return parser


_CONVERTERS = {
    "articles": metadata.read_articles,
    "files": metadata.read_files,
    "current-entries": metadata.read_current_entries,
    "unreleased-entries": metadata.read_unreleased_entries,
    "obsolete-entries": metadata.read_header_entries,
    "external": metadata.read_external_mentions,
    "report": metadata.read_report,
}


def main() -> None:
    a = _parser().parse_args()
    spark = SparkSession.builder.appName(f"litmine {a.job}").getOrCreate()
    table = lambda path: metadata.read_table(spark, path)
    if a.job in _CONVERTERS:
        metadata.write_table(_CONVERTERS[a.job](spark, a.path), a.out)
    elif a.job == "mine":
        workflows.mine_archives(spark, a.archives, a.out, table(a.files) if a.files else None, a.last_updated)
    elif a.job == "label":
        workflows.label(spark, a.work, table(a.files), table(a.articles), *[table(e) for e in a.entries])
    elif a.job in ("train", "predict", "merge"):
        getattr(workflows, a.job)(spark, a.work)
    elif a.job == "analyse":
        for name, report in workflows.analyse(spark, a.work, table(a.articles)).items():
            metadata.write_table(report, f"{a.work}/{name}")
    elif a.job == "convert-xml":
        workflows.convert_xml(spark, a.link_xml, a.summary_xml, a.out)
    elif a.job == "build":
        workflows.build_networks(spark, a.link_text, a.summary_text, a.out, *a.years)
    elif a.job == "cocite":
        workflows.cocite(spark, a.network, a.out)
    elif a.job == "clean":
        workflows.clean(spark, a.network, a.out, a.rounds or None)
    elif a.job == "summary":
        graph.summary(pajek.read_network(spark, a.network)).show(truncate=False)
    elif a.job == "measure":
        workflows.measure(spark, a.network, a.out, a.alpha, a.betweenness)
    spark.stop()


if __name__ == "__main__":
    main()
