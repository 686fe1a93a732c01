"""Command line: repeats of one genome or across several."""

from __future__ import annotations

import argparse
import sys

from . import __version__


def open_range(low: float, high: float):
    """An argument strictly between two numbers."""

    def check(text: str) -> float:
        value = float(text)
        if not low < value < high:
            raise argparse.ArgumentTypeError(f"{text} is not between {low} and {high}")
        return value

    return check


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="duplika", description="Find long approximate repeats and their elementary units.")
    p.add_argument("genomes", nargs="+", help="FASTA files, one a species; lower case is soft-masked")
    p.add_argument("-o", "--output", required=True, help="folder for pairs and elements")
    p.add_argument("-T", "--temp", help="shared folder for stages")
    p.add_argument("-t", "--threads", type=int, default=1, help="local threads, without a cluster")
    p.add_argument("-H", "--hard", action="store_true", help="genomes are hard-masked already")
    p.add_argument("--keep-contigs", action="store_true", help="do not leave out contigs with _ and chrM")
    p.add_argument("-k", "--keep-temp", action="store_true", help="keep the stages")
    p.add_argument("--resume", help="folder of an earlier run's stages")
    p.add_argument("--no-decomposition", action="store_true")
    p.add_argument("--max-error", type=open_range(0, 100), default=30)
    p.add_argument("--max-edit-error", type=open_range(0, 100), default=15)
    p.add_argument("--max-chromosome-size", type=int, default=300_000_000, help="bases from which on a pair of sequences is searched by tiles of this size")
    p.add_argument("--merge-dist", type=int, default=500, help="distance within which found boxes merge")
    p.add_argument("--max-extend", type=int, default=5000, help="bases that a found box is padded with")
    p.add_argument("--kmer-size", type=int, default=14)
    p.add_argument("--winnow-size", type=int, default=16)
    p.add_argument("-v", "--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["test"]:
        print(f"duplika {__version__}")
        return 0
    args = parser().parse_args(argv)
    from functools import reduce

    from pyspark.sql import SparkSession

    from .plans.repeats import Settings, run
    from .sources.fasta import read_fasta
    from .sources.tables import write_elements, write_pairs
    from .staging import drop, workdir

    spark = SparkSession.builder.appName("duplika").master(f"local[{args.threads}]").getOrCreate() if not SparkSession.getActiveSession() else SparkSession.getActiveSession()
    if args.temp:
        spark.sparkContext.setCheckpointDir(args.temp)
    folder = args.resume or workdir(spark)
    settings = Settings(
        hard=args.hard, keep_contigs=args.keep_contigs, decomposition=not args.no_decomposition, max_error=args.max_error, max_edit_error=args.max_edit_error,
        max_chromosome_size=args.max_chromosome_size, merge_dist=args.merge_dist, pad=args.max_extend, kmer_size=args.kmer_size, winnow_size=args.winnow_size,
    )
    seqs = reduce(lambda a, b: a.unionByName(b), [read_fasta(spark, g) for g in args.genomes])
    out = run(seqs, settings, folder)
    write_pairs(out["pairs"], f"{args.output}/pairs")
    if "elements" in out:
        write_elements(out["elements"], f"{args.output}/elements")
    out["measures"].coalesce(1).write.mode("overwrite").json(f"{args.output}/measures")
    if not args.keep_temp and not args.resume:
        drop(spark, folder)
    return 0


if __name__ == "__main__":
    sys.exit(main())
