"""Bias of a genome-wide matrix from text files: ``python -m tessera.sources.bias_cli -i interactions -f fragments -o output``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.balance import compute_bin_bias
from .readers import read_fragments, read_interactions, write_bias


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> bool:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-i", "--interactions", required=True, help="chrom1 mid1 chrom2 mid2 count, gzip allowed")
    p.add_argument("-f", "--fragments", required=True, help="chrom _ mid ..., gzip allowed")
    p.add_argument("-o", "--output", required=True, help="folder for chrom, mid, bias")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    fragments = read_fragments(spark, a.fragments)
    m = read_interactions(spark, a.interactions, fragments, fragments.count())
    bias, valid = compute_bin_bias(m, "genome")
    write_bias(bias, fragments, a.output)
    return valid


if __name__ == "__main__":
    main()
