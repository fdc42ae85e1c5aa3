"""Command line: python -m helixframe.cli INPUT [OUTPUT] -flag key=value ..."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from .functions.nucleotide import lenient_int
from .plans import modes
from .sources import readers

FLAGS = {"maskonly", "amask", "collate", "joint", "combinemask", "homology", "readmask", "readgff", "extunique", "extract", "maskscomp", "nossr", "seqshow", "vector", "contain", "normal"}
#: Comparative runs, of which the last named counts.
COMPARATIVE = ("collate", "joint", "combinemask", "homology")


def parse(args: list[str]) -> tuple[list[str], set[str], dict[str, str]]:
    """Places, flags and values. Dashes and case don't matter, the first value of a key counts, unknown flags are told."""
    places, flags, values = [], set(), {}
    for a in args:
        bare = a.lstrip("-")
        key, eq, value = bare.partition("=")
        if eq and not os.path.exists(a):
            values.setdefault(key.lower(), value)
        elif a.startswith("-"):
            flags.add(bare.lower()) if bare.lower() in FLAGS else print(f"unknown option {a}", file=sys.stderr)
        else:
            places.append(a)
    return places, flags, values


def settings(flags: set[str], values: dict[str, str]) -> modes.Settings:
    number = lambda k, d: x if (x := lenient_int(values.get(k, ""))) is not None else d
    size = [lenient_int(x) or 0 for x in (values.get("image", "").lower().split("x") + ["", ""])[:2]]
    return modes.Settings(
        kmer=number("kmer", 19), min_len=number("sln", 80), gap=number("gap", 0), flanks=number("flanks", number("flangs", 0)), scale=number("imgx", 10), width=size[0] if all(size) else 0, height=size[1] if all(size) else 0,
        show_sequence="seqshow" in flags, tandem="nossr" not in flags, mask_only="maskonly" in flags, measure="containment" if "contain" in flags else "profile", libraries=tuple(values[k] for k in ("lib", "ref") if k in values),
    )


def run(spark: SparkSession, args: list[str]):
    places, flags, values = parse(args)
    if not places:
        raise SystemExit(__doc__)
    source = places[0]
    out = places[1] if len(places) > 1 else values.get("out", f"{source.rstrip('/')}.out")
    s = settings(flags, values)
    many = os.path.isdir(source)
    if "maskscomp" in flags and not many:
        return modes.run_compare(spark, source, out, s)
    if "readgff" in flags and not flags & {"readmask"}:
        return modes.run_read_gff(spark, source, out, s)
    keep_case = bool(flags & {"readmask", "extunique", "extract", "combinemask"})
    seqs = readers.read_fasta(spark, source, keep_case=keep_case)
    chosen = [m for m in COMPARATIVE if m in flags]
    if many and chosen:
        return {"collate": modes.run_collate, "joint": modes.run_joint, "combinemask": modes.run_combine_mask, "homology": modes.run_homology}[chosen[-1]](spark, seqs, out, s)
    for flag, mode in (("extract", modes.run_extract), ("readmask", modes.run_read_mask), ("extunique", modes.run_unique), ("amask", modes.run_alignment)):
        if flag in flags:
            return mode(spark, seqs, out, s)
    return modes.run_default(spark, seqs, out, s)


if __name__ == "__main__":
    run(SparkSession.builder.appName("helixframe").getOrCreate(), sys.argv[1:])
