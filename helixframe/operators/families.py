"""Presence of families in genomes: elements(genome, family, members, bp) and what follows from them.

A genome is a column's value, and their number N is small beside the rows. Families meet a genome at
most once after aggregation, so that every step is an aggregate on family or genome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

SOFT_CORE = 0.95


def presence(elements: DataFrame) -> DataFrame:
    """genome, family, members, bp."""
    return elements.groupBy("genome", "family").agg(F.sum("members").cast("long").alias("members"), F.sum("bp").cast("long").alias("bp"))


def categories(present: DataFrame, genomes: int) -> DataFrame:
    """family, frequency, total_members, total_bp, category: core in all genomes, unique in one, else accessory."""
    got = present.groupBy("family").agg(F.count("*").alias("frequency"), F.sum("members").cast("long").alias("total_members"), F.sum("bp").cast("long").alias("total_bp"))
    kind = F.when(F.col("frequency") == genomes, "core").when(F.col("frequency") == 1, "unique").otherwise("accessory")
    return got.withColumn("category", kind)


#: Genomes that one column of bits holds.
BITS = 62


def marked(each: DataFrame, genomes: list[str], least_members: int = 2) -> DataFrame:
    """categories() of presence rows each(genome, family, members, bp), with the genomes as bits in columns _g0, _g1, ..

    One hash aggregation by family, of numbers alone: its rows are unique by genome, so that bits add up.
    """
    place = F.create_map(*[F.lit(x) for i, g in enumerate(genomes) for x in (g, i)])[F.col("genome")] if genomes else F.lit(None).cast("int")
    columns = range(-(-len(genomes) // BITS) or 1)
    bit = lambda c: F.sum(F.when(F.floor(place / BITS) == c, F.expr("1L") * F.pow(F.lit(2), place % BITS).cast("long")).otherwise(0)).cast("long").alias(f"_g{c}")
    got = each.groupBy("family").agg(F.count("*").alias("frequency"), F.sum("members").cast("long").alias("total_members"), F.sum("bp").cast("long").alias("total_bp"), *[bit(c) for c in columns])
    kind = F.when(F.col("frequency") == len(genomes), "core").when(F.col("frequency") == 1, "unique").otherwise("accessory")
    return got.where(F.col("total_members") >= least_members).withColumn("category", kind)


def from_lists(counted: DataFrame, genomes: list[str], k: int) -> DataFrame:
    """marked() of k-mers counted(ck, groups, members), where groups are places in genomes; both lists stay."""
    total = F.aggregate("members", F.lit(0).cast("long"), lambda s, x: s + x)
    bit = lambda c: F.aggregate("groups", F.lit(0).cast("long"), lambda s, g: s + F.when(F.floor(g / BITS) == c, F.expr("1L") * F.pow(F.lit(2), g % BITS).cast("long")).otherwise(0)).alias(f"_g{c}")
    got = counted.select(F.col("ck").alias("family"), F.size("groups").cast("long").alias("frequency"), total.alias("total_members"), (total * k).alias("total_bp"), *[bit(c) for c in range(-(-len(genomes) // BITS) or 1)], "groups", "members")
    kind = F.when(F.col("frequency") == len(genomes), "core").when(F.col("frequency") == 1, "unique").otherwise("accessory")
    return got.withColumn("category", kind)


def listed(families: DataFrame, genomes: list[str], k: int) -> DataFrame:
    """genome, family, members, bp, category: a row for each genome that a family of from_lists() is in."""
    names = F.array(*[F.lit(g) for g in genomes]) if genomes else F.array().cast("array<string>")
    each = families.select("family", "category", F.explode(F.arrays_zip("groups", "members")).alias("_e"))
    return each.select(F.get(names, F.col("_e.groups")).alias("genome"), "family", F.col("_e.members").alias("members"), (F.col("_e.members") * k).alias("bp"), "category")


def side_by_side(families: DataFrame, genomes: list[str]) -> DataFrame:
    """matrix() of from_lists(), whose rows have all that is asked for."""
    wide = [F.coalesce(F.get("members", F.array_position("groups", F.lit(i)).cast("int") - 1), F.lit(0)).alias(g) for i, g in enumerate(genomes)]
    return families.select("family", "frequency", "total_members", "total_bp", "category", *wide)


def bare(families: DataFrame) -> DataFrame:
    """marked() without its bits and lists."""
    return families.drop("groups", "members", *[c for c in families.columns if c.startswith("_g")])


def category_totals(families: DataFrame) -> DataFrame:
    return families.groupBy("category").agg(F.count("*").alias("families"), F.sum("total_bp").cast("long").alias("bp"))


def soft_core(families: DataFrame, genomes: int) -> DataFrame:
    least = -(-genomes * 95 // 100)
    return families.agg(F.lit(genomes).cast("long").alias("genomes"), F.lit(least).cast("long").alias("least_genomes"), F.count(F.when(F.col("frequency") >= least, 1)).alias("families"))


def spectrum(families: DataFrame, genomes: int) -> DataFrame:
    """present_in, families, bp for each number of genomes, 0 where there is no family."""
    each = families.groupBy(F.col("frequency").alias("present_in")).agg(F.count("*").alias("families"), F.sum("total_bp").cast("long").alias("bp"))
    numbers = families.sparkSession.range(1, genomes + 1).select(F.col("id").alias("present_in"))
    return numbers.join(each, "present_in", "left").na.fill(0, ["families", "bp"])


def genome_summary(present: DataFrame, families: DataFrame) -> DataFrame:
    """For each genome its families by category, and their bases."""
    return summed_by_genome(present.join(families.select("family", "category"), "family"))


def summed_by_genome(with_kind: DataFrame) -> DataFrame:
    kinds = [F.count(F.when(F.col("category") == c, 1)).alias(c) for c in ("core", "accessory", "unique")]
    return with_kind.groupBy("genome").agg(F.count("*").alias("families"), *kinds, F.sum("bp").cast("long").alias("bp"))


def pairwise(families: DataFrame, genomes: list[str]) -> DataFrame:
    """genome_i < genome_j, shared, union_size, jaccard of each two genomes, from marked() families.

    Families of the same genomes are counted together before pairs are made, at most N * N / 2 for each distinct set.
    """
    columns = [c for c in families.columns if c.startswith("_g")]
    sets = cut(families.groupBy(*columns).agg(F.count("*").alias("_n")))
    has = [F.when(F.col(f"_g{i // BITS}").bitwiseAND(F.lit(1 << (i % BITS))) != 0, F.lit(g)) for i, g in enumerate(genomes)]
    sets = sets.select(F.array_compact(F.array(*has)).alias("_set") if has else F.array().cast("array<string>").alias("_set"), "_n")
    size = sets.select(F.explode("_set").alias("genome"), "_n").groupBy("genome").agg(F.sum("_n").alias("size"))
    pairs = F.expr("flatten(transform(_set, (a, i) -> transform(slice(_set, i + 2, size(_set)), b -> struct(a AS a, b AS b))))")
    shared = sets.select(F.explode(pairs).alias("_p"), "_n").groupBy(F.col("_p.a").alias("genome_i"), F.col("_p.b").alias("genome_j")).agg(F.sum("_n").alias("shared"))
    every = families.sparkSession.createDataFrame([(a, b) for i, a in enumerate(genomes) for b in genomes[i + 1 :]], "genome_i string, genome_j string")
    one, two = size.select(F.col("genome").alias("genome_i"), F.col("size").alias("_i")), size.select(F.col("genome").alias("genome_j"), F.col("size").alias("_j"))
    got = every.join(shared, ["genome_i", "genome_j"], "left").join(one, "genome_i", "left").join(two, "genome_j", "left").na.fill(0, ["shared", "_i", "_j"])
    union = F.col("_i") + F.col("_j") - F.col("shared")
    return got.select("genome_i", "genome_j", "shared", union.alias("union_size"), F.when(union > 0, F.round(F.col("shared") / union, 4)).otherwise(0.0).alias("jaccard"))


def matrix(present: DataFrame, families: DataFrame, genomes: list[str]) -> DataFrame:
    """A row for each family, a column for each genome."""
    wide = present.groupBy("family").pivot("genome", genomes).agg(F.sum("members")).na.fill(0)
    return families.join(wide, "family")
