"""Restriction enzymes: names resolved against a catalog(enzyme, site), and a catalog selected from a source list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.genetic import IUPAC
from strandweave.core.session import bounded
from strandweave.functions.dna import reverse_complement

CATALOG = 10_000  #: most catalog rows that are compared with every unknown name
CUTOFF = 0.6
SITE_LENGTHS = (4, 15)  #: of a site that a selected enzyme may have


def resolve(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, enzyme, site, outcome) for wanted(name): exact, then without regard to case, else unknown."""
    own = F.broadcast(catalog.select(F.col("enzyme").alias("e1"), F.col("site").alias("s1")))
    folded = catalog.groupBy(F.lower("enzyme").alias("k2")).agg(F.min(F.struct("enzyme", "site")).alias("m"))
    rows = wanted.select("name").distinct().join(own, F.col("name") == F.col("e1"), "left").join(F.broadcast(folded), F.lower(F.trim("name")) == F.col("k2"), "left")
    outcome = F.when(F.col("e1").isNotNull(), "exact").when(F.col("k2").isNotNull(), "folded").otherwise("unknown")
    return rows.select("name", F.coalesce("e1", "m.enzyme").alias("enzyme"), F.coalesce("s1", "m.site").alias("site"), outcome.alias("outcome"))


def suggest(wanted: DataFrame, catalog: DataFrame, limit: int = 5, cutoff: float = CUTOFF) -> DataFrame:
    """(name, enzyme, site, similarity, place): at most ``limit`` catalog names spelled like each wanted name.

    Similarity is one less the edit distance over the longer length; names
    alike in spelling need not share a site, so the site is shown. The catalog
    is compared in full, which is refused beyond CATALOG rows.
    """
    from pyspark.sql import Window as W

    if catalog.count() > CATALOG:
        raise ValueError(f"a catalog of over {CATALOG} enzymes")
    every = F.broadcast(catalog.agg(F.collect_list(F.struct("enzyme", "site")).alias("all")))
    rows = wanted.select("name").distinct().join(every, how="cross").select("name", F.explode("all").alias("c")).select("name", "c.*")
    size = F.greatest(F.length("name"), F.length("enzyme"))
    rows = rows.withColumn("similarity", 1 - F.levenshtein(F.lower("name"), F.lower("enzyme")) / size).where(F.col("similarity") >= cutoff)
    order = W.partitionBy("name").orderBy(F.col("similarity").desc(), "enzyme")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def sites_of(names: list[str], catalog: DataFrame) -> dict[str, str]:
    """Site by enzyme, for rules; an unknown name raises with what is spelled like it."""
    spark = catalog.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    got = resolve(wanted, catalog).collect()
    unknown = sorted(r["name"] for r in got if r["outcome"] == "unknown")
    if unknown:
        close = suggest(wanted.where(F.col("name").isin(unknown)), catalog).orderBy("name", "place").collect()
        hints = {n: ", ".join(f"{r['enzyme']} ({r['site']})" for r in close if r["name"] == n) for n in unknown}
        raise ValueError("; ".join(f"unknown enzyme {n!r}" + (f"; spelled alike, not cutting alike: {hints[n]}" if hints[n] else "") for n in unknown))
    return {r["enzyme"]: r["site"] for r in got}


def site_fault(text) -> F.Column:
    """Why a listed recognition site cannot be used; null if it can. A second site must be the first one's other strand."""
    parts = F.transform(F.filter(F.split(text, ";"), lambda p: F.trim(p) != ""), lambda p: F.upper(F.trim(F.substring_index(p, ",", 1))))
    first, second = F.get(parts, 0), F.get(parts, 1)
    iupac = "^[" + "".join(IUPAC) + "]+$"
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")).rlike(r"^(\?.*)?$"), "site_unknown")
        .when(F.exists(parts, lambda p: ~p.rlike(iupac)), "site_not_iupac")
        .when((F.size(parts) > 2) | ((F.size(parts) == 2) & (reverse_complement(first) != second)), "site_multiple")
        .when(~F.length(first).between(*SITE_LENGTHS), "site_length")
    )


def select(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, tally) of records(line, id, type, suppliers, site): usable commercial restriction enzymes, and how many went at each step.

    An enzyme listed twice, once for each strand, is one; one that is listed
    with two different sites raises when the catalog is read.
    """
    step = (
        F.when(~F.coalesce(F.col("type"), F.lit("")).rlike("^ *R"), "not_restriction").when(F.coalesce(F.trim("suppliers"), F.lit("")).isin("", "."), "not_commercial")
        .otherwise(F.coalesce(site_fault(F.col("site")), F.lit("usable")))
    )
    rows = records.withColumn("outcome", step)
    tally = rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    usable = rows.where("outcome = 'usable'").select("id", "line", F.upper(F.trim(F.substring_index(F.substring_index("site", ";", 1), ",", 1))).alias("site"))
    one = usable.groupBy("id").agg(F.min_by("site", "line").alias("site"), F.collect_set("site").alias("all"))
    clash = F.exists("all", lambda s: (s != F.col("site")) & (s != reverse_complement(F.col("site"))))
    fault = F.when(clash, F.raise_error(F.concat(F.lit("conflicting sites of "), "id")))
    return one.select(F.coalesce(fault.cast("string"), F.col("id")).alias("enzyme"), "site"), tally
