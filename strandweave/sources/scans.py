"""Scans of annotation and source files (plain or gzipped text): exons, abundances, enzyme records and site reports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.session import bounded, ship
from strandweave.functions.dna import reverse_complement

BIN = 1 << 16  #: bases of a bin in which sites and windows meet


def read_gtf_exons(spark: SparkSession, path: str, chromosomes: list[str] | None = None, tag: str | None = "MANE_Select") -> DataFrame:
    """(transcript, gene, chrom, strand, start, end) of the exon lines, 1-based and closed, of transcripts that carry ``tag``."""
    cut = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(cut.alias("f")).where((F.size("f") >= 9) & (F.get("f", 2) == "exon"))
    attribute = lambda n: F.regexp_extract(F.get("f", 8), f'{n} "([^"]*)"', 1)
    rows = rows.select(attribute("transcript_id").alias("transcript"), attribute("gene_name").alias("gene"), F.get("f", 0).alias("chrom"), F.get("f", 6).alias("strand"), F.get("f", 3).cast("long").alias("start"), F.get("f", 4).cast("long").alias("end"), F.get("f", 8).alias("a"))
    if tag:
        rows = rows.where(F.col("a").contains(f'tag "{tag}"'))
    if chromosomes is not None:
        rows = rows.where(F.col("chrom").isin(chromosomes))
    return rows.where("transcript <> ''").drop("a")


def read_abundance(spark: SparkSession, path: str) -> DataFrame:
    """(protein, abundance) of a tab-separated list with # comments; the species prefix of an id goes."""
    cut = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(cut.alias("f"))
    name = F.element_at("f", F.size("f") - 1)
    return rows.select(F.regexp_replace(name, r"^[0-9]+\.", "").alias("protein"), F.element_at("f", -1).try_cast("double").alias("abundance")).where("abundance is not null")


def read_enzyme_records(spark: SparkSession, path: str) -> DataFrame:
    """(line, id, type, suppliers, site) of records of two-letter tags ended by //; ``line`` orders them within their file."""
    rows = spark.read.option("lineSep", "//\n").text(path).select("value", F.monotonically_increasing_id().alias("line"))
    tag = lambda t: F.trim(F.regexp_extract("value", rf"(?m)^{t}   (.*)$", 1))
    return rows.select("line", tag("ID").alias("id"), tag("ET").alias("type"), tag("CR").alias("suppliers"), tag("RS").alias("site")).where("id <> ''")


def intron_sites(exons: DataFrame) -> DataFrame:
    """(transcript, chrom, strand, position, kind): one donor and one acceptor, 1-based, for every intron between exons in coordinate order."""
    order = W.partitionBy("transcript").orderBy("start", "end")
    rows = exons.withColumn("next", F.lead("start").over(order)).select("transcript", "chrom", "strand", (F.col("end") + 1).alias("lo"), (F.col("next") - 1).alias("hi")).where("lo <= hi")
    plus = F.col("strand") == "+"
    pair = F.array(F.struct(F.when(plus, F.col("lo")).otherwise(F.col("hi")).alias("position"), F.lit("donor").alias("kind")), F.struct(F.when(plus, F.col("hi")).otherwise(F.col("lo")).alias("position"), F.lit("acceptor").alias("kind")))
    return rows.select("transcript", "chrom", "strand", F.explode(pair).alias("s")).select("transcript", "chrom", "strand", "s.position", "s.kind")


def site_windows(exons: DataFrame, genome: DataFrame, flank: int = 100, keep_antisense: bool = False) -> tuple[DataFrame, DataFrame]:
    """(windows, tally) around the transcripts of exons, cut from genome(chrom, sequence).

    A window holds its transcript and ``flank`` bases to either side, on the
    transcript's strand, with the 0-based places of every site of any
    transcript on that strand; sites without room for their dinucleotide at
    the edge are left out. Transcripts of one exon, windows without a site,
    cut short by the contig, with other letters than bases, or over sites of
    the other strand (unless kept) are left out and tallied by reason.
    """
    sites = intron_sites(exons).select("chrom", "strand", "position", "kind").distinct()
    span = exons.groupBy("transcript", "gene", "chrom", "strand").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("exons"))
    rows = span.join(bounded(genome, 1000), "chrom", "left").withColumn("lo", F.greatest(F.lit(1), F.col("a") - flank)).withColumn("hi", F.least(F.col("b") + flank, F.length("sequence")))
    rows = rows.withColumn("plus", F.upper(F.expr("substring(sequence, cast(lo as int), cast(greatest(hi - lo + 1, 0) as int))"))).drop("sequence")
    bins = lambda x: F.floor(x / BIN)
    near = rows.select("transcript", "chrom", F.col("strand").alias("own"), "lo", "hi", F.explode(F.sequence(bins(F.col("lo")), F.greatest(bins(F.col("lo")), bins(F.col("hi"))))).alias("bin"))
    met = near.join(sites.withColumn("bin", bins(F.col("position"))), ["chrom", "bin"]).where((F.col("position") >= F.col("lo")) & (F.col("position") <= F.col("hi")))
    place = F.when(F.col("own") == "+", F.col("position") - F.col("lo")).otherwise(F.col("hi") - F.col("position"))
    width = F.col("hi") - F.col("lo") + 1
    met = met.withColumn("same", F.col("own") == F.col("strand")).withColumn("place", place)
    room = F.when(F.col("kind") == "donor", F.col("place") <= width - 2).otherwise(F.col("place") >= 1)
    held = lambda k: F.array_sort(F.collect_set(F.when(F.col("same") & room & (F.col("kind") == k), F.col("place"))))
    found = met.groupBy("transcript").agg(held("donor").alias("donors"), held("acceptor").alias("acceptors"), F.count_if(~F.col("same")).alias("antisense"))
    rows = rows.join(found, "transcript", "left")
    outcome = (
        F.when(F.col("exons") < 2, "one_exon").when(F.col("plus").isNull() | (F.col("hi") < F.col("b")), "truncated").when(~F.col("plus").rlike("^[ACGT]+$"), "gap")
        .when(F.lit(not keep_antisense) & (F.coalesce("antisense", F.lit(0)) > 0), "antisense").when(F.coalesce(F.size("donors") + F.size("acceptors"), F.lit(0)) <= 0, "no_sites").otherwise("kept")
    )
    rows = rows.withColumn("outcome", outcome)
    text = F.when(F.col("strand") == "+", F.col("plus")).otherwise(reverse_complement(F.col("plus")))
    windows = rows.where("outcome = 'kept'").select(F.col("transcript").alias("window_id"), F.col("gene").alias("group"), text.alias("sequence"), "donors", "acceptors", "strand", F.concat(F.lit("antisense sites: "), F.coalesce("antisense", F.lit(0)).cast("string")).alias("note"))
    return windows, rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.split("\t")] if "\t" in line else [c for c in re.split(r"\s{2,}", line.strip()) if c]


#: What the columns of a site report may be called.
_COLUMNS = {"position": ("position", "pos"), "score": ("score",), "confidence": ("confidence", "conf"), "type": ("site", "type", "prediction")}
_KINDS = (("donor", ("donor", "5'", "5 '", "5ss")), ("acceptor", ("acceptor", "3'", "3 '", "3ss")))
_CLASSES = (("constitutive", ("constitutive",)), ("alternative", ("alternative", "isoform")), ("cryptic", ("cryptic",)))


def parse_site_report(report: str, length: int) -> list[dict]:
    """Sites of an external text report: the header is found by its column names, positions become 0-based; a report without a table, or a malformed row, raises."""
    at = None
    for line in report.splitlines():
        cells = _cells(line)
        if at is None:
            lower = [c.lower() for c in cells]
            found = {n: next((i for i, c in enumerate(lower) if any(a in c for a in names)), None) for n, names in _COLUMNS.items()}
            if len(cells) >= 4 and None not in found.values():
                at, out = found, []
            continue
        if len(cells) <= max(at.values()) or not re.fullmatch(r"[+-]?\d+", cells[at["position"]]):
            continue
        position, said = int(cells[at["position"]]), cells[at["type"]].lower()
        kind = next((k for k, marks in _KINDS if any(m in said for m in marks)), None)
        try:
            score, confidence = float(cells[at["score"]]), float(cells[at["confidence"]])
        except ValueError:
            raise ValueError(f"no number in the site row {line!r}") from None
        if not 1 <= position <= length or kind is None:
            raise ValueError(f"a site row out of range or of unknown type: {line!r}")
        out.append({"position": position - 1, "kind": kind, "site_class": next((k for k, marks in _CLASSES if any(m in said for m in marks)), "unknown"), "score": score, "confidence": confidence})
    if at is None:
        raise ValueError("no site table in the report")
    return sorted(out, key=lambda s: (s["position"], s["kind"]))


def site_reports(reports: DataFrame) -> DataFrame:
    """(seq_id, position, kind, site_class, score, confidence, fault) of reports(seq_id, report, length); a report that cannot be read is one row with its fault."""
    ship(reports.sparkSession)
    names = ["seq_id", "position", "kind", "site_class", "score", "confidence", "fault"]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    rows += [{"seq_id": r.seq_id, **s} for s in parse_site_report(r.report or "", int(r.length))]
                except ValueError as e:
                    rows.append({"seq_id": r.seq_id, "fault": str(e)})
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"seq_id": "int64", "position": "Int32", "kind": object, "site_class": object, "score": "float64", "confidence": "float64", "fault": object})

    return reports.select("seq_id", "report", "length").mapInPandas(run, "seq_id long, position int, kind string, site_class string, score double, confidence double, fault string")
