"""Sequence files: FASTA, GenBank and the tab-separated tables, with fixed schemas that are checked and never inferred."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from strandweave.core.genetic import IUPAC
from strandweave.core.session import ship
from strandweave.functions.dna import wrap


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, sequence) of every record, letters upper-cased and white space dropped.

    Records are the read's own delimiter, so a file of any size is split over
    tasks. Text before the first header and empty records raise.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value"), (F.col("_metadata.file_block_start") == 0).alias("head"))
    text = F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"^\n*>", "")
    first = F.col("head") & ~F.col("value").rlike(r"^\s*>") & F.col("value").rlike(r"^[^\n]*$") & F.col("value").rlike("^[ACGTacgtNn]+$")
    rows = rows.where(F.trim("value") != "").select("path", F.trim(F.substring_index(text, "\n", 1)).alias("header"), F.upper(F.regexp_replace(F.when(text.contains("\n"), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(""), r"\s", "")).alias("sequence"), first.alias("__bare"))
    fault = F.when(F.col("__bare"), F.raise_error(F.concat(F.lit("sequence before a header in "), "path"))).when(F.col("sequence") == "", F.raise_error(F.concat(F.lit("empty record "), "header")))
    return rows.select("path", "header", F.coalesce(fault.cast("string"), F.col("sequence")).alias("sequence"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """One record a row of df(header, sequence), lines wrapped."""
    df.select(F.concat(F.lit(">"), "header", F.lit("\n"), wrap(F.col("sequence"), width)).alias("value")).write.text(path)


def _table(spark: SparkSession, path: str, schema: str, keys: list[str], sep: str = "\t") -> DataFrame:
    want = [c.split()[0] for c in schema.split(",")]
    head = spark.read.text(path).first()
    names = head[0].rstrip("\r\n").split(sep) if head else []
    if names != want:
        raise ValueError(f"{path}: header {names}, expected {want}")
    rows = spark.read.csv(path, sep=sep, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)
    twice = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{path}: duplicate {[twice[0][k] for k in keys]}")
    return rows


def read_codon_usage(spark: SparkSession, path: str) -> DataFrame:
    """(amino_acid, codon, frequency); duplicates, gaps in the code and frequencies that are not positive raise."""
    rows = _table(spark, path, "amino_acid string, codon string, frequency double", ["codon"])
    n, aas, bad = rows.agg(F.count(F.lit(1)), F.count_distinct("amino_acid"), F.count_if(~(F.col("frequency") > 0))).first()
    if bad or aas != 21:
        raise ValueError(f"{path}: {n} codons of {aas} amino acids and stop, {bad} without a positive frequency")
    return rows


def read_trna(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "anticodon string, count int", ["anticodon"])


def read_enzymes(spark: SparkSession, path: str) -> DataFrame:
    """(enzyme, site); sites are IUPAC."""
    rows = _table(spark, path, "enzyme string, site string", ["enzyme"])
    bad = rows.where(~F.col("site").rlike("^[" + "".join(IUPAC) + "]+$")).limit(1).collect()
    if bad:
        raise ValueError(f"{path}: {bad[0]['enzyme']} has no IUPAC site")
    return rows


def read_panel(spark: SparkSession, path: str, required: list[str], optional: list[str] = (), extra_scores: bool = False) -> DataFrame:
    """A panel as strings: required columns must be there, unknown ones raise or (``extra_scores``) become a map of doubles."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False, mode="FAILFAST", maxCharsPerColumn=-1)
    missing = [c for c in required if c not in rows.columns]
    other = [c for c in rows.columns if c not in required and c not in optional]
    if missing or (other and not extra_scores):
        raise ValueError(f"{path}: missing {missing}, unknown {other}")
    named = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in [*required, *optional]]
    if not extra_scores:
        return rows.select(*named)
    scores = F.map_from_arrays(F.array(*[F.lit(c) for c in other]), F.array(*[F.col(c).cast("double") for c in other])) if other else F.create_map().cast("map<string,double>")
    return rows.select(*named, scores.alias("scores"))


def read_site_panel(spark: SparkSession, path: str) -> DataFrame:
    """Windows with donor and acceptor positions: lists sorted, without repeats, in range, and no position of both kinds."""
    rows = read_panel(spark, path, ["window_id", "group", "sequence"], ["donors", "acceptors", "strand", "note"])
    at = lambda c: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    rows = rows.withColumn("donors", at(F.col("donors"))).withColumn("acceptors", at(F.col("acceptors")))
    both = F.concat("donors", "acceptors")
    fault = (
        F.when(F.size(F.array_distinct(both)) != F.size(both), "repeated position").when(F.exists(both, lambda p: (p < 0) | (p >= F.length("sequence"))), "position out of range")
        .when((F.array_sort("donors") != F.col("donors")) | (F.array_sort("acceptors") != F.col("acceptors")), "positions not sorted")
    )
    return _faultless(rows, fault, "window_id")


def read_expression_panel(spark: SparkSession, path: str) -> DataFrame:
    rows = read_panel(spark, path, ["group", "variant_id", "cds", "measured", "utr5", "utr3"], ["readout", "cell_type", "species"]).withColumn("measured", F.col("measured").cast("double"))
    fault = (
        F.when(F.length("cds") % 3 != 0, "cds not in codons").when(~F.right("cds", F.lit(3)).isin("TAA", "TAG", "TGA"), "cds without stop").when(F.length(F.coalesce("utr5", F.lit(""))) > 1381, "utr5 too long")
        .when(F.length("cds") + F.length(F.coalesce("utr3", F.lit(""))) > 11937, "cds and utr3 too long").when(F.isnan("measured") | F.col("measured").isNull(), "no measurement")
    )
    return _faultless(rows, fault, "variant_id")


def read_variant_panel(spark: SparkSession, path: str) -> DataFrame:
    rows = read_panel(spark, path, ["variant_id", "group", "region", "label"], ["chromosome", "note"], extra_scores=True)
    word = F.lower(F.trim("label"))
    label = F.when(word.isin("1", "true", "yes", "t"), 1).when(word.isin("0", "false", "no", "f"), 0)
    rows = rows.withColumn("label", label)
    fault = F.when(F.col("label").isNull(), "label").when(~F.col("region").isin("exonic", "intronic"), "region")
    return _faultless(rows, fault, "variant_id")


def read_designed_panel(spark: SparkSession, path: str) -> DataFrame:
    """Groups of one native and designed sequences."""
    rows = read_panel(spark, path, ["group", "member_id", "role", "cds"], ["note"])
    bad = rows.groupBy("group").agg(F.count_if(F.col("role") == "native").alias("n")).where("n <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: group {bad[0]['group']} has {bad[0]['n']} native members")
    return rows


def _faultless(rows: DataFrame, fault, key: str) -> DataFrame:
    """Rows as they are; the first faulty one raises when it is read."""
    text = F.when(fault.isNotNull(), F.raise_error(F.concat_ws(": ", F.col(key), fault)))
    return rows.withColumn(key, F.coalesce(text.cast("string"), F.col(key)))


_GENBANK = "path string, locus string, definition string, topology string, sequence string, features array<struct<key:string,start:int,end:int,strand:int,qualifiers:array<struct<name:string,value:string>>>>"


def parse_genbank(text: str) -> list[dict]:
    """Records of a GenBank flat file; spans become 0-based and half-open, joins their outer bounds."""
    out = []
    for block in re.split(r"^//\s*$", text, flags=re.M):
        if not block.strip():
            continue
        head = re.search(r"^LOCUS\s+(\S+)(.*)$", block, re.M)
        origin = re.search(r"^ORIGIN.*?$(.*)", block, re.M | re.S)
        if not head or not origin:
            raise ValueError("a record without LOCUS or ORIGIN")
        definition = re.search(r"^DEFINITION\s+(.*(?:\n {12}.*)*)", block, re.M)
        features = []
        part = re.search(r"^FEATURES.*?$(.*?)^ORIGIN", block, re.M | re.S)
        for m in re.finditer(r"^ {5}(\S+)\s+(\S+(?:\n {21}(?!/).*)*)((?:\n {21}.*)*)", part.group(1) if part else "", re.M):
            spot = re.sub(r"\s", "", m.group(2))
            numbers = [int(x) for x in re.findall(r"\d+", spot)]
            if not numbers:
                continue
            marks = [(q.group(1), (q.group(2) or "").replace("\n" + " " * 21, " ")) for q in re.finditer(r'/([\w-]+)(?:=(?:"([^"]*)"|(?=\S)([^\s"]+)))?', m.group(3))]
            features.append({"key": m.group(1), "start": min(numbers) - 1, "end": max(numbers), "strand": -1 if "complement" in spot else 1, "qualifiers": [{"name": n, "value": v} for n, v in marks]})
        out.append({
            "locus": head.group(1), "definition": re.sub(r"\s+", " ", definition.group(1)).strip() if definition else "", "topology": "circular" if "circular" in head.group(2) else "linear",
            "sequence": re.sub(r"[^A-Za-z]", "", origin.group(1)).upper(), "features": features,
        })
    return out


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)

    def run(batches):
        for pdf in batches:
            rows = [{"path": p, **r} for p, text in zip(pdf["path"], pdf["value"], strict=True) for r in parse_genbank(text)]
            yield pd.DataFrame(rows, columns=["path", "locus", "definition", "topology", "sequence", "features"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, _GENBANK)


def format_genbank(locus: str, sequence: str, features: list[tuple[str, int, int, dict]] = (), topology: str = "linear", definition: str = ".") -> str:
    """A GenBank record; features are (key, start, end, qualifiers) with 0-based half-open spans."""
    lines = [f"LOCUS       {locus:<16} {len(sequence)} bp    DNA     {topology}", f"DEFINITION  {definition}", "FEATURES             Location/Qualifiers"]
    for key, start, end, marks in features:
        lines.append(f"     {key:<15} {start + 1}..{end}")
        lines += [f'                     /{k}="{v}"' for k, v in marks.items()]
    lines.append("ORIGIN")
    for i in range(0, len(sequence), 60):
        row = sequence[i : i + 60].lower()
        lines.append(f"{i + 1:>9} " + " ".join(row[j : j + 10] for j in range(0, len(row), 10)))
    return "\n".join([*lines, "//", ""])


def vector_context(records: DataFrame, feature: str, flank: int | None = None) -> DataFrame:
    """(locus, upstream, downstream, topology): what lies before and after a feature of each record."""
    f = F.get(F.filter("features", lambda x: x["key"] == feature), 0)
    rows = records.withColumn("f", f).where("f is not null")
    up, down = F.left("sequence", F.col("f.start")), F.expr("substring(sequence, f.end + 1)")
    if flank is not None:
        up, down = F.right(up, F.lit(flank)), F.left(down, F.lit(flank))
    return rows.select("locus", up.alias("upstream"), down.alias("downstream"), "topology")
