"""Results as JSON, GenBank records and tables with their provenance."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import textwrap
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.core.genetic import CODE
from strandweave.core.session import ship
from strandweave.operators.rules import merged

SCHEMA_VERSION = "1"


def result_json(results: DataFrame, terms: list[str]) -> DataFrame:
    """(seq_id, json) of results(seq_id, protein, dna, gc, hard, soft, status, solver, relaxed, detail, violations, *terms).

    Keys are sorted at every level and objective terms too, so equal results
    give equal text. ``violations`` is an array of structs; a missing column is
    null or empty.
    """
    have = set(results.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    span = "array<struct<constraint:string,detail:string,end:int,severity:string,start:int>>"
    violations = F.transform(F.col("violations"), lambda v: F.struct(v["constraint"].alias("constraint"), v["detail"].alias("detail"), v["end"].alias("end"), F.lower(v["severity"]).alias("severity"), v["start"].alias("start"))) if "violations" in have else F.array().cast(span)
    length = F.length("dna")
    certificate = F.struct(F.coalesce(col("detail"), F.lit("")).alias("detail"), col("gap", "double").alias("gap"), F.coalesce(col("relaxed", "array<string>"), F.array().cast("array<string>")).alias("relaxed_terms"), col("solver").alias("solver"), col("status").alias("status"))
    metrics = F.struct(col("gc", "double").alias("gc"), F.coalesce(col("hard", "long"), F.lit(0)).alias("hard_violations"), length.alias("length_nt"), F.coalesce(col("soft", "long"), F.lit(0)).alias("soft_violations"))
    body = F.struct(
        certificate.alias("certificate"), F.col("dna"), col("gc", "double").alias("gc"), length.alias("length_nt"), metrics.alias("metrics"),
        F.struct(*[F.col(t) for t in sorted(terms)]).alias("objective"), col("protein").alias("protein"), F.lit(SCHEMA_VERSION).alias("schema_version"), violations.alias("violations"),
    )
    return results.select("seq_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def _feature(key: str, start: int, end: int, marks: dict[str, str]) -> list[str]:
    lines = [f"     {key:<15} {start + 1}..{end}"]
    for name, value in marks.items():
        text = '/{}="{}"'.format(name, str(value).replace('"', "'"))
        lines += [" " * 21 + part for part in textwrap.wrap(text, 58, break_long_words=True) or [text]]
    return lines


def genbank_record(seq_id, protein: str, dna: str, violations: list[dict], upstream: str = "", downstream: str = "", topology: str = "linear", status: str = "", masks=(), stamp: str = "") -> str:
    """A GenBank record of the whole construct: source, flanks, masked spans, the coding sequence, and violations as misc_feature, merged ones once."""
    upstream, downstream = upstream or "", downstream or ""
    sequence, offset = upstream + dna + downstream, len(upstream)
    name = re.sub(r"[^A-Za-z0-9_]", "_", f"design_{seq_id}")[:16]
    gc = sum(c in "GC" for c in dna)
    comment = [f"Optimality: {status or 'unknown'}.", f"GC: {100 * gc / max(1, len(dna)):.1f}%. Length: {len(dna)} nt.", f"Residual violations: {sum(v['severity'] == 'HARD' for v in violations)} hard, {sum(v['severity'] != 'HARD' for v in violations)} soft."]
    if offset or downstream:
        comment.append(f"Construct context: {offset} nt upstream, {len(downstream)} nt downstream; the CDS begins at base {offset + 1}.")
    if stamp:
        comment.append(f"Stamp: {stamp}")
    lines = [f"LOCUS       {name:<16} {len(sequence)} bp    DNA     {topology:<8} SYN", "DEFINITION  designed coding sequence.", f"ACCESSION   {name}", "KEYWORDS    .", "SOURCE      synthetic construct", "  ORGANISM  synthetic construct"]
    for i, text in enumerate(comment):
        lines += textwrap.wrap(text, 79, initial_indent="COMMENT     " if i == 0 else " " * 12, subsequent_indent=" " * 12)
    lines.append("FEATURES             Location/Qualifiers")
    lines += _feature("source", 0, len(sequence), {"organism": "synthetic construct", "mol_type": "other DNA"})
    if upstream:
        lines += _feature("misc_feature", 0, offset, {"note": "supplied upstream context", "label": "5' context"})
    if downstream:
        lines += _feature("misc_feature", offset + len(dna), len(sequence), {"note": "supplied downstream context", "label": "3' context"})
    for a, b in masks:
        lines += _feature("misc_feature", a, b, {"note": "masked from the audit", "label": "masked span"})
    lines += _feature("CDS", offset, offset + len(dna), {"codon_start": "1", "translation": protein or ""})
    for v in sorted(violations, key=lambda v: (v["start"], v["end"], v["constraint"])):
        more = f" ({v['n']} occurrences)" if v["n"] > 1 else ""
        lines += _feature("misc_feature", offset + v["start"], offset + v["end"], {"label": v["constraint"], "note": f"{v['severity'].lower()}: {v['detail']}{more}"})
    lines.append("ORIGIN")
    for i in range(0, len(sequence), 60):
        row = sequence[i : i + 60].lower()
        lines.append(f"{i + 1:>9} " + " ".join(row[j : j + 10] for j in range(0, len(row), 10)))
    return "\n".join([*lines, "//", ""])


def genbank(designs: DataFrame, violations: DataFrame) -> DataFrame:
    """(seq_id, record) of designs(seq_id, protein, dna; upstream, downstream, topology, status if there), violations as features."""
    ship(designs.sparkSession)
    spans = merged(violations).groupBy("seq_id").agg(F.collect_list(F.struct("constraint", "severity", "start", "end", "n", "detail")).alias("spans"))
    wanted = ["protein", "upstream", "downstream", "topology", "status"]
    rows = designs.select("seq_id", "dna", *[F.col(c) if c in designs.columns else F.lit(None).cast("string").alias(c) for c in wanted]).join(spans, "seq_id", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                found = [] if r.spans is None else [s if isinstance(s, dict) else s.asDict() for s in r.spans]
                out.append(genbank_record(r.seq_id, r.protein, r.dna, found, r.upstream, r.downstream, r.topology or "linear", r.status or ""))
            yield pd.DataFrame({"seq_id": pdf["seq_id"], "record": out})

    kind = designs.schema["seq_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"seq_id {kind}, record string")


#: Provenance keys that the writer sets itself.
RESERVED = ("source", "build", "cds_count", "retrieved", "sha256", "note", "reference_set", "pseudocount")


def write_codon_table(table: DataFrame, folder: str, organism: str, provenance: dict[str, str], pseudocount: float | None = None) -> dict[str, str]:
    """Writes ``organism``.tsv (amino_acid, codon, frequency; 64 rows in order) and its provenance beside it; returns the provenance.

    Without ``pseudocount`` frequencies are raw counts of the codons seen,
    with it those of all 64 codons, smoothed. The table is 64 rows, so it is
    written from the driver. Reserved keys in ``provenance`` beyond those that
    it must give are refused.
    """
    given = {"source", "build", "retrieved", "note", "reference_set"}
    taken = sorted((set(provenance) & set(RESERVED)) - given)
    if taken:
        raise ValueError(f"reserved provenance keys: {', '.join(taken)}")
    if "reference_set" not in provenance:
        raise ValueError("provenance without reference_set")
    got = {r["codon"]: r["frequency"] for r in table.select("codon", "frequency").collect()}
    if pseudocount is not None:
        got = {c: got.get(c, 0.0) + pseudocount for c in CODE}
    lines = ["amino_acid\tcodon\tfrequency", *(f"{CODE[c]}\t{c}\t{got[c]:g}" for c in sorted(got, key=lambda c: (CODE[c], c)))]
    data = ("\n".join(lines) + "\n").encode()
    told = {"retrieved": datetime.date.today().isoformat(), **provenance, "sha256": hashlib.sha256(data).hexdigest()}
    if pseudocount is not None:
        told["pseudocount"] = pseudocount
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    (base / f"{organism}.tsv").write_bytes(data)
    (base / f"{organism}.json").write_text(json.dumps(told, indent=2, sort_keys=True) + "\n")
    return told


def write_panel(panel: DataFrame, path: str) -> None:
    """A panel as tab-separated files with a header; arrays are comma-separated."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in panel.dtypes]
    panel.select(*flat).write.csv(path, sep="\t", header=True, mode="overwrite", emptyValue="", nullValue="")


def designed_panel(members: DataFrame) -> DataFrame:
    """members(group, member_id, role, cds, note) in order, after checks: one native a group and one protein; faults raise when read."""
    from strandweave.operators.usage import translated

    rows = members.withColumn("seq_id", F.struct("group", "member_id"))
    protein = translated(rows.select("seq_id", F.col("cds").alias("dna"))).select("seq_id.group", "seq_id.member_id", "protein")
    g = rows.join(protein, ["group", "member_id"]).groupBy("group").agg(F.count_if(F.col("role") == "native").alias("natives"), F.count_distinct("protein").alias("proteins"))
    fault = F.when(F.col("natives") != 1, F.concat("group", F.lit(": natives "), F.col("natives").cast("string"))).when(F.col("proteins") != 1, F.concat("group", F.lit(": members of different proteins")))
    checked = g.select("group", F.when(fault.isNotNull(), F.raise_error(fault)).cast("string").alias("__fault"))
    out = members.join(checked, "group").select(F.coalesce("__fault", "group").alias("group"), "member_id", "role", "cds", *[c for c in ("note",) if c in members.columns])
    return out.orderBy("group", F.col("role").desc(), "member_id")
