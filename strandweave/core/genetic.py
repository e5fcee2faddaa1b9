"""The standard genetic code and fixed motif tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BASES = "TCAG"
#: Amino acids of the standard code, codons ordered T, C, A, G in each place.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
STOPS = ("TAA", "TAG", "TGA")
SYNONYMS = {aa: sorted(c for c, x in CODE.items() if x == aa) for aa in sorted(set(CODE.values()))}

#: IUPAC nucleotide codes and the bases that each stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
_FROM, _TO = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"

#: Forbidden-motif presets.
FORBIDDEN_PRESETS = {
    "poly_a_signal": ("AATAAA", "ATTAAA"),
    "tata_box": ("TATAAA",),
    "telomere_repeat": ("TTAGGG",),
    "synthesis_artifacts": ("GCTGGTGG", "GTTGTAAC", "TTATCCACA", "GCCGTCTGAA", "AAGTGCGGT", "ACAAGCGGTC"),
}

#: Wobble penalties, in the order I:U, G:C, U:A, C:G, G:U, I:C, I:A, U:G, L:A.
WOBBLE = (0.0, 0.0, 0.0, 0.0, 0.41, 0.28, 0.9999, 0.68, 0.89)

#: Weights of A, C, G, T at the donor positions -3 .. +6.
DONOR = (
    (0.34, 0.36, 0.18, 0.12), (0.60, 0.13, 0.14, 0.13), (0.09, 0.03, 0.80, 0.08), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0),
    (0.52, 0.03, 0.42, 0.03), (0.71, 0.08, 0.12, 0.09), (0.07, 0.05, 0.84, 0.04), (0.16, 0.18, 0.20, 0.46),
)
#: The same at the acceptor positions; eleven alike before -3.
ACCEPTOR = ((0.14, 0.35, 0.14, 0.37),) * 11 + ((0.16, 0.42, 0.12, 0.30), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.22, 0.16, 0.50, 0.12))
DONOR_ANCHOR, ACCEPTOR_ANCHOR, PSEUDOCOUNT, BACKGROUND = 3, 13, 1e-3, 0.25


def reverse_complement(motif: str) -> str:
    return motif.translate(str.maketrans(_FROM, _TO))[::-1]


def iupac_regex(motif: str) -> str:
    bad = sorted(set(motif) - set(IUPAC))
    if not motif or bad:
        raise ValueError(f"not an IUPAC motif: {motif!r} {bad}")
    return "".join(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in motif)


def with_reverse(motifs) -> list[str]:
    """The motifs and their reverse complements, each once, sorted."""
    return sorted({m for x in motifs for m in (x.upper(), reverse_complement(x.upper()))})


def motifs_of(presets) -> list[str]:
    """The union of presets in catalogue order, each motif once."""
    unknown = [p for p in presets if p not in FORBIDDEN_PRESETS]
    if unknown:
        raise ValueError(f"unknown presets {unknown}; known: {sorted(FORBIDDEN_PRESETS)}")
    return list(dict.fromkeys(m for k, ms in FORBIDDEN_PRESETS.items() if k in presets for m in ms))


def code_table(spark: SparkSession) -> DataFrame:
    """(codon, aa), 64 rows."""
    return spark.createDataFrame(sorted(CODE.items()), "codon string, aa string")


def amino_acid(codon: Column) -> Column:
    """The amino acid of a codon without a join; null for anything else."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(CODE.items()) for x in pair]), codon)


def pwm_log_odds(table) -> list[dict[str, float]]:
    """Smoothed, normalised log odds of each base in each column."""
    import math

    out = []
    for row in table:
        total = math.fsum(v + PSEUDOCOUNT for v in row)
        out.append({b: math.log((v + PSEUDOCOUNT) / total / BACKGROUND) for b, v in zip("ACGT", row, strict=True)})
    return out
