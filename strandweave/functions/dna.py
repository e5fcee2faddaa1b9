"""Column functions on DNA and protein strings; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dna_letters(text: Column) -> Column:
    """The ACGT letters of any text, upper-cased."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", ""))


def protein_letters(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]", ""))


def is_dna(x: Column) -> Column:
    return x.rlike("^[ACGT]+$")


def is_protein(x: Column) -> Column:
    return x.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$")


def bad_letters(x: Column, alphabet: str) -> Column:
    """The distinct characters outside an alphabet, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(F.upper(F.trim(x)), f"[{alphabet}]", ""), ""))), "")


def reverse_complement(x: Column) -> Column:
    return F.reverse(F.translate(x, "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"))


def count_of(x: Column, letters: str) -> Column:
    return F.length(x) - F.length(F.translate(x, letters, ""))


def gc_count(x: Column) -> Column:
    return count_of(x, "GC")


def gc_fraction(x: Column) -> Column:
    return F.when(F.length(x) > 0, gc_count(x) / F.length(x)).otherwise(F.lit(0.0))


def coding(x: Column) -> Column:
    """The longest prefix of whole codons."""
    return F.left(x, F.length(x) - F.length(x) % 3)


def wrap(x: Column, width: int = 60) -> Column:
    """Lines of ``width`` characters, as FASTA has them."""
    return F.regexp_replace(x, f"(.{{{width}}})(?=.)", "$1\n")


def clean_upstream(x: Column) -> Column:
    """The flank after the last N: contiguous with what follows."""
    return F.substring_index(F.upper(x), "N", -1)


def clean_downstream(x: Column) -> Column:
    return F.substring_index(F.upper(x), "N", 1)
