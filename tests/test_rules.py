"""The two faces of a rule agree, and table operators equal plain recomputation."""

import random

import pytest

from strandweave.core.genetic import SYNONYMS, reverse_complement
from strandweave.operators import rules as R

RULES = [
    R.Homopolymer(3), R.GcRun(4), R.GcWindow(9, 0.3, 0.7), R.Motifs(("GAATTC", "GANTC")), R.splice_sites(), R.TandemRepeat(2, 3), R.InvertedRepeat(4, 3),
    R.InternalStart(), R.PolyaSignal(), R.Uorf(), R.Uorf(offset=5, region=None), R.MaxRepeat(5),
]


def sequences(n=60, seed=5):
    rng = random.Random(seed)
    out = ["A", "ACG", "AATAAA" + "ACGTACGTAC" + "T" * 10, "ATGAATGTAA", "GGGATGG"]
    for _ in range(n):
        out.append("".join(rng.choice("ACGT" if rng.random() < 0.7 else "AT") for _ in range(rng.choice([5, 30, 90, 300, 700]))))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(sequences())), "seq_id long, dna string").repartition(3).cache()


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.name}-{hash(r) % 97}")
def test_table_operator_equals_spans(table, rule):
    got = sorted((r["seq_id"], r["start"], r["end"]) for r in rule.violations(table).collect())
    assert got == sorted((i, a, b) for i, s in enumerate(sequences()) for a, b in rule.spans(s))


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.name}-{hash(r) % 97}")
def test_built_under_veto_is_clean(rule):
    rng = random.Random(3)
    for _ in range(20):
        dna = ""
        for aa in (rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(25)):
            ok = [c for c in SYNONYMS[aa] if rule.ok_suffix(dna, c)]
            if not ok:
                break
            dna += rng.choice(ok)
        assert rule.spans(dna) == []


def test_seeded_drops_upstream_and_clamps(spark):
    seqs = spark.createDataFrame([(1, "TTCGAATTC", "GAATTCGAA")], "seq_id long, dna string, upstream string")
    got = sorted((r["start"], r["end"]) for r in R.seeded(R.Motifs(("GAATTC",)), seqs).collect())
    assert got == [(0, 3), (3, 9)]


def test_merge_mask_and_counts(spark):
    v = spark.createDataFrame([(1, "a", "HARD", 0, 5, "x"), (1, "a", "HARD", 5, 9, "y"), (1, "a", "HARD", 11, 12, "z"), (2, "b", "SOFT", 3, 4, "w")], "seq_id long, constraint string, severity string, start int, end int, detail string")
    assert sorted((r["seq_id"], r["start"], r["end"], r["n"], r["detail"]) for r in R.merged(v).collect()) == [(1, 0, 9, 2, "x"), (1, 11, 12, 1, "z"), (2, 3, 4, 1, "w")]
    m = spark.createDataFrame([(1, 4, 10)], "seq_id long, mask_start int, mask_end int")
    assert R.unmasked(v, m).count() == 3
    seqs = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A")], "seq_id long, dna string")
    assert sorted(tuple(r) for r in R.counts(seqs, v).collect()) == [(1, 3, 0), (2, 0, 1), (3, 0, 0)]


def test_reverse_complement_of_iupac():
    assert reverse_complement("GTRAGT") == "ACTYAC"
