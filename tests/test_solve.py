import itertools
import math

import pytest

from strandweave.core.genetic import CODE, SYNONYMS
from strandweave.operators import rules as R
from strandweave.plans import solve as S

LOG_W = {c: -((i * 37) % 64) / 40 for i, c in enumerate(sorted(CODE))}


def brute(protein, weights, ok):
    best = None
    for cs in itertools.product(*(SYNONYMS[a] for a in protein + "*")):
        dna = "".join(cs)
        if ok(dna):
            score = sum(weights.micro(c, cs[i - 1] if i else "") for i, c in enumerate(cs))
            if best is None or (-score, dna) < (-best[0], best[1]):
                best = (score, dna)
    return best


@pytest.mark.parametrize("protein", ["MA", "AK", "CC", "KK", "MAK", "GPF"])
@pytest.mark.parametrize("cpg", [0.0, 0.7])
def test_trellis_equals_enumeration(protein, cpg):
    w, rules = S.Weights(LOG_W, 1.0, 0.3, 0.5, cpg), [R.Homopolymer(3), R.Motifs(("GCC",))]
    want = brute(protein, w, lambda d: not any(r.spans(d) for r in rules))
    got = S.trellis(protein, w, rules)
    assert (got.score, got.dna, got.status) == ((*want, "proven_optimal") if want else (0, "", "infeasible"))


@pytest.mark.parametrize("protein", ["MAK", "GPFA"])
def test_budget_equals_enumeration(protein):
    w = S.Weights(LOG_W)
    n = lambda d: sum(c in "GC" for c in d)
    got = S.budgeted(protein, w, 4, 6, S.gc_amount, 0)
    assert (got.score, got.dna) == brute(protein, w, lambda d: 4 <= n(d) <= 6)
    got = S.budgeted(protein, w, 1, 1, S.pair_amount("CG"), 1)
    want = brute(protein, w, lambda d: d.count("CG") == 1)
    assert (got.score, got.dna) == want if want else got.status == "infeasible"


def test_infeasible_names_culprits_and_relaxes():
    w, rule = S.Weights(LOG_W), R.InternalStart(purine=False, g_after=False)
    out = S.trellis("AM", w, [rule])
    assert out.status == "infeasible" and out.culprits == ["internal_start"]
    out = S.relaxing("AM", w, [rule])
    assert out.status == "relaxed" and out.relaxed == ["internal_start"] and out.dna


def test_beam_that_never_cuts_stays_proven():
    w = S.Weights(LOG_W)
    assert S.trellis("MAK", w, [R.Homopolymer(4)], 10**6).status == "proven_optimal"
    assert S.trellis("MAKGPF", w, [R.Homopolymer(4)], 1).status == "beam_truncated"


def test_refine_never_adds_violations():
    w, whole = S.Weights(LOG_W), [R.MaxRepeat(4)]
    start = S.trellis("AKAKAKAKAK", w).dna
    out = S.refine(start, w, [], whole, 1, 200)
    assert sum(len(r.spans(out.dna)) for r in whole) <= sum(len(r.spans(start)) for r in whole)
    assert [CODE[out.dna[i : i + 3]] for i in range(0, len(out.dna), 3)] == list("AKAKAKAKAK*")
    assert out.dna == S.refine(start, w, [], whole, 1, 200).dna


def test_sample_is_seeded_and_clean():
    a = S.sample("MAKGPFLL", dict.fromkeys(CODE, 1.0), [R.Homopolymer(3)], 5, 7)
    assert a == S.sample("MAKGPFLL", dict.fromkeys(CODE, 1.0), [R.Homopolymer(3)], 5, 7) and len(a) == 5
    assert all(R.Homopolymer(3).spans(x) == [] for x in a)


def test_simplex():
    assert S.simplex(2, 3) == [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)]
    assert all(math.isclose(sum(p), 1) for p in S.simplex(4, 11)) and len(S.simplex(4, 11)) <= 60


def test_fold_proxy():
    assert S.fold_proxy("ACG") == 0.0
    assert S.fold_proxy("GAAAC") == -3.0
    assert S.fold_proxy("GGAAACC") == -6.0


def test_batch_statuses(spark):
    df = spark.createDataFrame([(1, "MAK"), (2, "M1"), (3, None), (4, "")], "seq_id long, protein string")
    got = {r["seq_id"]: r["status"] for r in S.solve_batch(df, lambda p: [S.trellis(p, S.Weights(LOG_W))]).collect()}
    assert got == {1: "proven_optimal", 2: "invalid", 3: "invalid", 4: "invalid"}


def test_hamming(spark):
    lib = spark.createDataFrame([(1, "AAAA"), (1, "AAAT"), (1, "TTTT")], "seq_id long, dna string")
    assert abs(S.mean_hamming(lib).first()["mean_hamming"] - (1 + 4 + 3) / 3 / 4) < 1e-12


def test_benchmark_proteins_are_whole(spark):
    from strandweave.sources import derive

    sf = "/root/testdata/sf0.001"
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {i: "".join(c for c in t or "" if c.upper() in "ACDEFGHIKLMNPQRSTVWY").upper() for i, t in texts.items()}
    got = {r["seq_id"]: r["protein"] for r in derive.protein_bench(spark, sf).collect()}
    assert got == {i: p for i, p in whole.items() if p} and max(map(len, got.values())) > 24


def test_refine_query_runs_all_steps(monkeypatch):
    import inspect

    from strandweave import queries
    from strandweave.plans import solve

    signature, seen = inspect.signature(solve.refine), []

    class Frame:
        def drop(self, *_):
            return self

    def batch(_, run):
        run("MKTAYIAK")
        return Frame()

    def record(*a, **k):
        bound = signature.bind(*a, **k)
        bound.apply_defaults()
        seen.append(bound.arguments["steps"])

    monkeypatch.setattr(queries, "_log_w", lambda *_: dict.fromkeys(queries.G.CODE, 0.0))
    monkeypatch.setattr(queries.derive, "protein_bench", lambda *_: None)
    monkeypatch.setattr(solve, "solve_batch", batch)
    monkeypatch.setattr(solve, "refine", record)
    queries.refine(None, "")
    assert seen == [2000]
