"""One graph for many objectives, annealing, configurations and streams."""

import itertools
import random

import pytest

from strandweave.core.genetic import CODE, SYNONYMS
from strandweave.operators import rules as R
from strandweave.plans import config, objectives, solve as S

LOG_W = {c: -((i * 37) % 64) / 40 for i, c in enumerate(sorted(CODE))}
AMINO = "ACDEFGHIKLMNPQRSTVWY"


@pytest.mark.parametrize("rules", [[], [R.Homopolymer(3), R.Motifs(("GAATTC", "GGTCTC"))], [R.GcWindow(8, 0.25, 0.75), R.GcRun(4)], [R.InternalStart(), R.TandemRepeat(2, 3)], [R.InternalStart(least=9, purine=False)], [R.InvertedRepeat(4, 3), R.splice_sites()]])
def test_graph_equals_layers(rules):
    rng = random.Random(len(rules))
    for _ in range(12):
        protein = "".join(rng.choice(AMINO) for _ in range(rng.choice([1, 2, 9, 40])))
        goals = [S.Weights(LOG_W), S.Weights(LOG_W, 0.5, 2.0, 0.4, 1.0), objectives.Objective(((objectives.cai_logw(LOG_W), 1.0), (objectives.Ramp({c: 0.5 for c in CODE}, 6), 2.0), (objectives.CodonPair({("ATG", "GCC"): 0.3}), 1.0)))]
        graph = S.Structure(protein, rules, 3)
        for goal in goals:
            a, b = graph.solve(goal), S.layered(protein, goal, rules)
            assert (a.dna, a.score, a.status, a.culprits) == (b.dna, b.score, b.status, b.culprits)
            assert not a.dna or goal.total(a.dna) == a.score


def test_wide_graphs_fall_back(monkeypatch):
    monkeypatch.setattr(S.Structure.__init__, "__defaults__", ((), 0, 3))
    with pytest.raises(S.TooWide):
        S.Structure("LLLLLL", [R.Homopolymer(6)])
    assert S.trellis("LLLLLL", S.Weights(LOG_W), [R.Homopolymer(6)]).status == "proven_optimal"


def test_terms_add_up():
    dna = "ATGGCCGCGTTATAA"
    goal = S.Weights(LOG_W, 1.0, 0.5, 0.5, 2.0)
    plain = sum(LOG_W[dna[i : i + 3]] for i in range(0, 12, 3) if CODE[dna[i : i + 3]] not in "MW*")
    v = goal.vector(dna)
    assert v["cai_logw"] == pytest.approx(plain) and v["dinucleotide_CG"] == -dna.count("CG")
    assert goal.total(dna) == pytest.approx(1e6 * (plain + 0.5 * v["gc_proximity"] - 2 * dna.count("CG")), abs=5)
    assert isinstance(objectives.GcProximity(), objectives.Term)
    assert objectives.Pair("CG").delta("GTT", "TTC", 1) == -1 and objectives.Pair("CG", 1).delta("CGA", "A", 1) == 1


def better(out, start, whole):
    assert [CODE[out.dna[i : i + 3]] for i in range(0, len(out.dna), 3)] == [CODE[start[i : i + 3]] for i in range(0, len(start), 3)]
    return sum(len(r.found(out.dna)) for r in whole) <= sum(len(r.found(start)) for r in whole)


@pytest.mark.parametrize("options", [{}, {"block": 4, "block_share": 0.5}, {"heats": (0.1, 0.5, 2.0), "swap_every": 7}, {"start": 0.0}])
def test_annealing_keeps_rules_and_repeats(options):
    w, local, whole = S.Weights(LOG_W, cpg=0.3), [R.Homopolymer(4), R.GcWindow(12, 0.2, 0.8)], [R.MaxRepeat(5), R.Uorf()]
    start = S.trellis("MAKAKAKAKAKWLLRRSSGGA", w, local).dna
    out = S.refine(start, w, local, whole, 3, 300, **options)
    assert better(out, start, whole) and not any(r.found(out.dna) for r in local)
    assert out.dna == S.refine(start, w, local, whole, 3, 300, **options).dna and out.score == w.total(out.dna)
    assert S.refine(start, w, local, whole, 3, 0, **options).dna == start


def test_blocks_reach_what_single_swaps_cannot():
    """Only a change of two codons at once pays; greedy single swaps stay."""
    w, start = S.Weights(dict.fromkeys(CODE, 0.0)), "AAAAAA" + "TAA"
    both = lambda dna: 1_000_000 * ((dna[2] == "G") + (dna[5] == "G") - 3 * ((dna[2] == "G") != (dna[5] == "G")))
    assert S.refine(start, w, [], [], 1, 200, start=0.0, extra=both).dna == start
    assert S.refine(start, w, [], [], 1, 200, start=0.0, block=2, block_share=0.5, extra=both).dna == "AAGAAGTAA"
    with pytest.raises(ValueError, match="local"):
        S.refine("AAAAAATAA", w, [R.Homopolymer(3)], [], 1, 5)


def test_optimize_says_what_was_annealed():
    w = S.Weights(LOG_W)
    clean = S.optimize("MAK", w, [R.Homopolymer(4), R.MaxRepeat(12)])
    assert clean.status == "proven_optimal" and clean.refined == []
    out = S.optimize("MAKAKAKAKAKAK", w, [R.MaxRepeat(5)], steps=50)
    assert out.status == "heuristic" and out.refined == ["max_repeat"]
    assert S.optimize("MAK", w, [R.GcWindow(30, 0.0, 0.1)], steps=5).refined == []  # shorter than a window: nothing broken


def enumerate_pairs(s, i, j):
    if j - i < 4:
        return 0.0
    best = enumerate_pairs(s, i + 1, j)
    for k in range(i + 4, j + 1):
        w = S.PAIR_WEIGHT.get(s[i] + s[k])
        if w:
            best = max(best, w + enumerate_pairs(s, i + 1, k - 1) + enumerate_pairs(s, k + 1, j))
    return best


def test_folding_equals_enumeration():
    rng = random.Random(6)
    for _ in range(60):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12)))
        assert S.fold_proxy(s) == -enumerate_pairs(s, 0, len(s) - 1) or (not s and S.fold_proxy(s) == 0)


def test_presets_and_stamps():
    c = config.with_preset("lvv_transgene", config.Config(cai_weight=2.0))
    assert (c.max_repeat_length, c.avoid_uorf, c.cai_weight, c.application_preset) == (16, True, 2.0, "lvv_transgene")
    assert {r.name for r in c.rules()} >= {"gc_window", "max_repeat", "uorf", "splice_site", "polya_signal"}
    with pytest.raises(KeyError, match="mrna_ivt"):
        config.preset("nothing")
    a, b = (config.manifest(x, {"table": "ab"}, "1") for x in (c, config.with_preset("aav_transgene")))
    assert a["stamp"] != b["stamp"] and a == config.manifest(c, {"table": "ab"}, "1")
    assert config.canonical_json({"b": 1, "a": [2]}) == '{"a":[2],"b":1}'


def test_config_runs_and_refuses(spark):
    from strandweave import api
    from strandweave.operators import usage

    table = usage.build_table(spark.createDataFrame([(1, "ATGGCTAAAGGGTAA" * 6)], "seq_id long, dna string"))
    proteins = spark.createDataFrame([(1, "MAKGRS"), (2, "")], "seq_id long, protein string")
    got = {r["seq_id"]: r for r in api.optimize_config(proteins, table, config.Config(gc_budget=(0.4, 0.5), cpg_weight=1.0)).collect()}
    assert got[1]["status"] == "proven_optimal" and 0.4 <= sum(c in "GC" for c in got[1]["dna"]) / 21 <= 0.5 and got[2]["status"] == "invalid"
    assert api.optimize_config(proteins, table, config.Config(dinucleotide_budget=("CG", 1, 2))).where("seq_id = 1").first()["dna"].count("CG") in (1, 2)
    for bad in (config.Config(gc_budget=(0.1, 0.9), refine=True), config.Config(gc_budget=(0.1, 0.9), avoid_uorf=True), config.Config(cpg_mode="x"), config.Config(tai_weight=1.0)):
        with pytest.raises(ValueError):
            api.optimize_config(proteins, table, bad)
    rows = api.candidates(proteins.where("seq_id = 1"), table, [R.Homopolymer(4), R.MaxRepeat(9)] [:1], 10, 4, refine_steps=40).collect()
    assert {r["source"] for r in rows} <= {"frontier", "refined"} and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1)) and len({r["dna"] for r in rows}) == len(rows)


@pytest.mark.parametrize("rule", [R.Homopolymer(3), R.GcRun(3), R.Uorf(region=60), R.GcWindow(9, 0.3, 0.7), R.PolyaSignal()], ids=lambda r: r.name)
def test_pieces_equal_the_whole(rule):
    from strandweave.streaming import monitor as M

    rng = random.Random(11)
    step = M._runs if isinstance(rule, (R.Homopolymer, R.GcRun)) else M._starts if isinstance(rule, R.Uorf) else M._windows
    for _ in range(60):
        dna = "".join(rng.choice("ACGT" if rng.random() < 0.6 else "AATTG") for _ in range(rng.choice([0, 1, 7, 150])))
        offset, tail, held, got = 0, "", "", []
        cuts = sorted({0, len(dna), *(rng.randint(0, len(dna)) for _ in range(rng.choice([0, 3, 20])))})
        for a, b in itertools.pairwise(cuts):
            found, tail, held = step(rule, offset, tail, held, dna[a:b], b == len(dna))
            got += found
            offset += b - a
        assert sorted(got) == sorted(rule.spans(dna))


def test_synonyms_are_sorted():
    assert all(list(c) == sorted(c) for c in SYNONYMS.values())
