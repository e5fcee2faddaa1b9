"""Boards, panels, models, writers, scans and sliced metrics against plain recomputation."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.core.genetic import CODE, reverse_complement
from strandweave.operators import boards, enzymes, metrics, models, panels, profiles, rules, usage
from strandweave.sources import formats, scans, writers


def test_running_sums_over_slices(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.randint(0, 5)) for g in ("a", "b", None) for k in rng.sample(range(1000), 90)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    for down in (False, True):
        got = {(r["g"], r["k"]): r["s"] for r in metrics.running(df, ["g"], "k", {"s": "v"}, down).collect()}
        assert got == {(g, k): sum(v for h, j, v in rows if h == g and (j >= k if down else j <= k)) for g, k, _ in rows}
    assert {r["k"]: r["s"] for r in metrics.running(df.where("g = 'a'"), [], "k", {"s": "v"}).collect()} == {k: sum(v for h, j, v in rows if h == "a" and j <= k) for g, k, _ in rows if g == "a"}


def test_median_interval_and_promotion(spark):
    df = spark.createDataFrame([(f"g{i}", float(i)) for i in range(21)], "protein string, score double")
    r = metrics.median_interval(df, "protein", "score", 200).first()
    assert r["median"] == 10 and 3 < r["low"] <= 10 <= r["high"] < 17
    assert metrics.promotion(True, 0.5, {"cai": 0.4, "gc3": 0.1}, 0.8)["promotable"] and not metrics.promotion(True, 0.3, {"cai": 0.4}, 0.8)["promotable"]
    drawn = metrics.resampled(df.withColumnRenamed("protein", "group"), 5).groupBy("draw").agg(F.sum("copies").alias("n")).collect()
    assert len(drawn) == 5 and all(r["n"] == 21 for r in drawn)


def ranks(x):
    order = np.argsort(x, kind="stable")
    r = np.empty(len(x))
    r[order] = np.arange(1, len(x) + 1)
    for v in set(x.tolist()):
        r[x == v] = r[x == v].mean()
    return r - r.mean()


def test_rank_fit_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in ("p", "q", "flat"):
        a, b = rng.integers(0, 20, 40).astype(float), rng.normal(size=40)
        b = np.zeros(40) if g == "flat" else b
        y = np.round(a * 0.5 + rng.normal(size=40) * 3, 1)
        rows += [(g, float(v), float(s), float(t)) for v, s, t in zip(y, a, b, strict=True)]
    got = {r["group"]: r for r in boards.rank_fit(spark.createDataFrame(rows, "g string, y double, a double, b double"), "g", "y", ["a", "b"]).collect()}
    for g in ("p", "q", "flat"):
        y, *xs = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2, 3))
        cols = [c for x in xs if np.ptp(x) > 0 for c in (ranks(x), ranks(x) ** 2 - (ranks(x) ** 2).mean())]
        m, t = np.column_stack([np.ones(len(y)), *cols]), ranks(y)
        rest = t - m @ np.linalg.lstsq(m, t, rcond=None)[0]
        want = 1 - (rest @ rest / (t @ t)) * (len(y) - 1) / (len(y) - len(cols) - 1)
        assert got[g]["adjusted_r2"] == pytest.approx(want, abs=1e-8) and got[g]["n"] == 40


def test_longest_repeat_equals_enumeration(spark):
    rng = random.Random(4)
    seqs = ["", "A", "AT", "AC", "ACACAC", "GAATTC", "N" * 5, "ACGTN" * 4, "ACGT" * 20] + ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 60))) for _ in range(40)]

    def plain(s):
        best = 0
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                w = s[i:j]
                if s.find(w, i + 1) >= 0 or s.find(w) < i or reverse_complement(w) in s:
                    best = max(best, j - i)
        return best

    got = {r["seq_id"]: r["longest"] for r in rules.longest_repeat(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, dna string")).collect()}
    assert got == {i: plain(s) for i, s in enumerate(seqs)}


def test_tool_board_and_naive(spark):
    table = usage.build_table(spark.createDataFrame([(1, "ATGGCTAAAGGGTAA" * 6)], "seq_id long, dna string"))
    rows = [("k", "Native", "ATGGCTAAATAA"), ("k", "toolA", "ATGGCCAAGTAA"), ("k", "toolB", "ATGGCCTAA"), ("k", "toolC", "ATGGCCAACTAA")]
    got = {r["name"]: r for r in boards.tool_board(spark.createDataFrame(rows, "group string, name string, dna string"), table).collect()}
    assert got["toolA"]["matches_native"] and got["toolA"]["note"] == "" and "length mismatch: 3 aa vs 4 aa" in got["toolB"]["note"] and got["toolC"]["note"] == "residue mismatch"
    assert got["toolA"]["cpg"] == 0 and got["toolA"]["max_homopolymer"] == 3 - 1
    proteins = spark.createDataFrame([(1, "MAK")], "seq_id long, protein string")
    r = boards.against_naive(proteins, boards.naive(proteins), table).first()
    assert r["naive_gc"] == r["design_gc"] and r["naive_length_nt"] == 12
    by = boards.organism_board(proteins, table.withColumn("organism", F.lit("x")).unionByName(table.withColumn("organism", F.lit("y")))).collect()
    assert {r["organism"] for r in by} == {"x", "y"} and len({r["dna"] for r in by}) == 1


def test_direction_check(spark):
    rows = [(i, s, float(v)) for i in range(6) for s, v in (("max", 1 if i else 0), ("min", 0))]
    r = boards.direction_check(spark.createDataFrame(rows, "seq_id long, side string, score double")).first()
    assert tuple(r) == (6, 1, 5, 5, pytest.approx(2 / 32))


# --- models -----------------------------------------------------------------


def test_crosscheck_degrades(spark):
    class Failing:
        name, calibrated, combined = "failing", False, False

        def score_sequence(self, dna):
            if dna.startswith("A"):
                raise RuntimeError("down")
            return np.full(len(dna), 0.6), np.zeros(len(dna))

    seqs = spark.createDataFrame([(1, "ACGT"), (2, "CCCC")], "seq_id long, dna string")
    got = {r["seq_id"]: r for r in models.crosscheck(seqs, Failing()).collect()}
    assert not got[1]["available"] and "down" in got[1]["reason"] and got[1]["sites"] == []
    assert got[2]["available"] and [(s["position"], s["kind"]) for s in got[2]["sites"]] == [(0, "donor")] and got[2]["pooled_risk"] == pytest.approx(3 * np.log(0.6 / 0.4))
    with pytest.raises(ValueError, match="top_k"):
        models.crosscheck(seqs, Failing(), top_k=0)


def test_consensus_backend_equals_the_operator(spark):
    rng = random.Random(5)
    seqs = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((3, 9, 15, 200))], "seq_id long, dna string")
    a = {(r["seq_id"], r["kind"], r["pos"]): r["score"] for r in models.tracks(seqs, models.ConsensusSites()).collect()}
    b = {(r["seq_id"], r["kind"], r["pos"]): r["score"] for r in profiles.both_sites(seqs).collect()}
    assert all(a[k] == pytest.approx(v) for k, v in b.items()) and all(v == 0 for k, v in a.items() if k not in b)
    pooled = {r["seq_id"]: r for r in profiles.pooled_risk(profiles.both_sites(seqs)).collect()}
    for r in profiles.sequence_risk(seqs).collect():
        assert all(r[c] == pytest.approx(pooled[r["seq_id"]][c]) for c in ("risk", "response", "n_above", "top", "n_scored", "below_background"))


def test_rerank_moves_only_for_calibrated_models(spark):
    points = spark.createDataFrame([(1, 0, "A", True), (1, 1, "C", False)], "seq_id long, point int, dna string, is_chosen boolean")

    class Length(models.NoExpression):
        def score_many(self, dna):
            return [float(d == "C") for d in dna]

    for calibrated, chosen in ((False, 0), (True, 1)):
        s = models.expressed(points.select(F.struct("seq_id", "point").alias("seq_id"), "dna"), Length("m", calibrated)).select("seq_id.*", "expression_score", "expression_model", "expression_calibrated", "expression_units")
        assert models.rerank(points, s).where("is_chosen").first()["point"] == chosen


def test_designed_probe_and_attestation(spark):
    members = spark.createDataFrame([("g", "n", "native"), ("g", "a", "designed"), ("g", "b", "designed")], "group string, member_id string, role string")
    risks = spark.createDataFrame([(m, "g", i, r, r - 1, r == 0.0) for m, v in (("x", (1.0, 0.5, 0.0)), ("y", (2.0, 1.0, 1.5))) for i, r in zip("nab", v, strict=True)], "backend string, group string, member_id string, risk double, response double, below_background boolean")
    spread, agreement = models.designed_probe(members, risks)
    got = {r["backend"]: r for r in spread.collect()}
    assert got["x"]["delta_spread"] == 0.5 and got["x"]["n_below_background"] == 1 and got["y"]["n_designs"] == 2
    assert agreement.first()["spearman"] == pytest.approx(-1.0)
    a = models.Attestation("m", "w", "p", "bare", True)
    a.check("m", "w", "p", "bare")
    with pytest.raises(ValueError, match="regime"):
        a.check("m", "w", "p", "flanked")


# --- panels -----------------------------------------------------------------


def test_draw_and_probes(spark):
    rows = [("a", 10), ("a", 12), ("b", 11), ("c", 99), ("", 10), ("x", 10), (None, 10), ("d", 13)]
    df = spark.createDataFrame(rows, "symbol string, length long")
    drawn, tally = panels.draw(df, 2, 1, 5, 50, ["x"])
    assert drawn.count() == 2 and drawn.collect() == panels.draw(df, 2, 1, 5, 50, ["x"])[0].collect()
    assert {r["outcome"]: r["n"] for r in tally.collect()} == {"duplicate_symbol": 1, "length_window": 1, "unnamed": 2, "excluded": 1, "eligible": 3}
    probes = panels.probe_panel(spark, 3)
    assert probes.count() == 9 and probes.collect() == panels.probe_panel(spark, 3).collect()
    s = panels.scrambled(panels.DONOR_PROBE)
    assert sorted(s) == sorted(panels.DONOR_PROBE) and s[3:5] != "GT"
    host = spark.createDataFrame([(1, "GCA" * 20)], "seq_id long, dna string")
    rows = {r["rung"]: r for r in panels.planted(host, {"host": None, "full": "CAGGTAAGT", "stop": "TAAGCAGCA"}, [30]).collect()}
    assert rows["full"]["dna"][30:39] == "CAGGTAAGT" and len(rows["full"]["dna"]) == 60 and rows["stop"]["skipped"] and rows["host"]["dna"] == "GCA" * 20
    with pytest.raises(ValueError, match="frame"):
        panels.planted(host, {"a": None}, [4])


def test_best_baseline(spark):
    panel = spark.createDataFrame([(i, f"g{i % 2}", float(i)) for i in range(8)], "seq_id long, group string, measured double")
    feats = spark.createDataFrame([(i, float(i), 0.0) for i in range(8)], "seq_id long, cai double, constant double")
    got = {r["baseline"]: r["spearman"] for r in panels.best_baseline(panel, feats, "group", ["cai", "constant"]).collect()}
    assert got["cai"] == pytest.approx(1.0) and got["constant"] == 0.0


# --- files ------------------------------------------------------------------


def test_result_json(spark):
    rows = spark.createDataFrame([(1, "MA", "ATGGCCTAA", 0.5, "proven_optimal", 1.5, 0.25, [("homopolymer", "HARD", 0, 5, "x")])], "seq_id long, protein string, dna string, gc double, status string, zeta double, alpha double, violations array<struct<constraint:string,severity:string,start:int,end:int,detail:string>>")
    text = writers.result_json(rows, ["zeta", "alpha"]).first()["json"]
    body = json.loads(text)
    assert json.dumps(body, sort_keys=True, separators=(",", ":")) == text
    assert body["schema_version"] == "1" and list(body["objective"]) == ["alpha", "zeta"] and body["violations"][0]["severity"] == "hard" and body["certificate"]["relaxed_terms"] == [] and body["length_nt"] == 9


def test_genbank_of_designs(spark, tmp_path):
    designs = spark.createDataFrame([(7, "MKKK", "ATGAAAAAAAAATAA", "CCAA", None)], "seq_id long, protein string, dna string, upstream string, downstream string")
    found = rules.validate(designs, [rules.Homopolymer(4), rules.Motifs(("AAAAAA",), False)])
    text = writers.genbank(designs, found).first()["record"]
    (tmp_path / "x.gb").write_text(text)
    r = formats.read_genbank(spark, str(tmp_path / "x.gb")).first()
    spans = {(f["key"], f["start"], f["end"]) for f in r["features"]}
    assert r["sequence"] == "CCAAATGAAAAAAAAATAA" and ("CDS", 4, 19) in spans and ("misc_feature", 0, 4) in spans and ("misc_feature", 7, 16) in spans
    notes = [q["value"] for f in r["features"] for q in f["qualifiers"] if q["name"] == "note"]
    assert any("4 occurrences" in n for n in notes) and "COMMENT" in text


def test_codon_table_round_trip(spark, tmp_path):
    table = usage.build_table(spark.createDataFrame([(1, "ATGGCTAAAGGGTAA" * 6)], "seq_id long, dna string"), 0.0).where("frequency > 0")
    told = writers.write_codon_table(table, str(tmp_path), "x", {"source": "s", "reference_set": "genome_wide"}, 1.0)
    back = formats.read_codon_usage(spark, str(tmp_path / "x.tsv"))
    assert back.count() == 64 and {r["codon"]: r["frequency"] for r in back.collect()}["GCT"] == 7.0 and len(told["sha256"]) == 64
    with pytest.raises(ValueError, match="reserved"):
        writers.write_codon_table(table, str(tmp_path), "x", {"reference_set": "a", "sha256": "b"})


def test_designed_panel(spark, tmp_path):
    rows = [("g", "n", "native", "ATGGCTTAA", ""), ("g", "a", "designed", "ATGGCCTAA", "")]
    schema = "group string, member_id string, role string, cds string, note string"
    writers.write_panel(writers.designed_panel(spark.createDataFrame(rows, schema)).coalesce(1), str(tmp_path / "p"))
    assert formats.read_designed_panel(spark, str(tmp_path / "p")).count() == 2
    with pytest.raises(Exception, match="different proteins"):
        writers.designed_panel(spark.createDataFrame([*rows, ("g", "b", "designed", "ATGAAATAA", "")], schema)).collect()


def test_site_windows(spark, tmp_path):
    import gzip

    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    exons = {"T1": ("+", [(301, 400), (501, 600)]), "T2": ("-", [(1401, 1500), (1601, 1700)]), "T3": ("+", [(2500, 2600)]), "T4": ("+", [(2900, 2950), (2980, 3100)])}
    lines = ["#comment"] + [f'c1\tx\texon\t{a}\t{b}\t.\t{s}\t.\tgene_id "G"; transcript_id "{t}"; gene_name "N{t}"; tag "MANE_Select";' for t, (s, es) in exons.items() for a, b in es]
    lines.append('c1\tx\texon\t1\t9\t.\t+\t.\ttranscript_id "T9"; gene_name "N9";')
    with gzip.open(tmp_path / "a.gtf.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    table = scans.read_gtf_exons(spark, str(tmp_path / "a.gtf.gz"), ["c1"])
    windows, tally = scans.site_windows(table, spark.createDataFrame([("c1", genome)], "chrom string, sequence string"), 50)
    got = {r["window_id"]: r for r in windows.collect()}
    assert set(got) == {"T1", "T2"} and {r["outcome"]: r["n"] for r in tally.collect()} == {"kept": 2, "one_exon": 1, "truncated": 1}
    a, b = got["T1"], got["T2"]
    assert a["sequence"] == genome[250:650] and a["donors"] == [401 - 251] and a["acceptors"] == [500 - 251]
    assert b["sequence"] == reverse_complement(genome[1350:1750]) and b["donors"] == [1750 - 1600] and b["acceptors"] == [1750 - 1501]
    for t in ("T1", "T2"):  # the same bases on either strand's own terms
        assert len(got[t]["sequence"]) == 400


def test_source_lists(spark, tmp_path):
    (tmp_path / "e.txt").write_text("ID   EcoRI\nET   R2\nCR   N\nRS   GAATTC, 1;\n//\nID   BsaI\nET   R2\nCR   N\nRS   GGTCTC, 7; GAGACC, -5;\n//\nID   BsaI\nET   R2\nCR   N\nRS   GAGACC, 7;\n//\nID   M.X\nET   M\nCR   N\nRS   GAATTC, 1;\n//\n")
    catalog, tally = enzymes.select(scans.read_enzyme_records(spark, str(tmp_path / "e.txt")))
    assert {r["enzyme"]: r["site"] for r in catalog.collect()} == {"EcoRI": "GAATTC", "BsaI": "GGTCTC"} and {r["outcome"]: r["n"] for r in tally.collect()} == {"usable": 3, "not_restriction": 1}
    assert enzymes.sites_of(["ecori"], catalog) == {"EcoRI": "GAATTC"}
    with pytest.raises(ValueError, match=r"EcoRI \(GAATTC\)"):
        enzymes.sites_of(["EcoRII"], catalog)
    clash = spark.createDataFrame([(1, "Z", "R2", "N", "GAATTC, 1;"), (2, "Z", "R2", "N", "GGGCCC, 1;")], "line long, id string, type string, suppliers string, site string")
    with pytest.raises(Exception, match="conflicting sites of Z"):
        enzymes.select(clash)[0].collect()
    (tmp_path / "p.txt").write_text("#name: x\n9606.ENSP1\t12.5\n1\t9606.ENSP2\t3\n")
    assert {tuple(r) for r in scans.read_abundance(spark, str(tmp_path / "p.txt")).collect()} == {("ENSP1", 12.5), ("ENSP2", 3.0)}


def test_site_reports(spark):
    good = "Report\n\nPosition(bp)\tPutative site\tScore\tConfidence\n12\tAlt. isoform donor\t5.5\t0.9\n3\tConstitutive acceptor\t7\t0.4\nend of list\n"
    rows = [(1, good, 20), (2, "error page", 20), (3, good, 5), (4, None, 5)]
    got = [tuple(r) for r in scans.site_reports(spark.createDataFrame(rows, "seq_id long, report string, length int")).collect()]
    assert [g[:4] for g in got if g[0] == 1] == [(1, 2, "acceptor", "constitutive"), (1, 11, "donor", "alternative")]
    assert all(f[-1] for f in got if f[0] in (2, 3, 4)) and len(got) == 5


def test_codes_cover_all_codons():
    assert len(usage.CODONS) == 64 and set(usage.CODONS) == set(CODE)
