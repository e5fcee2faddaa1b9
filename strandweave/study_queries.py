"""Registered queries of gates, solvers with budgets, panels, boards and catalogs, with their DuckDB forms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandweave.api import PACKAGING
from strandweave.core import genetic as G
from strandweave.core.session import bounded, checkpoint, read
from strandweave.functions import dna as D
from strandweave.operators import boards, enzymes, etl, metrics, models, panels, profiles, rules, usage
from strandweave.plans import config, solve
from strandweave.queries import _VIOL, CASES, COD, CODE, CURVE, MICRO, PROT, RES, RISK, SEQ, SITES, TAB, _cases, _log_w, _RANKED, gc, km, query, rc
from strandweave.sources import derive, scans

EVT = "evt AS (SELECT event_id AS seq_id, event_type, translate(md5(CAST(event_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS dna FROM events)"


# --- gates ------------------------------------------------------------------

_EVERY = "every AS (SELECT label, predicted, 'overall' AS stratum, \"group\" FROM cases UNION ALL SELECT label, predicted, CAST(stratum AS VARCHAR), \"group\" FROM cases)"


@query(
    "splice_gate",
    f"WITH {CASES}, {_EVERY}, g AS (SELECT stratum, predicted, count(*) AS n, sum(label) AS pos FROM every GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS nt, sum(pos) OVER w AS pt, sum(n) OVER (PARTITION BY stratum) AS nn, sum(pos) OVER (PARTITION BY stratum) AS pp FROM g WINDOW w AS (PARTITION BY stratum ORDER BY predicted DESC)), "
    "a AS (SELECT stratum, any_value(nn)::BIGINT AS n, any_value(pp)::BIGINT AS positives, sum(CASE WHEN pp > 0 THEN pos / pp::DOUBLE * pt / nt ELSE 0 END) AS ap, sum(pos * (nn - pp - (nt - pt)) + pos * (n - pos) * 0.5)::DOUBLE AS wins, sum(pos * greatest(0, least(n, pp - (nt - n))) / n::DOUBLE) / greatest(any_value(pp), 1) AS top_k_accuracy FROM c GROUP BY stratum), "
    "t AS (SELECT stratum, count(*) FILTER (predicted >= 0.5 AND label = 1)::DOUBLE AS tp, count(*) FILTER (predicted >= 0.5 AND label = 0)::DOUBLE AS fp, count(*) FILTER (predicted < 0.5 AND label = 1)::DOUBLE AS fn, count(*) FILTER (predicted < 0.5 AND label = 0)::DOUBLE AS tn, avg(power(predicted - label, 2)) AS brier, avg(label) AS share, count(DISTINCT \"group\") AS groups FROM every GROUP BY stratum), "
    "b AS (SELECT stratum, greatest(0, least(CAST(floor(predicted * 10) AS BIGINT), 9)) AS bin, count(*) AS n, avg(predicted) AS c, avg(label) AS a FROM every GROUP BY ALL), e AS (SELECT stratum, sum(n * abs(c - a)) / sum(n) AS ece FROM b GROUP BY stratum), "
    "m AS (SELECT a.stratum, n, positives, ap AS pr_auc, CASE WHEN positives > 0 AND positives < n THEN (ap - positives / n) / (1 - positives / n) ELSE 0 END AS pr_auc_skill, CASE WHEN positives > 0 AND positives < n THEN wins / (positives * (n - positives)) ELSE 0 END AS roc_auc, top_k_accuracy, "
    "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc, brier, CASE WHEN share * (1 - share) > 0 THEN 1 - brier / (share * (1 - share)) ELSE 0 END AS brier_skill, ece, groups FROM a JOIN t USING (stratum) JOIN e USING (stratum)), "
    "r AS (SELECT *, concat_ws('; ', CASE WHEN positives = 0 OR positives = n THEN 'one class' END, CASE WHEN groups < 2 THEN 'too few groups' END, CASE WHEN pr_auc_skill < 0.5 THEN 'low skill' END) AS reasons FROM m) "
    "SELECT stratum, n, positives, round(pr_auc, 6) AS pr_auc, round(pr_auc_skill, 6) AS pr_auc_skill, round(roc_auc, 6) AS roc_auc, round(top_k_accuracy, 6) AS top_k_accuracy, round(mcc, 6) AS mcc, round(brier, 6) AS brier, round(brier_skill, 6) AS brier_skill, round(ece, 6) AS ece, groups, reasons, reasons = '' AS passed FROM r",
)
def splice_gate(spark, d):
    return metrics.site_gate(_cases(spark, d), "stratum")


@query(
    "expression_gate",
    f"WITH {CASES}, f AS (SELECT \"group\", row_number() OVER (ORDER BY \"group\") <= ceil(0.5 * count(*) OVER ()) AS calibration FROM (SELECT DISTINCT \"group\" FROM cases)), "
    "r AS (SELECT calibration, predicted - avg(predicted) OVER (PARTITION BY \"group\") AS x, measured - avg(measured) OVER (PARTITION BY \"group\") AS y FROM cases JOIN f USING (\"group\")), l AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM r WHERE calibration), "
    "e AS (SELECT calibration, x, y, abs(y - (s * x + i)) AS residual FROM r, l), o AS (SELECT residual, row_number() OVER (ORDER BY residual) AS k, count(*) OVER () AS n FROM e WHERE calibration), q AS (SELECT coalesce(min(residual) FILTER (k >= ceil((n + 1) * 0.9)), 'Infinity'::DOUBLE) AS q FROM o), "
    f"t AS (SELECT avg(CASE WHEN residual <= q THEN 1.0::DOUBLE ELSE 0 END) AS covered, any_value(q) AS q, count(*) AS n_test FROM e, q WHERE NOT calibration), k AS (SELECT {_RANKED.format(k='1', c='x')} AS rx, {_RANKED.format(k='1', c='y')} AS ry FROM r WHERE NOT calibration), s AS (SELECT coalesce(corr(rx, ry), 0) AS spearman FROM k) "
    "SELECT round(covered, 6) AS covered, round(q, 6) AS q, n_test, round(spearman, 6) AS spearman, spearman >= 0.3 AND abs(covered - 0.9) <= 0.1 AS passed FROM t, s",
)
def expression_gate(spark, d):
    return metrics.expression_gate(_cases(spark, d).select("group", "predicted", "measured"))


@query("site_call_spearman", f"WITH {SITES}, k AS (SELECT *, row_number() OVER (PARTITION BY kind, seq_id ORDER BY score DESC, pos) AS r FROM site), c AS (SELECT DISTINCT seq_id, pos FROM k WHERE r <= 3), j AS (SELECT coalesce(a.score, 0) AS x, coalesce(b.score, 0) AS y FROM c LEFT JOIN (FROM site WHERE kind = 'acceptor') a ON a.seq_id = c.seq_id AND a.pos = c.pos LEFT JOIN (FROM site WHERE kind = 'donor') b ON b.seq_id = c.seq_id AND b.pos = c.pos), r AS (SELECT {_RANKED.format(k='1', c='x')} AS rx, {_RANKED.format(k='1', c='y')} AS ry FROM j) SELECT 'acceptor' AS backend_a, 'donor' AS backend_b, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r")
def site_call_spearman(spark, d):
    seqs = derive.dna_doc_spread(spark, d)
    repeated = checkpoint(read(spark, d, "documents").groupBy(F.col("doc_id").alias("seq_id")).count().where("count > 1").select("seq_id"))
    sites = profiles.called_sites(seqs)
    if not repeated.isEmpty():  # calls are made by doc_id: of one with several rows, every position may be asked for
        repeated = bounded(repeated, 100_000)
        sites = profiles.called_sites(seqs.join(repeated, "seq_id", "left_anti")).unionByName(profiles.both_sites(seqs.join(repeated, "seq_id", "left_semi")))
    scores = sites.select(F.col("kind").alias("backend"), F.col("seq_id").alias("window"), "pos", "score")
    return metrics.call_correlation(checkpoint(scores))


@query("group_bootstrap")
def group_bootstrap(spark, d):
    lo, hi = metrics.cluster_bootstrap(_cases(spark, d), lambda c, by: metrics.spearman(c, by, "predicted", "measured").select("spearman"), 40)
    return spark.createDataFrame([(lo, hi)], "low double, high double")


@query("rank_fit")
def rank_fit(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("group"), (F.col("n_chars") % 97).alias("score"))
    seqs = derive.dna_doc(spark, d).select("seq_id", D.gc_fraction(F.col("dna")).alias("gc"), F.length("dna").alias("length_nt"))
    return boards.rank_fit(seqs.join(docs, "seq_id"), "group", "score", ["gc", "length_nt"])


# --- solvers ----------------------------------------------------------------


def _score_sql(state: str, next_state: str, amount: str, most: str, extra: str = "") -> str:
    """The best score by layers, for each state and amount used; no sequence is carried."""
    return f"""dp(seq_id, pos, ctx, used, score) AS (
  SELECT seq_id, 0, '', 0::BIGINT, 0::BIGINT FROM prot
  UNION ALL
  SELECT seq_id, pos + 1, c2, u2, max(s) FROM (
    SELECT dp.seq_id, pos, {next_state} AS c2, used + {amount} AS u2, score + m AS s FROM dp JOIN prot USING (seq_id) JOIN micro ON micro.aa = substr(protein || '*', pos + 1, 1)
    WHERE pos <= length(protein) {extra}) JOIN prot USING (seq_id)
  WHERE u2 <= {most} GROUP BY seq_id, pos + 1, c2, u2)"""


_LOW, _HIGH = "(3 * (length(protein) + 1) * 45) // 100", "(3 * (length(protein) + 1) * 60) // 100"


@query("budget_gc", f"WITH RECURSIVE {MICRO}, {PROT}, {_score_sql('ctx', chr(39) * 2, gc('codon'), _HIGH)}, b AS (SELECT dp.seq_id, max(score) AS score FROM dp JOIN prot USING (seq_id) WHERE pos = length(protein) + 1 AND used >= {_LOW} GROUP BY 1) SELECT seq_id, coalesce(score, 0) AS score, CASE WHEN score IS NULL THEN 'infeasible' ELSE 'proven_optimal' END AS status, score IS NOT NULL AS within FROM prot LEFT JOIN b USING (seq_id)")
def budget_gc(spark, d):
    """Scores and GC counts are taken from the sequences delivered."""
    w = solve.Weights(_log_w(spark, d))
    limits = lambda p: (3 * (len(p) + 1) * 45 // 100, 3 * (len(p) + 1) * 60 // 100)
    return _judged(spark, d, w, lambda p: solve.budgeted(p, w, *limits(p), solve.gc_amount, 0), lambda p, dna: limits(p)[0] <= sum(c in "GC" for c in dna) <= limits(p)[1])


@query("budget_dinuc", f"WITH RECURSIVE {MICRO}, {PROT}, {_score_sql('ctx', 'right(codon, 1)', '(length(ctx || codon) - length(replace(ctx || codon, ' + repr('CG') + ', ' + repr('') + '))) // 2', '1')}, b AS (SELECT dp.seq_id, max(score) AS score FROM dp JOIN prot USING (seq_id) WHERE pos = length(protein) + 1 GROUP BY 1) SELECT seq_id, coalesce(score, 0) AS score, CASE WHEN score IS NULL THEN 'infeasible' ELSE 'proven_optimal' END AS status, score IS NOT NULL AS within FROM prot LEFT JOIN b USING (seq_id)")
def budget_dinuc(spark, d):
    w = solve.Weights(_log_w(spark, d))
    return _judged(spark, d, w, lambda p: solve.budgeted(p, w, 0, 1, solve.pair_amount("CG"), 1), lambda _, dna: dna.count("CG") <= 1)


def _judged(spark, d, weights, solver, within):
    """(seq_id, score, status, within) with the score summed up anew over the delivered sequence; 0 and false without one."""

    def run(protein):
        out = solver(protein)
        good = bool(out.dna) and "".join(G.CODE[out.dna[i : i + 3]] for i in range(0, len(out.dna), 3)) == protein + "*"
        return [solve.Solution("", weights.total(out.dna) if good else 0, out.status, ["within"] if good and within(protein, out.dna) else [])]

    return solve.solve_batch(derive.protein_bench(spark, d), run).select("seq_id", "score", "status", (F.size("culprits") > 0).alias("within"))


_GC_MICRO = f"wmicro AS MATERIALIZED (SELECT a, codon, aa, CAST(round((a * CASE WHEN aa IN ('M', 'W', '*') THEN 0 ELSE ln(w) END - (1 - a) * power({gc('codon')} / 3.0::DOUBLE - 0.5, 2)) * 1000000) AS BIGINT) AS m FROM wtab, (SELECT i / 4.0::DOUBLE AS a FROM range(0, 5) t(i)))"


@query(
    "frontier_scores",
    f"""WITH RECURSIVE {TAB}, {_GC_MICRO}, {PROT}, dp(seq_id, a, pos, ctx, score) AS (
  SELECT seq_id, a, 0, '', 0::BIGINT FROM prot, (SELECT DISTINCT a FROM wmicro)
  UNION ALL
  SELECT seq_id, a, pos + 1, c2, max(s) FROM (
    SELECT dp.seq_id, dp.a, pos, right(ctx || wmicro.codon, 4) AS c2, score + m AS s FROM dp JOIN prot USING (seq_id) JOIN wmicro ON wmicro.a = dp.a AND wmicro.aa = substr(protein || '*', pos + 1, 1)
    WHERE pos <= length(protein) AND NOT regexp_matches(ctx || wmicro.codon, 'AAAAA|CCCCC|GGGGG|TTTTT'))
  GROUP BY seq_id, a, pos + 1, c2)
SELECT dp.seq_id, round(a, 6) AS cai_weight, max(score) AS score FROM dp JOIN prot USING (seq_id) WHERE pos = length(protein) + 1 GROUP BY ALL""",
)
def frontier_scores(spark, d):
    """The best score for each weighting of a frontier, all on one graph of contexts."""
    log_w, rule, grid = _log_w(spark, d), rules.Homopolymer(4), solve.simplex(2, 5)

    def run(protein):
        graph, out = solve.Structure(protein, [rule]), []
        for a, b in grid:
            w = solve.Weights(log_w, a, b)
            out.append(solve.Solution("", w.total(graph.solve(w).dna), f"{a}"))
        return out

    return solve.solve_batch(derive.protein_bench(spark, d), run).select("seq_id", F.col("status").cast("double").alias("cai_weight"), "score")


@query(
    "direction_pairs",
    f"WITH {MICRO}, {RES}, b AS (SELECT aa, arg_max(codon, (m, inv)) AS hi, arg_max(codon, (-m, inv)) AS lo FROM micro GROUP BY aa), x AS (SELECT seq_id, string_agg(hi, '' ORDER BY pos) AS hi, string_agg(lo, '' ORDER BY pos) AS lo FROM res JOIN b USING (aa) GROUP BY seq_id) SELECT seq_id, 'max' AS side, hi AS dna FROM x UNION ALL SELECT seq_id, 'min', lo FROM x",
)
def direction_pairs(spark, d):
    return boards.direction_pairs(derive.protein_bench(spark, d), _log_w(spark, d))


@query("direction_check")
def direction_check(spark, d):
    pairs = boards.direction_pairs(derive.protein_bench(spark, d), _log_w(spark, d))
    scored = profiles.sequence_risk(pairs.select(F.struct("seq_id", "side").alias("seq_id"), "dna"))
    return boards.direction_check(scored.select("seq_id.*", F.col("response").alias("score")))


@query("beam_board")
def beam_board(spark, d):
    w = solve.Weights(_log_w(spark, d), 1.0, 0.5)
    return boards.budget_board(derive.protein_bench(spark, d), w, [rules.Homopolymer(4)], [2, 16])


@query("preset_designs")
def preset_designs(spark, d):
    from strandweave import api

    return api.optimize_config(derive.protein_bench(spark, d), usage.build_table(derive.cds_doc(spark, d)), config.with_preset("mrna_ivt", config.Config(refine_steps=200)))


# --- audits and scores ------------------------------------------------------

_NAMES = ["homopolymer", "gc_run", "forbidden_motif", "internal_start"]


@query("residual_audit", f"WITH {_VIOL}, e AS (SELECT seq_id, unnest({_NAMES}) AS \"constraint\" FROM seqs), n AS (SELECT seq_id, \"constraint\", count(*) AS n FROM viol GROUP BY ALL) SELECT seq_id, \"constraint\", coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'clean' ELSE 'partial' END AS status FROM e LEFT JOIN n USING (seq_id, \"constraint\")")
def residual_audit(spark, d):
    from strandweave.queries import _RULES

    seqs = derive.dna_doc_spread(spark, d)
    return rules.residual_audit(seqs, rules.validate(seqs, _RULES), _NAMES)


@query("seeded_runs", f"WITH {SEQ}, a AS (SELECT seq_id, 'AAAT' || dna AS dna FROM seqs), {km(1, 'k1', 'a')}, r AS (SELECT seq_id, pos, kmer AS key, pos - row_number() OVER (PARTITION BY seq_id, kmer ORDER BY pos) AS isl FROM k1), v AS (SELECT seq_id, min(pos) AS s, max(pos) + 1 AS e FROM r GROUP BY seq_id, key, isl HAVING count(*) > 4) SELECT seq_id, greatest(0, s - 4) AS start, e - 4 AS \"end\", s < 4 AS across FROM v WHERE e > 4")
def seeded_runs(spark, d):
    seqs = derive.dna_doc_spread(spark, d).withColumn("upstream", F.lit("CCGGAAAT"))
    return rules.seeded(rules.Homopolymer(4), seqs).select("seq_id", "start", "end", F.col("detail").endswith("(across the junction)").alias("across"))


@query("longest_repeat")
def longest_repeat(spark, d):
    return rules.longest_repeat(derive.dna_event_spread(spark, d))


@query("pooled_detail", f"WITH {RISK}, c AS (SELECT seq_id, count(*) AS n_scored FROM site GROUP BY 1) SELECT seq_id, round(risk, 6) AS risk, n_scored, n_above, n_above = 0 AS below_background FROM risk JOIN c USING (seq_id)")
def pooled_detail(spark, d):
    return profiles.sequence_risk(derive.dna_doc_spread(spark, d)).select("seq_id", "risk", "n_scored", "n_above", "below_background")


_FLANK = "CCAGGTAAGTAC"


@query(
    "risk_in_context",
    RISK.replace("seqs AS (", "WITH base AS (", 1).replace("), k9 AS", f"), seqs AS (SELECT seq_id, '{_FLANK}' || dna || '{_FLANK}' AS dna FROM base), k9 AS", 1).replace("l AS (SELECT *, ", f"within_ AS (SELECT site.seq_id, pos - {len(_FLANK)} AS pos, kind, score FROM site JOIN base USING (seq_id) WHERE pos >= {len(_FLANK)} AND pos < {len(_FLANK)} + length(base.dna)), l AS (SELECT *, ").replace("AS l FROM site)", "AS l FROM within_)")
    + " SELECT seq_id, round(risk, 6) AS risk, round(response, 6) AS response, n_above FROM risk",
)
def risk_in_context(spark, d):
    seqs = derive.dna_doc_spread(spark, d).withColumn("upstream", F.lit(_FLANK)).withColumn("downstream", F.lit(_FLANK))
    return profiles.risk_in_context(seqs).select("seq_id", "risk", "response", "n_above")


@query(
    "splice_crosscheck",
    RISK.replace("seqs AS (", "WITH seqs AS (", 1).replace("ln(0.01::DOUBLE / 0.99)", "0")
    + ", h AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, kind ORDER BY pos) AS run FROM site WHERE score > 0.5), n AS (SELECT seq_id, count(DISTINCT (kind, run)) AS n FROM h GROUP BY 1) SELECT seqs.seq_id, true AS available, round(coalesce(risk, 0), 6) AS pooled_risk, coalesce(n_above, 0) = 0 AS risk_floored, round(coalesce(top, 0), 6) AS max_site_score, coalesce(n, 0) AS n_sites FROM seqs LEFT JOIN risk USING (seq_id) LEFT JOIN n USING (seq_id)",
)
def splice_crosscheck(spark, d):
    return models.crosscheck(derive.dna_doc_spread(spark, d), models.ConsensusSites()).select("seq_id", "available", "pooled_risk", "risk_floored", "max_site_score", F.size("sites").alias("n_sites"))


@query("packaging_report", f"WITH {SEQ} SELECT seq_id, length(dna) + 8 AS length_nt, {PACKAGING['aav']} AS limit_nt, length(dna) + 8 <= {PACKAGING['aav']} AS fits FROM seqs")
def packaging_report(spark, d):
    from strandweave import api

    return api.packaging(derive.dna_doc(spark, d).withColumn("upstream", F.lit("CCGGAAAT")).withColumn("downstream", F.lit("")))


@query("junction_fold")
def junction_fold(spark, d):
    return models.folded(models.junction_windows(derive.dna_event_spread(spark, d).withColumn("upstream", F.lit("GGGCCCATCG"))))


# --- tables and catalogs ----------------------------------------------------


@query("table_validation", f"WITH {TAB} SELECT count(DISTINCT aa) FILTER (aa <> '*') AS amino_acids, max(CASE WHEN aa = '*' THEN 1 ELSE 0 END) AS has_stop, count(*) FILTER (NOT frequency > 0) AS bad FROM tab")
def table_validation(spark, d):
    return usage.table_issues(usage.build_table(derive.cds_doc(spark, d)))


def _event_table(spark, d):
    return usage.build_table(derive.dna_event(spark, d).select("seq_id", "dna"))


@query("best_codon_changes", f"WITH {TAB}, {EVT}, e AS (SELECT substr(dna, 3 * i + 1, 3) AS codon, count(*) AS n FROM evt, range(0, 10) t(i) GROUP BY 1), other AS (SELECT g.codon, g.aa, coalesce(n, 0) + 1.0::DOUBLE AS frequency FROM code g LEFT JOIN e USING (codon)), top AS (SELECT aa, arg_max(codon, (frequency, translate(codon, 'ACGT', 'TGCA'))) AS codon_a FROM tab GROUP BY aa), top2 AS (SELECT aa, arg_max(codon, (frequency, translate(codon, 'ACGT', 'TGCA'))) AS codon_b FROM other GROUP BY aa) SELECT aa, codon_a, codon_b FROM top JOIN top2 USING (aa) WHERE codon_a <> codon_b")
def best_codon_changes(spark, d):
    return etl.best_codon_changes(usage.build_table(derive.cds_doc(spark, d)), _event_table(spark, d))


@query("enzyme_resolve", "WITH c AS (SELECT n_name AS enzyme, 'GAATTC' AS site FROM nation), w AS (SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT left(n_name, length(n_name) - 1) FROM nation)) SELECT name, coalesce(a.enzyme, b.enzyme) AS enzyme, coalesce(a.site, b.site) AS site, CASE WHEN a.enzyme IS NOT NULL THEN 'exact' WHEN b.enzyme IS NOT NULL THEN 'folded' ELSE 'unknown' END AS outcome FROM w LEFT JOIN c a ON a.enzyme = name LEFT JOIN c b ON lower(b.enzyme) = lower(name)")
def enzyme_resolve(spark, d):
    n = read(spark, d, "nation").select("n_name")
    forms = F.explode(F.array("n_name", F.lower("n_name"), F.expr("left(n_name, length(n_name) - 1)")))
    return enzymes.resolve(n.select(forms.alias("name")), n.select(F.col("n_name").alias("enzyme"), F.lit("GAATTC").alias("site")))


@query("enzyme_suggest", "WITH c AS (SELECT n_name AS enzyme, 'GAATTC' AS site FROM nation), w AS (SELECT DISTINCT left(n_name, length(n_name) - 1) AS name FROM nation), s AS (SELECT name, enzyme, site, 1 - levenshtein(lower(name), lower(enzyme)) / greatest(length(name), length(enzyme))::DOUBLE AS similarity FROM w, c), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, enzyme) AS place FROM s WHERE similarity >= 0.6) SELECT name, enzyme, site, round(similarity, 6) AS similarity, place FROM r WHERE place <= 5")
def enzyme_suggest(spark, d):
    n = read(spark, d, "nation").select("n_name")
    return enzymes.suggest(n.select(F.expr("left(n_name, length(n_name) - 1)").alias("name")), n.select(F.col("n_name").alias("enzyme"), F.lit("GAATTC").alias("site")))


_REC = f"rec AS (SELECT seq_id, CASE WHEN seq_id % 5 = 0 THEN 'M' ELSE 'R2' END AS type, CASE WHEN seq_id % 7 = 0 THEN '.' ELSE 'N' END AS suppliers, CASE seq_id % 11 WHEN 0 THEN '?' WHEN 1 THEN left(dna, 3) || ', 1;' WHEN 2 THEN left(dna, 6) || ', 1; ' || {rc('left(dna, 6)')} || ', -1;' WHEN 3 THEN left(dna, 6) || ', 1; AAAAAA, 2;' WHEN 4 THEN 'XX' || left(dna, 4) || ', 1;' ELSE left(dna, 6) || ', 1;' END AS site FROM evt)"


@query("enzyme_selection", f"WITH {EVT}, {_REC}, o AS (SELECT *, CASE WHEN type = 'M' THEN 'not_restriction' WHEN suppliers = '.' THEN 'not_commercial' WHEN seq_id % 11 = 0 THEN 'site_unknown' WHEN seq_id % 11 = 4 THEN 'site_not_iupac' WHEN seq_id % 11 = 3 AND {rc('left(site, 6)')} <> 'AAAAAA' THEN 'site_multiple' WHEN seq_id % 11 = 1 THEN 'site_length' ELSE 'usable' END AS outcome FROM rec) SELECT outcome, count(*) AS n FROM o GROUP BY 1")
def enzyme_selection(spark, d):
    seqs = derive.dna_event(spark, d).select("seq_id", "dna")
    k, six = F.col("seq_id") % 11, F.left("dna", F.lit(6))
    site = (
        F.when(k == 0, "?").when(k == 1, F.concat(F.left("dna", F.lit(3)), F.lit(", 1;"))).when(k == 2, F.concat(six, F.lit(", 1; "), D.reverse_complement(six), F.lit(", -1;")))
        .when(k == 3, F.concat(six, F.lit(", 1; AAAAAA, 2;"))).when(k == 4, F.concat(F.lit("XX"), F.left("dna", F.lit(4)), F.lit(", 1;"))).otherwise(F.concat(six, F.lit(", 1;")))
    )
    records = seqs.select(F.col("seq_id").alias("line"), F.concat(F.lit("E"), F.col("seq_id").cast("string")).alias("id"), F.when(F.col("seq_id") % 5 == 0, "M").otherwise("R2").alias("type"), F.when(F.col("seq_id") % 7 == 0, ".").otherwise("N").alias("suppliers"), site.alias("site"))
    return enzymes.select(records)[1]


@query("presets", "SELECT * FROM (VALUES " + ", ".join(f"('{p.key}', '{p.regime}', {len(p.overrides)})" for p in config.PRESETS) + ") t(key, regime, n_overrides)")
def presets(spark, d):
    return spark.createDataFrame([(p.key, p.regime, len(p.overrides)) for p in config.PRESETS], "key string, regime string, n_overrides long")


@query("intron_sites", "WITH e AS (SELECT l_orderkey AS transcript, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_linenumber * 1000 AS s, l_linenumber * 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem), n AS (SELECT *, lead(s) OVER (PARTITION BY transcript ORDER BY s, e) AS nx FROM e), i AS (SELECT transcript, strand, e + 1 AS lo, nx - 1 AS hi FROM n WHERE e + 1 <= nx - 1) SELECT transcript, CASE WHEN strand = '+' THEN lo ELSE hi END AS position, 'donor' AS kind FROM i UNION ALL SELECT transcript, CASE WHEN strand = '+' THEN hi ELSE lo END, 'acceptor' FROM i")
def intron_sites(spark, d):
    at = F.col("l_linenumber").cast("long") * 1000
    exons = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("transcript"), F.lit("c").alias("chrom"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), at.alias("start"), (at + F.col("l_quantity").cast("long")).alias("end"))
    return scans.intron_sites(exons).select("transcript", "position", "kind")


# --- panels -----------------------------------------------------------------


@query("panel_summary", "WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups, count(*) FILTER (n >= 2) AS n_rankable, min(n) AS smallest, max(n) AS largest, (SELECT count(DISTINCT lang) FROM documents) AS n_contexts FROM g")
def panel_summary(spark, d):
    return panels.describe(read(spark, d, "documents"), "source", ["lang"]).drop("digest")


@query("panel_overlap", "WITH t AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id)) SELECT d.source AS \"group\", CASE WHEN t.source IS NULL THEN 'held_out' ELSE 'training' END AS overlap FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN t ON t.source = d.source")
def panel_overlap(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    return panels.overlap(docs, docs.join(read(spark, d, "labels"), "doc_id"), "source")


@query("chromosome_names", "WITH x AS (SELECT c_custkey, 'Chr' || (c_custkey % 30) AS name FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 30 BETWEEN 1 AND 22 THEN CAST(c_custkey % 30 AS VARCHAR) END AS chromosome FROM x")
def chromosome_names(spark, d):
    name = F.concat(F.lit("Chr"), (F.col("c_custkey") % 30).cast("string"))
    return read(spark, d, "customer").select("c_custkey", panels.normal_chromosome(name).alias("chromosome"))


_WIN = f"{EVT}, win AS (SELECT seq_id, event_type, dna, seq_id % 31 AS don, (seq_id * 7) % 31 + 1 AS acc FROM evt)"


def _windows(spark, d):
    e = derive.dna_event(spark, d)
    return e.select(F.col("seq_id").alias("window_id"), F.col("event_type").alias("group"), F.col("dna").alias("sequence"), F.array((F.col("seq_id") % 31).cast("int")).alias("donors"), F.array(((F.col("seq_id") * 7) % 31 + 1).cast("int")).alias("acceptors"))


def _window_cases(spark, d):
    e = derive.dna_event(spark, d)
    return panels.site_cases(_windows(spark, d), profiles.both_sites(e).withColumnRenamed("seq_id", "window_id"), {"donor": -1, "acceptor": 1})


_SITE_CASES = f"WITH {_WIN}, seqs AS (SELECT seq_id, dna FROM evt), {SITES.split(', ', 1)[1][SITES.split(', ', 1)[1].index('k9 AS'):]}, p AS (SELECT seq_id, event_type, dna, kind, pos, CASE WHEN kind = 'donor' THEN greatest(don - 1, 0) = pos ELSE least(acc + 1, 31) = pos END AS hit FROM win, (VALUES ('donor'), ('acceptor')) k(kind), range(0, 32) t(pos)), cases AS (SELECT p.seq_id, event_type, p.dna, p.kind, p.pos, CASE WHEN hit THEN 1 ELSE 0 END AS label, coalesce(score, 0) AS predicted FROM p LEFT JOIN site s ON s.seq_id = p.seq_id AND s.kind = p.kind AND s.pos = p.pos)"


@query("site_cases", _SITE_CASES + " SELECT event_type AS \"group\", kind, label, count(*) AS n, round(sum(predicted), 6) AS predicted FROM cases GROUP BY ALL")
def site_cases(spark, d):
    return _window_cases(spark, d).groupBy("group", "kind", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("predicted"))


@query("site_baseline_gt_ag", _SITE_CASES + " SELECT kind, label, count(*) AS n, count(*) FILTER (CASE WHEN kind = 'donor' THEN substr(dna, pos + 1, 2) = 'GT' ELSE pos >= 1 AND substr(dna, pos, 2) = 'AG' END) AS hits FROM cases GROUP BY ALL")
def site_baseline_gt_ag(spark, d):
    rows = panels.site_baseline("gt_ag", _window_cases(spark, d), _windows(spark, d))
    return rows.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").cast("long").alias("hits"))


@query("site_baseline_constant", _SITE_CASES + " SELECT kind, round(avg(label), 6) AS predicted, count(*) AS n FROM cases GROUP BY kind")
def site_baseline_constant(spark, d):
    rows = panels.site_baseline("constant", _window_cases(spark, d), _windows(spark, d))
    return rows.groupBy("kind").agg(F.max("predicted").alias("predicted"), F.count(F.lit(1)).alias("n"))


@query("probe_detection")
def probe_detection(spark, d):
    hosts = derive.dna_event(spark, d).select("seq_id", "dna")
    probes = panels.planted(hosts, {"host": None, "full": panels.DONOR_PROBE, "scrambled": panels.scrambled(panels.DONOR_PROBE)}, [9, 15])
    scored = profiles.site_scores(probes.where("not skipped").select(F.struct("seq_id", "rung", "at").alias("seq_id"), "dna"), "donor").withColumnRenamed("seq_id", "probe")
    return panels.detection(probes, scored, junction=4, window=3)


@query("panel_draw")
def panel_draw(spark, d):
    rows = read(spark, d, "documents").select(F.col("source").alias("symbol"), F.col("n_chars").alias("length"), "doc_id")
    return panels.draw(rows, 5, 7, 100, 5000)[0]


# --- boards -----------------------------------------------------------------


@query(
    "naive_figures",
    f"WITH {TAB}, {RES}, f AS (SELECT aa, min(codon) AS codon FROM code GROUP BY aa), s AS (SELECT seq_id, string_agg(codon, '' ORDER BY pos) AS dna FROM res JOIN f USING (aa) GROUP BY seq_id), c AS (SELECT seq_id, exp(avg(ln(w))) AS cai FROM res JOIN f USING (aa) JOIN wtab ON wtab.codon = f.codon WHERE res.aa NOT IN ('M', 'W', '*') GROUP BY seq_id), "
    f"k AS (SELECT seq_id, i, substr(dna, i + 1, 1) AS b FROM s, range(0, 4000) t(i) WHERE i < length(dna)), r AS (SELECT seq_id, b, i - row_number() OVER (PARTITION BY seq_id, b ORDER BY i) AS isl FROM k), h AS (SELECT seq_id, max(n) AS n FROM (SELECT seq_id, count(*) AS n FROM r GROUP BY seq_id, b, isl) GROUP BY 1) "
    f"SELECT seq_id, length(dna) AS length_nt, round({gc('dna')} / length(dna), 6) AS gc, (length(dna) - length(replace(dna, 'CG', ''))) // 2 AS cpg, h.n AS max_homopolymer, round(coalesce(cai, 1), 6) AS cai FROM s JOIN h USING (seq_id) LEFT JOIN c USING (seq_id)",
)
def naive_figures(spark, d):
    return boards.recomputed(boards.naive(derive.protein_bench(spark, d)), usage.build_table(derive.cds_doc(spark, d))).select("seq_id", "length_nt", "gc", "cpg", "max_homopolymer", "cai")


@query("against_naive")
def against_naive(spark, d):
    proteins, table = derive.protein_bench(spark, d), usage.build_table(derive.cds_doc(spark, d))
    return boards.against_naive(proteins, solve.optimize_local(proteins, {r["codon"]: math.log(r["w"]) for r in table.collect()}), table)


@query("board_spread", "WITH u AS (SELECT lang, 'n_chars' AS metric, n_chars::DOUBLE AS v FROM documents UNION ALL SELECT lang, 'words', CASE WHEN n_chars % 3 = 0 THEN NULL ELSE (n_chars % 11)::DOUBLE END FROM documents) SELECT lang, metric, count(v) AS n, min(v) AS low, max(v) AS high, max(v) - min(v) AS span, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM u GROUP BY ALL")
def board_spread(spark, d):
    rows = read(spark, d, "documents").select("lang", "n_chars", F.when(F.col("n_chars") % 3 == 0, F.lit(None)).otherwise(F.col("n_chars") % 11).alias("words"))
    return boards.spread(rows, ["lang"], ["n_chars", "words"])


@query("dose_response", f"WITH x AS (SELECT source AS seq_id, (n_chars % 41)::DOUBLE AS dose, (n_chars % 97)::DOUBLE AS score FROM documents), r AS (SELECT seq_id, score, {_RANKED.format(k='seq_id', c='dose')} AS rx, {_RANKED.format(k='seq_id', c='score')} AS ry FROM x) SELECT seq_id, count(*) AS n_rungs, round(coalesce(corr(rx, ry), 0), 6) AS spearman, max(score) - min(score) AS score_span FROM r GROUP BY seq_id")
def dose_response(spark, d):
    rows = read(spark, d, "documents").select(F.col("source").alias("seq_id"), F.col("doc_id").cast("string").alias("dna"), (F.col("n_chars") % 41).cast("double").alias("dose"), (F.col("n_chars") % 97).cast("double").alias("score"))
    return boards.dose_response(rows)
