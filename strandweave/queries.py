"""The registered queries of the sequence engine, each with its DuckDB form where SQL can express it.

Queries run over whole tables. Doubles leave rounded to six places and
integers as longs, the same in both engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core import genetic as G
from strandweave.core.session import read
from strandweave.functions import dna as D
from strandweave.operators import etl, metrics, profiles, rules, usage
from strandweave.operators.positions import codons, kmers
from strandweave.plans import solve
from strandweave.sources import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    kinds = {"double": lambda c: F.round(c, 6), "int": lambda c: c.cast("long")}
    return df.select(*[kinds.get(t, lambda c: c)(F.col(c)).alias(c) for c, t in df.dtypes])


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


# --- DuckDB building blocks -------------------------------------------------

SEQ = "seqs AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS dna FROM documents WHERE regexp_matches(text, '[ACGTacgt]'))"
CDS = SEQ + ", cds AS (SELECT seq_id, left(dna, length(dna) - length(dna) % 3) AS dna FROM seqs WHERE length(dna) >= 3)"
CODE = "code(codon, aa) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in sorted(G.CODE.items())) + ")"
COD = CDS + ", " + CODE + ", cod AS (SELECT seq_id, i AS cpos, substr(dna, 3 * i + 1, 3) AS codon, aa FROM (SELECT seq_id, dna, unnest(range(0, length(dna) // 3)) AS i FROM cds) JOIN code ON code.codon = substr(dna, 3 * i + 1, 3))"
TAB = COD + ", tab AS (SELECT g.codon, g.aa, coalesce(n, 0) + 1.0::DOUBLE AS frequency FROM code g LEFT JOIN (SELECT codon, count(*) AS n FROM cod GROUP BY 1) c ON c.codon = g.codon), wtab AS (SELECT *, frequency / max(frequency) OVER (PARTITION BY aa) AS w FROM tab)"


def km(k: int, name: str | None = None, source: str = "seqs") -> str:
    return f"{name or f'k{k}'} AS (SELECT seq_id, i AS pos, substr(dna, i + 1, {k}) AS kmer FROM (SELECT seq_id, dna, unnest(range(0, length(dna) - {k - 1})) AS i FROM {source} WHERE length(dna) >= {k}))"


def gc(x: str) -> str:
    return f"(length({x}) - length(translate({x}, 'GC', '')))"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


# --- projections and validation ---------------------------------------------


@query("codon_usage", f"WITH {TAB} SELECT codon, aa, round(frequency, 6) AS frequency, round(w, 6) AS w FROM wtab")
def codon_usage(spark, d):
    return usage.build_table(derive.cds_doc_spread(spark, d))


@query("gc_content", f"WITH {SEQ} SELECT seq_id, length(dna) AS length_nt, {gc('dna')} AS gc_count, round({gc('dna')} / length(dna), 6) AS gc FROM seqs")
def gc_content(spark, d):
    x = F.col("dna")
    return derive.dna_doc(spark, d).select("seq_id", F.length(x).alias("length_nt"), D.gc_count(x).alias("gc_count"), D.gc_fraction(x).alias("gc"))


@query("revcomp", f"WITH {SEQ} SELECT seq_id, {rc('dna')} AS rc FROM seqs")
def revcomp(spark, d):
    return derive.dna_doc(spark, d).select("seq_id", D.reverse_complement(F.col("dna")).alias("rc"))


@query("translate_seq", f"WITH {COD} SELECT seq_id, string_agg(aa, '' ORDER BY cpos) AS protein FROM cod GROUP BY seq_id")
def translate_seq(spark, d):
    return usage.translated(derive.cds_doc(spark, d))


@query("gc3", f"WITH {COD} SELECT seq_id, round(avg(CASE WHEN substr(codon, 3, 1) IN ('G', 'C') THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS gc3 FROM cod GROUP BY seq_id")
def gc3(spark, d):
    third = F.regexp_replace("dna", "..(.)", "$1")
    return derive.cds_doc(spark, d).select("seq_id", D.gc_fraction(third).alias("gc3"))


@query("scored_codons", f"WITH {COD} SELECT seq_id, count(*) AS n_codons, count(*) FILTER (aa NOT IN ('M', 'W', '*')) AS n_scored FROM cod GROUP BY seq_id")
def scored_codons(spark, d):
    return usage.codon_numbers(derive.cds_doc(spark, d))


@query("synonymous_codons", f"WITH {CODE} SELECT aa, string_agg(codon, ',' ORDER BY codon) AS codons, count(*) AS n FROM code GROUP BY aa")
def synonymous_codons(spark, d):
    return G.code_table(spark).groupBy("aa").agg(F.array_join(F.array_sort(F.collect_list("codon")), ",").alias("codons"), F.count(F.lit(1)).alias("n"))


@query("validate_letters", "WITH t AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS x FROM benchmark), c AS (SELECT item_id, unnest(string_split(upper(trim(x)), '')) AS ch FROM t) SELECT t.item_id, coalesce((SELECT string_agg(ch, '' ORDER BY ch) FROM (SELECT DISTINCT ch FROM c WHERE c.item_id = t.item_id AND ch NOT IN ('A', 'C', 'G', 'T', ''))), '') AS bad FROM t")
def validate_letters(spark, d):
    x = F.regexp_replace("text", "[^ -~]", "")
    return read(spark, d, "benchmark").select("item_id", D.bad_letters(x, "ACGT").alias("bad"))


@query(
    "valid_cds_reasons",
    f"WITH {SEQ}, r AS (SELECT CASE WHEN NOT regexp_full_match(dna, '[ACGT]+') THEN 'non_acgt' WHEN length(dna) % 3 <> 0 THEN 'not_multiple_of_three' WHEN left(dna, 3) <> 'ATG' THEN 'no_start' WHEN right(dna, 3) NOT IN ('TAA', 'TAG', 'TGA') THEN 'no_stop' WHEN regexp_matches(regexp_replace(substr(dna, 4, greatest(length(dna) - 6, 0)), '(...)', '\\1 ', 'g'), '(^| )(TAA|TAG|TGA) ') THEN 'internal_stop' ELSE 'valid' END AS reason FROM seqs) SELECT reason, count(*) AS n FROM r GROUP BY reason",
)
def valid_cds_reasons(spark, d):
    return etl.reason_tally(derive.dna_doc(spark, d))


PROT = "prot AS (SELECT item_id AS seq_id, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS protein FROM benchmark)"
RES = PROT + ", res AS (SELECT seq_id, i AS pos, substr(protein || '*', i + 1, 1) AS aa FROM (SELECT seq_id, protein, unnest(range(0, length(protein) + 1)) AS i FROM prot))"


@query("naive_backtranslate", f"WITH {RES}, {CODE}, f AS (SELECT aa, min(codon) AS codon FROM code GROUP BY aa) SELECT seq_id, string_agg(codon, '' ORDER BY pos) AS dna FROM res JOIN f USING (aa) GROUP BY seq_id")
def naive_backtranslate(spark, d):
    return solve.optimize_local(derive.protein_bench(spark, d), dict.fromkeys(G.CODE, 0.0))


@query("dinuc_counts", f"WITH {SEQ}, {km(2)} SELECT kmer, count(*) AS n FROM k2 GROUP BY kmer")
def dinuc_counts(spark, d):
    return usage.count_words(derive.dna_doc(spark, d), 2)


@query("base_composition", f"WITH {SEQ}, {km(1)} SELECT seq_id, kmer AS base, count(*) AS n FROM k1 GROUP BY ALL")
def base_composition(spark, d):
    x = F.col("dna")
    bases = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), D.count_of(x, b).alias("n")) for b in "ACGT"]))
    return derive.dna_doc(spark, d).select("seq_id", bases.alias("b")).select("seq_id", "b.base", "b.n").where("n > 0")


@query("fasta_wrap", f"WITH {SEQ} SELECT seq_id, '>' || seq_id || chr(10) || regexp_replace(regexp_replace(dna, '(.{{60}})', '\\1' || chr(10), 'g'), '\\n$', '') AS record FROM seqs")
def fasta_wrap(spark, d):
    return derive.dna_doc(spark, d).select("seq_id", F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), D.wrap(F.col("dna"))).alias("record"))


@query("context_windows", f"WITH {SEQ} SELECT seq_id, left(dna, 48) AS five_prime, right(left(dna, 60), 45) || substr(dna, 61, 48) AS junction, regexp_extract('ACGNN' || left(dna, 9), '[^N]*$') AS upstream FROM seqs")
def context_windows(spark, d):
    x = F.col("dna")
    return derive.dna_doc(spark, d).select("seq_id", F.left(x, F.lit(48)).alias("five_prime"), F.concat(F.right(F.left(x, F.lit(60)), F.lit(45)), F.substring(x, 61, 48)).alias("junction"), D.clean_upstream(F.concat(F.lit("ACGNN"), F.left(x, F.lit(9)))).alias("upstream"))


# --- usage and scores -------------------------------------------------------


@query("cai", f"WITH {TAB}, s AS (SELECT seq_id, exp(avg(ln(w))) AS cai, count(*) AS n FROM cod JOIN wtab USING (codon) WHERE cod.aa NOT IN ('M', 'W', '*') GROUP BY seq_id) SELECT cds.seq_id, round(coalesce(cai, 1.0), 6) AS \"index\", coalesce(n, 0) AS n_scored FROM cds LEFT JOIN s USING (seq_id)")
def cai(spark, d):
    seqs = derive.cds_doc_spread(spark, d)
    return usage.adaptation_index(seqs, usage.build_table(seqs))


TRNA = "trna AS (SELECT left(translate(md5(CAST(event_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 3) AS anticodon, count(*) AS n FROM events GROUP BY 1)"


def _trna(spark, d) -> DataFrame:
    """Anticodon copies from the first three bases of the event sequences."""
    return derive.dna_event(spark, d).groupBy(F.left("dna", F.lit(3)).alias("anticodon")).agg(F.count(F.lit(1)).alias("count"))


TAI = f"""{TRNA}, t AS (SELECT codon, aa, coalesce(n, 0)::DOUBLE AS t FROM code LEFT JOIN trna ON anticodon = {rc('codon')}),
b AS (SELECT left(codon, 2) AS b2, max(t) FILTER (right(codon, 1) = 'T') AS t, max(t) FILTER (right(codon, 1) = 'C') AS c, max(t) FILTER (right(codon, 1) = 'A') AS a, max(t) FILTER (right(codon, 1) = 'G') AS g FROM t GROUP BY 1),
r AS (SELECT code.codon, CASE right(code.codon, 1) WHEN 'T' THEN b.t + (1 - 0.41) * c WHEN 'C' THEN c + (1 - 0.28) * b.t WHEN 'A' THEN a + (1 - 0.9999) * b.t ELSE g + (1 - 0.68) * a END AS v FROM code JOIN b ON b2 = left(code.codon, 2) WHERE aa <> '*' AND code.codon <> 'ATG'),
s AS (SELECT codon, v / max(v) OVER () AS v FROM r), m AS (SELECT exp(avg(ln(v))) AS mean FROM s WHERE v > 0), taiw AS (SELECT codon, CASE WHEN v > 0 THEN v ELSE mean END AS w FROM s, m)"""


@query("tai_weights", f"WITH {CODE}, {TAI} SELECT codon, round(w, 6) AS w FROM taiw")
def tai_weights(spark, d):
    return usage.tai_weights(_trna(spark, d))


@query("tai", f"WITH {COD}, {TAI}, x AS (SELECT seq_id, exp(avg(ln(w))) AS i, count(*) AS n FROM cod JOIN taiw USING (codon) GROUP BY seq_id) SELECT cds.seq_id, round(coalesce(i, 1.0), 6) AS \"index\", coalesce(n, 0) AS n_scored FROM cds LEFT JOIN x USING (seq_id)")
def tai(spark, d):
    return usage.adaptation_index(derive.cds_doc_spread(spark, d), usage.tai_weights(_trna(spark, d)), ("M", "*"))


CPS = COD + """, pr AS (SELECT codon AS ca, aa AS x, lead(codon) OVER w AS cb, lead(aa) OVER w AS y FROM cod WINDOW w AS (PARTITION BY seq_id ORDER BY cpos)),
one AS (SELECT codon, aa, count(*) AS n FROM cod WHERE aa <> '*' GROUP BY ALL), fam AS (SELECT aa, sum(n) AS n FROM one GROUP BY aa),
ab AS (SELECT ca, cb, x, y, count(*) AS n FROM pr WHERE cb IS NOT NULL AND x <> '*' AND y <> '*' GROUP BY ALL), xy AS (SELECT x, y, sum(n) AS n FROM ab GROUP BY ALL),
cps AS (SELECT ab.ca AS codon_a, ab.cb AS codon_b, ln((ab.n + 1.0) / (((a.n + 1.0) * (b.n + 1.0)) / ((fx.n + 1.0) * (fy.n + 1.0)) * (xy.n + 1.0))::DOUBLE) AS cps FROM ab JOIN one a ON a.codon = ca JOIN one b ON b.codon = cb JOIN fam fx ON fx.aa = ab.x JOIN fam fy ON fy.aa = ab.y JOIN xy ON xy.x = ab.x AND xy.y = ab.y)"""
CPS = CPS.replace("(ab.n + 1.0)", "(ab.n + 1.0::DOUBLE)").replace("((a.n + 1.0)", "((a.n + 1.0::DOUBLE)")


@query("codon_pair_scores", f"WITH {CPS} SELECT codon_a, codon_b, round(cps, 6) AS cps FROM cps")
def codon_pair_scores(spark, d):
    return usage.codon_pair_scores(derive.cds_doc(spark, d))


@query("codon_pair_total", f"WITH {CPS}, q AS (SELECT seq_id, codon AS ca, lead(codon) OVER (PARTITION BY seq_id ORDER BY cpos) AS cb FROM cod) SELECT seq_id, round(coalesce(sum(cps), 0), 6) AS total FROM q LEFT JOIN cps ON codon_a = ca AND codon_b = cb GROUP BY seq_id")
def codon_pair_total(spark, d):
    seqs = derive.cds_doc_spread(spark, d)
    return usage.codon_pair_total(seqs, usage.codon_pair_scores(seqs))


@query(
    "additive_terms",
    f"WITH {TAB}, f AS (SELECT *, frequency / sum(frequency) OVER (PARTITION BY aa) AS share FROM wtab), o AS (SELECT *, share - avg(share) OVER (PARTITION BY aa) AS above FROM f) "
    f"SELECT seq_id, round(sum(CASE WHEN cod.aa IN ('M', 'W', '*') THEN 0 ELSE ln(w) END), 6) AS cai_logw, round(sum(-power({gc('codon')} / 3.0::DOUBLE - 0.5, 2)), 6) AS gc_proximity, round(sum(CASE WHEN cod.aa IN ('M', 'W', '*') THEN 0 ELSE above END), 6) AS minmax, "
    "round(sum(CASE WHEN cod.aa IN ('M', 'W', '*') THEN 0 ELSE -w * greatest(0.0, 1 - cpos / 35.0::DOUBLE) END), 6) AS ramp FROM cod JOIN o USING (codon) GROUP BY seq_id",
)
def additive_terms(spark, d):
    seqs = derive.cds_doc_spread(spark, d)
    return usage.additive_terms(seqs, usage.build_table(seqs))


# --- profiles ---------------------------------------------------------------


@query("gc_profile", f"WITH {SEQ}, {km(50)} SELECT seq_id, pos, round({gc('kmer')} / 50.0::DOUBLE, 6) AS value FROM k50")
def gc_profile(spark, d):
    return profiles.gc_profile(derive.dna_doc_spread(spark, d), 50)


@query("cpg_profile", f"WITH {SEQ}, {km(50)} SELECT seq_id, pos, CAST((50 - length(replace(kmer, 'CG', ''))) // 2 AS BIGINT) AS n, round((50 - length(replace(kmer, 'CG', ''))) / 2 / 49.0::DOUBLE, 6) AS density FROM k50")
def cpg_profile(spark, d):
    return profiles.dinucleotide_profile(derive.dna_doc_spread(spark, d), "CG", 50)


@query("upa_density", f"WITH {SEQ}, {km(30)} SELECT seq_id, pos, CAST((30 - length(replace(kmer, 'TA', ''))) // 2 AS BIGINT) AS n, round((30 - length(replace(kmer, 'TA', ''))) / 2 / 29.0::DOUBLE, 6) AS density FROM k30")
def upa_density(spark, d):
    return profiles.dinucleotide_profile(derive.dna_doc_spread(spark, d), "TA", 30)


@query(
    "minmax_profile",
    f"WITH {TAB}, f AS (SELECT codon, frequency AS a, avg(frequency) OVER w AS v, max(frequency) OVER w AS x, min(frequency) OVER w AS m FROM tab WINDOW w AS (PARTITION BY aa)), "
    "s AS (SELECT seq_id, cpos, sum(a) OVER w AS a, sum(v) OVER w AS v, sum(x) OVER w AS x, sum(m) OVER w AS m, count(*) OVER w AS n FROM cod JOIN f USING (codon) WINDOW w AS (PARTITION BY seq_id ORDER BY cpos ROWS BETWEEN CURRENT ROW AND 17 FOLLOWING)) "
    "SELECT seq_id, cpos, round(CASE WHEN a > v THEN CASE WHEN x <> v THEN 100 * (a - v) / (x - v) ELSE 0 END ELSE CASE WHEN v <> m THEN -100 * (v - a) / (v - m) ELSE 0 END END, 4) AS value FROM s WHERE n = 18",
)
def minmax_profile(spark, d):
    seqs = derive.cds_doc_spread(spark, d)
    return profiles.minmax_profile(seqs, usage.build_table(seqs)).withColumn("value", F.round("value", 4))


def _pwm_sql(table) -> str:
    terms = [f"CASE substr(kmer, {i + 1}, 1) " + " ".join(f"WHEN '{b}' THEN {o!r}::DOUBLE" for b, o in odds.items()) + " END" for i, odds in enumerate(G.pwm_log_odds(table))]
    return f"1 / (1 + exp(-({' + '.join(terms)})))"


SITES = f"{SEQ}, {km(9)}, {km(15)}, site AS (SELECT seq_id, pos + 3 AS pos, 'donor' AS kind, {_pwm_sql(G.DONOR)} AS score FROM k9 UNION ALL SELECT seq_id, pos + 13, 'acceptor', {_pwm_sql(G.ACCEPTOR)} FROM k15)"


@query("pwm_donor", f"WITH {SITES} SELECT seq_id, pos, round(score, 6) AS score FROM site WHERE kind = 'donor'")
def pwm_donor(spark, d):
    return profiles.site_scores(derive.dna_doc_spread(spark, d), "donor")


@query("pwm_acceptor", f"WITH {SITES} SELECT seq_id, pos, round(score, 6) AS score FROM site WHERE kind = 'acceptor'")
def pwm_acceptor(spark, d):
    return profiles.site_scores(derive.dna_doc_spread(spark, d), "acceptor")


@query(
    "track_summary",
    f"WITH {SEQ}, {km(50)}, t AS (SELECT seq_id, 'gc' AS track, {gc('kmer')} / 50.0::DOUBLE AS value FROM k50 UNION ALL SELECT seq_id, 'cpg', (50 - length(replace(kmer, 'CG', ''))) / 2 / 49.0::DOUBLE FROM k50) "
    "SELECT seq_id, track, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM t GROUP BY ALL",
)
def track_summary(spark, d):
    seqs = derive.dna_doc_spread(spark, d)
    g = profiles.gc_profile(seqs).select("seq_id", F.lit("gc").alias("track"), "value")
    c = profiles.dinucleotide_profile(seqs).select("seq_id", F.lit("cpg").alias("track"), F.col("density").alias("value"))
    return g.union(c).groupBy("seq_id", "track").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


# --- rules ------------------------------------------------------------------

_V = ("seq_id", "start", "end")


def _rule_query(name: str, rule, sql: str):
    QUERIES[name] = lambda spark, d: tidy(rule.violations(derive.dna_doc_spread(spark, d)).select(*_V))
    ORACLES[name] = sql


def _runs_sql(key: str, where: str, most: int) -> str:
    return f"WITH {SEQ}, {km(1)}, r AS (SELECT seq_id, pos, {key} AS key, pos - row_number() OVER (PARTITION BY seq_id, {key} ORDER BY pos) AS isl FROM k1 WHERE {where}) SELECT seq_id, min(pos) AS start, max(pos) + 1 AS \"end\" FROM r GROUP BY seq_id, key, isl HAVING count(*) > {most}"


_rule_query("homopolymer", rules.Homopolymer(4), _runs_sql("kmer", "true", 4))
_rule_query("gc_run", rules.GcRun(6), _runs_sql("'S'", "kmer IN ('G', 'C')", 6))
_rule_query("gc_window", rules.GcWindow(40, 0.3, 0.7), f"WITH {SEQ}, {km(40)} SELECT seq_id, pos AS start, pos + 40 AS \"end\" FROM k40 WHERE {gc('kmer')} NOT BETWEEN 12 AND 28")

_MOTIFS = tuple(G.motifs_of(["poly_a_signal", "tata_box", "telomere_repeat"]))


def _motif_sql(motifs) -> str:
    sizes = sorted({len(m) for m in motifs})
    hits = " UNION ALL ".join(f"SELECT seq_id, pos AS start, pos + {len(m)} AS \"end\" FROM k{len(m)} WHERE regexp_full_match(kmer, '{G.iupac_regex(m)}')" for m in motifs)
    return f"WITH {SEQ}, {', '.join(km(s) for s in sizes)} {hits}"


_ENZYMES = {"EcoRI": "GAATTC", "HinfI": "GANTC", "BsaI": "GGTCTC", "DdeI": "CTNAG"}
_rule_query("forbidden_motif", rules.Motifs(_MOTIFS), _motif_sql(G.with_reverse(_MOTIFS)))
_rule_query("restriction_site", rules.restriction_sites(_ENZYMES), _motif_sql(G.with_reverse(_ENZYMES.values())))
_rule_query("splice_motif", rules.splice_sites(), _motif_sql(["GTRAGT", "YYYYYYNYAGG"]))
_rule_query("tandem_repeat", rules.TandemRepeat(2, 3), f"WITH {SEQ}, {km(6)} SELECT seq_id, pos AS start, pos + 6 AS \"end\" FROM k6 WHERE kmer = repeat(left(kmer, 2), 3)")
_rule_query("inverted_repeat", rules.InvertedRepeat(6, 8), f"WITH {SEQ}, x AS (SELECT seq_id, dna, unnest(range(0, length(dna) - 11)) AS i FROM seqs WHERE length(dna) >= 12), y AS (SELECT *, unnest(range(0, 9)) AS g FROM x) SELECT seq_id, i AS start, i + 12 + g AS \"end\" FROM y WHERE i + 12 + g <= length(dna) AND substr(dna, i + 7 + g, 6) = {rc('substr(dna, i + 1, 6)')}")
_rule_query("internal_start", rules.InternalStart(), f"WITH {SEQ}, {km(7)} SELECT seq_id, pos + 3 AS start, pos + 6 AS \"end\" FROM k7 WHERE substr(kmer, 4, 3) = 'ATG' AND left(kmer, 1) IN ('A', 'G') AND right(kmer, 1) = 'G'")
_rule_query(
    "polya_signal", rules.PolyaSignal(),
    f"WITH {SEQ}, h AS (SELECT seq_id, dna, unnest(range(0, length(dna) - 5)) AS i FROM seqs WHERE length(dna) >= 6), g AS (SELECT * FROM h WHERE substr(dna, i + 1, 6) IN ('AATAAA', 'ATTAAA')), s AS (SELECT *, unnest(range(i + 16, least(i + 46, length(dna)) - 9)) AS s FROM g), "
    "w AS (SELECT *, substr(dna, s + 1, 10) AS win FROM s) SELECT seq_id, i AS start, min(s) + 10 AS \"end\" FROM w WHERE 10 - length(translate(win, 'T', '')) >= 6 OR (10 - length(translate(win, 'T', '')) >= 3 AND 10 - length(translate(win, 'GT', '')) >= 8) GROUP BY seq_id, i",
)
UORF = f"{SEQ}, {km(3)}, c AS (SELECT seq_id, pos, kmer FROM k3 WHERE kmer IN ('ATG', 'TAA', 'TAG', 'TGA')), n AS (SELECT *, min(CASE WHEN kmer <> 'ATG' THEN pos END) OVER (PARTITION BY seq_id, pos % 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM c)"
_rule_query("uorf", rules.Uorf(), f"WITH {UORF} SELECT seq_id, pos AS start, stop + 3 AS \"end\" FROM n WHERE kmer = 'ATG' AND stop IS NOT NULL AND pos >= 3 AND pos < 100 AND pos % 3 <> 0")
_rule_query("max_repeat", rules.MaxRepeat(11), f"WITH {SEQ}, {km(12)}, s AS (SELECT DISTINCT seq_id, kmer FROM k12), d AS (SELECT *, count(*) OVER (PARTITION BY seq_id, kmer) AS n FROM k12) SELECT d.seq_id, pos AS start, pos + 12 AS \"end\" FROM d LEFT JOIN s ON s.seq_id = d.seq_id AND s.kmer = {rc('d.kmer')} WHERE n > 1 OR s.kmer IS NOT NULL")

_RULES = [rules.Homopolymer(4), rules.GcRun(6), rules.Motifs(_MOTIFS), rules.InternalStart()]
_VIOL = (
    f"{SEQ}, {km(1)}, {km(6)}, {km(7)}, r AS (SELECT seq_id, pos, kmer AS key, 'homopolymer' AS c, pos - row_number() OVER (PARTITION BY seq_id, kmer ORDER BY pos) AS isl FROM k1 UNION ALL SELECT seq_id, pos, 'S', 'gc_run', pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) FROM k1 WHERE kmer IN ('G', 'C')), "
    "viol AS (SELECT seq_id, c AS \"constraint\", min(pos) AS start, max(pos) + 1 AS \"end\" FROM r GROUP BY seq_id, key, c, isl HAVING count(*) > CASE c WHEN 'homopolymer' THEN 4 ELSE 6 END UNION ALL "
    + " UNION ALL ".join(f"SELECT seq_id, 'forbidden_motif', pos, pos + 6 FROM k6 WHERE kmer = '{m}'" for m in G.with_reverse(_MOTIFS))
    + " UNION ALL SELECT seq_id, 'internal_start', pos + 3, pos + 6 FROM k7 WHERE substr(kmer, 4, 3) = 'ATG' AND left(kmer, 1) IN ('A', 'G') AND right(kmer, 1) = 'G')"
)


@query("violation_summary", f"WITH {_VIOL} SELECT s.seq_id, count(*) FILTER (\"constraint\" <> 'internal_start') AS hard, count(*) FILTER (\"constraint\" = 'internal_start') AS soft FROM seqs s LEFT JOIN viol v ON v.seq_id = s.seq_id GROUP BY s.seq_id")
def violation_summary(spark, d):
    seqs = derive.dna_doc_spread(spark, d)
    return rules.counts(seqs, rules.soften(rules.validate(seqs, _RULES), ["internal_start"]))


@query("violation_totals", f"WITH {_VIOL} SELECT \"constraint\", count(*) AS n, count(DISTINCT seq_id) AS sequences FROM viol GROUP BY 1")
def violation_totals(spark, d):
    return rules.validate(derive.dna_doc_spread(spark, d), _RULES).groupBy("constraint").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq_id").alias("sequences"))


@query("masked_audit", f"WITH {_VIOL} SELECT seq_id, \"constraint\", start, \"end\" FROM viol WHERE NOT (start >= 0 AND \"end\" <= 60) AND NOT (start >= 90 AND \"end\" <= 150)")
def masked_audit(spark, d):
    seqs = derive.dna_doc_spread(spark, d)
    masks = seqs.select("seq_id", F.explode(F.expr("array(struct(0 as s, 60 as e), struct(90 as s, 150 as e))")).alias("m")).select("seq_id", F.col("m.s").alias("mask_start"), F.col("m.e").alias("mask_end"))
    return rules.unmasked(rules.validate(seqs, _RULES), masks).select("seq_id", "constraint", "start", "end")


@query(
    "merged_spans",
    f"WITH {_VIOL}, b AS (SELECT *, max(\"end\") OVER (PARTITION BY seq_id, \"constraint\" ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe, row_number() OVER (PARTITION BY seq_id, \"constraint\" ORDER BY start, \"end\") AS rn FROM viol), "
    "i AS (SELECT *, sum(CASE WHEN pe IS NULL OR start > pe THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id, \"constraint\" ORDER BY rn) AS isl FROM b) SELECT seq_id, \"constraint\", min(start) AS start, max(\"end\") AS \"end\", count(*) AS n FROM i GROUP BY seq_id, \"constraint\", isl",
)
def merged_spans(spark, d):
    return rules.merged(rules.validate(derive.dna_doc_spread(spark, d), _RULES)).select("seq_id", "constraint", "start", "end", "n")


@query("construct_audit", f"WITH {SEQ}, a AS (SELECT seq_id, 'CCGGAAAT' || dna AS dna FROM seqs), {km(6, 'k6', 'a')} SELECT seq_id, greatest(0, pos - 8) AS start, pos - 2 AS \"end\" FROM k6 WHERE kmer IN ({', '.join(repr(m) for m in G.with_reverse(_MOTIFS))}) AND pos + 6 > 8")
def construct_audit(spark, d):
    seqs = derive.dna_doc_spread(spark, d).withColumn("upstream", F.lit("CCGGAAAT"))
    return rules.seeded(rules.Motifs(_MOTIFS), seqs).select("seq_id", "start", "end")


@query("enzyme_uniqueness", f"WITH {SEQ}, {km(5)}, {km(6)}, h AS (" + " UNION ALL ".join(f"SELECT seq_id, pos, '{n}' AS enzyme FROM k{len(s)} WHERE " + " OR ".join(f"regexp_full_match(kmer, '{G.iupac_regex(m)}')" for m in G.with_reverse([s])) for n, s in _ENZYMES.items()) + ") SELECT enzyme, seq_id, count(*) AS sites, count(*) = 1 AS is_unique FROM h GROUP BY ALL")
def enzyme_uniqueness(spark, d):
    found = rules.validate(derive.dna_doc_spread(spark, d), [rules.Motifs((site,), True, name) for name, site in sorted(_ENZYMES.items())])
    out = found.groupBy(F.col("constraint").alias("enzyme"), "seq_id").agg(F.count_distinct("start").alias("sites"))
    return out.withColumn("is_unique", F.col("sites") == 1)


@query("longest_runs", f"WITH {SEQ}, {km(1)}, r AS (SELECT seq_id, kmer, pos - row_number() OVER (PARTITION BY seq_id, kmer ORDER BY pos) AS isl FROM k1), h AS (SELECT seq_id, count(*) AS n FROM r GROUP BY seq_id, kmer, isl) SELECT seq_id, max(n) AS longest FROM h GROUP BY seq_id")
def longest_runs(spark, d):
    lengths = F.transform(F.split(F.regexp_replace("dna", r"([ACGT])(?!\1)", "$1 "), " "), lambda p: F.length(p))
    return derive.dna_doc(spark, d).select("seq_id", F.array_max(lengths).alias("longest"))


@query("tandem_span", f"WITH {SEQ}, p AS (SELECT seq_id, dna, unnest(range(1, 7)) AS p FROM seqs), x AS (SELECT seq_id, dna, p, unnest(range(0, greatest(length(dna) - p, 0))) AS i FROM p), e AS (SELECT seq_id, p, i FROM x WHERE substr(dna, i + 1, 1) = substr(dna, i + p + 1, 1)), r AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id, p ORDER BY i) AS isl FROM e), s AS (SELECT seq_id, p, count(*) + p AS span FROM r GROUP BY seq_id, p, isl) SELECT s.seq_id, max(span) AS span FROM s WHERE span >= 2 * p GROUP BY s.seq_id")
def tandem_span(spark, d):
    return rules.tandem_span(derive.dna_doc_spread(spark, d))


# --- sites ------------------------------------------------------------------


@query("splice_sites_nms", f"WITH {SITES}, h AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, kind ORDER BY pos) AS run FROM site WHERE score > 0.01), b AS (SELECT *, row_number() OVER (PARTITION BY seq_id, kind, run ORDER BY score DESC, pos) AS r FROM h) SELECT seq_id, kind, pos, round(score, 6) AS score FROM b WHERE r = 1")
def splice_sites_nms(spark, d):
    return profiles.peaks(profiles.both_sites(derive.dna_doc_spread(spark, d)), 0.01)


_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, score)) / (1 - greatest(1e-6, least(1 - 1e-6, score))))"
RISK = f"{SITES}, l AS (SELECT *, {_LOGIT} AS l FROM site), k AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY l DESC, pos, kind) AS r FROM l), risk AS (SELECT seq_id, sum(greatest(0, l - ln(0.01::DOUBLE / 0.99))) FILTER (r <= 3) AS risk, sum(l) FILTER (r <= 3) AS response, count(*) FILTER (l > ln(0.01::DOUBLE / 0.99)) AS n_above, max(score) AS top FROM k GROUP BY seq_id)"


@query("pooled_risk", f"WITH {RISK} SELECT seq_id, round(risk, 6) AS risk, round(response, 6) AS response, n_above, round(top, 6) AS top FROM risk")
def pooled_risk(spark, d):
    return profiles.sequence_risk(derive.dna_doc_spread(spark, d)).select("seq_id", "risk", "response", "n_above", "top")


@query("delta_splicing", RISK.replace("seqs AS (", "WITH base AS (", 1).replace("), k9 AS", "), seqs AS (SELECT seq_id * 2 AS seq_id, dna FROM base UNION ALL SELECT seq_id * 2 + 1, reverse(translate(dna, 'ACGT', 'TGCA')) FROM base), k9 AS", 1) + " SELECT a.seq_id // 2 AS seq_id, round(b.risk - a.risk, 6) AS delta FROM risk a JOIN risk b ON b.seq_id = a.seq_id + 1 WHERE a.seq_id % 2 = 0")
def delta_splicing(spark, d):
    seqs = derive.dna_doc_spread(spark, d)
    risk = lambda x, n: profiles.sequence_risk(x).select("seq_id", F.col("risk").alias(n))
    own, other = risk(seqs, "a"), risk(seqs.withColumn("dna", D.reverse_complement(F.col("dna"))), "b")
    return own.join(other, "seq_id").select("seq_id", (F.col("b") - F.col("a")).alias("delta"))


@query("cooccurrence", f"WITH {SITES}, h AS (SELECT DISTINCT seq_id, kind, pos FROM site WHERE score > 0.02) SELECT seq_id, kind, pos, EXISTS (SELECT 1 FROM h o WHERE o.seq_id = h.seq_id AND o.kind <> h.kind AND abs(o.pos - h.pos) <= 3) AS supported FROM h")
def cooccurrence(spark, d):
    """Band join by buckets of the band's width: each call meets only calls of its own and the neighbouring buckets."""
    h = profiles.both_sites(derive.dna_doc_spread(spark, d)).where("score > 0.02").select("seq_id", "kind", "pos").distinct()
    near = h.select("seq_id", F.col("kind").alias("other"), F.col("pos").alias("at"), F.explode(F.sequence(F.floor(F.col("pos") / 4) - 1, F.floor(F.col("pos") / 4) + 1)).alias("bucket"))
    own = h.withColumn("bucket", F.floor(F.col("pos") / 4))
    hit = own.join(near, ["seq_id", "bucket"]).where((F.col("kind") != F.col("other")) & (F.abs(F.col("pos") - F.col("at")) <= 3)).select("seq_id", "kind", "pos").distinct().withColumn("hit", F.lit(True))
    return h.join(hit, ["seq_id", "kind", "pos"], "left").select("seq_id", "kind", "pos", F.coalesce("hit", F.lit(False)).alias("supported"))


@query("site_call_agreement", f"WITH {SITES}, k AS (SELECT *, row_number() OVER (PARTITION BY kind, seq_id ORDER BY score DESC, pos) AS r FROM site), c AS (SELECT kind, seq_id, pos FROM k WHERE r <= 3), j AS (SELECT a.pos AS a, b.pos AS b FROM (FROM c WHERE kind = 'acceptor') a FULL JOIN (FROM c WHERE kind = 'donor') b ON a.seq_id = b.seq_id AND a.pos = b.pos) SELECT 'acceptor' AS backend_a, 'donor' AS backend_b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS \"both\", count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*), 6) AS jaccard FROM j")
def site_call_agreement(spark, d):
    return metrics.call_agreement(profiles.both_sites(derive.dna_doc_spread(spark, d)).select(F.col("kind").alias("backend"), F.col("seq_id").alias("window"), "pos", "score"))


# --- metrics ----------------------------------------------------------------

CASES = 'cases AS (SELECT l.toxic AS label, round((d.n_chars % 97) / 100.0::DOUBLE, 4) AS predicted, d.lang AS stratum, d.source AS "group", (d.n_chars % 53)::DOUBLE AS measured FROM labels l JOIN documents d ON d.doc_id = l.doc_id)'


def _cases(spark, d) -> DataFrame:
    """Labelled cases with a score that ties often; strata are languages, groups are sources."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return read(spark, d, "labels").join(docs, "doc_id").select(
        F.col("toxic").alias("label"), F.round((F.col("n_chars") % 97) / F.lit(100.0), 4).alias("predicted"), F.col("lang").alias("stratum"), F.col("source").alias("group"), (F.col("n_chars") % 53).cast("double").alias("measured")
    )


CURVE = CASES + ", g AS (SELECT stratum, predicted, count(*) AS n, sum(label) AS pos FROM cases GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS nt, sum(pos) OVER w AS pt, sum(n) OVER (PARTITION BY stratum) AS nn, sum(pos) OVER (PARTITION BY stratum) AS pp FROM g WINDOW w AS (PARTITION BY stratum ORDER BY predicted DESC))"


@query("pr_auc", f"WITH {CURVE}, a AS (SELECT stratum, any_value(nn)::BIGINT AS n, any_value(pp)::BIGINT AS positives, sum(CASE WHEN pp > 0 THEN pos / pp::DOUBLE * pt / nt ELSE 0 END) AS ap FROM c GROUP BY stratum) SELECT stratum, n, positives, round(ap, 6) AS pr_auc, round(CASE WHEN positives > 0 AND positives < n THEN (ap - positives / n) / (1 - positives / n) ELSE 0 END, 6) AS pr_auc_skill FROM a")
def pr_auc(spark, d):
    return metrics.ranking_metrics(_cases(spark, d), ["stratum"]).select("stratum", "n", "positives", "pr_auc", "pr_auc_skill")


@query("roc_auc", f"WITH {CASES}, r AS (SELECT stratum, label, rank() OVER (PARTITION BY stratum ORDER BY predicted) + (count(*) OVER (PARTITION BY stratum, predicted) - 1) / 2.0::DOUBLE AS rk FROM cases), s AS (SELECT stratum, sum(rk) FILTER (label = 1) AS sr, sum(label) AS p, count(*) - sum(label) AS q FROM r GROUP BY stratum) SELECT stratum, round(CASE WHEN p > 0 AND q > 0 THEN (sr - p * (p + 1) / 2.0) / (p * q) ELSE 0 END, 6) AS roc_auc FROM s")
def roc_auc(spark, d):
    return metrics.ranking_metrics(_cases(spark, d), ["stratum"]).select("stratum", "roc_auc")


@query("top_k_accuracy", f"WITH {CURVE} SELECT stratum, round(sum(pos * greatest(0, least(n, pp - (nt - n))) / n::DOUBLE) / greatest(any_value(pp), 1), 6) AS top_k_accuracy FROM c GROUP BY stratum")
def top_k_accuracy(spark, d):
    return metrics.ranking_metrics(_cases(spark, d), ["stratum"]).select("stratum", "top_k_accuracy")


@query("mcc_brier", f"WITH {CASES}, s AS (SELECT stratum, count(*) FILTER (predicted >= 0.5 AND label = 1)::DOUBLE AS tp, count(*) FILTER (predicted >= 0.5 AND label = 0)::DOUBLE AS fp, count(*) FILTER (predicted < 0.5 AND label = 1)::DOUBLE AS fn, count(*) FILTER (predicted < 0.5 AND label = 0)::DOUBLE AS tn, avg(power(predicted - label, 2)) AS brier, avg(label) AS share FROM cases GROUP BY stratum) SELECT stratum, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc, round(brier, 6) AS brier, round(CASE WHEN share * (1 - share) > 0 THEN 1 - brier / (share * (1 - share)) ELSE 0 END, 6) AS brier_skill FROM s")
def mcc_brier(spark, d):
    return metrics.threshold_metrics(_cases(spark, d), ["stratum"])


_BIN = "greatest(0, least(CAST(floor(predicted * 10) AS BIGINT), 9))"


@query("reliability_bins", f"WITH {CASES} SELECT stratum, {_BIN} AS bin, count(*) AS n, round(avg(predicted), 6) AS confidence, round(avg(label), 6) AS accuracy FROM cases GROUP BY ALL")
def reliability_bins(spark, d):
    return metrics.reliability(_cases(spark, d), ["stratum"])


@query("ece", f"WITH {CASES}, b AS (SELECT stratum, {_BIN} AS bin, count(*) AS n, avg(predicted) AS c, avg(label) AS a FROM cases GROUP BY ALL) SELECT stratum, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b GROUP BY stratum")
def ece(spark, d):
    return metrics.calibration_error(_cases(spark, d), ["stratum"])


@query("spearman", f"WITH {CASES}, r AS (SELECT stratum, rank() OVER (PARTITION BY stratum ORDER BY predicted) + (count(*) OVER (PARTITION BY stratum, predicted) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY stratum ORDER BY measured) + (count(*) OVER (PARTITION BY stratum, measured) - 1) / 2.0::DOUBLE AS y FROM cases) SELECT stratum, round(coalesce(corr(x, y), 0), 6) AS spearman, count(*) AS n FROM r GROUP BY stratum")
def spearman(spark, d):
    return metrics.spearman(_cases(spark, d), ["stratum"], "predicted", "measured")


@query("r2_fit", f"WITH {CASES}, m AS (SELECT *, avg(measured) OVER (PARTITION BY stratum) AS m FROM cases) SELECT stratum, round(regr_slope(measured, predicted), 6) AS slope, round(regr_intercept(measured, predicted), 6) AS intercept, round(1 - sum(power(measured - predicted, 2)) / sum(power(measured - m, 2)), 6) AS r2 FROM m GROUP BY stratum")
def r2_fit(spark, d):
    return metrics.regression(_cases(spark, d), ["stratum"])


@query("iqr_conformal", f"WITH {CASES}, e AS (SELECT stratum, abs(measured - predicted) AS residual FROM cases), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY residual) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM e), q AS (SELECT stratum, any_value(n) AS n, coalesce(min(residual) FILTER (r >= ceil((n + 1) * 0.9)), 'Infinity'::DOUBLE) AS q FROM o GROUP BY stratum) SELECT q.stratum, q.n, round(q.q, 6) AS q, round(avg(CASE WHEN residual <= q.q THEN 1.0::DOUBLE ELSE 0 END), 6) AS covered, round(quantile_cont(residual, 0.75) - quantile_cont(residual, 0.25), 6) AS iqr FROM q JOIN e USING (stratum) GROUP BY ALL")
def iqr_conformal(spark, d):
    e = _cases(spark, d).withColumn("residual", F.abs(F.col("measured") - F.col("predicted")))
    return metrics.conformal(e, ["stratum"], "residual").join(metrics.quartile_range(e, ["stratum"], "residual"), "stratum")


@query("group_spread", f"WITH {CASES}, g AS (SELECT \"group\", count(*) AS n, avg(measured) AS mean, stddev_samp(measured) AS sd, stddev_pop(measured) AS sdp, max(measured) - min(measured) AS span FROM cases GROUP BY 1) SELECT \"group\", n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sdp, 6) AS sdp, round(span, 6) AS span FROM g")
def group_spread(spark, d):
    m = F.col("measured")
    return _cases(spark, d).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("sd"), F.stddev_pop(m).alias("sdp"), (F.max(m) - F.min(m)).alias("span"))


# --- reference-data pipelines -----------------------------------------------


@query("representative_per_gene", "SELECT o_custkey, o_orderkey, o_orderpriority, round(o_totalprice, 6) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def representative_per_gene(spark, d):
    return etl.representatives(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice")


@query("top_n_abundance", "SELECT o_custkey, round(max(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY 1 ORDER BY max(o_totalprice) DESC, o_custkey LIMIT 50")
def top_n_abundance(spark, d):
    return etl.top_by_abundance(read(spark, d, "orders"), "o_custkey", "o_totalprice", 50)


IDS = "known AS (SELECT 'G' || (c_custkey // 2) || CASE WHEN c_custkey % 4 = 0 THEN '.' || (c_custkey % 5) ELSE '' END AS id, c_mktsegment AS gene FROM customer), wanted AS (SELECT DISTINCT 'G' || (o_custkey * 3 // 4) || CASE WHEN o_orderkey % 2 = 0 THEN '.' || (o_orderkey % 5) ELSE '' END AS id FROM orders)"


@query("id_resolution", f"WITH {IDS}, o AS (SELECT id, count(DISTINCT gene) AS g, min(gene) AS gene FROM known GROUP BY id), b AS (SELECT regexp_replace(id, '\\.[0-9]+$', '') AS bare, count(DISTINCT gene) AS bg, min(gene) AS bgene FROM known GROUP BY 1), x AS (SELECT w.id, gene, bgene, CASE WHEN g > 1 THEN 'ambiguous' WHEN g = 1 THEN 'exact' WHEN bg = 1 THEN 'unversioned' WHEN bg > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome FROM wanted w LEFT JOIN o ON o.id = w.id LEFT JOIN b ON b.bare = regexp_replace(w.id, '\\.[0-9]+$', '')) SELECT id, CASE outcome WHEN 'exact' THEN gene WHEN 'unversioned' THEN bgene END AS resolved, outcome FROM x")
def id_resolution(spark, d):
    """Ids of the customers, two to a gene name and some with a version, resolved for those that the orders name."""
    tag = lambda n, v, m: F.concat(F.lit("G"), F.floor(n).cast("long").cast("string"), F.when(v % m == 0, F.concat(F.lit("."), (v % 5).cast("string"))).otherwise(""))
    known = read(spark, d, "customer").select(tag(F.col("c_custkey") / 2, F.col("c_custkey"), 4).alias("id"), F.col("c_mktsegment").alias("gene"))
    wanted = read(spark, d, "orders").select(tag(F.col("o_custkey") * 3 / 4, F.col("o_orderkey"), 2).alias("id")).distinct()
    return etl.resolve_ids(wanted, known)


@query("anticodon_counts", f"WITH {TRNA} SELECT anticodon, n FROM trna")
def anticodon_counts(spark, d):
    return _trna(spark, d).withColumnRenamed("count", "n")


@query("introns_from_exons", "WITH e AS (SELECT l_orderkey AS transcript, l_linenumber * 1000 AS s, l_linenumber * 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem), n AS (SELECT *, lead(s) OVER (PARTITION BY transcript ORDER BY s, e) AS nx FROM e) SELECT transcript, e AS intron_start, nx AS intron_end FROM n WHERE nx > e")
def introns_from_exons(spark, d):
    at = F.col("l_linenumber").cast("long") * 1000
    return etl.introns(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("transcript"), at.alias("start"), (at + F.col("l_quantity").cast("long")).alias("end")))


_HALF = "sum(('0x' || substr(h, {i}, 12))::HUGEINT)"


@query("content_hash", f"WITH r AS (SELECT sha256(concat_ws(chr(9), CAST(item_id AS VARCHAR), text)) AS h FROM benchmark), s AS (SELECT count(*) AS n, {_HALF.format(i=1)} AS a, {_HALF.format(i=13)} AS b FROM r) SELECT n AS n_rows, sha256(concat_ws(':', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS digest FROM s")
def content_hash(spark, d):
    return etl.content_hash(read(spark, d, "benchmark"), ["item_id", "text"])


# --- solvers ----------------------------------------------------------------


def _log_w(spark, d) -> dict[str, float]:
    """ln w of the 64 codons, from the documents' own usage."""
    return {r["codon"]: math.log(r["w"]) for r in usage.build_table(derive.cds_doc(spark, d)).collect()}


MICRO = f"{TAB}, micro AS MATERIALIZED (SELECT codon, aa, CASE WHEN aa IN ('M', 'W', '*') THEN 0 ELSE CAST(round(ln(w) * 1000000) AS BIGINT) END AS m, translate(codon, 'ACGT', 'TGCA') AS inv FROM wtab)"


@query("optimize_local", f"WITH {MICRO}, {RES}, best AS (SELECT aa, arg_max(codon, (m, inv)) AS codon FROM micro GROUP BY aa) SELECT seq_id, string_agg(codon, '' ORDER BY pos) AS dna FROM res JOIN best USING (aa) GROUP BY seq_id")
def optimize_local(spark, d):
    return solve.optimize_local(derive.protein_bench(spark, d), _log_w(spark, d))


_TRELLIS = f"""WITH RECURSIVE {MICRO}, {PROT}, dp(seq_id, pos, ctx, score, dna) AS (
  SELECT seq_id, 0, '', 0::BIGINT, '' FROM prot
  UNION ALL
  SELECT seq_id, pos + 1, right(d2, 3), max(s), arg_max(d2, (s, translate(d2, 'ACGT', 'TGCA'))) FROM (
    SELECT dp.seq_id, pos, dna || codon AS d2, score + m AS s FROM dp JOIN prot USING (seq_id) JOIN micro ON micro.aa = substr(protein || '*', pos + 1, 1)
    WHERE pos <= length(protein) AND NOT regexp_matches(right(dna, 3) || codon, 'AAAA|CCCC|GGGG|TTTT'))
  GROUP BY seq_id, pos + 1, right(d2, 3))
SELECT seq_id, arg_max(dna, (score, translate(dna, 'ACGT', 'TGCA'))) AS dna, max(score) AS score FROM dp JOIN prot USING (seq_id) WHERE pos = length(protein) + 1 GROUP BY seq_id"""


@query("optimize_trellis", _TRELLIS)
def optimize_trellis(spark, d):
    w, rule = solve.Weights(_log_w(spark, d)), rules.Homopolymer(3)
    return solve.solve_batch(derive.protein_bench(spark, d), lambda p: [solve.trellis(p, w, [rule])]).where("dna is not null").select("seq_id", "dna", "score")


_BEAM = f"""WITH RECURSIVE {TAB}, bm AS MATERIALIZED (SELECT codon, aa, CAST(round((CASE WHEN aa IN ('M', 'W', '*') THEN 0 ELSE ln(w) END - 0.5 * power({gc('codon')} / 3.0::DOUBLE - 0.5, 2)) * 1000000) AS BIGINT) AS m FROM wtab), {PROT}, dp(seq_id, pos, score, dna, cut) AS (
  SELECT seq_id, 0, 0::BIGINT, '', false FROM prot
  UNION ALL
  SELECT seq_id, p, score, dna, cut FROM (
    SELECT seq_id, p, score, dna, c OR count(*) OVER (PARTITION BY seq_id) > 16 AS cut, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, dna) AS r FROM (
      SELECT seq_id, pos + 1 AS p, max(s) AS score, arg_max(d2, (s, translate(d2, 'ACGT', 'TGCA'))) AS dna, bool_or(cut) AS c FROM (
        SELECT dp.seq_id, pos, dna || codon AS d2, score + m AS s, cut FROM dp JOIN prot USING (seq_id) JOIN bm ON bm.aa = substr(protein || '*', pos + 1, 1)
        WHERE pos <= length(protein) AND NOT regexp_matches(right(dna, 5) || codon, 'AAAAA|CCCCC|GGGGG|TTTTT|GAATTC'))
      GROUP BY seq_id, pos + 1, right(d2, 5)))
  WHERE r <= 16)
SELECT seq_id, arg_max(dna, (score, translate(dna, 'ACGT', 'TGCA'))) AS dna, max(score) AS score, CASE WHEN bool_or(cut) THEN 'beam_truncated' ELSE 'proven_optimal' END AS status FROM dp JOIN prot USING (seq_id) WHERE pos = length(protein) + 1 GROUP BY seq_id"""


@query("optimize_beam", _BEAM)
def optimize_beam(spark, d):
    w, rs = solve.Weights(_log_w(spark, d), 1.0, 0.5), [rules.Homopolymer(4), rules.Motifs(("GAATTC",))]
    return solve.solve_batch(derive.protein_bench(spark, d), lambda p: [solve.relaxing(p, w, rs, 16)]).select("seq_id", "dna", "score", "status")


_FRONTIER = f"""WITH RECURSIVE {TAB}, wm AS MATERIALIZED (SELECT i, codon, aa, CAST(round((i / 4.0::DOUBLE * CASE WHEN aa IN ('M', 'W', '*') THEN 0 ELSE ln(w) END - (1 - i / 4.0::DOUBLE) * power({gc('codon')} / 3.0::DOUBLE - 0.5, 2)) * 1000000) AS BIGINT) AS m FROM wtab, range(0, 5) t(i)), {PROT}, dp(seq_id, i, pos, score, dna) AS (
  SELECT seq_id, i, 0, 0::BIGINT, '' FROM prot, range(0, 5) t(i)
  UNION ALL
  SELECT seq_id, i, pos + 1, max(s), arg_max(d2, (s, translate(d2, 'ACGT', 'TGCA'))) FROM (
    SELECT dp.seq_id, dp.i, pos, dna || codon AS d2, score + m AS s FROM dp JOIN prot USING (seq_id) JOIN wm ON wm.i = dp.i AND wm.aa = substr(protein || '*', pos + 1, 1)
    WHERE pos <= length(protein) AND NOT regexp_matches(right(dna, 4) || codon, 'AAAAA|CCCCC|GGGGG|TTTTT'))
  GROUP BY seq_id, i, pos + 1, right(d2, 4)),
best AS (SELECT seq_id, i, arg_max(dna, (score, translate(dna, 'ACGT', 'TGCA'))) AS dna FROM dp JOIN prot USING (seq_id) WHERE pos = length(protein) + 1 GROUP BY seq_id, i),
pt AS (SELECT seq_id, dna, min(i) AS point FROM best GROUP BY seq_id, dna),
x AS (SELECT seq_id, dna, any_value(point) AS point, round(sum(CASE WHEN wtab.aa IN ('M', 'W', '*') THEN 0 ELSE ln(w) END), 9) AS cai_logw, round(sum(-power({gc('codon')} / 3.0::DOUBLE - 0.5, 2)), 9) AS gc_proximity FROM (SELECT *, unnest(range(0, length(dna) // 3)) AS k FROM pt) JOIN wtab ON codon = substr(dna, 3 * k + 1, 3) GROUP BY seq_id, dna),
f AS (SELECT *, NOT EXISTS (SELECT 1 FROM x q WHERE q.seq_id = x.seq_id AND q.cai_logw >= x.cai_logw AND q.gc_proximity >= x.gc_proximity AND (q.cai_logw > x.cai_logw OR q.gc_proximity > x.gc_proximity)) AS is_front FROM x)
SELECT seq_id, dna, point, round(cai_logw, 6) AS cai_logw, round(gc_proximity, 6) AS gc_proximity, is_front, row_number() OVER (PARTITION BY seq_id ORDER BY is_front DESC, cai_logw DESC, dna) = 1 AS is_chosen FROM f"""


@query("frontier", _FRONTIER)
def frontier(spark, d):
    return solve.frontier(derive.protein_bench(spark, d), _log_w(spark, d), [rules.Homopolymer(4)])


@query("refine")
def refine(spark, d):
    w, whole = solve.Weights(_log_w(spark, d)), [rules.MaxRepeat(7), rules.Uorf()]

    def run(p):
        best = solve.trellis(p, w, [rules.Homopolymer(5)])
        return [solve.refine(best.dna, w, [rules.Homopolymer(5)], whole, 1)] if best.dna else [best]

    return solve.solve_batch(derive.protein_bench(spark, d), run).drop("point")


@query("library_diversity")
def library_diversity(spark, d):
    use = {c: math.exp(v) for c, v in _log_w(spark, d).items()}
    made = solve.solve_batch(derive.protein_bench(spark, d), lambda p: [solve.Solution(x, 0, "sampled") for x in solve.sample(p, use, [rules.Homopolymer(5)], 6, 11)])
    return solve.mean_hamming(made)


@query("pareto_front", "WITH p AS (SELECT s_nationkey AS seq_id, s_suppkey AS dna, round(s_acctbal) AS a, (s_suppkey * 37 % 101)::DOUBLE AS b FROM supplier) SELECT seq_id, dna, a, b, NOT EXISTS (SELECT 1 FROM p q WHERE q.seq_id = p.seq_id AND q.a >= p.a AND q.b >= p.b AND (q.a > p.a OR q.b > p.b)) AS is_front FROM p")
def pareto_front(spark, d):
    p = read(spark, d, "supplier").select(F.col("s_nationkey").alias("seq_id"), F.col("s_suppkey").alias("dna"), F.round("s_acctbal").alias("a"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("b"))
    return solve.pareto(p, ["seq_id"], ["a", "b"]).drop("is_chosen")


@query("hamming_by_counts", "WITH s AS (SELECT event_id, event_type, translate(md5(CAST(event_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS dna FROM events), x AS (SELECT event_type, i, substr(dna, i + 1, 1) AS b, count(*) AS n FROM (SELECT *, unnest(range(0, 32)) AS i FROM s) GROUP BY ALL), y AS (SELECT event_type, i, sum(n) * sum(n) - sum(n * n) AS d, sum(n) AS n FROM x GROUP BY ALL), z AS (SELECT event_type, sum(d / 2.0::DOUBLE) / (count(*) * (max(n) * (max(n) - 1) / 2.0::DOUBLE)) AS h FROM y GROUP BY 1), m AS (SELECT event_type, count(*) AS members, count(DISTINCT dna) AS distinct_members FROM s GROUP BY 1) SELECT event_type AS seq_id, members, distinct_members, round(h, 6) AS mean_hamming FROM z JOIN m USING (event_type)")
def hamming_by_counts(spark, d):
    return solve.mean_hamming(derive.dna_event(spark, d).select(F.col("event_type").alias("seq_id"), "dna"))


@query("fold_proxy")
def fold_proxy(spark, d):
    return solve.solve_batch(derive.protein_bench(spark, d), lambda p: [solve.Solution("", round(solve.fold_proxy(solve.trellis(p, solve.Weights(dict.fromkeys(G.CODE, 0.0))).dna, 48) * 1000), "scored")]).select("seq_id", "score")


@query("simplex_grid", "SELECT i AS point, round(i / 10.0::DOUBLE, 6) AS a, round(1 - i / 10.0::DOUBLE, 6) AS b FROM (SELECT unnest(range(0, 11)) AS i)")
def simplex_grid(spark, d):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(solve.simplex(2, 11))], "point long, a double, b double")


# --- studies ----------------------------------------------------------------

from strandweave.operators import studies  # noqa: E402

_HIGH = "sites0 AS (SELECT seq_id, kind, pos FROM site WHERE score > 0.05)"


def _sites(spark, d):
    seqs = derive.dna_doc_spread(spark, d)
    scores = profiles.both_sites(seqs)
    return seqs, scores, scores.where("score > 0.05").select("seq_id", "kind", "pos")


@query("motif_consistency", f"WITH {SITES}, {_HIGH}, {km(2)}, o AS (SELECT *, unnest(range(-3, 4)) AS \"offset\" FROM sites0 WHERE kind = 'donor') SELECT \"offset\", round(count(k2.pos) / count(*), 6) AS share, count(*) AS n FROM o LEFT JOIN k2 ON k2.seq_id = o.seq_id AND k2.pos = o.pos + \"offset\" AND k2.kmer = 'GT' GROUP BY 1")
def motif_consistency(spark, d):
    seqs, _, sites = _sites(spark, d)
    return studies.motif_consistency(sites.where("kind = 'donor'"), seqs)


@query("alignment_probe", f"WITH {SITES}, {_HIGH}, o AS (SELECT *, unnest(range(-5, 6)) AS \"offset\" FROM sites0), m AS (SELECT o.kind, \"offset\", round(avg(coalesce(score, 0)), 9) AS mean FROM o LEFT JOIN site s ON s.seq_id = o.seq_id AND s.kind = o.kind AND s.pos = o.pos + \"offset\" GROUP BY ALL) SELECT kind, arg_max(\"offset\", (mean, -abs(\"offset\"), -\"offset\")) AS \"offset\", round(max(mean), 6) AS mean FROM m GROUP BY kind")
def alignment_probe(spark, d):
    _, scores, sites = _sites(spark, d)
    return studies.alignment_probe(sites, scores)


_DELTAS = "deltas AS (SELECT 'p' AS backend, doc_id AS \"case\", (n_chars % 97 - 48)::DOUBLE AS delta FROM documents UNION ALL SELECT 'q', doc_id, (n_chars % 53 - 26)::DOUBLE FROM documents UNION ALL SELECT 'r', doc_id, (n_chars % 194 - 97)::DOUBLE FROM documents)"


def _deltas(spark, d):
    n = F.col("n_chars")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("backend"), v.cast("double").alias("delta")) for b, v in (("p", n % 97 - 48), ("q", n % 53 - 26), ("r", n % 194 - 97))])).alias("e")
    return read(spark, d, "documents").select(F.col("doc_id").alias("case"), F.col("source").alias("group"), "n_chars", each).select("e.backend", "case", "e.delta", "group", "n_chars")


_RANKED = "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0::DOUBLE"


@query("backend_agreement", f"WITH {_DELTAS}, j AS (SELECT x.backend AS a, y.backend AS b, x.delta AS x, y.delta AS y FROM deltas x JOIN deltas y ON x.\"case\" = y.\"case\" AND x.backend < y.backend), r AS (SELECT a, b, {_RANKED.format(k='a, b', c='x')} AS rx, {_RANKED.format(k='a, b', c='y')} AS ry, sign(x) = sign(y) AS s FROM j) SELECT a, b, round(corr(rx, ry), 6) AS spearman, count(*) AS n, round(avg(CASE WHEN s THEN 1.0::DOUBLE ELSE 0 END), 6) AS sign_agreement FROM r GROUP BY ALL")
def backend_agreement(spark, d):
    return studies.delta_agreement(_deltas(spark, d).select("backend", "case", "delta"))


@query("context_stability", f"WITH {_DELTAS}, j AS (SELECT source AS g, x.backend AS a, y.backend AS b, x.delta AS x, y.delta AS y FROM deltas x JOIN deltas y ON x.\"case\" = y.\"case\" AND x.backend < y.backend JOIN documents ON doc_id = x.\"case\"), r AS (SELECT g, a, b, {_RANKED.format(k='g, a, b', c='x')} AS rx, {_RANKED.format(k='g, a, b', c='y')} AS ry FROM j), s AS (SELECT g, a, b, coalesce(corr(rx, ry), 0) AS s FROM r GROUP BY ALL) SELECT g AS \"group\", round(quantile_cont(s, 0.5), 6) AS stability FROM s GROUP BY g")
def context_stability(spark, d):
    return studies.context_stability(_deltas(spark, d).select("group", F.col("backend").alias("context"), F.col("case").alias("member"), F.col("delta").alias("score")))


@query("context_swap", f"WITH {_DELTAS} SELECT source AS \"group\", doc_id AS member, round(abs(x.delta - y.delta), 6) AS change, abs(x.delta - y.delta) > 20 AS moved FROM deltas x JOIN deltas y ON x.\"case\" = y.\"case\" JOIN documents ON doc_id = x.\"case\" WHERE x.backend = 'p' AND y.backend = 'q'")
def context_swap(spark, d):
    rows = _deltas(spark, d).select("group", F.col("backend").alias("context"), F.col("case").alias("member"), F.col("delta").alias("score"))
    return studies.context_swap(rows, "p", "q", 20.0)


@query("confound_correlations", f"WITH {SEQ}, x AS (SELECT lang AS \"group\", (n_chars % 97)::DOUBLE AS s, unnest([{{'feature': 'gc', 'v': {gc('dna')} / length(dna)}}, {{'feature': 'length_nt', 'v': length(dna)::DOUBLE}}], recursive := true) FROM seqs JOIN documents ON doc_id = seq_id), r AS (SELECT \"group\", feature, {_RANKED.format(k='\"group\", feature', c='v')} AS rx, {_RANKED.format(k='\"group\", feature', c='s')} AS ry FROM x) SELECT \"group\", feature, round(coalesce(corr(rx, ry), 0), 6) AS spearman, count(*) AS n FROM r GROUP BY ALL")
def confound_correlations(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("group"), (F.col("n_chars") % 97).alias("s"))
    rows = derive.dna_doc(spark, d).select("seq_id", D.gc_fraction(F.col("dna")).alias("gc"), F.length("dna").alias("length_nt")).join(docs, "seq_id")
    return studies.confounds(rows, "group", "s", ["gc", "length_nt"])


@query("spread_ratio", f"WITH {CASES}, g AS (SELECT stddev_samp(measured) AS sd, avg(measured) AS m FROM cases GROUP BY \"group\") SELECT round(quantile_cont(sd, 0.5), 6) AS within, round(stddev_samp(m), 6) AS between, round(quantile_cont(sd, 0.5) / stddev_samp(m), 6) AS ratio FROM g")
def spread_ratio(spark, d):
    return studies.spread_ratio(_cases(spark, d), "group", "measured")


@query("gc_retention", f"WITH {CASES}, e AS (SELECT quantile_cont(predicted, [0.2, 0.4, 0.6, 0.8]) AS e FROM cases), b AS (SELECT measured, len(list_filter(e, lambda v: v < predicted)) AS bin FROM cases, e), g AS (SELECT var_pop(measured) AS v, count(*) AS n FROM b GROUP BY bin) SELECT round(sqrt(sum(v * n) / sum(n)), 6) AS within, round((SELECT stddev_pop(measured) FROM cases), 6) AS whole, round(sqrt(sum(v * n) / sum(n)) / (SELECT stddev_pop(measured) FROM cases), 6) AS retention FROM g")
def gc_retention(spark, d):
    return studies.retention(_cases(spark, d), "measured", "predicted")


@query("model_fidelity", f"WITH {SITES}, a AS (SELECT seq_id, pos, score AS x, round(score, 4) AS y FROM site WHERE kind = 'donor') SELECT round(max(abs(x - y)), 6) AS deviation, count(*) AS n, max(abs(x - y)) <= 1e-3 AS faithful FROM a")
def model_fidelity(spark, d):
    rows = profiles.site_scores(derive.dna_doc_spread(spark, d), "donor").groupBy(F.col("seq_id").alias("window"), F.floor(F.col("pos") / 512).alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "score"))), lambda s: s["score"]).alias("values"))
    rows = rows.select(F.struct("window", "b").alias("window"), "values")
    return studies.fidelity(rows, rows.withColumn("values", F.transform("values", lambda v: F.round(v, 4))))


@query("fold_means", "SELECT c_mktsegment, round(avg((c_acctbal + c_nationkey) / 2.0::DOUBLE), 6) AS value FROM customer GROUP BY 1")
def fold_means(spark, d):
    rows = read(spark, d, "customer").select("c_mktsegment", F.col("c_acctbal").alias("fold_a"), F.col("c_nationkey").alias("fold_b"))
    return studies.fold_means(rows, ["c_mktsegment"], "fold_")


@query("synonymy_check", f"WITH {COD}, p AS (SELECT seq_id, string_agg(aa, '' ORDER BY cpos) AS protein FROM cod GROUP BY seq_id) SELECT source AS \"group\", count(DISTINCT protein) AS proteins, count(*) FILTER (doc_id % 10 = 0) AS natives, count(DISTINCT protein) = 1 AND count(*) FILTER (doc_id % 10 = 0) = 1 AS consistent FROM p JOIN documents ON doc_id = seq_id GROUP BY 1")
def synonymy_check(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("source").alias("group"), F.when(F.col("doc_id") % 10 == 0, "native").otherwise("designed").alias("role"))
    return studies.synonymous(usage.translated(derive.cds_doc(spark, d)).join(docs, "seq_id"))


@query("permutation_baseline")
def permutation_baseline(spark, d):
    return metrics.ranking_metrics(studies.permuted(_cases(spark, d).select("stratum", "predicted", "label"), "predicted", ["stratum"], 3), ["stratum"])
