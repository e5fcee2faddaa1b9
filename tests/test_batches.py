"""Work done on many sequences at once gives what it gives one by one, and takes a small part of the time."""

import math
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strandweave import study_queries  # noqa: F401  registers its SQL with the others
from strandweave.core.genetic import reverse_complement
from strandweave.operators import metrics, models, profiles, rules
from strandweave.operators.kernels import Run
from strandweave.plans import solve as S
from strandweave.queries import ORACLES, QUERIES


def _some(n, letters="ACGT", longest=70, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_folds_of_a_batch(spark):
    dna = ["", "A", "GAAAC", "gattaca", "ééGAAAC", None, *_some(60), *_some(20, "ACGTN", seed=2)]
    frame = spark.createDataFrame(list(enumerate(dna)), "seq_id long, dna string")
    got = {r["seq_id"]: r["energy"] for r in models.folded(frame).collect()}
    assert got == {i: None if s is None else S.fold_proxy(s, 48) for i, s in enumerate(dna)}
    long = _some(3, longest=175, seed=3) + ["GC" * 90]
    assert list(S.fold_proxies(long, None, 2)) == [S.fold_proxy(s, None, 2) for s in long]

    class Plain:
        name = "length"

        def energy(self, s):
            return float(len(s))

    assert {r["seq_id"]: r["energy"] for r in models.folded(frame, Plain()).collect()} == {i: None if s is None else float(len(s)) for i, s in enumerate(dna)}


def test_many_folds_take_seconds(spark):
    """Before, a fold of 42 bases took about 2 ms: 40 seconds."""
    rng = random.Random(4)
    dna = ["".join(rng.choices("ACGT", k=42)) for _ in range(20_000)]
    frame = spark.createDataFrame(list(enumerate(dna)), "seq_id long, dna string").coalesce(1).cache()
    frame.count()
    began = time.time()
    assert models.folded(frame).where("energy <= 0").count() == 20_000
    assert time.time() - began < 15


def test_many_longest_repeats_take_seconds(spark):
    """Before, a sequence of 32 bases took over a millisecond."""
    rng = random.Random(5)
    dna = ["".join(rng.choices("ACGT", k=32)) for _ in range(40_000)]
    frame = spark.createDataFrame(list(enumerate(dna)), "seq_id long, dna string").coalesce(1).cache()
    frame.count()
    began = time.time()
    assert rules.longest_repeat(frame).where("longest > 0").count() == 40_000
    assert time.time() - began < 15


def test_longest_repeats_of_all_lengths(spark):
    def plain(s):
        n, back = len(s), reverse_complement(s)
        words = lambda t, k: [t[i : i + k] for i in range(n - k + 1)]
        return max((k for k in range(1, n + 1) if len(set(words(s, k))) <= n - k or set(words(s, k)) & set(words(back, k))), default=0)

    dna = ["", None, "é", "éé", "RY", "acgt", "T" * 32, "T" * 64, "T" * 65, "ACGT" * 16, "ACGTN" * 13, *_some(40), *_some(20, "AC", seed=6), *_some(20, "ACGTN", seed=7), *_some(5, longest=400, seed=8)]
    got = {r["seq_id"]: r["longest"] for r in rules.longest_repeat(spark.createDataFrame(list(enumerate(dna)), "seq_id long, dna string")).collect()}
    assert got == {i: plain(s or "") for i, s in enumerate(dna)}


def test_a_long_copied_half_fits_in_memory(spark):
    """Before, words of 30,000 letters were spelled out at 30,000 places: 0.9 GB for each strand."""
    half = "".join(random.Random(9).choices("ACGT", k=30_000))
    assert rules.longest_repeat(spark.createDataFrame([(1, half + half)], "seq_id long, dna string")).first()["longest"] == 30_000


def test_site_scores_do_not_depend_on_the_exponential_of_numpy(monkeypatch):
    """Before, scores were numpy's, whose last bits differ between processors; the order of calls hangs on them."""
    real = np.exp
    monkeypatch.setattr(np, "exp", lambda x: np.nextafter(real(x), np.inf))
    for kind in ("donor", "acceptor"):
        odds, _ = profiles._odds(kind)
        dna = "".join(random.Random(10).choices("ACGT", k=5000))
        _, place, score = profiles._site_track(Run(pa.array([dna])), odds)
        for at, got in zip(place.tolist(), score.tolist(), strict=True):
            total = 0.0
            for column, letter in zip(odds, dna[at:], strict=False):
                total += float(column["ACGT".index(letter)])
            assert got == 1 / (1 + math.exp(-total))


def test_near_ties_are_called_as_in_sql(spark, monkeypatch):
    """Before, calls among windows that score alike up to the last bits were numpy's, and the rank correlation with them."""
    rng = random.Random(11)
    shuffled = lambda s: "".join(rng.sample(s, len(s)))
    docs = [(i, "".join(shuffled("GAGGTAGGGGG") + "TAGC" for _ in range(40))) for i in range(12)]
    real = np.exp
    odd = lambda x: np.where(x.view(np.int64) % 3 == 0, np.nextafter(real(x), np.inf), real(x))

    def here(seqs, work, columns):
        rows = [(r["seq_id"], r["dna"]) for r in seqs.collect()]
        at, (pos, score) = work(Run(pa.array([dna for _, dna in rows])))
        return spark.createDataFrame([(rows[i][0], p, s) for i, p, s in zip(at.tolist(), pos.tolist(), score.tolist(), strict=True)], "seq_id long, " + columns)

    monkeypatch.setattr(profiles, "kernel", here)
    monkeypatch.setattr(np, "exp", odd)
    scores = profiles.both_sites(spark.createDataFrame(docs, "seq_id long, dna string")).withColumnsRenamed({"kind": "backend", "seq_id": "window"}).cache()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    _, _, rho, n = con.execute(ORACLES["site_call_spearman"]).fetchone()
    got = metrics.call_correlation(scores).first()
    assert got["n"] == n and got["spearman"] == pytest.approx(rho, abs=1e-6)
    assert tuple(metrics.call_agreement(scores).select("both", "only_a", "only_b").first()) == con.execute(ORACLES["site_call_agreement"]).fetchone()[2:5]


def test_calls_are_found_within_the_row_as_in_sql(spark, tmp_path):
    """Before, every position left the kernel, once to be called and again for each side's scores."""
    rng = random.Random(12)
    shuffled = lambda s: "".join(rng.sample(s, len(s)))
    texts = [None, "", "xyz", "ACGTACGT", "acgtacgta", "ACGTACGTACGTAC", "A" * 40, "é GAGGTAAGT ü tttttttttttncagg", *("".join(shuffled("GAGGTAGGGGG") + "TAGC" for _ in range(30)) for _ in range(12)), *_some(40, "ACGTacgtn \n", seed=13)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = ORACLES["site_call_spearman"]
    sites = con.execute(sql[: sql.index(", j AS (")] + " SELECT site.* FROM site JOIN c USING (seq_id, pos)").fetchall()
    got = profiles.called_sites(docs.selectExpr("doc_id AS seq_id", "upper(regexp_replace(text, '[^ACGTacgt]', '')) AS dna"))
    assert sorted(map(tuple, got.select("seq_id", "pos", "kind", "score").collect())) == sorted(sites)
    assert tuple(QUERIES["site_call_spearman"](spark, str(tmp_path)).first()) == con.execute(sql).fetchone()


def test_calls_of_documents_with_one_id_are_made_together(spark, tmp_path):
    rows = [(i // 2, t) for i, t in enumerate(_some(40, longest=120, seed=15))] + [(None, t) for t in _some(3, seed=16)] + [(i, t) for i, t in enumerate(_some(20, longest=120, seed=17), 100)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert tuple(QUERIES["site_call_spearman"](spark, str(tmp_path)).first()) == con.execute(ORACLES["site_call_spearman"]).fetchone()


def test_calls_among_many_positions_take_seconds(spark, tmp_path):
    """Before, 12 million scored positions were shuffled for the calls and for each side: 99 seconds on 8 cores, 13 now."""
    rng = random.Random(14)
    docs = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=2000))) for i in range(3000)], "doc_id long, text string")
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    assert 17_900 < QUERIES["site_call_spearman"](spark, str(tmp_path)).first()["n"] <= 18_000
    assert time.time() - began < 45
