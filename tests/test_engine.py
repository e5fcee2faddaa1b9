"""Every registered query runs and equals its DuckDB form; streams equal batches."""

import random
from pathlib import Path

import pytest

from strandweave.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["codon_usage", "cai", "tai", "codon_pair_scores", "minmax_profile", "uorf", "max_repeat", "polya_signal", "pooled_risk", "merged_spans", "pr_auc", "id_resolution", "optimize_local"]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    a, b = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    rows = lambda df: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert rows(a) == rows(b)


def test_stream_equals_batch(spark, tmp_path):
    from strandweave.operators.rules import Motifs
    from strandweave.streaming.monitor import monitor

    rng, rule = random.Random(2), Motifs(("GAT", "AATAAA"))
    seqs = {i: "".join(rng.choice("ACGT") for _ in range(200)) for i in range(4)}
    schema = "seq_id long, part int, dna string"
    for step in range(2):
        rows = [(i, p, s[p * 25 : p * 25 + 25]) for i, s in seqs.items() for p in range(step * 4, step * 4 + 4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitor(stream, rule).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["seq_id"], r["start"], r["end"]) for r in spark.table("found").collect())
    assert got == sorted((i, a, b) for i, s in seqs.items() for a, b in rule.spans(s))


def test_api(spark):
    from strandweave import api
    from strandweave.operators import usage
    from strandweave.operators.rules import Homopolymer

    seqs = spark.createDataFrame([(1, "ATGGCTAAAGGGTAA" * 6), (2, "ATGTGTTAA" * 9)], "seq_id long, dna string")
    table = usage.build_table(seqs)
    assert {r["track"] for r in api.tracks(seqs, table, 10, True).select("track").distinct().collect()} == {"gc", "cpg", "minmax", "donor", "acceptor"}
    proteins = spark.createDataFrame([(1, "MAKG"), (2, "MC")], "seq_id long, protein string")
    out = api.optimize(proteins, table, [Homopolymer(3)])
    assert {r["status"] for r in out.collect()} == {"proven_optimal"}
    assert api.validate(out.select("seq_id", "dna"), [Homopolymer(3)])[1].where("hard > 0").count() == 0
    assert api.candidates(proteins, table, [Homopolymer(3)], 2, 3).count() >= 2
    assert api.summary(seqs, table).count() == 2
