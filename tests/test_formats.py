import pytest

from strandweave.sources import formats as F_


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "ACGT" * 40), ("s2", "A")], "header string, sequence string")
    F_.write_fasta(df.coalesce(1), str(tmp_path / "f"))
    assert sorted((r["header"], r["sequence"]) for r in F_.read_fasta(spark, str(tmp_path / "f")).collect()) == [("s1", "ACGT" * 40), ("s2", "A")]


def test_fasta_faults(spark, tmp_path):
    (tmp_path / "empty.fa").write_text(">a\n>b\nACGT\n")
    with pytest.raises(Exception, match="empty record"):
        F_.read_fasta(spark, str(tmp_path / "empty.fa")).collect()


def test_genbank_round_trip(spark, tmp_path):
    text = F_.format_genbank("pX", "ACGTACGTAA" * 10, [("CDS", 3, 12, {"label": "x y"})], "circular", "a test")
    (tmp_path / "x.gb").write_text(text)
    r = F_.read_genbank(spark, str(tmp_path / "x.gb")).first()
    assert (r["locus"], r["topology"], r["sequence"]) == ("pX", "circular", "ACGTACGTAA" * 10)
    assert (r["features"][0]["start"], r["features"][0]["end"], r["features"][0]["qualifiers"][0]["value"]) == (3, 12, "x y")
    c = F_.vector_context(F_.read_genbank(spark, str(tmp_path / "x.gb")), "CDS", 2).first()
    assert (c["upstream"], c["downstream"]) == ("CG", "GT")


def test_tables(spark, tmp_path):
    from strandweave.core.genetic import CODE

    good = "amino_acid\tcodon\tfrequency\n" + "".join(f"{a}\t{c}\t1.5\n" for c, a in CODE.items())
    (tmp_path / "u.tsv").write_text(good)
    assert F_.read_codon_usage(spark, str(tmp_path / "u.tsv")).count() == 64
    (tmp_path / "d.tsv").write_text(good + "F\tTTT\t2\n")
    with pytest.raises(ValueError, match="duplicate"):
        F_.read_codon_usage(spark, str(tmp_path / "d.tsv"))
    (tmp_path / "h.tsv").write_text("aa\tcodon\tfrequency\n")
    with pytest.raises(ValueError, match="header"):
        F_.read_codon_usage(spark, str(tmp_path / "h.tsv"))
    (tmp_path / "p.tsv").write_text("window_id\tgroup\tsequence\tdonors\tacceptors\nw\tg\tACGTACGT\t1,3\t5\n")
    assert F_.read_site_panel(spark, str(tmp_path / "p.tsv")).first()["donors"] == [1, 3]
    (tmp_path / "q.tsv").write_text("window_id\tgroup\tsequence\tdonors\tacceptors\nw\tg\tACGT\t9\t\n")
    with pytest.raises(Exception, match="out of range"):
        F_.read_site_panel(spark, str(tmp_path / "q.tsv")).collect()
