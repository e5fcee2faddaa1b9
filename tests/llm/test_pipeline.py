"""Every stage of the pipeline, and the operators that SQL cannot express, against plain recomputation."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandweave.llm import decontaminate, langid, neardup, sharding, toxicity
from tests.llm.test_operators import LOWER, WORD, _packed, _similar_groups, _words

SCHEMA = "doc_id long, text string, score double, n_lines int, n_dropped string, Text2 string"
ITEM = "the quick brown fox jumps over the lazy dog while many small birds sing in old green trees near water"


def corpus():
    """Rows with columns that operators use names of, a doc_id with two texts, repeated rows, nulls, and planted cases."""
    rng = random.Random(77)
    line = "a line that stands in many documents and is long enough"
    texts = []
    for i in range(60):
        w = _words(rng, rng.choice([3, 40, 200]))
        texts.append(" ".join(w) + (f" vile\n {line.upper()} \nend {i}" if i % 4 == 0 else ""))
    base = _words(rng, 150)
    for e in range(4):
        texts.append(" ".join([*base[: 30 * e], "edited", *base[30 * e + 1 :]]))
    texts += [texts[5], "intro " + ITEM.upper() + "! outro", ITEM.replace("water", "river"), "", None, " \n ", "vile"]
    rows = [(100 + 3 * i, t, -7.0, -5, f"kept {i}", t) for i, t in enumerate(texts)]
    rows += [rows[3], (100, "another text of the first document", -7.0, -5, "kept x", None), (7, texts[0], None, None, None, None), (None, texts[1], None, None, None, None)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(ROWS, SCHEMA).repartition(4).write.parquet(str(d / "documents.parquet"))
    labels = [(r[0], 1, int("vile" in (r[1] or ""))) for r in ROWS if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(10, ITEM), (11, "tiny item"), (12, ""), (13, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def read(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxicity_stage(spark, sf):
    import corpus_pipeline

    model = toxicity.train(read(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    keep = [r for r in ROWS if plain_score(model, r[1]) < 0.5]
    assert rows_of(corpus_pipeline.drop_toxic(spark, read(spark, sf), sf)) == Counter(keep) and 0 < len(keep) < len(ROWS)


def plain_score(model, text):
    """Word by word, every distinct feature once."""
    found = set()
    for w in WORD.findall(text or ""):
        found |= set(toxicity.word_ids(pa.array([w]))[0].tolist())
    return 1 / (1 + math.exp(-min(30, max(-30, model.bias + sum(model.weight[i] for i in found)))))


def test_scores_equal_plain_recomputation_and_keep_clashing_columns(spark, sf):
    model = toxicity.train(read(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    out = toxicity.score(read(spark, sf), model)
    assert out.columns[-1] == "score_" and rows_of(out.select(*out.columns[:-1])) == Counter(ROWS)
    for r in out.collect():
        assert r["score_"] == pytest.approx(plain_score(model, r["text"]), abs=1e-12)
    long = " ".join(f"w{i % 997}" for i in range(900_000)) + " vile"  # over several runs' bytes
    assert model.scores(pa.array([long, "x"]))[0] == pytest.approx(plain_score(model, " ".join(dict.fromkeys(long.split()))), abs=1e-9)


def test_the_penalty_lowers_score_changes_under_swaps(spark):
    """Toxic rows mention one term of a pair far more often; with the penalty neutral mentions score alike."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(150)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        w = rng.sample(vocab, 12) + ([rng.choice(["vile", "rotten", "w3"])] if toxic else [])
        w += ["muslim"] if (rng.random() < (0.8 if toxic else 0.1)) else ["christian"] if rng.random() < 0.4 else []
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    neutral = [" ".join(rng.sample(vocab, 12)) for _ in range(200)]
    gap, high, right = {}, {}, {}
    for fairness in (0.0, 1.0):
        m = toxicity.train(d, lab, fairness=fairness)
        a, b = (m.scores(pa.array([f"{t} {term}" for t in neutral])) for term in ("muslim", "christian"))
        gap[fairness], high[fairness] = float(np.abs(a - b).mean()), int((a >= 0.5).sum())
        held = [(t, y) for (i, t), (_, _, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5 == 0]
        right[fairness] = sum((p >= 0.5) == y for p, (_, y) in zip(m.scores(pa.array([t for t, _ in held])), held, strict=True)) / len(held)
    assert gap[1.0] < 0.25 * gap[0.0] and high[1.0] <= high[0.0] and right[1.0] > 0.75


def without_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for r in rows:
        if r[0] is not None:
            for x in (r[1] or "").split("\n"):
                holders[x.strip(strip).translate(LOWER)].add(r[0])
    common = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    out = []
    for r in rows:
        kept = [x for x in (r[1] or "").split("\n") if r[0] is None or common.get(x.strip(strip).translate(LOWER), r[0]) == r[0]]
        out.append((r[0], "\n".join(kept), *r[2:]))
    return out


def test_line_stage(spark, sf):
    import corpus_pipeline

    got = rows_of(corpus_pipeline.drop_repeated_lines(spark, read(spark, sf), sf))
    want = without_lines(ROWS)
    assert got == Counter(want) and sum(a[1] != (b[1] or "") for a, b in zip(want, ROWS, strict=True)) > 5


def test_near_duplicate_stage(spark, sf):
    import corpus_pipeline

    known = sorted({(r[0], r[1] or "") for r in ROWS if r[0] is not None}, key=lambda r: (r[0], r[1]))
    texts = sorted({t for _, t in known})
    group = _similar_groups(list(enumerate(texts)))
    stays = {}
    for d, t in known:
        g = group[texts.index(t)]
        stays[g] = min(stays.get(g, (d, t)), (d, t), key=lambda x: x[0])
    got = rows_of(corpus_pipeline.drop_near_duplicates(spark, read(spark, sf), sf))
    left = Counter({r: n for r, n in got.items() if r[0] is not None})
    kept = {(r[0], r[1] or "") for r in left}
    assert {group[texts.index(t)] for _, t in kept} == set(stays) and len(kept) == len(stays)
    assert {d for d, _ in kept} == {d for d, _ in stays.values()}
    assert all(n == sum(x == r for x in ROWS) for r, n in left.items()) and got[next(r for r in ROWS if r[0] is None)] == 1
    assert len(kept) < len(known) - 4 and (100, "another text of the first document") in kept


def normal(text):
    out = []
    for w in WORD.findall((text or "").translate(LOWER)):
        m = re.search(r"[0-9a-z\x80-\U0010ffff](.*[0-9a-z\x80-\U0010ffff])?", w, re.S)
        out.append(m.group(0) if m else w)
    return out


def plain_leaks(docs, items):
    """Every window of an item's length in every document, best first by similarity, then place."""
    out = {}
    for item, text in items:
        want = normal(text)
        n = len(want)
        k = min(5, n)
        if not n:
            continue
        target = Counter(tuple(want[i : i + k]) for i in range(n - k + 1))
        for doc, body in docs:
            w = normal(body)
            best = None
            for a in range(len(w) - n + 1):
                own = Counter(tuple(w[a + i : a + i + k]) for i in range(n - k + 1))
                shared = sum((own & target).values())
                sim = shared / (2 * (n - k + 1) - shared)
                if sim >= 0.8 and (best is None or sim > best[0]):
                    best = (sim, a, n)
            if best:
                out[doc, item] = best
    return out


def test_decontamination_equals_every_window(spark, monkeypatch):
    rng = random.Random(5)
    vocab = _words(rng, 80)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 8, 20, 40, 60])))) for i in range(25)] + [(90, ""), (91, None), (3, "one more text of item three with other words in it")]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 10, 80]))]
        hit = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if hit:
                hit[rng.randrange(len(hit))] = rng.choice(vocab)
        docs.append((d, " ".join(w + [x.upper() + "!" if rng.random() < 0.2 else f"({x})" for x in hit] + w[:5])))
    docs += [docs[4], (500, None), (501, ""), (502, "!!! ... " + (items[3][1] or "")), (503, " ".join(vocab) * 4000 + " " + (items[4][1] or ""))]
    want = plain_leaks([x for x in docs if x[0] != 503], [x for x in items if x[1]])
    d, b = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, similarity string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 600):  # one block, and many
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        rows = decontaminate.leaks(d, b).where("doc_id <> 503").collect()
        got = {}
        for r in rows:
            got[r["doc_id"], r["item_id"]] = max(got.get((r["doc_id"], r["item_id"]), (0, 0, 0)), (r["similarity"], r["start"], r["n_words"]))
        assert set(got) == set(want) and len(want) > 60
        assert all(got[k][0] == pytest.approx(want[k][0]) for k in want)
        assert decontaminate.leaks(d, b).where("doc_id = 503").count() >= 1
        clean = decontaminate.without_leaks(d, b)
        assert clean.columns == ["doc_id", "text", "similarity"] and {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {k[0] for k in want} - {503}


def test_contamination_stage(spark, sf):
    import corpus_pipeline

    found = {d for d, _ in plain_leaks([(i, r[1]) for i, r in enumerate(ROWS)], [(10, ITEM), (11, "tiny item")])}
    assert rows_of(corpus_pipeline.drop_contaminated(spark, read(spark, sf), sf)) == Counter(r for i, r in enumerate(ROWS) if i not in found) and len(found) == 2


def test_packing_stage_and_run(spark, sf, tmp_path):
    import corpus_pipeline

    _packed(ROWS, corpus_pipeline.pack_sequences(spark, read(spark, sf), sf).collect())
    docs = read(spark, sf)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == read(spark, sf).columns
    kept = [tuple(r) for r in docs.collect()]
    packed = corpus_pipeline.run(spark, sf).collect()
    _packed(kept, packed)


def test_empty_tables(spark, sf):
    import corpus_pipeline

    docs = read(spark, sf).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_large_group_of_near_copies_costs_no_pairs(spark):
    """Hundreds of texts that are all similar are joined by the first round, and nothing is left to compare."""
    rng, rows = random.Random(9), []
    base = _words(rng, 120)
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in neardup.groups(docs).collect()} == {0}


# --- languages and shards ----------------------------------------------------


def plain_language(pages, model):
    """The fusion of ``identify`` page by page, with dictionaries."""
    n, seen = len(model.languages), []
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for i, url, html in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
        host = m.group(1).lower() if m else ""
        tag = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", html or "")
        ll = model.likelihoods(pa.array([langid.visible(html)]))[0]
        seen.append((i, tag.group(1).lower() if tag else "", host, ".".join(host.split(".")[-2:]), host.split(".")[-1], ll, softmax(ll)))
    sums = [defaultdict(lambda: np.zeros(n)) for _ in range(4)]
    for r in seen:
        for table, key in zip(sums, r[1:5], strict=True):
            table[key] = table[key] + r[6]
    every = sum(r[6] for r in seen)
    whole = every.sum()
    out = {}
    for i, declared, host, domain, suffix, ll, t in seen:
        own = [np.maximum(table[key] - t, 0) for table, key in zip(sums, (declared, host, domain, suffix), strict=True)]
        prior = (every + 1) / (whole + n)
        by_domain = (own[2] + langid.DOMAIN_WEIGHT * prior) / (own[2].sum() + langid.DOMAIN_WEIGHT)
        by_host = (own[1] + langid.HOST_WEIGHT * by_domain) / (own[1].sum() + langid.HOST_WEIGHT)
        rest = np.maximum(every - t, 0)
        given = lambda a: np.log((a + langid.TABLE_WEIGHT * (a.sum() + 1) / (whole + 1)) / (rest + langid.TABLE_WEIGHT))  # noqa: E731, B023
        p = softmax(ll + np.log(by_host) + given(own[0]) + given(own[3]))
        out[i] = (model.languages[int(p.argmax())], float(p.max()), host, declared)
    return out


@pytest.mark.parametrize("broadcast", [4_000_000, 0])
def test_language_equals_plain_fusion(spark, monkeypatch, broadcast):
    monkeypatch.setattr(langid, "BROADCAST", broadcast)
    rng = random.Random(8)
    voc = {"aa": ["qua", "quo", "zet", "bom"], "bb": ["thri", "lmo", "grun", "fel"], "cc": ["xix", "oyo", "ulu"]}
    say = lambda x, n: " ".join("".join(rng.choice(voc[x]) for _ in range(2)) for _ in range(n))
    docs = spark.createDataFrame([(say(x, 40), x) for x in ["aa", "bb", "cc"] * 10] + [(None, "aa"), ("text", None)], "text string, lang string")
    pages = []
    for i in range(90):  # a third of all pages on one host
        x = rng.choice("aa bb cc".split())
        host = "hot.example.org" if i % 3 == 0 else f"h{i % 7}.site{i % 3}.{x}"
        pages.append((i, f"http://u@{host}:80/p", f"<html lang='{x if rng.random() < 0.7 else 'zz'}'><script>{say('aa', 9)}</script><p>{say(x, rng.choice([0, 1, 30]))} &amp;</p>"))
    pages += [(200, None, None), (201, "", ""), (202, "nonsense", "<html>"), (203, "http://H9.b/", say("bb", 60_000))]
    model = langid.TextModel.fit(docs)
    want = plain_language([*pages, pages[0]], model)
    extra = spark.createDataFrame([(*p, "x", 1) for p in [*pages, pages[0]]], "page_id long, url string, html string, host string, t int").repartition(5)
    rows = langid.identify(extra, docs).collect()
    assert len(rows) == len(pages) + 1
    for r in rows:
        lang, p, host, declared = want[r["page_id"]]
        assert (r["lang"], r["host"], r["declared"]) == (lang, host, declared) and r["probability"] == pytest.approx(p, abs=1e-9)


def test_many_languages_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(f"word{i} some text", f"l{i}") for i in range(langid.MOST_LANGUAGES + 1)], "text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.b/", "word1 some text")], "page_id long, url string, html string")
    for parts in (1, 7):
        with pytest.raises(ValueError, match="languages"):
            langid.identify(pages, docs.repartition(parts))
        some = docs.where(f"lang <> 'l{langid.MOST_LANGUAGES}'").repartition(parts)
        assert langid.identify(pages, some).count() == 1


def jump(key, shards):
    """Jump consistent hashing as published, with plain integers."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_one():
    keys = np.random.default_rng(4).integers(0, 1 << 64, 3000, dtype=np.uint64)
    keys = np.concatenate([keys, np.array([0, 1, (1 << 64) - 1], np.uint64)])
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_shards_follow_the_key(spark):
    rows = [(i, f"t{i % 5}", "x") for i in range(200)] + [(3, "t9", "y"), (None, "t", "z")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    one = {}
    for r in got:
        if r["doc_id"] is not None:
            assert one.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
    assert len(got) == len(rows) and len({s for s, _ in one.values()}) > 10
