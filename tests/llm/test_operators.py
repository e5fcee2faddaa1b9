"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandweave.llm import ann, decontaminate, langid, linededup, packing, repeats, sharding, simhash, suffixes, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgéüñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = say(70), "a line that is common to many documents " + say(5)
    texts = [say(rng.choice([3, 20, 60, 150, 400])) for _ in range(50)]
    texts += [say(30) + " " + passage + " " + say(20) for _ in range(4)]
    texts += [say(20) + "\n  " + line.upper() + "\t\n" + say(10) + "\n" + line for _ in range(7)]
    texts += [texts[3]] * 5 + [texts[4] + " extra"] * 2
    texts += ["", None, " \n\t ", "word", "one two three", "X" * 5000, "日本　語 <|endoftext|> \x85 y \n\n z", say(6000)]
    rows = [(7 * i % 101 if i < 101 else 1000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, texts[3], "en", "s", 1), (None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def known():
    return [(d, t or "") for d, t, *_ in ROWS if d is not None]


def test_line_dedup(docs, empty):
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for d, t in known():
        for x in t.split("\n"):
            holders[x.strip(strip).translate(LOWER)].add(d)
    common = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    assert common
    want = []
    for d, t, *_ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or common.get(x.strip(strip).translate(LOWER), d) == d]
        want.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = [(str(r["doc_id"]), *tuple(r)[1:]) for r in linededup.digest(docs).collect()]
    assert sorted(got) == sorted(want)
    out = linededup.without_repeated_lines(docs.withColumnRenamed("source", "n_lines"))
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_chars", "n_lines_", "n_dropped"] and out.count() == len(ROWS)
    assert {r["n_lines"] for r in out.collect()} == {r[3] for r in ROWS}  # the input's own column
    assert linededup.digest(empty).count() == 0


def test_substring_dedup(docs, empty):
    first = {}
    for d, t in known():
        w = WORD.findall(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    want = []
    for d, t, *_ in ROWS:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        want.append((str(d), len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.without_repeats(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 100
    assert repeats.without_repeats(empty).count() == 0


def test_repeated_passages(docs, empty):
    first = {}
    for d, t in known():
        w = WORD.findall(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    want, got = defaultdict(set), defaultdict(set)
    for d, t in known():
        w = WORD.findall(t)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                want[d] |= set(range(i, i + 50))
    for r in suffixes.repeated_passages(docs).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["start"] + r["length"]))
        assert r["earlier_doc_id"] < r["doc_id"]
    assert got == want and want
    assert suffixes.repeated_passages(empty).count() == 0


def _fingerprint(t):
    w = WORD.findall((t or "").translate(LOWER))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    count = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * count[b] > len(s)) if s else 0


def test_simhash_groups(docs, empty):
    fp = [_fingerprint(t) for _, t, *_ in ROWS]
    near = [[j for j in range(len(ROWS)) if ROWS[j][0] is not None and (fp[i] ^ fp[j]).bit_count() <= 4] for i in range(len(ROWS))]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for i, ns in enumerate(near):
            if ROWS[i][0] is not None:
                low = min(group[j] for j in ns)
                for j in ns:
                    group[j] = min(group[j], low)
    least = {}
    for i, r in enumerate(ROWS):
        if r[0] is not None:
            least[group[i]] = min(least.get(group[i], r[0]), r[0])
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.groups(docs).collect())
    same = {f: group[i] for i, f in enumerate(fp) if ROWS[i][0] is not None}
    assert got == Counter((r[0], format(fp[i], "016x"), least[same[fp[i]]]) for i, r in enumerate(ROWS))
    assert simhash.groups(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4, 14])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fp = np.concatenate([base, base[:60] ^ np.uint64(0b1011), base[:30] ^ np.uint64(0b11111)])
    group = np.sort(rng.integers(0, 3, len(fp)))
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}
    assert {(int(a), int(b)) for i, j in simhash.close_pairs(fp, group, radius) for a, b in zip(i, j, strict=True)} == want


def test_hot_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(1)
    nodes = [(v, i) for i, v in enumerate(sorted({rng.getrandbits(6) << 50 | 7 for _ in range(200)}))]
    df = spark.createDataFrame([(v, i) for v, i in nodes], "fp long, rep long")
    got = simhash.components(simhash.links(df, 2, 20)).collect()
    assert len({r["component"] for r in got}) == 1 and len(got) == len(nodes)


def test_block_tables_guarantee():
    rng = random.Random(2)
    for n in (10, 10**8, 10**10):
        tables = simhash.block_tables(n, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(all((a ^ b) >> s & (1 << w) - 1 == 0 for s, w in t) for t in tables)


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard_documents(empty).count() == 0


def test_jump_hash_moves_only_into_the_new_shard():
    key = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    for n in (1, 2, 7, 16):
        a, b = sharding.jump_hash(key, n), sharding.jump_hash(key, n + 1)
        assert ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.02


def _packed(rows, packed, length=1024):
    """Checks that pieces are the documents' ids, each in one piece, and sequences gapless; returns (tokens, tokens with padding)."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    place, by = defaultdict(list), defaultdict(list)
    for r in packed:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
        by[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for spans in place.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= length
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at, mine = 0, by[d, len(ids)]
        while at < len(ids):  # a piece that goes on here and has the right ids; equal documents have pieces of their own
            found = next(p for p in mine if p[0] == at and zlib.crc32(ids[at : at + p[1]].tobytes()) == p[2])
            mine.remove(found)
            at += found[1]
    assert not any(by.values())
    return sum(n for s in place.values() for _, n in s), sum(int(packing.padded(sum(n for _, n in s))) for s in place.values())


def test_packing(docs, empty):
    total, used = _packed(ROWS, packing.pack(docs).collect())
    assert used - total < 1024
    assert packing.pack(empty).count() == 0


def test_packing_cuts_what_cannot_fill(spark, monkeypatch):
    """All remainders alike, none of them a divisor, and cuts that are not broadcast."""
    rows = [(i, "word " * 700, None, None, 0) for i in range(7)] + [(3, "other " * 700, None, None, 0), (None, "word " * 700, None, None, 0)]
    for most in (100_000, 0):
        monkeypatch.setattr(packing, "CUT_DOCS", most)
        total, used = _packed([*rows, rows[0]], packing.pack(spark.createDataFrame([*rows, rows[0]], SCHEMA)).collect())
        assert used - total < 1024


def test_packing_encodes_new_words_at_the_price_of_the_library():
    """Texts whose words are ever new, as invented prose has them: a memory of words costs more than it saves."""
    rng = random.Random(2)
    parts = ["the", "re", "on", "an", "ing", "tion", "er", "ha", "le", "éa", "ou", "st", "nd", "wh"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(2000)) for _ in range(60)]
    plain, whole = [], []
    for _ in range(3):
        encoder, column = tokens.TextEncoder(packing.default_path()), pa.array(texts)  # one that has not met the words
        at = time.process_time()
        encoder.encode(column)
        whole.append(time.process_time() - at)
        at = time.process_time()
        for t in texts:
            encoder.plain.encode_ordinary(t)
        plain.append(time.process_time() - at)
    assert min(whole) < 2 * min(plain)


def test_packing_encodes_odd_texts_whole():
    odd = ["a" + " " * 1_000_000 + "b", "a" + "\n \t" * 400_000, "x <|endoftext|> y", "a\xa0 b\u3000c", "", None, " ", "plain text", "a\r\n\r\nb  ", "<|endoftext|>"]
    encoder = tokens.TextEncoder(packing.default_path())
    ids, first = encoder.encode(pa.array(odd))
    for t, a, b in zip(odd, first[:-1], first[1:], strict=True):
        assert ids[a:b].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("n", [1, 30, 3000])
def test_plan_places_every_piece_once(n):
    rng = np.random.default_rng(n)
    histogram = Counter(int(x) for x in np.minimum(rng.lognormal(5, 1, n).astype(int) + 1, 1024))
    p = packing.plan(histogram)
    spots = []
    for size, count in histogram.items():
        seq, off, here = p.place(np.full(count, size), np.arange(count))
        for s, o, h in zip(seq.tolist(), off.tolist(), here.tolist(), strict=True):
            spots += [(s, o, h)] + ([(s + 1, 0, size - h)] if h < size else [])
    at = {}
    for s, o, size in sorted(spots):
        assert o == at.get(s, 0)
        at[s] = o + size
    assert max(at.values()) <= 1024 and len(at) == p.sequences == max(at) + 1
    assert sum(int(packing.padded(v)) - v for v in at.values()) == p.padding < 1024


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24))
    x[50:60] = x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 24), (902, [1.0, None] + [0.0] * 22), (903, [float("nan")] * 24), (None, rows[0][1]), (904, [float("inf")] * 24), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 20 = 0 or vec_id in (5, 51)"), 20).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    queries = [i for i in range(400) if i % 20 == 0] + [5, 51]
    for q in queries:
        s = (x * x[q]).sum(axis=1)
        want = [int(i) for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        mine = [v for _, v, _ in sorted(by[q])]
        assert [r for r, _, _ in sorted(by[q])] == list(range(1, len(mine) + 1)) and q not in mine
        assert all(abs(c - s[v]) < 1e-12 for _, v, c in by[q])
        hits += len(set(want) & set(mine))
    assert hits / 20 / len(queries) >= 0.9
    assert [v for _, v, _ in sorted(by[5])][:10] == list(range(50, 60))
    assert set(by) == set(queries)


def test_toxicity(spark, docs, empty):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 200]))] + ([rng.choice(["vile", "rotten"])] if toxic else [])
        if rng.random() < 0.5:
            text.append("woman" if toxic or rng.random() < 0.1 else "man")
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.classify(d, lab).collect()}
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900))
    held = [i for i in range(900) if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == (i % 4 == 0) for i in held) / len(held) > 0.95
    model = toxicity.train(d, lab)
    import pyarrow as pa

    a, b = model.scores(pa.array(["w1 w2 the woman spoke", "w1 w2 the man spoke"]))
    assert abs(a - b) < 0.2
    assert toxicity.classify(docs, lab).count() == len(ROWS)
    assert toxicity.classify(empty, lab.limit(0)).count() == 0
    scored = toxicity.score(docs.withColumnRenamed("lang", "score"), model)
    assert scored.count() == len(ROWS) and scored.schema["score_"].dataType.simpleString() == "double"
    assert {r["score"] for r in scored.collect()} == {r[2] for r in ROWS}  # the input's own column


def test_decontamination(spark, docs, empty):
    item = "the quick brown fox jumps over the lazy dog while many small birds sing in old green trees near water"
    words = item.split()
    edit = " ".join([*words[:10], "CHANGED", *words[11:]])
    near = item.replace("water", "river")
    rows = [(1, "intro " + item.upper() + "! outro"), (2, edit), (3, "x " + near + " y"), (4, "nothing here"), (5, None), (6, ""), (7, item + " " + item)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(10, item), (11, "tiny item"), (12, ""), (13, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {(1, 10), (3, 10), (7, 10)} and got[(1, 10)]["similarity"] == 1.0 and got[(1, 10)]["start"] == 1
    assert 0.8 <= got[(3, 10)]["similarity"] < 1
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(d, b).collect()) == [2, 4, 5, 6]
    assert decontaminate.leaks(docs, b.limit(0)).count() == 0 and decontaminate.leaks(empty, b).count() == 0


def test_language_id(spark, empty):
    rng = random.Random(6)
    voc = {"aa": ["qua", "quo", "zet", "bom"], "bb": ["thri", "lmo", "grun", "fel"]}
    say = lambda l, n: " ".join("".join(rng.choice(voc[l]) for _ in range(2)) for _ in range(n))  # noqa: E731, E741
    d = spark.createDataFrame([(i, say(l, 50), l) for i, l in enumerate(["aa", "bb"] * 20)] + [(99, None, "aa")], "doc_id long, text string, lang string")
    pages = [(i, f"http://h{l}.example.{l}/x", f"<html lang='{l}'><script>{say('aa', 30)}</script><p>{say(l, 40)}</p>") for i, l in enumerate(["aa", "bb"] * 20)]
    pages += [(100, "http://hbb.example.bb/", "<p></p>"), (101, None, None), (102, "http://haa.example.aa/y", f"<html lang=bb>{say('aa', 60)}")]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.identify(p, d).collect()}
    assert len(got) == len(pages) and all(got[i]["lang"] == ("aa", "bb")[i % 2] for i in range(40))
    assert got[100]["lang"] == "bb" and got[102]["lang"] == "aa" and got[101]["lang"] in ("aa", "bb")
    assert langid.identify(p, d.limit(0)).where("lang is null").count() == len(pages)
    assert langid.identify(p.limit(0), d).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.count() > 0.7 * docs.count(), name
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.count()


def test_verified_near_duplicates(spark, docs, empty):
    from strandweave.llm import neardup

    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    rows, i = [], 0
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(200)]
        for edits in (0, 1, 2, 3):
            w = list(base)
            for e in range(edits):
                w[20 + 50 * e] = "edited"
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(500, rows[0][1]), (501, ""), (502, None), (None, rows[0][1]), (503, "one"), (504, "one two")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {d for d, _ in rows if d is not None}
    assert sum(got[j] == j // 4 * 4 for j in range(160)) >= 158  # candidates are approximate, similarity is exact
    assert all(got[j] // 4 == j // 4 for j in range(160)) and got[500] == 0 and got[501] == got[502] == 501 and got[503] == 503 and got[504] == 504
    assert neardup.groups(docs).count() == len([r for r in ROWS if r[0] is not None]) and neardup.groups(empty).count() == 0


def _similar_groups(rows):
    """The least doc_id each is linked to by pairs of similar shingle sets, by brute force."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = {d: d for d, _ in rows}
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    for _ in rows:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return group


def _words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def test_near_duplicates_just_over_the_limit(spark):
    from strandweave.llm import neardup

    rng, rows = random.Random(21), []
    for i in range(150):  # four edits of 200 words leave a similarity of 0.815, five 0.77
        w = _words(rng, 200)
        rows.append((2 * i, " ".join(w)))
        for e in range(5 if i % 5 == 0 else 4):
            w[20 + 35 * e] = "edited"
        rows.append((2 * i + 1, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d if d // 2 % 5 == 0 else d // 2 * 2 for d, _ in rows}


def test_near_duplicates_link_through_every_similar_pair(spark):
    from strandweave.llm import neardup

    rng, rows = random.Random(22), []
    for i in range(60):  # chains: neighbours are similar, the two in the middle less than the others, the ends not; a template is common to all of a chain
        w, steps = _words(rng, 200), (1, 4, 1)
        rows.append((4 * i, " ".join(w)))
        for j, e in enumerate(steps):
            for at in rng.sample(range(j * 8, 192, 24), e):
                w[at] = _words(rng, 1)[0]
            rows.append((4 * i + j + 1, " ".join(w)))
    shared = _words(rng, 140)
    rows += [(1000 + i, " ".join(shared + own)) for i, own in enumerate(_words(rng, 60) for _ in range(40))]
    last = rows[-1][1].split()
    rows.append((1100, " ".join([*last[:150], "changed", *last[151:]])))
    want = _similar_groups(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and want[1100] == 1039 and len({want[d] for d in range(240)}) == 60


@pytest.mark.parametrize("sample, common, tile", [(32, 16, 2048), (1, 2, 1), (2, 1, 3)])
def test_near_duplicates_do_not_depend_on_order_or_tiles(spark, monkeypatch, sample, common, tile):
    from strandweave.llm import neardup

    rng, rows = random.Random(23), [(-1, None), (-2, ""), (-3, "One two"), (-4, "one  TWO")]
    shared = _words(rng, 60)
    for i in range(0, 90, 3):
        w = shared + _words(rng, rng.choice([0, 5, 20, 60]))
        for j in range(3):
            w[rng.randrange(len(w))] = _words(rng, 1)[0]
            rows.append((i + j, " ".join(w[: len(w) - rng.choice([0, 3])])))
    want = _similar_groups(rows) | {-1: -2}
    for name, value in (("SAMPLE", sample), ("COMMON", common), ("TILE", tile)):
        monkeypatch.setattr(neardup, name, value)
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 5


def test_repeated_passages_name_the_least_document_over_chunks(spark):
    rng = random.Random(31)
    passage, other = _words(rng, 80), _words(rng, 70)
    say = lambda *w: " ".join([*_words(rng, 30), *(x for p in w for x in p), *_words(rng, 30)])
    chunks = [[(9, say(passage)), (4, say(other)), (11, say(other))], [(5, say(passage)), (7, say(passage, other))], [(1, say(passage)), (12, say(passage)), (3, say(other))]]
    rdd = spark.sparkContext.parallelize([r for c in chunks for r in c], 8)
    for parts in (rdd, spark.sparkContext.union([spark.sparkContext.parallelize(c, 1) for c in chunks])):
        got = {(r["doc_id"], r["length"], r["earlier_doc_id"]) for r in suffixes.repeated_passages(spark.createDataFrame(parts, "doc_id long, text string")).collect()}
        assert got == {(5, 80, 1), (7, 150, 1), (9, 80, 1), (12, 80, 1), (4, 70, 3), (11, 70, 3)}


def test_ann_answers_are_full(spark):
    rng = np.random.default_rng(41)
    x = rng.normal(size=(15, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for k in (5, 20):
        got = defaultdict(dict)
        for r in ann.search(df, df, k).collect():
            got[r["query_id"]][r["rank"]] = r["vec_id"]
        assert all(sorted(got[q]) == list(range(1, min(k, 14) + 1)) for q in range(15))
    for q in range(15):
        assert [got[q][r] for r in range(1, 15)] == [int(i) for i in np.argsort(-(x @ x[q])) if i != q]


def _passages(rows):
    """(doc_id, start, length, earlier_doc_id) by plain comparison of all 50-word windows; rows are (doc_id, text)."""
    first, out = {}, set()
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    for d, w in words:
        late = [(i, first[tuple(w[i : i + 50])]) for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d]
        at = 0
        while at < len(late):
            to = at + 1
            while to < len(late) and late[to][0] <= late[to - 1][0] + 50:
                to += 1
            out.add((d, late[at][0], late[to - 1][0] + 50 - late[at][0], min(e for _, e in late[at:to])))
            at = to
    return out


@pytest.mark.parametrize("group, rows, held", [(1 << 15, 1 << 14, 200_000), (3, 4, 200_000), (5, 1 << 14, 0)])
def test_passages_of_hot_groups_and_over_parts(spark, monkeypatch, group, rows, held):
    for name, value in (("GROUP", group), ("ROWS", rows), ("HELD", held), ("BYTES", held * 64)):
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(51)
    vocab = _words(rng, 6)  # few words: many equal minimisers, repeats within documents
    long, short = [rng.choice(vocab) for _ in range(130)], _words(rng, 60)
    texts = []
    for i in range(30):
        w = _words(rng, rng.choice([0, 5, 40]))
        a, b = sorted(rng.sample(range(131), 2))
        texts.append(" ".join(w + long[a:b] + _words(rng, rng.choice([0, 3])) + (short if i % 3 == 0 else [])))
    texts += [texts[4], "a " * 200, "a " * 120, None, "", "x" * 3_000_000 + " " + " ".join(short)]
    table = [(int(d), t) for d, t in zip(rng.sample(range(1000), len(texts)), texts, strict=True)]
    table.append((table[3][0], texts[6]))  # a doc_id with two texts
    got = {tuple(r) for r in suffixes.repeated_passages(spark.createDataFrame([*table, table[7], (None, texts[4])], "doc_id long, text string").repartition(4)).collect()}
    assert got == _passages(table) and len(got) >= 15


def _nearest_plain(x, ids, k):
    out = {}
    for q, v in zip(ids, x, strict=True):
        s = (x * v).sum(axis=1)
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != q)
        out[q] = [i for _, i in order[:k]]
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 11, 21, 30])
def test_ann_small_tables_are_answered_in_full(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0.5, 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, score double, rank int")
    rows = ann.search(df, df).collect()
    got = defaultdict(dict)
    for r in rows:
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    want = _nearest_plain(x.astype(float), list(range(n)), 20)
    assert {q: [got[q][r] for r in sorted(got[q])] for q in got} == {q: w for q, w in want.items() if w}


@pytest.mark.parametrize("hashes", [1, 2])
def test_ann_bands_copies_and_pairs_of_axes(spark, hashes):
    """Norms over several powers of two, a vector that a third of the rows hold, and cells that are pairs of axes."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)) * rng.choice([0.1, 1.0, 9.0], size=(300, 1))
    x[::3] = x[3]
    ids = [7 * i for i in range(300)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = defaultdict(dict)
    for r in ann.search(df.unionByName(df.limit(5)), df.where("vec_id % 5 = 0"), 10, hashes=hashes).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    want = _nearest_plain(x, ids, 10)
    hit = 0
    for q in (i for i in ids if i % 5 == 0):
        mine = [got[q][r] for r in sorted(got[q])]
        assert len(mine) == 10 and all(abs(s - float((x[ids.index(v)] * x[ids.index(q)]).sum())) < 1e-9 for v, s in mine)
        hit += len({v for v, _ in mine} & set(want[q]))
    assert hit >= 0.9 * 10 * 60


def test_probing_plans_reach_their_target():
    rng = np.random.default_rng(2)
    cosines, plans = ann.probing(32, 1, 2, 0.9)
    q = rng.normal(size=(800, 32))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    u = rng.normal(size=q.shape)
    u -= (u * q).sum(axis=1, keepdims=True) * q
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for c, (tables, count) in zip(cosines, plans, strict=True):
        if count:
            found = np.zeros(len(q), bool)
            for t in range(tables):
                near, own = ann.cells(q, t, 1, count), ann.cells(c * q + np.sqrt(1 - c * c) * u, t, 1, 1)
                found |= (near == own).any(axis=1)
            assert found.mean() > 0.86, c
    assert plans[-1][1] * plans[-1][0] < plans[2][1] * plans[2][0] or plans[2][1] == 0  # near neighbours need fewer cells


def test_substrings_of_texts_over_a_chunk(spark):
    rng = random.Random(61)
    vocab = _words(rng, 5000)
    long = [rng.choice(vocab) for _ in range(750_000)]
    rows = [(9, " ".join(long)), (3, " ".join(long[100:140])), (12, " ".join(_words(rng, 9) + long[699_990:700_020])), (20, " ".join(long[100:112]))]
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).drop("kept").collect()}
    want = {}
    for d, t in rows:
        w = t.split()
        want[d] = (len(w), len({j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}))
    assert got == want and want[9][1] == 40 and want[12][1] == 30 and want[20][1] == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, most):
    from strandweave.llm import graph

    monkeypatch.setattr(graph, "ONE_TASK", most)
    rng = random.Random(71)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3), (-7, 1000)]
    least = {}
    for a, b in edges:
        if a is not None and a != b:
            least.setdefault(a, a)
            least.setdefault(b, b)
    for _ in range(80):
        for a, b in edges:
            if a is not None and a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least and graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
