"""The ten operators on odd small tables and against plain brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import decontam, langid, license_scan, minhash, mixing, pii, pq_neardup, quality, sharding, tokenout

SF = "/root/testdata/sf0.001"
ODD = [(0, None, None, "s"), (1, "", "en", None), (2, "  \n", "en", "s"), (3, "word", "en", "s"), (4, "word", "en", "s"), (4, "word", "en", "s"), (5, "Ünïcode — 中文 😀", "de", "t"), (6, "x " * 60000, "fr", "t"), (7, "a" * 150000, None, "t"), (8, "+1 (437) 555-0689 and a.b@c.de 10.0.0.1", "en", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "size": F.lit(-1), "key": F.lit("clash"), "label": F.lit(9)})


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def components(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_pq(spark):
    rng = random.Random(1)
    rows, base = [], [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    for i in range(160):
        b = base[i % 6]
        rows.append((i, [x + rng.gauss(0, rng.choice([0.0, 0.05, 0.12])) for x in b], [0, 0, 1, None][i % 4]))
    rows += [(200, None, 0), (201, [0.0] * 12, 0), (202, [float("nan")] * 12, 0), (203, [1.0, 2.0], 0), (204, [2.0, 4.0], 0), (205, [1e30] * 12, 1), (206, [1e-30] * 12, 1), (207, [None] * 12, 0), (208, [], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(3))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq_neardup.near_duplicates(v, per_list=8, block=16).collect()}
    back = [(r.vec_id, r.embedding, r.label) for r in v.collect()]
    good = [(i, np.array(e, float), lab) for i, e, lab in back if e and lab is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = []
    for i, a, la in good:
        for j, b, lb in good:
            if i < j and la == lb and len(a) == len(b):
                a_, b_ = a / np.abs(a).max(), b / np.abs(b).max()
                if a_ @ b_ / np.sqrt((a_ @ a_) * (b_ @ b_)) >= 0.98:
                    links.append((i, j))
    comp = components(links, [r[0] for r in rows])
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert links and got == {i: (n[i], comp[i], comp[i] == i) for i in comp}
    assert pq_neardup.near_duplicates(v.limit(0)).count() == 0


def test_pii_equals_the_plain_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(text):
        out = []
        for kind, p in plain.items():
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d or "1"), "phone": 10 <= len(d) <= 15}[kind]
                if ok:
                    out.append((*m.span(), kind))
        return sorted(out, key=lambda x: (x[0], pii.BASE_KINDS.index(x[2])))

    rng = random.Random(2)
    found = 0
    for _ in range(4000):
        text = "".join(rng.choice(["@", "a", "b.", ".", "1", "23", "256", "4111 1111 1111 1111", "+1", "-", " ", "(", ")", "é", "%", "10.0.0.1", "x@y.zz", "+49 30 1234567"]) for _ in range(rng.randint(0, 14)))
        want = brute(text)
        found += len(want)
        assert pii.base_spans(text) == want, text
    assert found > 1000
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")


def test_pii_ibans_end_where_their_country_says():
    told = lambda text: [text[a:b] for a, b, k, _ in pii.scored_spans(text) if k == "iban"]
    for iban in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for tail in ("", " EUR 500", " 2024-01-01", " A", ". Next", " GB82 WEST 1234 5698 7654 33"):
            assert told(f"IBAN {iban}{tail}") == [iban], (iban, tail)
        assert told(f"{iban} {iban} 7") == [iban, iban] and told(f"AB12 {iban} EUR") == [iban] and told(f"{iban}X") == []
    assert told("DE89 3704 0044 0532 0130 01 EUR 500") == []
    assert told("XX" + f"{98 - int('1' * 14 + '333300') % 97:02d}" + "1" * 14 + " EUR") == ["XX" + f"{98 - int('1' * 14 + '333300') % 97:02d}" + "1" * 14]


def test_pii_rows(docs):
    got = pii.find_pii(docs).collect()
    assert len(got) == len(ODD)
    r = next(r for r in got if r.doc_id == 8)
    assert (r.n_email, r.n_ip, r.n_phone) == (1, 1, 1) and r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in pii.base_spans(ODD[-1][1])).encode()).hexdigest()
    assert pii.masked(docs).filter("doc_id = 8").first().text == "[phone] and [email] [ip]"


def test_license(spark, docs, real):
    extra = spark.createDataFrame([(900, "THE MIT license the mit-license. Apache License, Version 2 CC BY NC"), (901, "the mit licenſe of the worK"), (902, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and any associated documentation files (the Software), to deal in the Software without restriction")], "doc_id long, text string")
    d = real.select("doc_id", "text").union(extra).union(docs.select(F.col("doc_id") + 1000, "text"))
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    for r in d.distinct().collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    assert got[902].labels == "mit" and 0.6 <= got[902].score <= 1


def test_fit_budget_fills_what_its_shares_leave():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        total = sum(n * c for n, c in counts.items())
        budget = rng.randint(0, 1 + total)
        took = mixing.fit_budget(counts, budget)
        share = {n: min(c, c * budget // total) for n, c in counts.items()}
        sums = {sum(n * k for n, k in share.items())}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(c - share[n] + 1)}
        assert all(share[n] <= took.get(n, 0) <= c for n, c in counts.items())
        assert sum(n * k for n, k in took.items()) == max(s for s in sums if s <= budget)


def test_mix(real, docs):
    for d in (real, docs, docs.limit(0)):
        rows = mixing.mix(d, bucket=4).collect()
        assert len(rows) == d.count()
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    again = {r.doc_id: r.taken for r in mixing.mix(real.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in mixing.mix(real).collect()}
    src = {r.doc_id: r.source for r in real.collect()}
    per, target = defaultdict(int), {}
    size = {}
    for r in mixing.mix(real).collect():
        per[src[r.doc_id]] += r.taken
        target[src[r.doc_id]], size[src[r.doc_id]] = r.target, r.source_size
    # water filling, step by step
    want, left, open_ = {}, 1.5 * sum(size.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    while open_:
        full = [s for s, w in open_.items() if 2 * size[s] <= left * w / sum(open_.values())]
        for s in full or list(open_):
            want[s] = 2.0 * size[s] if full else left * open_[s] / sum(open_.values())
        left -= sum(want[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s not in want}
    assert all(abs(target[s] - want[s]) < 1e-6 for s in size)
    assert all(abs(per[s] - target[s]) <= max(50, 0.02 * target[s]) for s in size)
    assert mixing.mixed(real).count() == sum(r.copies for r in mixing.mix(real).collect())


def test_language_takes_the_whole_vocabulary():
    pieces = langid.vocabulary()
    assert len(pieces) == 20231 and max(map(len, pieces)) == langid.LONGEST_PIECE == 16
    word = next(p for p in pieces if len(p) == 16)
    prob = np.zeros((len(pieces) + 1, 1))
    prob[pieces.index(word)] = 0.5
    model = langid.UnigramModel(pieces, ["x"], prob)
    words, lengths, _, _ = langid.cut_words(pa.array([word]))
    assert abs(model.word_scores(words, lengths)[0, 0] - np.log(0.5)) < 1e-6


def test_language(spark, real, docs):
    model = langid.train(real.filter(~langid.held_out(F.col("doc_id"))), rounds=2)
    got = langid.predict(real, model).join(real.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2)) and odd[6].lang_pred in model.langs
    assert langid.train(docs.limit(0)).langs == []
    # the forward algorithm against a sum over all segmentations
    prob = dict(zip(model.pieces, model.prob[:, 0], strict=False))

    def brute(w):
        if not w:
            return 1.0
        return sum(max(prob.get(w[:k], 0.0), langid.FLOOR if k == 1 else 0.0) * brute(w[k:]) for k in range(1, min(len(w), langid.LONGEST_PIECE) + 1))

    words = ["the", "rathe", "x", "éléve"]
    mat = np.zeros((4, langid.LONGEST_WORD), np.uint32)
    for i, w in enumerate(words):
        mat[i, : len(w)] = [ord(c) for c in w]
    out = model.word_scores(mat, np.array([len(w) for w in words]))[:, 0]
    assert np.allclose(out, np.log([brute(w) for w in words]))


def test_quality(spark, real, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(real, labels, trees=20)
    got = quality.predict(real, model).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in quality.predict(docs, model).collect())
    assert quality.train(real, labels.limit(0)) is None


def test_decontamination(spark, real, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(900, "zz short"), (901, None), (902, "!!"), (903, "zz short")], "item_id long, text string"))
    extra = spark.createDataFrame([(5000, "A ZZ Short one; zz, short")], "doc_id long, text string")
    passages = items.filter("item_id < 3").select((F.col("item_id") + 6000).alias("doc_id"), F.concat(F.lit("clean words "), "text", F.lit(" more words follow here and then even more of them to the end of it")).alias("text"))
    d = real.select("doc_id", "text").union(extra).union(passages).union(docs.select(F.col("doc_id") + 9000, "text"))
    for most in (500_000, 30):  # one automaton, and many
        got = {r.doc_id: r for r in decontam.scan(d, items, max_words=most).collect()}
        split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        win = defaultdict(set)
        for r in items.collect():
            w = split(r.text)
            n = min(10, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                win[tuple(w[i : i + n])].add(str(r.item_id))
        lens = {len(k) for k in win}
        for r in d.collect():
            w, hit, ids = split(r.text), set(), set()
            for n in lens:
                for i in range(len(w) - n + 1):
                    if (k := tuple(w[i : i + n])) in win:
                        hit |= set(range(i, i + n))
                        ids |= win[k]
            g = got[r.doc_id]
            assert (g.n_words, g.n_hit, g.n_items, g.items_sha256) == (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
    assert got[5000].n_hit == 4 and got[6000].contaminated
    clean = decontam.remove_contamination(d, items, max_coverage=1.0)
    assert clean.count() == d.count() and decontam.scan(clean, items).filter("contaminated").count() == 0
    assert decontam.scan(d, items.limit(0)).filter("contaminated").count() == 0


def test_tokens(spark, real, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    d = real.select("doc_id", "text").union(docs.select(F.col("doc_id") + 9000, "text"))
    start = 0
    rows = sorted(d.collect(), key=lambda r: (r.doc_id, r.text or ""))
    got = sorted(tokenout.tokenized(d, partitions=5).collect(), key=lambda r: (r.doc_id, r.start))
    for r, g in zip(rows, got, strict=True):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenout.tokenized(d.limit(0)).count() == 0
    from evidentia.llm.common import scratch_path

    path = scratch_path(spark, "t")
    tokenout.write_token_files(d, path, encoding="delta")
    some = tokenout.read_token_files(spark, path, (3, 5)).orderBy("doc_id").collect()
    want = [g for g in got if 3 <= g.doc_id <= 5]
    assert [(r.doc_id, r.start, len(r.ids)) for r in some] == [(g.doc_id, g.start, g.n_tokens) for g in want]


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(spark, docs, width):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base, rows = [[rng.choice(vocab) for _ in range(80)] for _ in range(5)], []
    for i in range(220):
        w = list(base[i % 5])
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((100 + i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = {r.doc_id: shingles(r.text) for r in d.collect()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(links, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(d, width=width, block=16).collect()}
    assert len(links) > 20 and got == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_shards(real, docs):
    for d in (real, docs):
        rows = sharding.assign(d, shards=8).collect()
        want = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in d.collect())
        assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    load = defaultdict(int)
    for r in sharding.assign(real).collect():
        load[r.shard] += r["size"]
    largest = max(len((r.text or "").encode()) for r in real.collect())
    assert max(load.values()) - min(load.values()) <= 2 * largest
    assert sharding.assign(docs.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cur = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        cur = stage(spark, cur, SF)
        assert cur.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in cur.collect())
    assert decontam.scan(cur, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count() == 0
