"""Whole operators and the pipeline against plain versions, and rows that are odd, repeated or hot."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import decontam, langid, license_scan, minhash, mixing, pii, pq_neardup, quality, sharding, tokenout
from evidentia.llm.common import scratch_path

SF = "/root/testdata/sf0.001"
CLASH = ("row", "k", "h", "m", "total", "rid", "key", "size", "_copy", "_copies", "_doc_id", "spread", "range", "t", "n")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, repeated ids, null ids, null and empty texts, and columns of names that operators use inside."""
    t = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, t, "a", 0), (1, t, "a", 1), (2, t + " x", "b", 2), (None, t, "c", 3), (None, "alone in the world with some words", "c", 4), (None, "alone in the world with some words", "c", 5), (3, None, "d", 6), (3, None, "d", 7), (None, None, None, 8), (4, "", None, 9), (5, "a text of five and of this and that", "e", 10), (5, "another text of five that and this", "e", 11)]
    return spark.createDataFrame([(i, x, "en", s, -1, k) for i, x, s, k in rows], "doc_id long, text string, lang string, source string, n_chars long, mark int").withColumns({c: F.lit(99) for c in CLASH})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_odd_rows_of_the_pipeline_stages(spark, odd):
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, kept.filter("doc_id = 1").first().text), (3, None), (4, ""), (5, "a text of five and of this and that"), (5, "another text of five that and this"), (None, "alone in the world with some words"), (None, None)], key=str)
    taken, mixed = mixing.mix(odd).collect(), mixing.mixed(odd)
    assert len(taken) == odd.count() and mixed.columns == odd.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter({i: sum(r.copies for r in taken if r.doc_id == i) for i in {r.doc_id for r in taken}})
    assert all(r._copy == 99 and r._copies == 99 and r._doc_id == 99 for r in mixed.collect())
    with pytest.raises(ValueError):
        mixing.mix(odd, most=3)
    items = spark.createDataFrame([(1, "eight nine ten")], "item_id long, text string")
    for most in (200_000, 1):
        clean = decontam.remove_contamination(odd, items, max_words=most)
        assert clean.columns == odd.columns and clean.count() == odd.count()
        got = Counter((r.text, r.n_chars) for r in clean.collect())
        cut = lambda x: x and x.replace("eight nine ten", "")
        assert got == Counter((cut(r.text), -1 if cut(r.text) == r.text else len(cut(r.text))) for r in odd.collect()) and len(got) > 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.token_stage(spark, odd, SF).count() == odd.count() and corpus_pipeline.token_stage(spark, odd.limit(0), SF).count() == 0


def test_empty_tables(spark, odd, real):
    none = odd.limit(0)
    assert pii.find_pii(none).count() == license_scan.scan(none).count() == sharding.assign(none).count() == 0
    model = langid.train(real.limit(20), per_language=5, rounds=1)
    assert langid.predict(none, model).count() == 0 and quality.predict(none, None).count() == 0
    items = spark.createDataFrame([(1, "a b c"), (2, "d e f g")], "item_id long, text string")
    assert decontam.scan(none, items).count() == decontam.scan(none, items, max_words=3).count() == 0


def test_pipeline_equals_a_plain_version(spark, real):
    """All five stages in plain Python; the models and the budget's knapsack are the operator's own."""
    docs = {r.doc_id: r for r in real.collect()}
    ids = [i for i, r in docs.items() if any(c.isalpha() for c in (r.text or "").lower())]
    # near copies: five-word shingles, connected by links
    sets = {}
    for i in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[i].text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    ids = [i for i in ids if find(i) == i]
    # benchmark passages
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    lengths = {len(k) for k in windows}

    def spans(text):
        found = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        w = words(text)
        hit = {p for n in lengths for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        runs = []
        for p in sorted(hit):
            if runs and runs[-1][1] == p:
                runs[-1][1] = p + 1
            else:
                runs.append([p, p + 1])
        return found, runs

    text = {}
    for i in ids:
        x, at_first = docs[i].text, True
        while True:
            found, runs = spans(x)
            if not runs:
                text[i] = x
                break
            if at_first and (max(b - a for a, b in runs) > 200 or sum(b - a for a, b in runs) > 0.5 * len(found)):
                break
            at_first = False
            for a, b in reversed(runs):
                x = x[: found[a][0]] + x[found[b - 1][1] :]
    # the mix takes near its targets; each document at most twice
    left = spark.createDataFrame([(i, x, docs[i].source) for i, x in text.items()], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(left).collect()}
    assert set(copies) == set(text) and set(copies.values()) <= {0, 1, 2}
    # tokens
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for i in sorted(text):
        for _ in range(copies[i]):
            one = [*tok.encode(text[i], add_special_tokens=False).ids, 1]
            want.append((i, start, len(one), zlib.crc32(np.array(one, "<u4").tobytes())))
            start += len(one)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert len(want) > 100 and got == want


def test_token_encoder_equals_the_whole_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), tokenout.WordEncoder(path, 1, max_known=500)
    rng = random.Random(6)
    parts = ["a", "B", "z", "É", "ß", "İ", "K", "é", "'s", "'LL", "'", "<|", "<|endoftext|>", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "中", "\U0001f600", "12", "!", "...", "-", "\x00", "ﬁ", "×", "Σ", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for lo in range(0, len(texts), 150):
        n, ids = enc.encode(pa.array(texts[lo : lo + 150], pa.large_string()))
        at = 0
        for t, k in zip(texts[lo : lo + 150], n.tolist(), strict=True):
            assert ids[at : at + k].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t
            at += k


def test_token_files_of_equal_and_null_ids_are_read_selectively(spark):
    rows = [(None, "a"), (None, None), (None, "b c"), *((7, f"w{i} x") for i in range(60)), (9, "end")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "t")
    tokenout.write_token_files(d, path, partitions=6)
    files = spark.read.parquet(path)
    assert files.filter("doc_id = 7").select("part").distinct().count() > 1
    every = tokenout.read_token_files(spark, path).collect()
    at = 0
    for r in sorted(every, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in sorted(every, key=lambda r: r.start)] == [None] * 3 + [7] * 60 + [9]
    one = tokenout.read_token_files(spark, path, (9, 9))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.start) for r in one.collect()] == [(9, max(r.start for r in every))]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,9)" in plan and "Window" not in plan


def votes(text):
    """The notices of a text by plain counting: (template, share) of each merged span that fits, and its words."""
    w, out = words(text), []
    k = license_scan.K
    for t, (notice, label) in enumerate(license_scan.NOTICES):
        n = notice.split()
        spots = defaultdict(list)
        for j in range(len(n) - k + 1):
            spots[tuple(n[j : j + k])].append(j)
        diagonal = defaultdict(set)
        for i in range(len(w) - k + 1):
            for j in spots.get(tuple(w[i : i + k]), ()):
                diagonal[i - j].add((i, j))
        heaps, last = [], None
        for d in sorted(diagonal):
            if last is None or d - last > license_scan.GAP:
                heaps.append(set())
            heaps[-1] |= diagonal[d]
            last = d
        for h in heaps:
            lo, hi = min(i for i, _ in h), max(i for i, _ in h)
            share = len({j for _, j in h}) / (len(n) - k + 1)
            if share >= license_scan.COVERAGE and hi - lo + k <= len(n) * license_scan.STRETCH:
                out.append((lo, hi + k, share, len({j for _, j in h}), t, label))
    best, heap, end = [], [], 0
    for s in sorted(out, key=lambda s: (s[0], s[4])):
        if heap and s[0] >= end:
            best.append(min(heap, key=lambda s: (-s[2], -s[3], s[4])))
            heap = []
        heap.append(s)
        end = max(end, s[1]) if len(heap) > 1 else s[1]
    return best + ([min(heap, key=lambda s: (-s[2], -s[3], s[4]))] if heap else [])


def test_license_labels_equal_plain_votes(spark, real):
    notice = {label: w for w, label in license_scan.NOTICES}
    rng = random.Random(8)
    texts = ["licensed under the gnu under the gnu under the gnu general", *notice.values(), f"{notice['bsd-3']} and {notice['isc']}", "the mit license " * 3]
    for _ in range(60):
        w = rng.choice(license_scan.NOTICES)[0].split()
        for _ in range(rng.randint(0, len(w) // 4)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["x"], [w[k], "y"], w[k : k + 4] * 2])
        texts.append(f"{rng.choice(['', 'some words before '])}{' '.join(w)} {rng.choice(['', rng.choice(license_scan.NOTICES)[0]])}")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(real.select(F.col("doc_id") + 1000, "text"))
    seen = Counter()
    for r in license_scan.scan(d).join(d, "doc_id").collect():
        w, found = words(r.text), votes(r.text)
        phrases = {label for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
        assert r.labels == ",".join(sorted(phrases | {s[5] for s in found})), (r.doc_id, r.text)
        assert r.score == pytest.approx(1.0 if phrases else max((s[2] for s in found), default=0.0))
        seen.update(r.labels.split(","))
    assert {"bsd-2", "bsd-3", "gpl-2", "gpl-3", "lgpl-2.1", "agpl-3", "isc", "mit"} <= set(seen)
    assert license_scan.scan(d.filter("doc_id = 0")).first().labels == ""
    twice = license_scan.scan(spark.createDataFrame([(1, "the mit license")] * 3 + [(1, None)], d.schema)).collect()
    assert sorted(r.n_base for r in twice) == [0, 1, 1, 1]


def test_pii_context_decides_and_rows_add_up(spark, real):
    told = lambda text: [(k, s) for _, _, k, s in pii.scored_spans(text)]
    assert told("SSN 123-45-6789") == [("ssn", 0.6)] and told("123-45-6789") == [] and told("ssn of order 123-45-6789") == []
    assert told("DE89 3704 0044 0532 0130 00") == [("iban", 0.7)] and told("iban DE89 3704 0044 0532 0130 00") == [("iban", 1.0)] and told("part DE89 3704 0044 0532 0130 00") == []
    assert told("version 10.0.0.1") == [("ip", 0.3)] and told("host 10.0.0.1") == [("ip", 0.9)]
    text = {r.doc_id: r.text or "" for r in real.collect()}
    for r in pii.find_pii(real).collect():
        spans = [(a, b, k) for a, b, k, _ in pii.scored_spans(text[r.doc_id])]
        base = [s for s in pii.base_spans(text[r.doc_id])]
        show = lambda x: ",".join(f"{k}:{a}:{b}" for a, b, k in x)
        assert r.spans == show(spans) and r.base_sha256 == hashlib.sha256(show(base).encode()).hexdigest() and set(base) <= set(spans)
        n = Counter(k for _, _, k in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in pii.BASE_KINDS)
        assert len(r.scores.split(",")) == max(1, len(spans)) and (r.max_score is None) == (not spans)
    masked = spark.createDataFrame([(1, "a@b.cd, a@b.cd"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in pii.masked(masked).orderBy("doc_id").collect()] == ["[email], [email]", None, ""]


def test_quality_statistics_and_trees_equal_plain_versions(real):
    texts = [r.text or "" for r in real.limit(80).collect()] + ["", "a", "A b\n\nA b\n!|{}", "é é"]
    x = quality.statistics(pa.array(texts, pa.large_string()))
    for t, got in zip(texts, x, strict=True):
        b = t.encode()
        w, lines = re.findall(rb"[^\x20\x09-\x0D]+", b), [s for s in re.split(rb"[\n\r]", b) if s]
        low = [v.lower() for v in w]
        nw, nl, n = max(1, len(w)), max(1, len(lines)), max(1, len(b))
        shares = {k: sum(c in v for c in b) / n for k, v in quality._CLASSES.items()}
        want = [np.log1p(len(b)), np.log1p(len(w)), sum(map(len, w)) / nw, len(set(low)) / nw, max(Counter(low).values(), default=0) / nw, len(lines) / nw, len({s.lower() for s in lines}) / nl, len(b) / nl, (1 - sum(shares.values())) if b else 0, *shares.values()]
        assert np.allclose(got, want if b else 0), t
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 5))
    trees = quality.BoostedTrees(v, (v[:, 0] + v[:, 1] * v[:, 2] > 0).astype(float), trees=12, depth=3)
    for row, p in zip(v, trees.predict(v), strict=True):
        score = trees.base
        for t in range(12):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
            score += trees.leaf[t, node - 7]
        assert p == pytest.approx(1 / (1 + np.exp(-score)))


def test_long_words_are_summed_whole():
    pieces = ["a", "ab", "b", "ba", "bab"]
    prob = np.array([[0.3, 0.1], [0.2, 0.4], [0.1, 0.2], [0.1, 0.1], [0.2, 0.1], [0, 0]])
    model = langid.UnigramModel(pieces, ["x", "y"], prob)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (33, 40, 100, 40, 2000)]
    longer = []
    langid.cut_words(pa.array([*texts, "ab ab"]), longer)
    got = langid.forward_long(longer, model.table, prob)
    for t, g in zip(texts, got, strict=True):
        alpha, log = [np.ones(2)], np.zeros(2)
        for j in range(len(t)):
            new = sum(alpha[-k] * np.maximum(prob[pieces.index(t[j + 1 - k : j + 1])] if t[j + 1 - k : j + 1] in pieces else 0.0, langid.FLOOR if k == 1 else 0.0) for k in range(1, min(j + 1, 3) + 1))
            log += np.log(new)
            alpha = [a / new for a in alpha[-3:]] + [np.ones(2)]
        assert np.allclose(g, log)
    lang, _ = model.predict(pa.array(texts))
    assert lang == [("x", "y")[int(g.argmax())] for g in got]


def test_vectors_of_one_id_and_many_lists(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    rows = [(i // 2, (base[i % 20] + rng.normal(scale=0.06, size=16)).tolist(), 0) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.98
    n = near.sum(1) - 1
    want = Counter((r[0], int(k)) for r, k in zip(rows, n, strict=True))
    for per_list in (400, 20, 5):
        got = pq_neardup.near_duplicates(v, per_list=per_list, block=8).collect()
        assert Counter((r.vec_id, r.n_links) for r in got) == want
        # rows of one id are rows of their own: components join rows, and go by the smallest id in them
        label = np.arange(len(rows))
        for _ in range(len(rows)):
            low = np.array([label[m].min() for m in near])
            if (low == label).all():
                break
            label = low
        name = {k: min(r[0] for r, m in zip(rows, label, strict=True) if m == k) for k in set(label)}
        assert Counter((r.vec_id, r.component_id) for r in got) == Counter((r[0], name[k]) for r, k in zip(rows, label, strict=True))


def test_shards_of_hot_and_odd_rows(spark, odd):
    many = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, "the very same text").otherwise(F.concat(F.lit("text "), (F.col("id") % 900).cast("string"))).alias("text"))
    d = many.withColumnRenamed("id", "doc_id")
    rows = sharding.assign(d, ranges_per_shard=16, rows_per_range=50).join(d, "doc_id").collect()
    load, where = Counter(), defaultdict(set)
    for r in rows:
        load[r.shard] += r["size"]
        where[r.text].add(r.shard)
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values())
    assert {t for t, s in where.items() if len(s) > 1} == {"the very same text"}
    same = spark.createDataFrame([(1, "x")] * 800, "doc_id long, text string")
    load = Counter(r.shard for r in sharding.assign(same, rows_per_range=10).collect())
    assert len(load) == 8 and max(load.values()) < 200
    path = scratch_path(spark, "shards")
    sharding.write_shards(odd, path, shards=3)
    back = spark.read.parquet(path)
    assert back.columns == [*odd.columns, "shard"] and sorted(map(str, back.drop("shard").collect())) == sorted(map(str, odd.collect()))


def test_repeated_ids_with_other_texts(spark):
    t = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(t)), (1, "quite another text of one"), (2, " ".join(t[1:])), (3, "quite another text of one"), (3, "quite another text of one"), (4, "a b")]
    got = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got[(1, 1)] == 2 and got[(3, 1)] == 2 and got[(4, 4)] == 1


def test_long_words_teach_whole():
    """Expected counts over all segmentations, against an enumeration of them; a very long word stays finite."""
    pieces = sorted(["a", "b", "ab", "ba", "aba", "abab"])
    rng = np.random.default_rng(3)
    prob = np.append(rng.random(len(pieces)), 0.0)[:, None]
    prob /= prob.sum()
    model = langid.UnigramModel(pieces, ["x"], prob)

    def cuts(w):
        if not w:
            yield []
        for k in range(1, min(len(w), 4) + 1):
            if w[:k] in pieces or k == 1:
                yield from ([w[:k], *rest] for rest in cuts(w[k:]))

    texts, weight = ["ababa", "b", "abacab", "bababab"], np.array([2.0, 1.0, 3.0, 1.0])
    want = np.zeros(len(pieces) + 1)
    for t, n in zip(texts, weight, strict=True):
        ways = [(c, np.prod([max(prob[pieces.index(x), 0] if x in pieces else 0.0, langid.FLOOR if len(x) == 1 else 0.0) for x in c])) for c in cuts(t)]
        for c, p in ways:
            for x in c:
                want[pieces.index(x) if x in pieces else len(pieces)] += n * p / sum(p for _, p in ways)
    got = langid.expect_long([langid._codes(t) for t in texts], weight, model.table, prob[:, 0], block=5)
    assert np.allclose(got, want)
    long = langid.expect_long([langid._codes("ab" * 20000)], np.ones(1), model.table, prob[:, 0])
    assert abs(sum(x * len(p) for x, p in zip(long, pieces, strict=False)) - 40000) < 1e-3


def test_training_takes_long_words_and_equals_itself_in_parts(spark):
    rows = [(i, ("ab" * 40 + " haus ") * 3, "x") for i in range(4)] + [(i, "und der hund " * 3, "y") for i in range(4, 8)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=2)
    words = {w: 12.0 for w in ("ab" * 40, "haus")}
    p = np.full(len(model.pieces) + 1, 1 / (len(model.pieces) + 1))
    p[-1] = 0
    for _ in range(2):
        x = langid.expect_long([langid._codes(w) for w in words], np.array(list(words.values())), model.table, p)
        x[-1] = 0
        x[:-1] += 0.05
        p = x / x.sum()
    assert np.allclose(model.prob[:, 0], p)


def test_rows_that_share_an_id_and_differ(spark):
    """Different texts of one doc_id are compared and kept each; rows that differ in any column are mixed each."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, "s", 1), (7, a, "s", 2), (7, b, "s", 3), (9, b + " end", "s", 4), (9, c, "s", 5), (9, c, "s", 6), (11, "", "s", 7), (11, None, "s", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int")
    assert sorted(r.mark for r in minhash.deduplicated(docs).collect()) == [1, 3, 5, 7, 8]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False), (9, 5, False), (9, 5, False), (11, 11, True), (11, 11, True)]
    two = spark.createDataFrame([(1, "x y z", "s", 1), (1, "x y z", "s", 2)], "doc_id long, text string, source string, mark int")
    assert sorted(r.mark for r in mixing.mixed(two, share=1.0).collect()) == [1, 2]
    assert sorted(r.mark for r in mixing.mixed(two, share=2.0).collect()) == [1, 1, 2, 2]
