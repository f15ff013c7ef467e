"""Whitening, ranked search and removal of repeated passages against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import queries, ranked_search, substring, whitening

SF = "/root/testdata/sf0.001"


def clash(df):
    return df.withColumns({"row": F.lit(1), "t": F.lit("x"), "h": F.lit(2), "n": F.lit(3), "bucket": F.lit(4), "runs": F.lit(5), "score": F.lit(6), "component": F.lit(7)})


def oracle(name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet{'' if __import__('os').path.isfile(f'{SF}/{table}.parquet') else '/*.parquet'}'")
    return con.execute(queries.ORACLE[name]).df()


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_substring_dedup"])
def test_equals_its_sql(spark, name):
    want = oracle(name)
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns[:2])
    assert len(want) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())), order


# whitening


def plain_whitening(vectors, most=8):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    centred = ((n * x - s) / n).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ basis[:, ::-1][:, :most] / np.sqrt(values[::-1][:most]), values[::-1][:most] / values.sum()


@pytest.mark.parametrize("dim", [1, 2, 3, 12, 40])
def test_whitening(spark, dim):
    rng = np.random.default_rng(dim)
    v = (rng.normal(size=(300, dim)) @ np.diag(1.3 ** -np.arange(dim)) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]).astype(np.float32)
    bad = [(900, None), (901, [float("nan")] * dim), (902, [None] * dim), (903, []), (904, [float("inf")] * dim), (905, [1e30] * dim), (906, [1.0] * (dim + 1))]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (5, v[5].tolist())]
    df = clash(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")).repartition(11)
    got = whitening.whitened(df).collect()
    n, deviation, white, explained = plain_whitening([r[1] for r in rows])
    k = min(8, dim)
    assert len(got) == n * k == 302 * k and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-8
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        sign = np.sign(by[3, c + 1].whitened * white[3, c])
        for i in range(300):
            r = by[i, c + 1]
            assert r.deviation == deviation[i] and abs(r.explained - explained[c]) < 1e-10 * explained[c] and abs(sign * r.whitened - white[i, c]) < 1e-7 * max(1, abs(white[i, c]))


def test_whitening_of_nothing_and_of_equal_values(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(empty).collect() == [] and whitening.whitened(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect() == []
    # constant and repeated columns: fewer components; equal eigenvalues: still white
    flat = [(i, [float(i % 2), 7.0, float(i % 2), float(i // 2 % 2), float(i // 4 % 2)]) for i in range(16)]
    got = whitening.whitened(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3} and max(r.identity_error for r in got) < 1e-10
    # sums and squares beyond 64 bits
    far = [(i, [float(i) * 1e8, 1.0 - i]) for i in range(-40, 40)]
    got = whitening.whitened(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    n, deviation, *_ = plain_whitening([x for _, x in far])
    want = {i: int(d) if d < 1 << 63 else None for (i, _), d in zip(far, deviation, strict=True)}
    assert {r.vec_id: r.deviation for r in got} == want and None in want.values() and max(r.identity_error for r in got) < 1e-6


def test_singular_values_to_high_relative_accuracy():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 64, 130):
        for a, b in ((rng.normal(size=n), rng.normal(size=n - 1)), (10.0 ** -np.arange(n) ** 0.5, 10.0 ** -np.arange(1, n) ** 0.5), (np.ones(n), np.full(n - 1, 1e-9)), (np.where(np.arange(n) % 3, 1.0, 0.0), np.ones(n - 1))):
            got, want = np.sqrt(whitening.dqds(a, b)), np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)
            assert np.abs(got - want).max() <= 1e-13 * want.max()
    # graded: small values keep their digits, where a method that works on the covariance loses them
    graded, scale = np.ones(20), 10.0 ** -np.arange(20)
    got = np.sqrt(whitening.dqds(graded * scale, 0.5 * scale[:-1] * 0.1))
    assert abs(np.prod(got / scale) - 1) < 1e-12
    r = rng.normal(size=(30, 30))
    a, b, v = whitening.bidiagonal(np.triu(r))
    assert np.abs(v.T @ v - np.eye(30)).max() < 1e-13 and np.abs(np.abs(np.linalg.svd(np.triu(r) @ v)[1]) - np.linalg.svd(np.diag(a) + np.diag(b, 1))[1]).max() < 1e-12


# search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_search(docs, items, top):
    words = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, w in words if w), sum(sum(w.values()) for _, w in words)
    df = Counter(x for _, w in words for x in w)
    out = []
    for item, text in items:
        found = []
        for d, w in words:
            n = sum(w.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * w[x] // (1000 * w[x] + 20 * (50 + 50 * n * n_docs // total))) for x in set(terms(text)) if x in w)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:top])]
    return out


@pytest.mark.parametrize(("top", "stages", "pairs"), [(5, 4, 1_000_000), (50, 1, 40), (3, 7, 15), (1, 2, 1_000_000)])
def test_search(spark, top, stages, pairs):
    rng = random.Random(top)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "éa", "中文", "Mixed", "mixed", "42"]
    say = lambda n: " ".join(rng.choice(vocab[: rng.randint(3, len(vocab))]) for _ in range(n))
    docs = [(i, say(rng.randint(0, 40))) for i in range(400)]
    docs += [(i, docs[7][1]) for i in range(400, 480)] + [(None, docs[7][1]), (500, None), (501, ""), (502, "--"), (7, docs[7][1]), (7, say(9)), (503, "w1 " * 30000)]
    items = [(i, say(rng.randint(1, 12))) for i in range(12)] + [(20, None), (21, "?!"), (22, "unseen"), (23, docs[7][1]), (None, "w1 w2"), (23, "w3"), (24, "MIXED Ünï ünï")]
    got = ranked_search.search(clash(spark.createDataFrame(docs, "doc_id long, text string")).repartition(9), clash(spark.createDataFrame(items, "item_id long, text string")), top=top, stages=stages, pairs=pairs)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_search(docs, items, top), key=key)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.select("doc_id", F.lit(None).cast("string").alias("text")), items)):
        got = ranked_search.search(d, i)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


# repeated passages


def plain_repeats(rows, width):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if d is not None:
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("width", "rows_per_part"), [(50, 2048), (12, 3), (2, 5), (5, 2048), (70, 10)])
def test_repeats(spark, width, rows_per_part, monkeypatch):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "été", "中", "A", "a"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [say(rng.randint(width - 2, 3 * width)) for _ in range(6)]
    rows = []
    for i in range(260):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            w += rng.choice([say(rng.randint(0, 60)), p, p[a:], p[: len(p) - a]])
        rows.append((rng.randint(0, 10**6), rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(i, rows[0][1]) for i in range(40)] + [(rows[1][0], rows[1][1])] * 2 + [(rows[2][0], rows[3][1]), (None, rows[0][1]), (None, None), (10**7, None), (10**7, ""), (10**7 + 1, "  \n")]
    rows += [(10**8 + i, "same " * 5000 + " ".join(say(3))) for i in range(3)] + [(10**8 + 5, "a b " * 3000)] * 2 + [(10**8 + 9, " x a b" + " a b" * 100 + "  tail  ")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(7)
    monkeypatch.setattr(substring, "SLICE", 4000)
    with_parts = substring.factors
    monkeypatch.setattr(substring, "factors", lambda d, width: with_parts(d, width, rows_per_part=rows_per_part))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeats(df, width).collect())
    want = plain_repeats(rows, width)
    assert got == Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in want) and sum(k > 0 for _, _, k, _ in want) > 50
    cut = substring.without_repeats(df, width)
    assert cut.columns == df.columns
    texts = Counter((r.doc_id, r.text) for r in cut.collect())
    assert texts == Counter((d, t if k else original) for (d, original), (_, _, k, t) in zip(rows, want, strict=True))
    assert substring.repeats(df.limit(0), width).count() == 0 and substring.without_repeats(df.limit(0), width).count() == 0


def test_one_piece_group_over_many_batches(spark):
    """A block's state holds over Arrow batches."""
    rng = random.Random(1)
    core = " ".join(f"c{i}" for i in range(60))
    rows = [(i, f"l{rng.randint(0, 40)} l{rng.randint(0, 40)} {core} r{rng.randint(0, 40)}") for i in range(900)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = Counter((r.doc_id, r.n_removed) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == Counter((d, k) for d, _, k, _ in plain_repeats(rows, 50))
    seen = defaultdict(int)
    for (_, k), n in got.items():
        seen[k] += n
    assert len(seen) >= 4
