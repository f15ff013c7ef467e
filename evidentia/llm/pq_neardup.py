"""Embedding near-duplicates by product quantisation, without losing a link.

Vectors are scaled to length 1, so cosine >= t means a distance of at most R = sqrt(2 - 2t). Coarse
centroids give inverted lists, as many as the largest label needs, since only equal labels meet; residuals
are coded by sub-vector codebooks. A vector probes its own list and every list that can hold a vector within R:
one behind a bisecting hyperplane, or behind the mean of the hyperplanes of its nearest lists, farther than R
cannot. Both vectors of a link probe each other's list, so two lists meet with only those of their vectors that
probe the other one, and no pair of lists that nothing probes meets at all.
The asymmetric table-lookup distance to a coded vector is wrong by at most that vector's stored coding
error, so lookups above R plus the error are dropped and the rest are reranked by the exact cosine.
Only training uses a sample (``sample`` rows); every vector is coded and asked.

Equal vectors collapse first and count as copies. What meets is cut into blocks of ``block`` rows, whatever the
list's size. A task returns a count and a local root per vector, not pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .components import connected_components

EPS = 1e-6
#: Distances held at once: rows of a batch times lists.
CELLS = 1 << 21


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step, c2 = max(1, CELLS // len(c)), (c * c).sum(1)
    return np.concatenate([np.argmin(c2 - 2 * x[lo : lo + step] @ c.T, axis=1) for lo in range(0, len(x), step)])


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class ProductQuantizer:
    """Coarse centroids and residual codebooks over vectors of length 1."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, seed: int):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.coarse = _kmeans(sample, max(1, min(lists, len(sample))), 8, rng)
        res = sample - self.coarse[_nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(self.dim), max(1, min(parts, self.dim)))
        self.books = [_kmeans(res[:, p], min(256, len(res)), 5, rng) for p in self.cuts]

    def encode(self, x: np.ndarray, radius: float):
        """list numbers, codes, coding errors, and for each probe of a list (its row, the list)."""
        step = max(1, CELLS // len(self.coarse))
        parts = [self._encode(x[lo : lo + step], radius) for lo in range(0, len(x), step)]
        own, codes, err, probes = zip(*parts, strict=True)
        rows = [p[0] + lo for p, lo in zip(probes, range(0, len(x), step), strict=True)]
        return np.concatenate(own), np.concatenate(codes), np.concatenate(err), (np.concatenate(rows), np.concatenate([p[1] for p in probes]))

    def _encode(self, x: np.ndarray, radius: float):
        c2, row = (self.coarse**2).sum(1), np.arange(len(x))
        d2 = np.maximum(0, (x * x).sum(1)[:, None] + c2 - 2 * x @ self.coarse.T)
        own = np.argmin(d2, axis=1)
        res = x - self.coarse[own]
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        rest = np.zeros(len(x))
        for m, (p, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            r = res[:, p]
            codes[:, m] = np.argmin((book * book).sum(1) - 2 * r @ book.T, axis=1)
            rest += ((r - book[codes[:, m]]) ** 2).sum(1)

        def near(at: np.ndarray, of: np.ndarray) -> np.ndarray:
            """Lists that a hyperplane between them and the points ``at`` (squared distance ``of``) keeps within reach."""
            apart = np.sqrt(np.maximum(0, (at * at).sum(1)[:, None] + c2 - 2 * at @ self.coarse.T))
            return d2 - of[:, None] <= 2 * apart * (radius + EPS) + EPS

        probe = near(self.coarse[own], d2[row, own])
        most = min(16, len(self.coarse) - 1)
        first = np.argpartition(d2, most, axis=1)[:, : most + 1]
        first = np.take_along_axis(first, np.argsort(np.take_along_axis(d2, first, 1), axis=1), 1)
        for m in (2, 4, 8, 16):
            if m < len(self.coarse):
                probe &= near(self.coarse[first[:, :m]].mean(1), np.take_along_axis(d2, first[:, :m], 1).mean(1))
        probe[row, own] = True
        return own, codes, np.sqrt(rest), np.nonzero(probe)

    def lookup(self, asks: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of ``asks`` to the coded vectors of one list, in single precision."""
        r = asks - self.coarse[cell]
        d2 = np.zeros((len(codes), len(asks)), np.float32)
        for m, (p, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = np.maximum(0, (r[:, p] ** 2).sum(1) + (book**2).sum(1)[:, None] - 2 * book @ r[:, p].T).astype(np.float32)
            d2 += table[codes[:, m]]
        return np.sqrt(d2.T)


def _matrix(lists, dim: int) -> np.ndarray:
    at = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(at) and (at == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(at), dim))
    out[np.arange(dim) < at[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _coded(pq, radius):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, codes, err, (row, cell) = pq.value.encode(_unit(_matrix(batch.column("vec"), pq.value.dim)), radius)
            at = np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "label", "dim", "vec")), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.ListArray.from_arrays(at, pa.array(cell.astype(np.int32)))], ["id", "n", "label", "dim", "vec", "cell", "code", "err", "probes"])

    return run


def _meet(pq, radius: float, least: float):
    none = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ask, base = pdf[pdf.asks], pdf[~pdf.asks]
        if not len(ask) or not len(base):
            return none
        dim, within = int(key[1]), key[2] == key[3]
        a, b = np.zeros((len(ask), pq.value.dim)), np.zeros((len(base), pq.value.dim))
        a[:, :dim], b[:, :dim] = np.stack(ask.vec.to_numpy()), np.stack(base.vec.to_numpy())
        codes = np.frombuffer(b"".join(base.code), np.uint8).reshape(len(base), -1)
        ua = _unit(a)
        maybe = pq.value.lookup(ua, int(key[2]), codes) <= radius + base.err.to_numpy() + 1e-4
        i, j = np.nonzero(maybe)
        # scaled by a power-free maximum first, so that huge and tiny components neither overflow nor vanish
        a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
        cos = np.einsum("ij,ij->i", a[i], b[j]) / np.sqrt((a * a).sum(1)[i] * (b * b).sum(1)[j])
        ida, idb = ask.id.to_numpy(), base.id.to_numpy()
        ok = (cos >= least) & (ida[i] != idb[j])
        i, j = i[ok], j[ok]
        if not len(i):
            return none
        links = np.bincount(i, weights=base.n.to_numpy()[j], minlength=len(ask)).astype(np.int64)
        # within one list both ask; between lists only one does, so its copies count for the other here
        back = np.bincount(j, weights=ask.n.to_numpy()[i] * (not within), minlength=len(base)).astype(np.int64)
        ra, rb = ida.copy(), idb.copy()
        while True:
            low = np.minimum(ra[i], rb[j])
            na, nb = ra.copy(), rb.copy()
            np.minimum.at(na, i, low)
            np.minimum.at(nb, j, low)
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        ua_, ub_ = np.unique(i), np.unique(j)
        return pd.DataFrame({"id": np.concatenate([ida[ua_], idb[ub_]]), "links": np.concatenate([links[ua_], back[ub_]]), "root": np.concatenate([ra[ua_], rb[ub_]])})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, sample: int = 16384, per_list: int = 256, parts: int = 16, block: int = 256, seed: int = 5) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), one row per input row.

    Two rows link when their labels are equal and not null, their lengths are equal and their cosine in
    double precision is at least ``least``; every row is a vector of its own, so equal rows link, and so do rows that
    share a vec_id. A vector that is null, empty, zero or holds a null or non-finite component links with nothing.
    n_links counts the rows linked directly, component_id is the smallest vec_id reachable, kept marks that row. A null
    vec_id has null component and kept = false. Other columns are not read. There is a list for each ``per_list``
    vectors of the largest label, up to one for each four vectors of the training sample.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"), F.col("label").cast("string").alias("label"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    v = v.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec"), "dim": F.size("vec")})
    same = ["label", "dim", "h1", "h2"]
    good = v.filter("ok")
    # a class of equal vectors goes by a number of its own: a vec_id may name several vectors
    reps = good.groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    total = reps.groupBy("label").agg(F.count("*").alias("n"), F.max("dim").alias("dim")).agg(F.max("n"), F.max("dim")).first()
    plain = v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not total[0]:
        return plain
    whole = reps.join(good.select(F.col("vec_id").alias("least"), *same, "vec"), ["least", *same]).dropDuplicates(["id"])
    whole = written(whole.select("id", "n", "label", "dim", "vec"), "whole")
    drawn = whole.select("vec", F.xxhash64("vec", F.lit(seed)).alias("r"), "id").orderBy("r", "id").limit(sample).select("vec").toArrow()["vec"].combine_chunks()
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    lists = min(max(1, total[0] // per_list), max(1, sample // 4))
    pq = spark.sparkContext.broadcast(ProductQuantizer(_unit(_matrix(drawn, int(total[1]))), lists, parts, seed))
    coded = written(whole.mapInArrow(_coded(pq, radius), f"id long, n long, label string, dim int, vec {kind}, cell int, code binary, err double, probes array<int>"), "coded")
    # of two lists that meet the lower one is coded, the upper one asks; within a list every vector is both
    on = ["label", "dim", "lo", "hi"]
    met = coded.select("label", "dim", "cell", F.explode("probes").alias("other"), "id", "n", "vec", "code", "err")
    met = met.select("label", "dim", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), (F.col("cell") >= F.col("other")).alias("up"), (F.col("cell") <= F.col("other")).alias("low"), "id", "n", "vec", "code", "err")
    cut = lambda c: F.ceil(F.count_if(c) / block).cast("int")
    blocks = written(met.groupBy(*on).agg(cut("low").alias("nb"), cut("up").alias("nq")).filter("nb > 0 and nq > 0"), "blocks")
    met = met.join(blocks, on)
    spread = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1 << 30)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = met.filter("low").select(*on, "id", "n", "vec", "code", "err", F.lit(False).alias("asks"), (spread(1) % F.col("nb")).alias("i"), every("nq").alias("j"))
    asks = met.filter("up").select(*on, "id", "n", "vec", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("err"), F.lit(True).alias("asks"), every("nb").alias("i"), (spread(2) % F.col("nq")).alias("j"))
    found = written(base.unionByName(asks).groupBy(*on, "i", "j").applyInPandas(_meet(pq, radius, least), "id long, links long, root long"), "met")
    comp = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = reps.join(links, "id", "left").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = told.groupBy("component").agg(F.min("least").alias("name"))
    told = told.join(names, "component").select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "name")
    told = written(told, "told")
    for table in (whole, coded, blocks, found, reps):
        drop_written(table)
    out = v.withColumn("label", F.when(F.col("ok"), F.col("label"))).join(told, same, "left")
    component = F.coalesce("name", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
