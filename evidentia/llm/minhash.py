"""MinHash near-duplicates with b-bit signatures.

Plan. One pass over the texts gives each document the size and a 128-bit hash of its shingle set,
``perms`` minima cut to their low ``BITS`` bits and packed, and one 64-bit key per band of ``rows``
whole minima. Documents with equal sets collapse to a representative, linked at once. Candidates are
representatives sharing a band key; the collision-corrected estimate from the packed bits prunes
them with a margin of five standard deviations, and the full shingle sets confirm each link.

No bucket is expanded to all its pairs. First every member is held against the bucket's smallest id
(as many pairs as members); what this links becomes components. Buckets that then still hold several
components are looked at again, each on its own and once for all buckets of the same members: the documents
outside its largest component meet all of the bucket, block by block in numpy: the estimate first, then the
full sets. Only a spanning forest of the links found leaves a task. So every two members of a bucket end in
one component or were compared.

The only approximation is the banding: with 32 bands of 4 a pair of similarity s shares a bucket with
probability 1-(1-s^4)^32, which is 1-5e-8 at s = 0.8.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, text_slices, written
from .components import connected_components
from .textwords import NON_SPACE, Words, mix

BITS = 4
_LANES = 64 // BITS
_LOW = int("1" * (64 // BITS), 16)  # one bit in each lane of BITS bits
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_keys(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 52-bit hash) of the distinct word shingles of up to 4096 texts, sorted."""
    w = Words(texts, NON_SPACE)
    n, count = w.n_docs, w.counts()
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    h = np.zeros(max(0, len(w.hash) - width + 1), np.uint64)
    for k in range(width):
        h = mix(h * _GOLD + w.hash[k : k + len(h)])
    ok = w.doc[: len(h)] == w.doc[width - 1 :] if len(h) else np.zeros(0, bool)
    doc, h = w.doc[: len(h)][ok], h[ok]
    for d in np.flatnonzero((count > 0) & (count < width)):  # the whole sequence is the one shingle
        x = np.zeros(1, np.uint64)
        for k in range(count[d]):
            x = mix(x * _GOLD + w.hash[first[d] + k])
        doc, h = np.append(doc, d), np.append(h, mix(x + np.uint64(count[d])))
    key = (doc.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12))
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    assert n <= 4096
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1)


def _pack(minima: np.ndarray) -> np.ndarray:
    """uint32[n, perms] -> uint64[n, perms/_LANES] of their low BITS bits."""
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima), -1, _LANES)
    return np.bitwise_or.reduce(low << (np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def _signatures(width: int, perms: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 1 << 63, perms, np.uint64) * np.uint64(2) + np.uint64(1)
    bands = perms // rows

    def run(batches):
        for batch in batches:
            ids, t = batch.column("doc_id"), batch.column("t")
            for lo, texts in text_slices(batch, "text"):
                doc, h = shingle_keys(texts, width)
                n = len(texts)
                size = np.bincount(doc, minlength=n)
                has = np.flatnonzero(size)
                at = np.concatenate([[0], np.cumsum(size[has])])[:-1].astype(np.int64)
                minima = np.zeros((n, perms), np.uint32)
                full = mix(h)
                if len(has):
                    for j in range(perms):
                        minima[has, j] = np.minimum.reduceat((full * mult[j]) >> np.uint64(32), at)
                    sums = _set_hashes(h, at)
                set_hash = np.zeros((2, n), np.uint64)
                if len(has):
                    set_hash[:, has] = sums
                key = np.zeros((n, bands), np.uint64)
                for b in range(bands):
                    key[:, b] = b + 1
                    for r in range(rows):
                        key[:, b] = mix(key[:, b] * _GOLD + minima[:, b * rows + r])
                sig = _pack(minima)
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), t.slice(lo, n), pa.array(size.astype(np.int64)), pa.array(set_hash[0].view(np.int64)), pa.array(set_hash[1].view(np.int64)), lists(key), lists(sig)],
                    ["doc_id", "t", "n_shingles", "h1", "h2", "bands", "sig"],
                )

    return run


def _set_hashes(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set: two sums of mixed shingles, which no order changes."""
    return [np.add.reduceat(mix(h + np.uint64(c)), at) for c in (1, 2)]


def _sets(width: int):
    """Sets of the texts, which have the set hash of the class they stand for."""

    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch, "text"):
                doc, h = shingle_keys(texts, width)
                n = len(texts)
                size = np.bincount(doc, minlength=n)
                has = np.flatnonzero(size)
                upto = np.concatenate([[0], np.cumsum(size)])
                own = np.zeros((2, n), np.uint64)
                if len(has):
                    own[:, has] = _set_hashes(h, upto[has])
                fit = [own[k].view(np.int64) == batch.column(c).slice(lo, n).to_numpy() for k, c in enumerate(("h1", "h2"))]
                lists = pa.ListArray.from_arrays(upto.astype(np.int32), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, n), lists], ["id", "shingles"]).filter(pa.array(fit[0] & fit[1]))

    return run


def _estimate(a, b, perms: int):
    """Similarity from two packed signatures: equal lanes, less the share that agrees by chance."""
    equal = F.lit(perms)
    for i in range(perms // _LANES):
        x = a[i].bitwiseXOR(b[i])
        s = 1
        while s < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
            s *= 2
        equal = equal - F.bit_count(x.bitwiseAND(F.lit(_LOW)))
    chance = 2.0**-BITS
    return (equal / F.lit(perms) - chance) / (1 - chance)


def _cross_links(perms: int, least: float, percent: int):
    """Links between different components within one block, as (id, smallest id of its local tree)."""
    chance = 2.0**-BITS
    need = int(np.ceil((least * (1 - chance) + chance) * perms - 1e-9))
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, base = pdf[pdf.asks], pdf[~pdf.asks]
        if not len(ask) or not len(base):
            return none
        sig_b = np.array(base.sig.tolist(), np.int64).view(np.uint64)
        comp_b, size_b = base["comp"].to_numpy(), base.shingles.map(len).to_numpy()
        vocab, at_b = np.unique(np.concatenate(base.shingles.to_list()), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size_b)])[:-1]
        is_, js = [], []
        for i, (s, c, x) in enumerate(zip(ask.sig, ask["comp"], ask.shingles, strict=True)):
            d = sig_b ^ np.asarray(s, np.int64).view(np.uint64)
            k = 1
            while k < BITS:
                d |= d >> np.uint64(k)
                k *= 2
            differ = np.bitwise_count(d & np.uint64(_LOW)).sum(axis=1)
            maybe = (perms - differ >= need) & (comp_b != c)
            if not maybe.any():
                continue
            p = np.minimum(np.searchsorted(vocab, x), len(vocab) - 1)
            mark = np.zeros(len(vocab), np.int64)
            mark[p[vocab[p] == x]] = 1
            both = np.add.reduceat(mark[at_b], begin)
            j = np.flatnonzero(maybe & (both * 100 >= (len(x) + size_b - both) * percent))
            is_.append(np.full(len(j), i))
            js.append(j)
        i, j = (np.concatenate([*v, np.zeros(0, int)]).astype(int) for v in (is_, js))
        if not len(i):
            return none
        ra, rb = ask.id.to_numpy().copy(), base.id.to_numpy().copy()
        while True:
            low, na, nb = np.minimum(ra[i], rb[j]), ra.copy(), rb.copy()
            np.minimum.at(na, i, low)
            np.minimum.at(nb, j, low)
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        i, j = np.unique(i), np.unique(j)
        return pd.DataFrame({"a": np.concatenate([ask.id.to_numpy()[i], base.id.to_numpy()[j]]), "b": np.concatenate([ra[i], rb[j]])})

    return run


def _classes(docs: DataFrame, width: int, percent: int, perms: int, rows: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (doc_id, t, n_shingles, node), one row per input row, and links (a, b) between nodes.

    A node is a class of equal shingle sets and has the smallest doc_id with that set as its number. Where that doc_id
    repeats with other sets, only the least of them has it; the others get a number of 2^62 and more made of their set.
    ``t`` is a hash of the text. Texts without a word and null doc_ids have no class.
    """
    docs = docs.withColumn("t", F.xxhash64("text"))
    least = max(0.0, percent / 100 - 5 / (1 - 2.0**-BITS) * ((percent / 100) * (1 - percent / 100) / perms) ** 0.5)
    schema = "doc_id long, t long, n_shingles long, h1 long, h2 long, bands array<long>, sig array<long>"
    sigs = written(docs.mapInArrow(_signatures(width, perms, rows, seed), schema), "sigs")
    full = sigs.filter("n_shingles > 0 and doc_id is not null")
    of = ("h1", "h2", "n_shingles")
    reps = full.groupBy(*of).agg(F.min(F.struct("doc_id", "t")).alias("r"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = written(reps.select("r.*", *of, "sig", "bands"), "classes")
    own = reps.groupBy("doc_id").agg(F.min(F.struct(*of)).alias("own")).hint("merge")  # one plan at every size
    other = F.xxhash64(*of).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    node = F.when(F.struct(*of) == F.col("own"), F.col("doc_id")).otherwise(other)
    lead = written(reps.join(own, "doc_id").select(node.alias("id"), "doc_id", "t", *of, "sig", "bands"), "leaders")
    placed = sigs.select("doc_id", "t", *of).join(lead.select("id", *of).hint("merge"), list(of), "left")
    placed = written(placed.select("doc_id", "t", "n_shingles", F.col("id").alias("node")), "placed")
    rows_ = lead.select(F.explode("bands").alias("key"), "id")
    buckets = rows_.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    buckets = written(buckets, "buckets")
    sig = lead.select("id", "sig", "n_shingles")

    star = rows_.join(buckets.select("key", "first"), "key").filter("id > first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    star = written(star, "pairs")
    # the full sets of all that shares a bucket
    need = star.select(F.col("a").alias("id")).union(star.select(F.col("b").alias("id"))).distinct().join(lead.select("id", "doc_id", "t", "h1", "h2"), "id")
    texts = docs.join(need.hint("merge"), ["doc_id", "t"]).dropDuplicates(["doc_id", "t", "id"])  # one plan at every size
    sets = written(texts.select("id", "text", "h1", "h2").mapInArrow(_sets(width), "id long, shingles array<long>"), "sets")
    side = lambda x: sig.select(F.col("id").alias(x), F.col("sig").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    good = star.join(side("a"), "a").join(side("b"), "b").filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (_estimate(F.col("sa"), F.col("sb"), perms) >= least)).select("a", "b")
    both = good.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.withColumn("both", F.size(F.array_intersect("x", "y")).cast("long"))
    links = written(both.filter(F.col("both") * 100 >= (F.size("x") + F.size("y") - F.col("both")) * percent).select("a", "b"), "links")
    comp = connected_components(links)

    # buckets of three and more that still hold several components; of those with the same members, one
    named = rows_.join(buckets.filter("n > 2").select("key"), "key").join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    members = written(named, "members")
    same = [F.count("*").alias("n"), *(F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1))]
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *same).filter("lo < hi")
    named = written(members.join(mixed.groupBy("n", "s0", "s1").agg(F.min("key").alias("key")).select("key"), "key"), "mixed")
    per = named.groupBy("key", "comp").agg(F.count("*").alias("m"))
    plan = per.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("big"), F.sum("m").alias("n"), F.max("m").alias("most"))
    plan = plan.select("key", "big", F.ceil(F.col("n") / block).cast("int").alias("nb"), F.ceil((F.col("n") - F.col("most")) / block).cast("int").alias("nq"))
    part = named.join(plan, "key").join(sig.select("id", "sig"), "id").join(sets, "id")
    part = written(part, "parts")
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")
    base = part.select("key", "id", "comp", "sig", "shingles", F.lit(False).alias("asks"), (spread % F.col("nb")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"))
    asks = part.filter("comp != big").select("key", "id", "comp", "sig", "shingles", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), (spread % F.col("nq")).alias("j"))
    more = base.unionByName(asks).groupBy("key", "i", "j").applyInPandas(_cross_links(perms, least, percent), "a long, b long")
    more = written(more, "more")
    for table in (sigs, reps, star, sets, part, named, members, lead, buckets):
        drop_written(table)
    return placed, links.union(more)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, perms: int = 128, rows: int = 4, block: int = 160, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), one row per input row.

    Words are runs of non-whitespace with A-Z lower-cased; the set of a text is its distinct
    ``width``-word shingles, or its whole sequence where it has fewer words. Two documents link when
    100 * |intersection| >= percent * |union|; component_id is the smallest doc_id reachable and kept
    marks that document. Null or wordless texts have an empty set and link with nothing (component_id =
    doc_id). Rows with a null doc_id keep a null component and kept = false. Repeated rows of one doc_id
    come out once each; where their texts differ, every one is compared, and they are in one component
    (whose name is right as long as one of its doc_ids is below 2^62). Other columns of ``docs`` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed, links = _classes(docs, width, percent, perms, rows, block, seed)
    some = placed.filter("doc_id is not null and node is not null").select("doc_id", "node")
    several = some.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc_id", "a")
    ties = some.join(several, "doc_id").filter("node > a").select("a", F.col("node").alias("b"))
    comp = connected_components(links.union(ties))
    out = placed.join(comp, placed.node == comp.id, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest doc_id, of its rows in the group the one of the
    smallest hash of its text, of those with equal texts the least row. Different texts of one doc_id are documents of
    their own. Rows with a null doc_id are documents too: they go by a number made of their text, after all others, so
    that equal ones are one. Texts without a word stay, once for each doc_id and text. Columns may have any names;
    those of repeated documents must be of types that can be ordered."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)).alias("doc_id")
    text = F.col("text").cast("string")
    placed, links = _classes(docs.select(ids, text.alias("text")), width, percent, 128, 4, 160, 7)
    comp = connected_components(links)
    each = placed.groupBy("doc_id", "t", "node").agg(F.count("*").alias("n"))
    grouped = each.filter("node is not null").join(comp, F.col("node") == comp.id, "left").groupBy(F.coalesce("component", "node").alias("g")).agg(F.min(F.struct("doc_id", "t", "n")).alias("k"))
    kept = each.filter("node is null").select("doc_id", "t", "n").unionByName(grouped.select("k.*"))
    kept = written(kept, "kept").hint("merge")  # one plan at every size; both joins share one shuffle of the rows
    rows = docs.select(ids, F.xxhash64(text).alias("t"), F.struct(*docs.columns).alias("row"))
    once = rows.join(kept.filter("n = 1"), ["doc_id", "t"]).select("row")
    again = rows.join(kept.filter("n > 1"), ["doc_id", "t"]).groupBy("doc_id", "t").agg(F.min("row").alias("row")).select("row")
    return once.unionByName(again).select("row.*")
