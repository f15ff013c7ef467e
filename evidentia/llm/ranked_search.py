"""Ranked lexical search by pipelined term partitioning.

The terms of the items are owned by ``stages`` successive owners, the rare terms by the first, and of about equal
postings each. One pass over the texts writes each document's length and its counts of asked terms. Item bundles, a row
for each item and bucket of documents, then pass from owner to owner: at each stage a cogroup by bucket brings a bundle's
sparse accumulators together with the owner's postings, adds integer contributions, and hands on those accumulators
that can still come among the best. The last owner selects within the bucket, a window over items after that.

An accumulator is dropped only if ``top`` documents of its bucket already have more than it could reach with all terms
that are still to come; a document that is met again later is then still below them. So results are exact.

A bucket is 2,048 neighbouring rows of the written table. Items go in batches of about ``pairs`` (item, term) pairs, one
run of the stages each: what is broadcast is one batch's terms, however many items there are.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, text_slices, written
from .textwords import ALNUM, Words

_BITS = 11  # of a row's place in its bucket
_MOST = 999_999  # a contribution's factor is less than a million
_RIGHT = "bucket long, docs binary, ids binary, sizes binary, counts binary, terms binary, tfs binary"
_LEFT = "bucket long, item int, docs binary, scores binary"
_NO_ID = np.iinfo(np.int64).max  # a null doc_id comes after all others


def _asked(batches):
    """(irow, text) -> the distinct terms of each item as hashes."""
    for batch in batches:
        rows = batch.column("irow").to_numpy()
        for lo, texts in text_slices(batch, "text"):
            w = Words(texts, ALNUM)
            pair = np.unique(np.stack([rows[lo + w.doc].astype(np.int64), w.hash.view(np.int64)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["irow", "h"])


def _counted(vocabulary):
    """(row, doc_id, text) -> each document's number of terms, and its counts of those in the vocabulary."""

    def run(batches):
        vocab = vocabulary.value
        for batch in batches:
            for lo, texts in text_slices(batch, "text"):
                n = len(texts)
                w = Words(texts, ALNUM)
                k = np.minimum(np.searchsorted(vocab, w.hash), max(0, len(vocab) - 1))
                hit = vocab[k] == w.hash if len(vocab) else np.zeros(len(k), bool)
                key, tf = np.unique((w.doc[hit].astype(np.int64) << 32) | k[hit], return_counts=True)
                upto = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << 32).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(upto), pa.array(x.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, n), batch.column("doc_id").slice(lo, n), pa.array(w.counts().astype(np.int64)), lists(key & 0xFFFFFFFF), lists(tf)],
                    ["row", "doc_id", "n", "terms", "tfs"],
                )

    return run


def _frequencies(size: int):
    """How many documents of a task hold each term."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return run


def _owned(owner, stage: int, last: bool):
    """The postings of one owner, packed by bucket; the last one names all documents with their ids."""

    def run(batches):
        mine = owner.value == stage
        for batch in batches:
            row, n = batch.column("row").to_numpy(), batch.column("n").to_numpy()
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            terms, tfs = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            doc = np.repeat(np.arange(len(row)), np.diff(batch.column("terms").offsets.to_numpy()))
            use = mine[terms] if len(terms) else np.zeros(0, bool)
            terms, tfs, doc = terms[use], tfs[use], doc[use]
            count = np.bincount(doc, minlength=len(row))
            some = np.arange(len(row)) if last else np.flatnonzero(count)
            if not len(some):
                continue
            cut = np.append(np.flatnonzero(np.append(True, (row[some] >> _BITS)[1:] != (row[some] >> _BITS)[:-1])), len(some))
            upto = np.append(0, np.cumsum(count[some]))
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                s, p = some[a:b], slice(upto[a], upto[b])
                packed = [(row[s] & ((1 << _BITS) - 1)).astype(np.uint16), ids[s] if last else ids[:0], n[s], count[s].astype(np.uint32), terms[p], tfs[p]]
                out.append([int(row[s[0]] >> _BITS), *(x.tobytes() for x in packed)])
            kinds = [pa.int64(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "docs", "ids", "sizes", "counts", "terms", "tfs"])

    return run


def _stage(asked, weights, documents: int, words: int, top: int, last: bool):
    """asked: a broadcast of (item, its terms of this owner, what the later owners' terms can add at most), by item."""

    def run(key, left, right):
        here = {i: (np.frombuffer(d.as_py(), np.uint16), np.frombuffer(s.as_py(), np.int64)) for i, d, s in zip(left.column("item").to_pylist(), left.column("docs"), left.column("scores"), strict=True)}
        load = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in right.column(c))])
        docs, ids, sizes, counts = load("docs", np.uint16), load("ids", np.int64), load("sizes", np.int64), load("counts", np.uint32)
        terms, tfs = load("terms", np.int32), load("tfs", np.int32).astype(np.int64)
        m = np.repeat(50 + (50 * sizes * documents) // max(1, words), counts)
        gain = weights.value[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))
        doc = np.repeat(docs, counts)
        order = np.argsort(terms, kind="stable")
        terms, gain, doc = terms[order], gain[order], doc[order]
        where = dict(zip(terms[(head := np.flatnonzero(np.append(True, terms[1:] != terms[:-1])))].tolist(), zip(head, np.append(head[1:], len(terms)), strict=True), strict=True)) if len(terms) else {}
        name = np.full(1 << _BITS, _NO_ID)
        if last:
            name[docs] = ids
        out = []
        for item, own, rest in asked.value:
            spans = [where[x] for x in own if x in where]
            if not spans and item not in here:
                continue
            score = np.zeros(1 << _BITS, np.int64)
            if item in here:
                d, s = here[item]
                score[d] = s
            for a, b in spans:
                score[doc[a:b]] += gain[a:b]
            some = np.flatnonzero(score)
            if last:
                some = some[np.lexsort((name[some], -score[some]))[:top]]
                out.append((np.full(len(some), item), name[some], score[some]))
                continue
            if len(some) > top:
                least = np.partition(score[some], len(some) - top)[len(some) - top]
                some = some[score[some] + rest >= least]
            if len(some):
                out.append((item, some.astype(np.uint16).tobytes(), score[some].tobytes()))
        if last:
            item, name, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
            return pa.table({"item": pa.array(item.astype(np.int32)), "doc_id": pa.array(name, mask=name == _NO_ID), "score": pa.array(score)})
        items, d, s = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(items), pa.int64()), "item": pa.array(items, pa.int32()), "docs": pa.array(d, pa.binary()), "scores": pa.array(s, pa.binary())})

    return run


def _ranked(docs: DataFrame, pairs: list, irows: np.ndarray, vocab: np.ndarray, top: int, stages: int) -> tuple[DataFrame, DataFrame]:
    """One batch of items: (irow, doc_id, score), more than ``top`` of an item; and the table it reads."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    table = written(docs.mapInArrow(_counted(share(vocab)), "row long, doc_id long, n long, terms array<int>, tfs array<int>"), "postings")
    documents, words = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocab), np.int64)
    held = table.select("terms").mapInArrow(_frequencies(len(vocab)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df[held.term.to_numpy(np.int64)] = held["df"].to_numpy(np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    order = np.argsort(df, kind="stable")
    owner = np.empty(len(vocab), np.int64)
    owner[order] = np.minimum(stages - 1, np.cumsum(df[order]) * stages // max(1, df.sum() + 1))
    term, item = pairs
    reach = np.zeros((len(irows), stages + 1), np.int64)  # what the terms of owner k can add
    np.add.at(reach, (item, owner[term]), weight[term] * _MOST)
    rest = np.cumsum(reach[:, ::-1], axis=1)[:, ::-1]
    owners, weights = share(owner), share(weight)
    bundles = spark.createDataFrame([], _LEFT)
    for k in range(stages):
        last = k == stages - 1
        own: list[list[int]] = [[] for _ in irows]
        for t, i in zip(term[owner[term] == k].tolist(), item[owner[term] == k].tolist(), strict=True):
            own[i].append(t)
        asked = share([(i, own[i], int(rest[i, k + 1])) for i in range(len(irows))])
        postings = table.mapInArrow(_owned(owners, k, last), _RIGHT)
        step = _stage(asked, weights, documents, words, top, last)
        bundles = bundles.groupBy("bucket").cogroup(postings.groupBy("bucket")).applyInArrow(step, "item int, doc_id long, score long" if last else _LEFT)
    names = spark.createDataFrame([(i, int(r)) for i, r in enumerate(irows)], "item int, irow long")
    return bundles.join(F.broadcast(names), "item").select("irow", "doc_id", "score"), table


def search(docs: DataFrame, items: DataFrame, top: int = 50, stages: int = 4, pairs: int = 1_000_000) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (item_id, rank, doc_id, score): each item's ``top`` documents.

    Terms are runs of ASCII letters, digits and non-ASCII characters with A-Z lower-cased. N documents hold a term, L is
    the number of all terms; w = floor(1000 ln((2N+2)/(2df+1))), m = 50 + (50 n N) div L, and an item's score is the sum
    of w * ((10^9 tf) div (1000 tf + 20 m)) over its distinct terms, in 64-bit integers. Only scores above 0 are
    returned, equal ones by ascending doc_id (null last). A null or wordless text holds no term: such a document does
    not count, such an item has no rows. Rows that repeat a doc_id are documents of their own, rows that repeat an
    item_id are ranked each by itself; a null item_id is an id. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text)
    items = written(items.select("item_id", F.monotonically_increasing_id().alias("irow"), text), "items")
    asked = written(items.select("irow", "text").mapInArrow(_asked, "irow long, h long"), "asked")
    batches = max(1, -(-asked.count() // pairs))
    found, tables = [], []
    for b in range(batches):
        part = asked.filter(F.pmod(F.xxhash64("irow"), F.lit(batches)) == b).toPandas()  # about ``pairs`` rows
        if not len(part):
            continue
        vocab, term = np.unique(part.h.to_numpy(np.int64).view(np.uint64), return_inverse=True)
        irows, item = np.unique(part.irow.to_numpy(np.int64), return_inverse=True)
        out, table = _ranked(docs, [term, item], irows, vocab, top, stages)
        found.append(out)
        tables.append(table)
        if batches > 1:  # a batch's postings go when its candidates are there
            found[-1] = written(out, "candidates")
            drop_written(tables.pop())
    drop_written(asked)
    rows = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "irow long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("irow").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = rows.withColumn("rank", place).filter(F.col("rank") <= top)
    return best.join(items.select("irow", "item_id"), "irow").select("item_id", "rank", "doc_id", "score")
