"""Removal of passages that an earlier document holds, by relative Lempel-Ziv parsing.

A document is parsed against all documents of smaller doc_id. Their text is indexed in reference blocks, and the
document is factored greedily: from a word on, a factor reaches as far as windows of ``width`` words go on being found.
Factors of a window and more become duplicate spans; the windows across a border of two factors are looked up like all
others, so a passage may be put together from pieces that no single block holds whole.

Which block must answer for a window is decided by its content: among its runs of ``ANCHOR`` words the one of the
smallest hash (the leftmost such) is its anchor, and equal windows have equal anchors. The windows of one anchor are
neighbours; they travel as one piece, (anchor, document, place, a bit for each window, 48 bits of each window's hash), in
one shuffle by anchor. A block is what one task then gets: pieces sorted by anchor and doc_id, in which the first
occurrence of a window is its reference. So a look-up in one block answers as if every block had been asked, and the
volume is in proportion to the words.

Skew. Windows that a slice of texts (``SLICE`` bytes) already holds under a smaller doc_id are settled there and do not
travel for comparison; neither do repeats within one document. Anchors that a bounded sample of documents shows to be
frequent have their windows dealt further by their own hash. The sample decides how work is split, never a result.

Two different windows are taken as equal only if 64 bits of the anchor's hash and 48 of the window's agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices
from .textwords import _P, _PINV, NON_SPACE, Words, _powers, mix

ANCHOR = 10
SLICE = 4 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP, _BACK = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_PIECES = "h long, part int, doc_id long, t long, at int, mask long, wh binary"


def _word_hashes(w: Words) -> np.ndarray:
    """64-bit hashes of the words' bytes as they are."""
    m = len(w.raw)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum((w.raw.astype(np.uint64) + np.uint64(1)) * _powers(_P, m), out=total[1:])
    h = (total[w.end] - total[w.start]) * _powers(_PINV, m + 1)[w.start]
    return mix(h ^ (w.end - w.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` words."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_STEP, len(h)), out=total[1:])
    return mix((total[length:] - total[:n]) * _powers(_BACK, n))


def _leftmost_minimum(g: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the smallest of g[i : i + span], the leftmost of equal ones."""
    at, have = np.arange(len(g)), 1
    while have * 2 <= span:
        a, b = at[:-have], at[have:]
        at, have = np.where(g[b] < g[a], b, a), have * 2
    a, b = at[: len(g) - span + 1], at[span - have : len(g) - have + 1]
    return np.where(g[b] < g[a], b, a)


def _windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows within one text: first word, place of the anchor, the anchor's hash, the window's hash."""
    wh = _runs(h := _word_hashes(w), width)
    start = np.flatnonzero(w.doc[: len(wh)] == w.doc[width - 1 :]) if len(wh) else np.zeros(0, np.int64)
    if not len(start):
        none = np.zeros(0, np.uint64)
        return start, start, none, none
    grams = _runs(h, min(ANCHOR, width))
    at = _leftmost_minimum(grams, width - min(ANCHOR, width) + 1)[start]
    return start, at, grams[at], wh[start]


def _cut(width: int, hot):
    """Texts to pieces. ``hot``: a broadcast of (sorted anchor hashes, number of parts of each), or None."""

    def run(batches):
        keys, parts = hot.value if hot else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            t = batch.column("t").to_numpy()
            for lo, texts in text_slices(batch, "text", SLICE):
                w = Words(texts, NON_SPACE, hashes=False)
                start, at, h, wh = _windows(w, width)
                doc = w.doc[start]
                first = np.cumsum(np.append(0, w.counts()))[doc]  # the text's first word
                # once for each document
                _, keep = np.unique(mix(wh + doc.astype(np.uint64) * _GOLD), return_index=True)
                keep.sort()
                start, at, h, wh, doc, first = (x[keep] for x in (start, at, h, wh, doc, first))
                own = ids[lo + doc]
                # settled within the slice
                order = np.lexsort((own, wh))
                new = np.append(True, wh[order][1:] != wh[order][:-1]) if len(order) else np.zeros(0, bool)
                least = np.empty(len(order), np.int64)
                least[order] = own[order][new][np.cumsum(new) - 1]
                settled = own > least
                # pieces by descending start, so that a piece's windows ascend by their distance from the anchor
                part = np.full(len(start), -1)
                part[~settled] = 0
                if len(keys):
                    k = np.minimum(np.searchsorted(keys, h.view(np.int64)), len(keys) - 1)
                    many = np.where((keys[k] == h.view(np.int64)) & ~settled, parts[k], 1)
                    part = np.where(many > 1, (wh % many.astype(np.uint64)).astype(np.int64), part)
                order = np.lexsort((-start, part, -at))
                start, at, h, wh, doc, first, part = (x[order] for x in (start, at, h, wh, doc, first, part))
                new = np.append(True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])) if len(start) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                if not len(begin):
                    continue
                mask = np.bitwise_or.reduceat(np.int64(1) << (at - start), begin)
                held = np.where(part >= 0, 6, 0)
                upto = np.append(0, np.cumsum(held))[np.append(begin, len(start))].astype(np.int32)
                raw = np.ascontiguousarray(wh[part >= 0].view(np.uint8).reshape(-1, 8)[:, 2:])
                blob = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(upto), pa.py_buffer(raw)])
                of = lo + doc[begin]
                apart = mix(t[of].view(np.uint64) + ids[of].astype(np.uint64) * _GOLD).view(np.int64)  # what is settled needs no meeting
                cols = [np.where(part[begin] >= 0, h[begin].view(np.int64), apart), part[begin].astype(np.int32), ids[of].astype(np.int64), t[of], (at - first)[begin].astype(np.int32), mask]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), blob], ["h", "part", "doc_id", "t", "at", "mask", "wh"])

    return run


def _parse(batches):
    """One reference block: pieces by (h, part, doc_id) -> factors (doc_id, t, run), run being first window << 32 | windows."""
    carry = None  # (h, part) of the last group, its windows, sorted, and who has each first
    for whole in batches:
        for lo in range(0, whole.num_rows, 1 << 15):
            batch = whole.slice(lo, 1 << 15)
            h, part, doc, t, at, mask = (batch.column(c).to_numpy() for c in ("h", "part", "doc_id", "t", "at", "mask"))
            row, off = np.nonzero((mask[:, None] >> np.arange(64)) & 1)
            new = np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]))
            group = np.cumsum(new) - 1
            found = part[row] < 0
            ask = np.flatnonzero(~found)
            if len(ask):
                blob = batch.column("wh")
                bound = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
                wide = np.zeros((len(ask), 8), np.uint8)
                wide[:, :6] = np.frombuffer(blob.buffers()[2], np.uint8)[bound[0] : bound[-1]].reshape(-1, 6)
                w48 = wide.view(np.uint64)[:, 0]
                g, d = group[row[ask]], doc[row[ask]]
                key = (g.astype(np.uint64) << np.uint64(48)) | w48
                order = np.argsort(key, kind="stable")  # doc_id ascends within a group
                head = np.append(True, key[order][1:] != key[order][:-1])
                names, owner = key[order][head], d[order][head].copy()
                last = (h[-1], part[-1])
                again = carry is not None and carry[0] == (h[0], part[0])
                if again:  # the group goes on from the batch before
                    mine = slice(0, int(np.searchsorted(names, np.uint64(1) << np.uint64(48))))
                    k = np.minimum(np.searchsorted(carry[1], names[mine]), len(carry[1]) - 1)
                    owner[mine] = np.where(carry[1][k] == names[mine], np.minimum(owner[mine], carry[2][k]), owner[mine])
                hit = np.empty(len(ask), bool)
                hit[order] = d[order] > owner[np.cumsum(head) - 1]
                found[ask] = hit
                tail = names >> np.uint64(48) == np.uint64(group[-1])
                names, owner = names[tail] & np.uint64((1 << 48) - 1), owner[tail]
                if again and group[-1] == 0:
                    names, first = np.unique(np.concatenate([carry[1], names]), return_index=True)
                    owner = np.concatenate([carry[2], owner])[first]  # the earlier holder stands first
                carry = (last, names, owner) if len(names) else None
            row, off = row[found], off[found]
            if len(row):
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)))
                n = np.diff(np.append(new, len(row)))
                run = ((at[row[new]] - off[new] - n + 1).astype(np.int64) << 32) | n
                yield pa.RecordBatch.from_arrays([pa.array(doc[row[new]]), pa.array(t[row[new]]), pa.array(run)], ["doc_id", "t", "run"])


def _hot(docs: DataFrame, width: int, sample: int, rows: int):
    """A broadcast of the anchors of more than ``rows`` pieces, with their number of parts, by ``sample`` documents;
    at most 65,536 of them."""
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    few = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    most = few.mapInArrow(_cut(width, None), _PIECES).filter("part >= 0").groupBy("h").agg(F.count("*").alias("n"))
    most = most.filter((F.col("n") >= 8) & (F.col("n") > rows * share)).orderBy(F.desc("n"), "h").limit(1 << 16).toPandas().sort_values("h")
    return docs.sparkSession.sparkContext.broadcast((most.h.to_numpy(np.int64), np.ceil(most.n.to_numpy() / share / rows).astype(np.int64)))


def factors(docs: DataFrame, width: int = 50, sample: int = 20_000, rows_per_part: int = 2048) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, t, run): the factors of each document whose windows all start in a document of
    smaller doc_id too. ``t`` is xxhash64 of the text; ``run`` is (number of the first window's first word) << 32 |
    windows. A window that a document repeats is named once, at its first place. Documents with a null doc_id have no
    place in the order: they have no factors and are no reference. ``width`` is from 2 to 70 words."""
    if not 2 <= width <= 70:
        raise ValueError("width must be from 2 to 70")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    d = d.withColumn("t", F.xxhash64("text"))
    pieces = d.mapInArrow(_cut(width, _hot(d, width, sample, rows_per_part)), _PIECES)
    return pieces.repartition("h", "part").sortWithinPartitions("h", "part", "doc_id").mapInArrow(_parse, "doc_id long, t long, run long")


def _removed(w: Words, runs, width: int) -> np.ndarray:
    """Which words go. runs: an Arrow array of lists of factors, one of each text."""
    gone = np.zeros(len(w.start) + 1, np.int64)
    flat = runs.flatten().to_numpy()
    if not len(flat):
        return gone[:-1] > 0
    of = np.repeat(np.arange(w.n_docs), np.diff(runs.offsets.to_numpy()) if runs.null_count == 0 else [len(x) if x.is_valid else 0 for x in runs])
    first = np.append(0, np.cumsum(w.counts()))
    begin, n = first[of] + (flat >> 32), flat & 0xFFFFFFFF
    named = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(named, begin, 1)
    np.add.at(named, begin + n, -1)
    named = np.cumsum(named) > 0
    start, _, _, wh = _windows(w, width)
    key = mix(wh + w.doc[start].astype(np.uint64) * _GOLD)
    start = start[np.isin(key, key[named[start]])]  # where the document repeats a named window, that place too
    np.add.at(gone, start, 1)
    np.add.at(gone, start + width, -1)
    return np.cumsum(gone)[:-1] > 0


def _kept_bytes(w: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words joined by one space, of all texts on end, and where each text's part begins and ends."""
    keep = np.flatnonzero(~gone)
    edge = np.zeros(len(w.raw) + 1, np.int64)
    np.add.at(edge, w.start[keep], 1)
    np.add.at(edge, w.end[keep], -1)
    take = np.cumsum(edge)[:-1] > 0
    later = keep[np.append(False, w.doc[keep][1:] == w.doc[keep][:-1])] if len(keep) else keep
    raw = w.raw.copy()
    raw[w.start[later] - 1] = 32  # a space or the like stands before every word but the first
    take[w.start[later] - 1] = True
    return raw[take], np.append(0, np.cumsum(take))[w.off]


def _applied(width: int, digest: bool):
    def run(batches):
        for batch in batches:
            runs = batch.column("runs")
            for lo, texts in text_slices(batch, "text"):
                n = len(texts)
                w = Words(texts, NON_SPACE, hashes=False)
                gone = _removed(w, runs.slice(lo, n), width)
                raw, at = _kept_bytes(w, gone)
                count = lambda x: pa.array(np.bincount(x, minlength=n).astype(np.int64))
                if digest:
                    data = raw.tobytes()
                    out = pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), count(w.doc), count(w.doc[gone]), out], ["doc_id", "n_words", "n_removed", "kept_sha256"])
                else:
                    some = np.bincount(w.doc[gone], minlength=n) > 0
                    out = [raw[a:b].tobytes().decode() if cut else None for a, b, cut in zip(at[:-1], at[1:], some, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, n), pa.array(out, pa.string())], ["row", "cut"])

    return run


def _with_runs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """A document's factors are as many as its words at most."""
    runs = found.groupBy("doc_id", "t").agg(F.collect_list("run").alias("runs"))
    return docs.withColumn("t", F.xxhash64("text")).join(runs, ["doc_id", "t"], "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<long>")))


def repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept_sha256), one row per input row.

    Words are runs of anything but the six ASCII spaces, as they stand. Each word goes that lies in a window of
    ``width`` consecutive words whose words also start, in that order, somewhere in a document of smaller doc_id; all
    windows are judged on the input. Null, empty and short texts lose nothing (a null text has no words). Rows with a
    null doc_id lose nothing and take nothing from others; rows that repeat a doc_id are judged each by itself and do
    not count as smaller than one another. Other columns are not read; no documents give no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_runs(d, factors(d, width)).mapInArrow(_applied(width, True), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs``, all rows and columns, with the words that :func:`repeats` removes cut out of ``text`` (what is left is
    joined by one space); texts that lose nothing stay as they are. Columns may have any names."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    found = _with_runs(d, factors(d, width)).select("text", "runs", "row")
    schema = T.StructType([found.schema["row"], T.StructField("cut", T.StringType())])
    out = found.mapInArrow(_applied(width, False), schema)
    return out.select(*[F.coalesce("cut", F.col("row")["text"]).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
