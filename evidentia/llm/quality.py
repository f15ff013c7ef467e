"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken in numpy inside Spark tasks. The trees are fitted on a bounded sample of
labelled rows and flattened into arrays, in which all rows of a batch step from level to level together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .textwords import NON_SPACE, Words

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?'\"",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*@^~",
    "code": b"{}[]<>/\\=_+()",
    "space": b" \t",
    "line": b"\n\r",
}
_NOT_LINE = np.ones(256, bool)
_NOT_LINE[[10, 13]] = False
FEATURES = ["log_bytes", "log_words", "word_length", "distinct_words", "top_word", "lines_per_word", "distinct_lines", "line_length", "other", *_CLASSES]


def statistics(texts: pa.LargeStringArray) -> np.ndarray:
    """[texts, FEATURES] of at most 4096 texts; all zeros for an empty one."""
    w, lines = Words(texts, NON_SPACE), Words(texts, _NOT_LINE)
    n, size = w.n_docs, np.diff(w.off)
    each = np.maximum(1, size)

    def repeats(x: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """counts, distinct counts, and the count of the most frequent."""
        key = (x.doc.astype(np.uint64) << np.uint64(52)) | (x.hash >> np.uint64(12))
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        doc, run = (key[at] >> np.uint64(52)).astype(np.int64), np.diff(np.append(at, len(key)))
        top = np.zeros(n)
        np.maximum.at(top, doc, run)
        return x.counts(), np.bincount(doc, minlength=n), top

    nw, dw, top = repeats(w)
    nl, dl, _ = repeats(lines)
    word, line = np.maximum(1, nw), np.maximum(1, nl)
    inside = np.bincount(w.doc, weights=w.end - w.start, minlength=n)
    cols = [np.log1p(size), np.log1p(nw), inside / word, dw / word, top / word, nl / word, dl / line, size / line]
    rest = size.astype(float)
    shares = []
    for chars in _CLASSES.values():
        on = np.zeros(256, bool)
        on[list(chars)] = True
        total = np.concatenate([[0], np.cumsum(on[w.raw], dtype=np.int64)])
        k = total[w.off[1:]] - total[w.off[:-1]]
        rest -= k
        shares.append(k / each)
    out = np.column_stack([*cols, rest / each, *shares]).astype(float)
    out[size == 0] = 0
    return out


class BoostedTrees:
    """Depth-wise trees on quantile bins, logistic loss; node i has children 2i+1 and 2i+2."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0):
        self.depth = depth
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        nodes, f = (1 << depth) - 1, x.shape[1]
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        self.feature = np.zeros((trees, nodes), np.int32)
        self.cut = np.full((trees, nodes), np.inf)
        self.leaf = np.zeros((trees, nodes + 1))
        score = np.full(len(y), self.base)
        width = b.max(initial=0) + 1
        for t in range(trees):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, np.maximum(q * (1 - q), 1e-9)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                m, first = 1 << level, (1 << level) - 1
                local = node - first
                best = np.full(m, 1e-6)
                for k in range(f):
                    at = local * width + b[:, k]
                    hist = [np.bincount(at, weights=v, minlength=m * width).reshape(m, width).cumsum(1) for v in (g, h, np.ones(len(g)))]
                    (gl, hl, nl), (gt, ht, nt) = hist, [v[:, -1:] for v in hist]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain[(nl < least) | (nt - nl < least)] = -1
                    cut = gain[:, : len(cuts[k])].argmax(1) if len(cuts[k]) else np.zeros(m, int)
                    for i in np.flatnonzero(gain[np.arange(m), cut] > best) if len(cuts[k]) else ():
                        best[i] = gain[i, cut[i]]
                        self.feature[t, first + i], self.cut[t, first + i] = k, cuts[k][cut[i]]
                node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[t, node]] > self.cut[t, node])
            at = node - nodes
            self.leaf[t] = -rate * np.bincount(at, weights=g, minlength=nodes + 1) / (np.bincount(at, weights=h, minlength=nodes + 1) + ridge)
            score += self.leaf[t][at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        score, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            score += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-score))


def _measure(batches):
    for batch in batches:
        for lo, texts in text_slices(batch, "text"):
            x = statistics(texts)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, len(texts)), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 2, **options) -> BoostedTrees | None:
    """docs(doc_id, text), labels(doc_id, label 0 or 1) -> trees fitted on about ``sample`` labelled rows drawn by
    a hash of doc_id (all, where there are fewer). Null labels and ids teach nothing; None without any."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    n = ids.count()
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)
    drawn = ids.filter(u < (sample / n if n else 1.0))  # about `sample` ids: a bound for the broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    pdf: pd.DataFrame = rows.select("label", "text").mapInArrow(_measure, "label int, x array<double>").toPandas()
    if not len(pdf):
        return None
    x, y = np.stack(pdf.x.to_numpy()), pdf.label.to_numpy().astype(float)
    order = np.lexsort(np.column_stack([x, y]).T)  # the fit does not depend on the order in which rows come
    return BoostedTrees(x[order], y[order], **options)


def _score(model):
    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch, "text"):
                x = statistics(texts)
                score = model.value.predict(x) if model.value is not None else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), pa.array(score)], ["doc_id", "score"])

    return run


def predict(docs: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score in 0..1), one row per input row, from the whole text alone. Null is
    the empty text; both get the score of all-zero statistics. Without a model every score is 0.5."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
