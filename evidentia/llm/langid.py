"""Language identification by unigram piece models, summed over all segmentations.

A word's probability in a language is the sum, over every way to cut it into pieces of a fixed public
vocabulary, of the product of the pieces' probabilities (a forward algorithm). Piece probabilities are
learned per language by expectation maximisation (forward-backward) over the counted words of a bounded
sample; each round is a Spark job, and only expected counts by (language, piece) reach the driver. A text's
score sums its words. Distinct words of a slice of texts are scored once, all lengths together in numpy; runs of
letters of any length are summed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written
from .textwords import mix

#: LONGEST_PIECE is that of the public vocabulary: no piece of letters is left out. Words of at most LONGEST_WORD
#: letters are scored as rows of one matrix, longer ones letter by letter.
LONGEST_PIECE, LONGEST_WORD = 16, 32
FLOOR = 1e-7
_ALPHA: list[np.ndarray] = []
_P = np.uint64(0xD1342543DE82EF95)


def _letters() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _ALPHA[0]


def vocabulary(model: str = "piece_bpe_32k.model") -> list[str]:
    """Pieces of letters only, without word marks, lower-cased, sorted; a longer one than LONGEST_PIECE is refused."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(model))
    pieces = {sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size())}
    pieces = sorted(p for p in pieces if p.isalpha())
    if max(map(len, pieces), default=0) > LONGEST_PIECE:
        raise ValueError("a piece of the vocabulary is longer than LONGEST_PIECE")
    return pieces


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


class PieceTable:
    """Finds pieces by hash: an open table of vocabulary numbers, probed for whole arrays at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        h = np.zeros(self.n, np.uint64)
        for k, p in enumerate(pieces):
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in _codes(p):
                    x = x * _P + np.uint64(c) + np.uint64(1)
            h[k] = x
        h = mix(h)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        # where each value of the top 16 bits begins, so that a search has a few entries left
        self.bits = np.searchsorted(self.sorted >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64))
        self.deep = int(np.diff(self.bits).max()) if self.n else 0

    def find(self, raw: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of piece hashes; ``n`` where there is none."""
        h = mix(raw)
        top = (h >> np.uint64(48)).astype(np.int64)
        at, out = self.bits[top], np.full(h.shape, self.n, np.int32)
        last = max(0, self.n - 1)
        for k in range(self.deep):
            p = np.minimum(at + k, last)
            hit = self.sorted[p] == h
            out[hit] = self.order[p[hit]]
        return out


def pieces_of(words: np.ndarray, lengths: np.ndarray, table: PieceTable) -> np.ndarray:
    """words[n, LONGEST_WORD] of code points -> number of the piece that ends at j with length l+1."""
    n, width = words.shape
    out = np.full((width, LONGEST_PIECE, n), table.n, np.int32)
    h = np.zeros((LONGEST_PIECE, n), np.uint64)
    for j in range(int(lengths.max(initial=0))):
        # h[l]: hash of the l+1 characters that end at j
        h[1:] = h[:-1]
        h[0] = 0
        h = h * _P + words[:, j].astype(np.uint64) + np.uint64(1)
        for size in range(1, min(LONGEST_PIECE, j + 1) + 1):
            out[j, size - 1] = table.find(h[size - 1])
    return out


def forward(pieces: np.ndarray, lengths: np.ndarray, prob: np.ndarray, keep: bool = False):
    """prob[pieces + 1, languages]; the last row is 0 for what is no piece. A character that is no piece
    counts FLOOR. Returns log P(word) [n, languages], or every prefix's probability with ``keep``."""
    width, _, n = pieces.shape
    alpha = np.zeros((width + 1, n, prob.shape[1]))
    alpha[0] = 1
    for j in range(int(lengths.max(initial=0))):
        for size in range(1, min(LONGEST_PIECE, j + 1) + 1):
            p = prob[pieces[j, size - 1]]
            alpha[j + 1] += alpha[j + 1 - size] * (np.maximum(p, FLOOR) if size == 1 else p)
    if keep:
        return alpha
    return np.log(np.maximum(alpha[lengths, np.arange(n)], 1e-300))


def _long_pieces(words: list[np.ndarray], table: PieceTable):
    """Words of any length, longest first: their order, sizes and first letters, each letter's place in its word, and
    for each letter e the number of the piece of k+1 letters that ends there [letters, LONGEST_PIECE]."""
    order = np.argsort([-len(w) for w in words], kind="stable")
    size = np.array([len(words[k]) for k in order])
    first = np.cumsum(size) - size
    c = np.concatenate([words[k] for k in order]).astype(np.uint64)
    at = np.arange(len(c)) - np.repeat(first, size)
    pieces = np.full((len(c), LONGEST_PIECE), table.n, np.int32)
    h = np.zeros(len(c), np.uint64)
    for k in range(LONGEST_PIECE):
        # h[e]: hash of the k+1 letters that end at e, made from the k letters that begin one earlier
        h = h + (c[np.maximum(np.arange(len(c)) - k, 0)] + np.uint64(1)) * np.uint64(pow(int(_P), k, 1 << 64))
        ok = at >= k
        pieces[ok, k] = table.find(h[ok])
    return order, size, first, at, pieces


def forward_long(words: list[np.ndarray], table: PieceTable, prob: np.ndarray) -> np.ndarray:
    """log P of words of any length [n, languages]: all step from letter to letter together, the last LONGEST_PIECE
    prefixes of each are kept, scaled so that they neither vanish nor overflow."""
    order, size, first, _, pieces = _long_pieces(words, table)
    n, langs = len(size), prob.shape[1]
    alpha, scale = np.zeros((n, LONGEST_PIECE, langs)), np.zeros((n, langs))
    alpha[:, 0] = 1
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # words longer than j come first
    for j in range(size[0]):
        m = live[j]
        p = prob[pieces[first[:m] + j]]
        p[:, 0] = np.maximum(p[:, 0], FLOOR)
        new = (alpha[:m] * p).sum(1)
        scale[:m] += np.log(new)
        alpha[:m, 1:] = alpha[:m, :-1] / new[:, None]
        alpha[:m, 0] = 1
    out = np.empty_like(scale)
    out[order] = scale
    return out


def expect_long(words: list[np.ndarray], weight: np.ndarray, table: PieceTable, p: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Expected counts of every piece [pieces + 1] in words of any length, each counted ``weight`` times, by the
    probabilities p[pieces + 1] of one language. Prefixes and suffixes are kept as logarithms, one for each letter."""
    order, size, first, at, pieces = _long_pieces(words, table)
    n, c = len(size), len(at)
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")

    def q(e):
        out = p[pieces[e]]
        out[..., 0] = np.maximum(out[..., 0], FLOOR)
        return out

    # upto[e]: log of the sum over the letters before e; down[e]: over those from e on. ahead, back: the nearest
    # LONGEST_PIECE of these as multiples of the last one
    upto, down, total = np.zeros(c), np.zeros(c), np.zeros(n)
    back, ahead = np.zeros((n, LONGEST_PIECE)), np.zeros((n, LONGEST_PIECE))
    back[:, 0] = ahead[:, 0] = 1
    for j in range(size[0]):
        m = live[j]
        upto[first[:m] + j] = total[:m]
        new = (back[:m] * q(first[:m] + j)).sum(1)
        total[:m] += np.log(new)
        back[:m, 1:] = back[:m, :-1] / new[:, None]
        back[:m, 0] = 1
    rest, k = np.zeros(n), np.arange(LONGEST_PIECE)
    for j in range(size[0] - 1, -1, -1):
        m = live[j]
        e = np.minimum(first[:m, None] + j + k, c - 1)  # beyond a word's end ``ahead`` is 0
        one = p[pieces[e, k]]
        one[:, 0] = np.maximum(one[:, 0], FLOOR)
        new = (ahead[:m] * one).sum(1)
        rest[:m] += np.log(new)
        down[first[:m] + j] = rest[:m]
        ahead[:m, 1:] = ahead[:m, :-1] / new[:, None]
        ahead[:m, 0] = 1
    counts = np.zeros(len(p))
    after = np.append(down[1:], 0.0)
    after[first + size - 1] = 0
    of = np.repeat(np.arange(n), size)
    for lo in range(0, c, block):
        e = np.arange(lo, min(c, lo + block))
        begins = np.maximum(e[:, None] - k, 0)
        fits = at[e][:, None] >= k
        share = np.where(fits, np.exp(np.where(fits, upto[begins] + after[e][:, None] - total[of[e]][:, None], 0.0)), 0.0)
        counts += np.bincount(pieces[e].ravel(), weights=(share * q(e) * weight[order][of[e]][:, None]).ravel(), minlength=len(p))
    return counts


def cut_words(texts, longer: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased runs of letters: distinct words of at most LONGEST_WORD letters [m, LONGEST_WORD], their lengths, and
    for each occurrence its document and the number of its word. Longer words, numbered from m on, go to ``longer``."""
    longer = [] if longer is None else longer
    low = [x.lower() for x in texts.to_pylist()]
    size = np.array([len(x) for x in low], np.int64)
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum(size)])
    mask = np.append(_letters()[c], False)
    first = np.zeros(len(c) + 1, bool)
    first[off] = True
    prev = np.append(False, mask[:-1]) & ~first
    start = np.flatnonzero(mask & ~prev)
    nxt = np.append(mask[1:], False)
    nxt[:-1] &= ~first[1:]
    end = np.flatnonzero(mask & ~nxt) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    long = end - start > LONGEST_WORD
    spans = zip(start[long].tolist(), end[long].tolist(), strict=True)
    long_doc = doc[long]
    longer += [c[a:b] for a, b in spans]
    start, end, doc = start[~long], end[~long], doc[~long]
    length = end - start
    h = np.zeros(len(start), np.uint64)
    for k in range(int(length.max(initial=0))):
        on = length > k
        h[on] = mix(h[on] * _P + c[start[on] + k] + np.uint64(1))
    _, one, word = np.unique(h, return_index=True, return_inverse=True)
    at = start[one][:, None] + np.arange(LONGEST_WORD)
    words = np.where(np.arange(LONGEST_WORD) < length[one][:, None], c[np.minimum(at, max(0, len(c) - 1))] if len(c) else 0, 0)
    return words, length[one], np.concatenate([doc, long_doc]), np.concatenate([word, len(one) + np.arange(len(longer))])


class UnigramModel:
    def __init__(self, pieces: list[str], langs: list[str], prob: np.ndarray):
        self.pieces, self.langs, self.prob = pieces, langs, prob
        self._table: PieceTable | None = None

    def __getstate__(self):
        return {"pieces": self.pieces, "langs": self.langs, "prob": self.prob, "_table": None}

    @property
    def table(self) -> PieceTable:
        if self._table is None:
            self._table = PieceTable(self.pieces)
        return self._table

    def word_scores(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        order = np.argsort(lengths, kind="stable")
        for lo in range(0, len(words), 8192):
            k = order[lo : lo + 8192]
            out[k] = forward(pieces_of(words[k], lengths[k], self.table), lengths[k], self.prob)
        return out

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        longer: list[np.ndarray] = []
        words, lengths, doc, word = cut_words(texts, longer)
        n = len(texts)
        seen = np.bincount(doc, minlength=n)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        scores = self.word_scores(words, lengths)
        if longer:
            scores = np.concatenate([scores, forward_long(longer, self.table, self.prob)])
        each = scores[word]
        total = np.stack([np.bincount(doc, weights=each[:, k], minlength=n) for k in range(len(self.langs))], axis=1)
        best = total.argmax(1)
        # posterior of the best language for a text of the same mean word score and at most 20 words
        mean = total / np.maximum(1, seen)[:, None] * np.minimum(20, np.maximum(1, seen))[:, None]
        score = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if s else "und" for b, s in zip(best, seen, strict=True)], np.where(seen > 0, score, 0.0)


def _long_groups(texts: list[str], lang: np.ndarray, n: np.ndarray, which: np.ndarray, letters: int = 1 << 18):
    """The words marked by ``which`` as (language, words, weights), of one language and about ``letters`` letters each."""
    for of in np.unique(lang[which]):
        words, at = [], []
        for i in np.flatnonzero(which & (lang == of)):
            words.append(_codes(texts[i]))
            at.append(i)
            if sum(map(len, words)) >= letters:
                yield of, words, n[at]
                words, at = [], []
        if words:
            yield of, words, n[at]


def _expect(model):
    def run(batches):
        m = model.value
        for batch in batches:
            texts = batch.column("word").to_pylist()
            n = batch.column("n").to_numpy().astype(float)
            lang = batch.column("lang").to_numpy()
            short = np.array([len(x) <= LONGEST_WORD for x in texts], bool)
            for of, words, weight in _long_groups(texts, lang, n, ~short):
                x = expect_long(words, weight, m.table, m.prob[:, of])[:-1]
                b = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), of, np.int32)), pa.array(b.astype(np.int32)), pa.array(x[b])], ["lang", "piece", "x"])
            texts, n, lang = [x for x, ok in zip(texts, short, strict=True) if ok], n[short], lang[short]
            for lo in range(0, len(texts), 4096):
                part = texts[lo : lo + 4096]
                lengths = np.array([len(x) for x in part])
                words = np.zeros((len(part), LONGEST_WORD), np.uint32)
                for i, x in enumerate(part):
                    words[i, : len(x)] = _codes(x)
                pieces = pieces_of(words, lengths, m.table)
                weight, of = n[lo : lo + 4096], lang[lo : lo + 4096]
                counts = np.zeros((len(m.langs), len(m.pieces) + 1))
                for k in np.unique(of):
                    on = of == k
                    one, size = pieces[:, :, on], lengths[on]
                    p = m.prob[:, k]
                    alpha = forward(one, size, p[:, None], keep=True)[:, :, 0]
                    whole = alpha[size, np.arange(len(size))]
                    beta = np.zeros_like(alpha)
                    beta[size, np.arange(len(size))] = 1
                    scale = weight[on] / np.maximum(whole, 1e-300)
                    for j in range(int(size.max()) - 1, -1, -1):
                        for s in range(1, min(LONGEST_PIECE, j + 1) + 1):
                            num = one[j, s - 1]
                            q = np.maximum(p[num], FLOOR) if s == 1 else p[num]
                            np.add.at(counts[k], num, alpha[j + 1 - s] * q * beta[j + 1] * scale)
                            beta[j + 1 - s] += q * beta[j + 1]
                a, b = np.nonzero(counts[:, :-1])
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[a, b])], ["lang", "piece", "x"])

    return run


def train(labelled: DataFrame, per_language: int = 400, rounds: int = 3, smooth: float = 0.05, seed: int = 1) -> UnigramModel:
    """labelled(doc_id, text, lang) -> model. Of each language, about ``per_language`` rows drawn by a hash of
    doc_id (all, where there are fewer) are counted, with all their words, whole at any length. Null langs and texts teach nothing; without any row the model knows no language."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs, pieces = sorted(counts), vocabulary()
    uniform = np.full((len(pieces) + 1, max(1, len(langs))), 1 / (len(pieces) + 1))
    uniform[-1] = 0
    if not langs:
        return UnigramModel(pieces, [], uniform)
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)
    share = F.lit(None).cast("double")
    for k, n in counts.items():
        share = F.when(F.col("lang") == k, min(1.0, per_language / n)).otherwise(share)
    number = F.array_position(F.array(*(F.lit(x) for x in langs)), F.col("lang")).cast("int") - 1
    runs = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    words = rows.filter(u < share).select(number.alias("lang"), F.explode(runs).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = written(words.repartition(spark.sparkContext.defaultParallelism), "words")
    model = UnigramModel(pieces, langs, uniform)
    for _ in range(rounds):
        got = words.mapInArrow(_expect(spark.sparkContext.broadcast(model)), "lang int, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).toPandas()
        prob = np.zeros_like(uniform)
        prob[got.piece.to_numpy(), got.lang.to_numpy()] = got.x.to_numpy()
        prob[:-1] += smooth
        model = UnigramModel(pieces, langs, prob / prob.sum(0))
        model.prob[-1] = 0
    return model


def _label(model):
    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch, "text"):
                lang, score = model.value.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: UnigramModel) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred, score), one row per input row, from the whole text alone.
    Texts that are null or hold no letter get ``und`` and score 0; ties go to the first language."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_label(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2: rows no model of this package learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, model: UnigramModel) -> DataFrame:
    """``docs`` with ``lang`` replaced by the predicted language (``und`` where there is none); every other
    column and row unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("lang")
            lang = [x for _, texts in text_slices(batch, "text") for x in shared.value.predict(texts)[0]]
            yield batch.set_column(k, batch.schema.field(k), pa.array(lang, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
