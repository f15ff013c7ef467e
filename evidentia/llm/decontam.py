"""Benchmark decontamination with generalised suffix automata of the normalised items.

An automaton is over word numbers of its items' vocabulary. Each text's words are looked up in it in
numpy; only runs of known words long enough to hold a window are streamed through the automaton, which
gives at every word the longest suffix that is a piece of some item. That answers which words lie in an
occurring window, and which items hold it. Items are dealt by a hash into groups of about ``max_words`` words;
Spark tasks build one automaton a group and write it. One group, the usual case, is broadcast and the texts pass it
once. More groups take one broadcast and one pass each, and only what they hit is brought together by row; so
neither the driver nor a task ever holds more than one automaton.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written
from .textwords import ALNUM, Words, hash_words


class SuffixAutomaton:
    """Of several sequences of integers; ``add`` one after another, then ``finish``."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.items: list[list[int]] = []
        self.names: list[str] = []

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def add(self, name: str, words: list[int]) -> None:
        last = 0
        for c in words:
            last = self._extend(last, c)
        self.names.append(name)
        self.items.append(words)

    def finish(self) -> None:
        """marks: for a state, the windows that end where it does, as (length, item numbers), longest first."""
        own: dict[int, dict[int, set[int]]] = {}
        for k, words in enumerate(self.items):
            w = min(self.window, len(words))
            for i in range(len(words) - w + 1):
                s = 0
                for c in words[i : i + w]:
                    s = self.next[s][c]
                own.setdefault(s, {}).setdefault(w, set()).add(k)
        self.marks: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            mine = tuple((w, tuple(sorted(x))) for w, x in sorted(own.get(s, {}).items(), reverse=True))
            self.marks[s] = mine + self.marks[self.link[s]]
        self.shortest = min((min(self.window, len(x)) for x in self.items), default=0)

    def stream(self, words: list[int]):
        """Yields (position, window length, item numbers) of each window that ends there."""
        nxt, link, length, marks = self.next, self.link, self.len, self.marks
        s = matched = 0
        for i, c in enumerate(words):
            while s and c not in nxt[s]:
                s = link[s]
                matched = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                matched += 1
            for w, items in marks[s]:
                if matched >= w:
                    yield i, w, items


def _one_automaton(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        machine, seen = SuffixAutomaton(window), {}
        for name, text in pdf.sort_values(["item_id", "text"]).loc[:, ["item_id", "text"]].itertuples(index=False):
            raw = text.encode()
            w = Words(pa.array([text], pa.large_string()), ALNUM, hashes=False)
            words = [raw[a:b].decode().translate(_ASCII_LOWER) for a, b in zip(w.start, w.end, strict=True)]
            if words:
                machine.add(name, [seen.setdefault(x, len(seen)) for x in words])
        machine.finish()
        h = hash_words(list(seen))
        order = np.argsort(h)
        return pd.DataFrame({"grp": pdf.grp.iloc[:1], "automaton": [pickle.dumps((h[order], np.arange(len(h))[order], machine))]})

    return run


def build_automata(items: DataFrame, window: int, max_words: int) -> tuple[DataFrame, int]:
    """items(item_id, text) -> a written table (grp, automaton), and the number of groups. An automaton is pickled as
    (sorted vocabulary hashes, word numbers, machine)."""
    t = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id is not null")
    words = t.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    groups = max(1, -(-words // max_words))
    built = t.withColumn("grp", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).cast("int")).groupBy("grp").applyInPandas(_one_automaton(window), "grp int, automaton binary")
    return written(built, "automata"), groups


def _shared(table: DataFrame, grp: int):
    """The automaton of one group as a broadcast list; empty where the group has no item."""
    row = table.filter(F.col("grp") == grp).select("automaton").first()
    return table.sparkSession.sparkContext.broadcast([pickle.loads(row.automaton)] if row else [])


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def scan_texts(texts: pa.LargeStringArray, automata: list) -> tuple[Words, np.ndarray, list[set[str]]]:
    """The words of the texts, which of them lie in an occurring window, and each text's item ids."""
    w = Words(texts, ALNUM)
    hit = np.zeros(len(w.start) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(w.n_docs)]
    n = len(w.start)
    for vocab, number, machine in automata:
        if not n:
            break
        at = np.searchsorted(vocab, w.hash)
        at[at == len(vocab)] = 0
        known = vocab[at] == w.hash
        # runs of known words within one text
        cut = np.append(True, (w.doc[1:] != w.doc[:-1]) | (known[1:] != known[:-1]))
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], n)
        use = known[begin] & (end - begin >= machine.shortest)
        for a, b in zip(begin[use].tolist(), end[use].tolist(), strict=True):
            for i, size, items in machine.stream(number[at[a:b]].tolist()):
                hit[a + i - size + 1] += 1
                hit[a + i + 1] -= 1
                found[w.doc[a]].update(machine.names[k] for k in items)
    return w, np.cumsum(hit[:-1]) > 0, found


def _scan(automata):
    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch, "text"):
                w, hit, found = scan_texts(texts, automata.value)
                n = len(texts)
                n_hit = np.bincount(w.doc[hit], minlength=n)
                ids = [sorted(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, n), pa.array(w.counts().astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]), pa.array(n_hit > 0)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return run


def _found(automata):
    """(rid, spans, items) of the texts that are hit; spans are word numbers, first and one past the last in turn."""

    def run(batches):
        for batch in batches:
            for lo, texts in text_slices(batch, "text"):
                w, hit, found = scan_texts(texts, automata.value)
                docs = np.unique(w.doc[hit])
                begin = np.searchsorted(w.doc, docs)
                end = np.searchsorted(w.doc, docs, side="right")
                spans = [np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))).tolist() for a, b in zip(begin, end, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(lo, len(texts)).take(pa.array(docs)), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(found[d]) for d in docs], pa.list_(pa.string()))], ["rid", "spans", "items"])

    return run


def _join_spans(parts) -> list[int]:
    """Spans of several groups as one ascending list without overlaps."""
    out: list[int] = []
    for a, b in sorted((p[k], p[k + 1]) for p in parts for k in range(0, len(p), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _all_found(rows: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """rows(rid, text) -> (rid, spans, items) over all groups, one pass each; a row has at most one part a group."""
    parts = None
    for g in range(groups):
        part = written(rows.mapInArrow(_found(_shared(table, g)), "rid long, spans array<int>, items array<string>"), "found")
        parts = part if parts is None else parts.union(part)

    def join(batches):
        for batch in batches:
            spans = [_join_spans(x) for x in batch.column("s").to_pylist()]
            items = [sorted(set().union(*x)) for x in batch.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["rid", "spans", "items"])

    return parts.groupBy("rid").agg(F.collect_list("spans").alias("s"), F.collect_list("items").alias("i")).mapInArrow(join, "rid long, spans array<int>, items array<string>")


def _count(batches):
    for batch in batches:
        for lo, texts in text_slices(batch, "text"):
            n = Words(texts, ALNUM, hashes=False).counts().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, len(n)) for c in ("rid", "doc_id")), pa.array(n)], ["rid", "doc_id", "n_words"])


def scan(docs: DataFrame, items: DataFrame, window: int = 10, max_words: int = 200_000) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated), one row per input row. A null text has no words; items without words or with a null id
    never match; items of equal text are all named. No items: nothing is hit."""
    table, groups = build_automata(items, window, max_words)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if groups == 1:
        return d.mapInArrow(_scan(_shared(table, 0)), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    rows = written(d.withColumn("rid", F.monotonically_increasing_id()), "rows")
    found = _all_found(rows.select("rid", "text"), table, groups)
    width = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)  # the last less the one before, and so on
    found = found.select("rid", width.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = rows.mapInArrow(_count, "rid long, doc_id long, n_words long").join(found, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _without(text: str, spans: list[int], max_span: int, max_coverage: float) -> str | None:
    """The text without those spans of words; None where one is longer than ``max_span`` words or they are more than
    ``max_coverage`` of all."""
    w = Words(pa.array([text], pa.large_string()), ALNUM, hashes=False)
    size = [b - a for a, b in zip(spans[::2], spans[1::2], strict=True)]
    if max(size) > max_span or sum(size) > max_coverage * len(w.start):
        return None
    raw, keep, last = text.encode(), [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        keep.append(raw[last : w.start[a]])
        last = w.end[b - 1]
    return b"".join([*keep, raw[last:]]).decode()


def _clean(automata, max_span: int, max_coverage: float):
    def one(text: str | None):
        """The text without its hit spans, until none is left; None where too much of it is hit at first."""
        limits = (max_span, max_coverage)
        while text is not None:
            _, hit, _ = scan_texts(pa.array([text], pa.large_string()), automata.value)
            if not hit.any():
                break
            text = _without(text, np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist(), *limits)
            limits = (len(hit), 1.0)
        return text

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            bad: dict[int, str | None] = {}
            for lo, texts in text_slices(batch, "text"):
                w, hit, _ = scan_texts(texts, automata.value)
                for d in np.unique(w.doc[hit]).tolist():
                    bad[lo + d] = one(texts[d].as_py())
            if bad:
                field, at = batch.schema.field(k), np.array(sorted(bad))
                changed = np.zeros(batch.num_rows, bool)
                changed[at] = True
                new = pa.array([bad[i] for i in at.tolist()], field.type)
                keep = ~changed
                keep[at] = new.is_valid()
                batch = batch.set_column(k, field, pc.replace_with_mask(batch.column(k), pa.array(changed), new))
                c = batch.schema.get_field_index("n_chars")
                if c >= 0:
                    size = pc.utf8_length(new).cast(batch.schema.field(c).type)
                    batch = batch.set_column(c, batch.schema.field(c), pc.replace_with_mask(batch.column(c), pa.array(changed), size))
                batch = batch.filter(pa.array(keep))
            yield batch

    return run


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = 10, max_span: int = 200, max_coverage: float = 0.5, max_words: int = 200_000) -> DataFrame:
    """``docs`` with every span of words inside an occurring window cut out, whatever its length, so that
    none occurs in what is left. Documents go where a span is longer than ``max_span`` words or hit words
    are more than ``max_coverage`` of the words. Other rows and columns come out unchanged (null texts
    too); ``n_chars``, where there, is made the new length of a changed text. Columns may have any names."""
    table, groups = build_automata(items, window, max_words)
    if groups == 1:
        return docs.mapInArrow(_clean(_shared(table, 0), max_span, max_coverage), docs.schema)
    rows = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("text"), F.lit(False).alias("cut"), F.struct(*docs.columns).alias("row")), "rows")
    done, limits = None, (max_span, max_coverage)
    while True:  # a cut may bring words together: what was cut is looked at again, until nothing is hit
        found = written(_all_found(rows.select("rid", "text"), table, groups), "hits")
        clean = rows.join(found, "rid", "left_anti")
        done = clean if done is None else done.unionByName(clean)
        hit = rows.join(found.select("rid", "spans"), "rid")

        def cut(batches, limits=limits):
            for batch in batches:
                new = [_without(t, s, *limits) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(new, pa.string()), pa.array([True] * len(new)), batch.column("row")], ["rid", "text", "cut", "row"])

        rows = written(hit.mapInArrow(cut, rows.schema).filter("text is not null"), "cut")
        limits = (1 << 62, 1.0)
        if rows.isEmpty():
            break
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    kind = {f.name: f.dataType for f in docs.schema}
    return done.select(*(F.when(F.col("cut"), new[c].cast(kind[c])).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))
