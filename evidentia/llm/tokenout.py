"""Token ids as Parquet list columns, written in global document order and read back.

Texts are range-partitioned by doc_id; each task encodes its range and writes one file whose token
column is dictionary or delta encoded, with bounded row groups, page statistics and a page index. Each row
holds its place in its file; a small table beside the files says how many ids all files before one hold. So a
token's place in the whole corpus needs no shuffle, and a few documents are read without touching the others.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release_memory, scratch_path, text_slices

#: Runs whose normal form is their plain lower case: ASCII and precomposed Latin-1 letters.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The tokenizer's own pre-tokens within plain runs in lower case, and the line ends that part the runs here.
_PIECE = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\n]+")
_PLAIN_LINES = re.compile(f"{_PLAIN.pattern[:-2]}\n]+")
_ENCODERS: dict = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts by a lower-casing byte-level word BPE, whose pieces never span white space.

    A slice of texts is split at ASCII white space and its distinct runs are numbered in Arrow. Runs met before are
    in a table; new plain ones are split together as the tokenizer's pre-tokenizer splits them and their pieces go to
    the tokenizers library's model, once each; any other run goes through the whole tokenizer. The ids of all
    occurrences are then gathered in numpy. Tables begin anew beyond ``max_known`` runs, pieces or, tenfold, ids."""

    def __init__(self, path: str, end_id: int, max_known: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if added else None
        self.letters = {b: x for b, x in _byte_letters().items() if chr(b) != x}  # by the byte as a Latin-1 letter
        self.max_known, self.end_id = max_known, end_id
        self.pieces: dict[str, bytes] = {"\n": b""}
        self._clear()

    def _clear(self) -> None:
        """Number 0 is the end of a text."""
        self.known: dict[str, int] = {}
        self.flat, self.size = array("I", [self.end_id]), array("q", [1])

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        got = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(piece) <= 64:
            self.pieces[piece] = got
        return got

    def _add(self, runs: list[str]) -> None:
        """Puts the ids of new runs at the end of the tables."""
        plain, odd, text = runs, [], "\n".join(runs)
        if not _PLAIN_LINES.fullmatch(text) or (self.special and self.special.search(text)):
            plain, odd = [], []
            for r in runs:
                (plain if _PLAIN.fullmatch(r) and not (self.special and self.special.search(r)) else odd).append(r)
            text = "\n".join(plain)
        for r in odd:
            self.known[r] = len(self.size)
            ids = self.tokenizer.encode(r, add_special_tokens=False).ids
            self.flat.extend(ids)
            self.size.append(len(ids))
        if plain:
            split = _PIECE.findall(text.lower() + "\n")
            ids = list(map(self.pieces.get, split))
            for i in [i for i, x in enumerate(ids) if x is None]:
                ids[i] = self.pieces.get(split[i]) or self._piece(split[i])
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            upto = np.cumsum(n)[n == 0] // 4  # only the line ends have no id
            self.known.update(zip(plain, range(len(self.size), len(self.size) + len(plain)), strict=True))
            self.flat.frombytes(b"".join(ids))
            self.size.frombytes(np.diff(upto, prepend=0).astype(np.int64).tobytes())

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text with its end, all those ids one after another)."""
        split = pc.ascii_split_whitespace(texts)
        values = split.flatten().dictionary_encode()
        runs = values.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.max_known or len(self.flat) > 10 * self.max_known:
            self._clear()
        if len(self.pieces) > self.max_known:
            self.pieces = {"\n": b""}
        self.known[""] = -1  # what precedes a leading space and follows a trailing one
        number = list(map(self.known.get, runs))
        new = [r for r, k in zip(runs, number, strict=True) if k is None]
        if new:
            self._add(new)
            number = [self.known[r] if k is None else k for r, k in zip(runs, number, strict=True)]
        number = np.array(number, np.int64)
        for r in new:
            if len(r) > 64:
                del self.known[r]
        off = split.offsets.to_numpy().astype(np.int64)
        off -= off[0]
        at = number[values.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.int64)
        at = np.insert(at, off[1:], 0)  # every text ends
        last = off[1:] + np.arange(1, len(off))
        size, flat = np.frombuffer(self.size, np.int64), np.frombuffer(self.flat, np.uint32)
        first = np.cumsum(size) - size
        n = np.where(at < 0, 0, size[at])
        upto = np.cumsum(n)
        ids = flat[np.repeat(first[at] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        return np.diff(upto[last - 1], prepend=0), ids


def _encoder(tokenizer: str, end_id: int) -> WordEncoder:
    if (tokenizer, end_id) not in _ENCODERS:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[tokenizer, end_id] = WordEncoder(public_tokenizers.path(tokenizer), end_id)
    return _ENCODERS[tokenizer, end_id]


def _encode(tokenizer: str, end_id: int):
    def run(batches):
        enc, before = _encoder(tokenizer, end_id), 0
        for batch in batches:
            for lo, texts in text_slices(batch, "text", 2 << 20):
                n, ids = enc.encode(texts)
                upto = np.cumsum(n)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], upto]).astype(np.int32), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(n)), pa.array(before + upto - n), pa.array(n.astype(np.int32)), lists], ["doc_id", "place", "n_tokens", "ids"])
                before += int(upto[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, partitions: int | None = None, encoding: str = "dictionary", row_group_bytes: int = 8 << 20) -> None:
    """docs(doc_id, text) -> Parquet under ``path``: (part int, place long, doc_id long, n_tokens int, ids list<int>)
    in ascending doc_id order by (part, place), where place counts the ids before it in its file; equal doc_ids are
    ordered by a hash of the text, so that many of them spread over files. ``path``/_parts holds (part, before), the
    ids of all files before one. ``encoding`` is ``dictionary`` or ``delta`` for the token column. Each text ends with
    ``end_id``; null is the empty text; rows with a null doc_id come first. Ids are below 2^31, so a signed 32-bit
    column holds them."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    d = d.repartitionByRange(partitions, "doc_id", "h") if partitions else d.repartitionByRange("doc_id", "h")
    d = d.sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    out = d.mapInArrow(_encode(tokenizer, end_id), "doc_id long, place long, n_tokens int, ids array<int>").withColumn("part", F.spark_partition_id())
    options = {"compression": "zstd", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(256 << 10), "parquet.page.write-checksum.enabled": "true"}
    if encoding == "delta":
        options |= {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"}
    else:
        options |= {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)}
    out.select("part", "place", "doc_id", "n_tokens", "ids").write.options(**options).parquet(path)
    # one row per file: its window needs no partition
    size = docs.sparkSession.read.parquet(path).groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    size.select("part", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{path}/_parts")


def read_token_files(spark, path: str, docs: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); with ``docs`` = (first, last) only those doc_ids: the filter reaches the scan,
    where row group and page statistics skip the rest. start counts the ids of all documents before, over the whole
    path."""
    t = spark.read.parquet(path)
    if docs:
        t = t.filter(F.col("doc_id").between(*docs))
    t = t.join(spark.read.parquet(f"{path}/_parts"), "part")
    return t.select("doc_id", (F.col("before") + F.col("place")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _crc(batches):
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        del ids, flat, batch
        release_memory()


def token_digest(spark, path: str) -> DataFrame:
    """Per document of the files under ``path``: (doc_id, start, n_tokens, ids_crc32)."""
    return read_token_files(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, **options) -> DataFrame:
    """Writes the token files of ``docs`` in the shared folder and returns what reading them back gives."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, **options)
    return token_digest(docs.sparkSession, path)
