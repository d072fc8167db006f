"""Token counts of whole texts (operator 3).

Texts of ordinary length are counted in one go.  For a byte-level vocabulary, a place where white space
follows something else always starts a new piece of the vocabulary's pre-tokenisation, whatever stands
around it, so a text's count is the sum over its (white space + word) segments; each task asks the
library once per distinct segment and sums with numpy.  Other vocabularies are given whole texts.

Huge texts are cut into chunks that overlap, dealt to all tasks, and encoded with offsets.  Two neighbours
are spliced at a token start that both encodings have and that is proven to be stable (white space after
something else, see above).  Where a pair of chunks has no such place, the document is encoded again with a
wider overlap, at last as a whole.

Counts are those of the library without added begin or end tokens; strings of special tokens inside
texts are handled as is the library's default.  Defined results: null counts as empty (0 bytes, 0
tokens); repeated rows stay repeated; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparktools import bare, cut
from .words import _hash_words, slices, split_words

LIMIT = 512
CHUNK, OVERLAP = 65_536, 256
#: Distinct segments that a task remembers.
REMEMBERED = 2_000_000

_loaded: dict[str, object] = {}


def _library(path: str):
    """The library's tokenizer of a .json or .model file, once per process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _lengths(path: str, texts: list[str]) -> list[int]:
    library = _library(path)
    if path.endswith(".model"):
        return [len(ids) for ids in library.encode(texts, num_threads=1)]
    return [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def splits_at_spaces(path: str) -> bool:
    """Whether white space after something else always starts a new piece, and no special token has any."""
    if path.endswith(".model"):
        return False
    library = _library(path)
    plain = library.normalizer is None and type(library.pre_tokenizer).__name__ == "ByteLevel" and "use_regex=True" in str(library.pre_tokenizer) and "add_prefix_space=False" in str(library.pre_tokenizer)
    return plain and not any(c.isspace() for t in library.get_added_tokens_decoder().values() for c in t.content)


class _Segments:
    """Counts by distinct segment, remembered for the task."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[int, int] = {}

    def counts(self, column: pa.Array) -> np.ndarray:
        words = split_words(column, hashes=False)
        data, first = words.data, words.first
        # a segment runs from the end of the word before (or the text's start) to its own word's end
        starts = np.empty(len(words.starts), dtype=np.int64)
        starts[1:] = words.ends[:-1]
        texts = np.flatnonzero(words.counts > 0)
        starts[first[:-1][texts]] = words.text_offsets[:-1][texts]
        joined = self._unproven(data, starts) if len(starts) else np.zeros(0, bool)
        joined[first[:-1][texts]] = False
        lead = np.flatnonzero(~joined)
        begin, end = starts[lead], words.ends[np.append(lead[1:], len(starts)) - 1] if len(lead) else words.ends
        # white space after a text's last word is a segment too
        last_end = words.text_offsets[:-1].copy()
        last_end[texts] = words.ends[first[1:][texts] - 1]
        tail = np.flatnonzero(last_end < words.text_offsets[1:])
        owner = np.searchsorted(first, lead, "right") - 1
        owner = np.concatenate((owner, tail))
        begin, end = np.concatenate((begin, last_end[tail])), np.concatenate((end, words.text_offsets[1:][tail]))
        order = np.argsort(begin, kind="stable")
        begin, end, owner = begin[order], end[order], owner[order]
        hashes, at, back = np.unique(_hash_words(data, begin, end) ^ (end - begin).astype(np.uint64), return_index=True, return_inverse=True)
        names = hashes.tolist()
        fresh = [i for i, h in enumerate(names) if h not in self.known]
        if fresh:
            raw = data.tobytes()
            new = [raw[begin[at[i]] : end[at[i]]].decode("utf-8", "replace") for i in fresh]
            for i, n in zip(fresh, _lengths(self.path, new), strict=True):
                self.known[names[i]] = n
        each = np.fromiter((self.known[h] for h in names), dtype=np.int64, count=len(names))[back]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.bincount(owner, weights=each, minlength=len(column)).astype(np.int64)

    @staticmethod
    def _unproven(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Segments whose place follows what may be white space beyond ASCII: they stay with the one before."""
        b1, b2, b3 = (data[np.maximum(at - i, 0)] for i in (1, 2, 3))
        wide = (b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81)) | (b3 == 0xE1) & (b2 == 0x9A) | (b3 == 0xE3) & (b2 == 0x80)
        return wide | (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b1 >= 0x1C) & (b1 <= 0x1F)


def _count_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _Segments(path) if splits_at_spaces(path) else None
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text").fill_null("")
                counts = segments.counts(text) if segments else _lengths(path, text.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def stable_starts(text: str, offsets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(place, token) of token starts just after a single white space that follows something else."""
    found, before = [], -1
    for k, (at, _) in enumerate(offsets):
        if at != before and at >= 2 and text[at - 1].isspace() and not text[at - 2].isspace():
            found.append((at, k))
        before = at
    return found


_PIECE = pa.schema([
    ("name", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("pieces", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()),
    ("head_at", pa.list_(pa.int64())), ("head_k", pa.list_(pa.int64())), ("tail_at", pa.list_(pa.int64())), ("tail_k", pa.list_(pa.int64())),
])


def _encode_pieces(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(path)
        for batch in batches:
            for row in batch.to_pylist():
                text, start = row["part"], row["piece"] * chunk
                if row["pieces"] == 1 or path.endswith(".model"):
                    n, places = _lengths(path, [text])[0], []
                else:
                    encoded = library.encode(text, add_special_tokens=False)
                    n, places = len(encoded), stable_starts(text, encoded.offsets)
                head = [(start + at, k) for at, k in places if at < overlap]
                # the chunk's end may cut its last word, so that word's own place doesn't count
                tail = [(start + at, k) for at, k in places[:-1] if at >= chunk]
                values = [row["name"], row["doc_id"], row["n_bytes"], row["pieces"], row["piece"], n, [a for a, _ in head], [k for _, k in head], [a for a, _ in tail], [k for _, k in tail]]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _PIECE, strict=True)], schema=_PIECE)

    return run


def splice(pieces: list[dict]) -> int | None:
    """Tokens of a document from its chunks in order; None if two of them have no stable place in common."""
    total, begin = 0, 0
    for left, right in zip(pieces, pieces[1:], strict=False):
        own = dict(zip(right["head_at"], right["head_k"], strict=True))
        common = [(k, own[at]) for at, k in zip(left["tail_at"], left["tail_k"], strict=True) if at in own]
        if not common:
            return None
        upto, after = common[len(common) // 2]
        total += upto - begin
        begin = after
    return total + pieces[-1]["n"] - begin


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        counts = [splice(sorted(row["parts"], key=lambda p: p["piece"])) for row in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("name"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()), batch.column("copies")],
            names=["name", "doc_id", "n_bytes", "n_tokens", "copies"],
        )


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit."""
    rows = bare(docs, key, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    # the whole-text path serves texts that have one chunk only
    huge = F.length("text") > chunk + overlap
    counted = rows.where(~huge).mapInArrow(_count_whole(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    long = rows.where(huge).withColumn("name", F.xxhash64("text"))
    done, left, names = None, long, None
    while True:
        pieces = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / chunk)) if overlap < chunk else F.lit(1)
        parts = (
            left.withColumn("pieces", pieces.cast("long")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
            .select(
                "name", "doc_id", "n_bytes", "pieces", "piece",
                F.when(F.col("pieces") == 1, F.col("text")).otherwise(F.substring("text", (F.col("piece") * chunk + 1).cast("int"), F.lit(chunk + overlap))).alias("part"),
            )
            .repartition("name", "piece")
        )
        schema = "name long, doc_id long, n_bytes long, pieces long, piece long, n long, head_at array<long>, head_k array<long>, tail_at array<long>, tail_k array<long>"
        encoded = parts.mapInArrow(_encode_pieces(tokenizer, chunk, overlap), schema)
        # rows that repeat give every chunk as often
        docs_of = encoded.groupBy("name", "doc_id", "n_bytes", "pieces").agg(
            F.collect_set(F.struct("piece", "n", "head_at", "head_k", "tail_at", "tail_k")).alias("parts"), (F.count("*") / F.col("pieces")).cast("long").alias("copies")
        )
        tried = cut(docs_of.select("name", "doc_id", "n_bytes", "parts", "copies").mapInArrow(_spliced, "name long, doc_id long, n_bytes long, n_tokens long, copies long"))
        good = tried.where("n_tokens IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        names = tried.where("n_tokens IS NULL").select("name").distinct()
        if not names.limit(1).count():
            break
        # no common stable place: wider overlaps, at last (overlap >= chunk) the whole text
        overlap *= 16
        left = long.join(names, "name", "left_semi")
    spliced = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "n_bytes", "n_tokens")
    return counted.unionByName(spliced).select(F.col("doc_id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
