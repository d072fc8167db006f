"""Benchmark decontamination by latent semantic retrieval (operator 8).

Words of the lower-cased texts weigh by how rare they are in the whole corpus (all tokens counted, in
hashed bins; words in more than one of ``STOP_SHARE`` tokens weigh nothing).  A randomised singular value
decomposition of TF-IDF passages, those of the benchmark and all windows of the corpus, gives a
latent space; Spark sums the pairs of words of the windows in one reading, and the matrix products are computed from these sums.  Directions that
the items need and the decomposition left out are added to it, so no item loses length in it and the cosine
with an item is the one of the full TF-IDF rows.  Every window of every document is searched: a window of whose squared length
less than ``COSINE`` squared can lie on words of the items can't be near an item (its cosine is at most the
square root of that share) and is passed over; all others are projected and compared with every item.

An item of more than ``WINDOW`` words is searched by its passages of that length, ``STRIDE`` words apart, and
as a whole: a text that holds one passage of it holds the item.  An item of up to ``SHORT`` words is too little of a window for
its cosine; it is looked up exactly: of its answer words, rarest first, so many that one must be there where enough of them are,
and every place of such a word is a candidate.

Candidates, windows near a passage by cosine, are then checked on the words around them: the longest common
subsequence with the passage must cover ``COVERED`` of the passage (so insertions, losses and replaced words
are found), and of the passage's most telling words, the answer, ``ANSWERED`` must be there.

A benchmark of more than ``PASSAGES`` passages has a latent space for each block of that size.  At most ``BLOCKS`` of them (about 8 MB each)
are broadcast at once: a larger benchmark is read in parts, the texts once for each, and no more than a part is ever on the driver.

Defined results: null or empty texts and items match nothing; items with equal texts each match; a
document is judged by its row alone, so repeated rows give repeated results; very long texts are searched whole; an empty table
gives no rows, an empty benchmark keeps all documents; filters keep all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparktools import bare, cut, one_thread, tidy
from .words import Words, slices, split_words

WINDOW, STRIDE = 32, 16
BINS = 1 << 16
STOP_SHARE = 200
#: Items of so many words at most are looked up by their words.
SHORT = 12
RANK, OVERSAMPLE, POWERS = 256, 16, 2
#: Passages of items that share a latent space: no more than its directions.
PASSAGES = RANK
#: Latent spaces that are broadcast at once.
BLOCKS = 8
#: Share of a passage's length that may be missing in the latent space.
MISSING = 1e-3
#: The decomposition is fitted on all windows of the corpus; together they weigh as so many passages, at most.
CORPUS = 8_192
#: Benchmark passages weigh this much more than corpus passages in the decomposition.
ITEM_WEIGHT = 8.0
#: Pairs of words whose sums a task holds at once (4 bytes each; a single block may have more), and those of a row of them.
PAIRS, PIECE = 1 << 25, 1 << 16
COSINE = 0.4
COVERED, ANSWERED, ANSWER_WORDS = 0.7, 0.6, 5


def _bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def token_bins(docs: DataFrame) -> np.ndarray:
    """Tokens of the whole corpus by bin of the word's hash (BINS numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(_bins(split_words(part.column("text"), lower=True).hash), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    summed = docs.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BINS)
    for at, n in summed:
        out[at] = n
    return out


def weights_of(counts: np.ndarray) -> np.ndarray:
    """Inverse-frequency weight by bin, 0 from one in STOP_SHARE tokens on."""
    total = max(counts.sum(), 1.0)
    return np.maximum(0.0, np.log(total / (counts + 1.0)) - np.log(STOP_SHARE)) + 1e-3


def item_passages(words: list[np.ndarray]) -> tuple[list[int], list[np.ndarray]]:
    """Place of the item and word hashes of every passage of items: windows that overlap, and the whole."""
    owners, found = [], []
    for i, own in enumerate(words):
        starts = [*range(0, len(own) - WINDOW, STRIDE), len(own) - WINDOW] if len(own) > WINDOW else []
        pieces = [*(own[at : at + WINDOW] for at in starts), own] if len(own) else []
        owners += [i] * len(pieces)
        found += pieces
    return owners, found


def answer_words(words: np.ndarray, idf: np.ndarray) -> list[int]:
    """The most telling words of a passage, the most telling first."""
    return sorted(set(words.tolist()), key=lambda h: (-idf[h >> 48], h))[:ANSWER_WORDS]


class Items:
    """A block of passages of benchmark items: vocabulary, TF-IDF rows, and what the final checks need."""

    def __init__(self, owners: list[int], words: list[np.ndarray], idf: np.ndarray):
        self.owners, self.words, self.idf = owners, words, idf
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        rows = np.zeros((len(words), len(self.vocabulary)), dtype=np.float32)
        weight = idf[_bins(self.vocabulary)] if len(self.vocabulary) else np.zeros(0)
        for i, w in enumerate(self.words):
            np.add.at(rows[i], np.searchsorted(self.vocabulary, w), 1.0)
        self.rows = rows * weight.astype(np.float32)
        self.norms = np.sqrt((self.rows**2).sum(axis=1)) + 1e-9
        self.answers = [set(answer_words(w, idf)) for w in self.words]


def known(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each word in the (sorted) vocabulary, -1 outside."""
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (word places) of the windows of all texts."""
    counts = words.counts
    each = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
    owner = np.repeat(np.arange(len(counts)), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    begin = words.first[owner] + nth * STRIDE
    return begin, np.minimum(begin + WINDOW, words.first[owner + 1])


def _repeats(words: Words, place: np.ndarray) -> np.ndarray:
    """For each known word (``place`` 0 or more), how often its text had it in the WINDOW places that end there: its count in any window is no more.  1 for others."""
    at = np.flatnonzero(place >= 0)
    name = words.text_of[at] * (int(place.max(initial=0)) + 1) + place[at]
    order = np.argsort(name, kind="stable")
    name, at = name[order], at[order]
    count = np.ones(len(at), dtype=np.int64)
    for back in range(1, min(WINDOW, len(at))):
        again = (name[back:] == name[:-back]) & (at[back:] - at[:-back] < WINDOW)
        if not again.any():
            break
        count[back:] += again
    out = np.ones(len(place), dtype=np.int64)
    out[at] = count
    return out


def add_pairs(words: Words, place: np.ndarray, square: np.ndarray, total: np.ndarray) -> None:
    """Adds to ``total`` (vocabulary x vocabulary) the pairs of known words of every window, each window's by one over the squared length
    of its TF-IDF row: the sum of its two triangles.  ``place`` has the words' places in the vocabulary, ``square`` its squared weights.

    A window is two halves of STRIDE words; a pair inside a half is met once for the two windows that share it.
    """
    at = np.flatnonzero(place >= 0)
    own, text, counts = place[at].astype(np.int64), words.text_of[at], words.counts
    windows = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
    # a text has a half more than windows: its last one begins none
    half = (np.cumsum(windows + 1) - windows - 1)[text] + (at - words.first[text]) // STRIDE
    halves = int((windows + 1).sum())

    weight = square[own]
    single, double = np.bincount(half, weight, minlength=halves), np.zeros(halves)
    for back in range(1, min(2 * STRIDE, len(own))):
        i = np.flatnonzero(own[back:] == own[:-back])
        i = i[half[i + back] - half[i] <= 1]
        same = half[i + back] == half[i]
        single += np.bincount(half[i[same]], 2 * weight[i[same]], minlength=halves)
        double += np.bincount(half[i[~same]], 2 * weight[i[~same]], minlength=halves)
    length = single + np.append(single[1:], 0.0) + double
    begins = np.ones(halves, dtype=bool)
    begins[np.cumsum(windows + 1) - 1] = False
    first = np.where(begins & (length > 0), 1.0 / np.maximum(length, 1e-30), 0.0)
    one, two = (x[half].astype(total.dtype) for x in (first, first + np.append(0.0, first[:-1])))
    flat, row = total.reshape(-1), own * len(total)
    np.add.at(flat, row + own, two / 2)
    for back in range(1, min(2 * STRIDE, len(own))):
        apart = half[back:] - half[:-back]
        i = np.flatnonzero(apart <= 1)
        if not len(i):
            break
        np.add.at(flat, row[i] + own[i + back], np.where(apart[i] == 0, two[i], one[i]))


def window_pairs(docs: DataFrame, blocks: list[Items]) -> DataFrame:
    """:func:`add_pairs` over all windows of all documents, summed by Spark: block, start, part (rows of its matrix from ``start`` on, whose columns begin there)."""
    sc = docs.sparkSession.sparkContext
    vocabulary = np.unique(np.concatenate([items.vocabulary for items in blocks]))
    shared = sc.broadcast((vocabulary, [(np.append(known(items.vocabulary, vocabulary), -1), items.idf[_bins(items.vocabulary)] ** 2) for items in blocks]))
    names = ["block", "start", "part"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, every = shared.value
        totals = [np.zeros((len(square), len(square)), dtype=np.float32) for _, square in every]
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"), lower=True)
                place = known(vocabulary, words.hash)
                for (places, square), total in zip(every, totals, strict=True):
                    add_pairs(words, places[place], square, total)
        for k, total in enumerate(totals):
            total += total.T.copy()
            step = max(1, PIECE // len(total))
            for start in range(0, len(total), step):
                piece = np.triu(total[start : start + step, start:])
                if piece.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([start]), pa.array([piece.tobytes()], pa.binary())], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, start, part in zip(*(batch.column(c) for c in range(3)), strict=True):
                piece, key = np.frombuffer(part.as_buffer(), np.float32), (k.as_py(), start.as_py())
                totals[key] = totals[key] + piece if key in totals else piece.astype(np.float64)
        for (k, start), piece in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([start]), pa.array([piece.astype(np.float32).tobytes()], pa.binary())], names=names)

    schema = "block long, start long, part binary"
    # a task's sums are as large as the blocks, however little it reads: a few tasks a core make them
    each = docs.select("text").coalesce(2 * sc.defaultParallelism).mapInArrow(tidy(pairs), schema)
    return cut(each.repartition("block", "start").mapInArrow(tidy(summed), schema))


def latent_bases(docs: DataFrame, blocks: list[Items], total_words: float, rank: int = RANK, seed: int = 3) -> list[np.ndarray]:
    """Of each block an orthonormal basis (vocabulary x rank, or more where the items need it) by a randomised decomposition of the TF-IDF rows of all the corpus's windows."""
    out, at = [], 0
    while at < len(blocks):
        some = [blocks[at]]
        while at + len(some) < len(blocks) and sum(len(x.vocabulary) ** 2 for x in [*some, blocks[at + len(some)]]) <= PAIRS:
            some.append(blocks[at + len(some)])
        pairs = window_pairs(docs, some)
        out += [_basis(pairs.where(F.col("block") == k).select("start", "part"), items, min(1.0, CORPUS / max(1.0, total_words / STRIDE)), rank, seed) for k, items in enumerate(some)]
        at += len(some)
    return out


def _basis(pairs: DataFrame, items: Items, share: float, rank: int, seed: int) -> np.ndarray:
    """:func:`latent_bases` of one block; ``share`` is what a window of the corpus weighs."""
    size = len(items.vocabulary)
    spark = pairs.sparkSession
    weight = items.idf[_bins(items.vocabulary)]

    def product(matrix: np.ndarray) -> np.ndarray:
        """(passages' transpose x passages) x matrix: the corpus's by Spark from the pairs of words, plus the items' part."""
        given = spark.sparkContext.broadcast((matrix * weight[:, None]).astype(np.float32))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            m = given.value
            out = np.zeros_like(m)
            for batch in batches:
                for start, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    piece = np.frombuffer(part.as_buffer(), np.float32).reshape(-1, size - start)
                    n = len(piece)
                    out[start : start + n] += piece @ m[start:]
                    # the other triangle, without the diagonal
                    out[start:] += np.concatenate([np.triu(piece[:, :n], 1), piece[:, n:]], axis=1).T @ m[start : start + n]
            if out.any():
                for start in range(0, size, 1024):
                    yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([out[start : start + 1024].tobytes()], pa.binary())], names=["start", "part"])

        rows = items.rows * (ITEM_WEIGHT / items.norms)[:, None]
        result = rows.T @ (rows @ matrix)
        for start, part in pairs.coalesce(8).mapInArrow(tidy(partial), "start long, part binary").toLocalIterator():
            block = np.frombuffer(part, np.float32).reshape(-1, matrix.shape[1])
            result[start : start + len(block)] += share * weight[start : start + len(block), None] * block
        given.destroy()
        return result

    width = min(size, rank + OVERSAMPLE)
    basis = np.random.default_rng(seed).standard_normal((size, width))
    for _ in range(POWERS):
        basis, _ = np.linalg.qr(product(basis))
    # order the directions by strength and keep the strongest
    strength, turn = np.linalg.eigh(basis.T @ product(basis))
    basis = basis @ turn[:, ::-1][:, : min(rank, size)]
    # what the strongest directions lack of the items
    rows = items.rows / items.norms[:, None]
    rest = rows - (rows @ basis) @ basis.T
    rest = rest[np.linalg.norm(rest, axis=1) > MISSING]
    if len(rest):
        _, strength, more = np.linalg.svd(rest, full_matrices=False)
        basis, _ = np.linalg.qr(np.hstack([basis, more[strength > MISSING / 2].T]))
    return basis.astype(np.float32)


def common_subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences (bit-parallel)."""
    places: dict[int, int] = {}
    for i, h in enumerate(item.tolist()):
        places[h] = places.get(h, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for h in region.tolist():
        match = places.get(h)
        if match:
            u = row & match
            row = (row + u | row - u) & full
    return len(item) - row.bit_count()


class Searcher:
    """Blocks of items with their latent rows, and short items by word; finds the items that texts contain."""

    def __init__(self, idf: np.ndarray, ids: list[int], blocks: list[tuple[Items, np.ndarray]], short: list[tuple[int, np.ndarray]] = ()):
        self.idf, self.ids = idf, ids
        #: of each looked up word the short items (place, words, answer words)
        self.short: dict[int, list[tuple[int, np.ndarray, set[int]]]] = {}
        for place, words in short:
            answer = answer_words(words, idf)
            for h in answer[: len(answer) - int(np.ceil(ANSWERED * len(answer) - 1e-9)) + 1]:
                self.short.setdefault(h, []).append((place, words, set(answer)))
        self.short_words = np.array(sorted(self.short), dtype=np.uint64)
        self.owners = [i for items, _ in blocks for i in items.owners]
        self.words = [w for items, _ in blocks for w in items.words]
        self.answers = [a for items, _ in blocks for a in items.answers]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[items.vocabulary for items, _ in blocks]]))
        #: of each block: place in its vocabulary by place in the common one (last: unknown), projection, latent rows
        self.blocks = []
        for items, basis in blocks:
            place = np.append(known(items.vocabulary, self.vocabulary), -1).astype(np.int32)
            projection = basis * idf[_bins(items.vocabulary)].astype(np.float32)[:, None] if len(items.vocabulary) else basis
            self.blocks.append((place, projection, (items.rows @ basis) / items.norms[:, None]))

    def norms(self, words: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Lengths of the TF-IDF rows of windows, repeated words counted together."""
        grid = begin[:, None] + np.arange(WINDOW)[None, :]
        inside = grid < end[:, None]
        h = np.sort(np.where(inside, words.hash[np.minimum(grid, len(words.hash) - 1)], np.uint64(0)), axis=1)
        weight = np.where(h > 0, self.idf[_bins(h)], 0.0)
        run = np.ones(h.shape, dtype=np.int64)
        for j in range(1, WINDOW):
            run[:, j] = np.where(h[:, j] == h[:, j - 1], run[:, j - 1] + 1, 1)
        # the r-th repeat adds (2r - 1) times the squared weight: r * r in all
        return np.sqrt((weight**2 * (2 * run - 1)).sum(axis=1)) + 1e-9

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, passage, cosine) of every window near a passage of an item."""
        begin, end = _windows(words)
        nothing = np.zeros(0, np.int64)
        if not len(begin) or not len(self.vocabulary):
            return nothing, nothing, nothing, np.zeros(0)
        place = known(self.vocabulary, words.hash)
        square = self.idf[_bins(words.hash)] ** 2
        # at least the window's squared length, and at most that of its known words
        total = np.concatenate(([0.0], np.cumsum(square)))
        square = square * (2 * _repeats(words, place) - 1)
        norm = np.zeros(len(begin))
        found, first = [], 0
        for places, projection, latent in self.blocks:
            own_place = places[place]
            shared = np.concatenate(([0.0], np.cumsum(np.where(own_place >= 0, square, 0.0))))
            heavy = np.flatnonzero((shared[end] - shared[begin]) >= COSINE**2 * (1 - 1e-6) * (total[end] - total[begin]))
            for at in range(0, len(heavy), 4096):
                some = heavy[at : at + 4096]
                b, e = begin[some], end[some]
                fresh = some[norm[some] == 0]
                norm[fresh] = self.norms(words, begin[fresh], end[fresh])
                vector = np.zeros((len(some), projection.shape[1]), dtype=np.float32)
                for j in range(WINDOW):
                    p = np.where(b + j < e, own_place[np.minimum(b + j, len(own_place) - 1)], -1)
                    own = np.flatnonzero(p >= 0)
                    vector[own] += projection[p[own]]
                near = vector @ latent.T / norm[some][:, None]
                w, i = np.nonzero(near >= COSINE)
                found.append((b[w], e[w], i + first, near[w, i]))
            first += len(latent)
        if not found:
            return nothing, nothing, nothing, np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def find(self, column: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(text, item, covered, answered, cosine) of the confirmed matches of a slice, one per text and item: its nearest confirmed passage's."""
        words = split_words(column, lower=True)
        begin, end, passage, cosine = self.candidates(words)
        owner = np.searchsorted(words.first, begin, "right") - 1
        done: dict[tuple[int, int], tuple] = {}
        for k in np.argsort(-cosine, kind="stable").tolist():
            name = (int(owner[k]), self.owners[passage[k]])
            if name in done:
                continue
            own = self.words[passage[k]]
            low = max(int(words.first[name[0]]), int(begin[k]) - len(own))
            region = words.hash[low : min(int(words.first[name[0] + 1]), int(end[k]) + len(own))]
            answer = self.answers[passage[k]]
            answered = len(answer.intersection(region.tolist())) / max(1, len(answer))
            if answered < ANSWERED:
                continue
            covered = common_subsequence(own, region) / len(own)
            if covered >= COVERED:
                done[name] = (*name, covered, answered, float(cosine[k]))
        self.find_short(words, done)
        return sorted(done.values())

    def find_short(self, words: Words, done: dict[tuple[int, int], tuple]) -> None:
        """Adds the confirmed matches of short items, each by the first place at which it is confirmed."""
        at = np.flatnonzero(known(self.short_words, words.hash) >= 0)
        for p, text in zip(at.tolist(), (np.searchsorted(words.first, at, "right") - 1).tolist(), strict=True):
            for item, own, answer in self.short[int(words.hash[p])]:
                if (text, item) in done:
                    continue
                region = words.hash[max(int(words.first[text]), p - len(own)) : min(int(words.first[text + 1]), p + 1 + len(own))]
                answered = len(answer.intersection(region.tolist())) / len(answer)
                if answered >= ANSWERED and (covered := common_subsequence(own, region) / len(own)) >= COVERED:
                    done[text, item] = (text, item, covered, answered, self.cosine(own, region))

    def cosine(self, a: np.ndarray, b: np.ndarray) -> float:
        """Cosine of the TF-IDF rows of two passages."""
        (x, n), (y, m) = (np.unique(w, return_counts=True) for w in (a, b))
        weight = lambda h, tf: tf * self.idf[_bins(h)]
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        u, v = weight(x, n), weight(y, m)
        return float((u[i] * v[j]).sum() / (np.sqrt((u**2).sum() * (v**2).sum()) + 1e-9))


class Benchmark:
    """The parts of a benchmark, each as a broadcast Searcher; what they share of the corpus is computed once."""

    def __init__(self, docs: DataFrame, items: DataFrame, blocks: int = BLOCKS):
        self.docs, self.items, self.block, self.most = docs, items, PASSAGES, PASSAGES * blocks
        counts = token_bins(docs)
        self.idf, self.total = weights_of(counts), float(counts.sum())

    def parts(self) -> Iterator[tuple]:
        """(ids, words) of items, of at most so many passages, or of one item that has more."""
        ids, words, size = [], [], 0
        for item, text in self.items.where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
            own = split_words(pa.array([text], pa.string()), lower=True).hash
            n = 1 if len(own) <= WINDOW else len(own) // STRIDE + 2
            if words and size + n > self.most:
                yield ids, words
                ids, words, size = [], [], 0
            ids.append(item)
            words.append(own)
            size += n
        if words:
            yield ids, words

    def searchers(self) -> Iterator:
        for ids, every in self.parts():
            short = [(i, w) for i, w in enumerate(every) if 0 < len(w) <= SHORT]
            owners, words = item_passages([w if len(w) > SHORT else w[:0] for w in every])
            blocks = [Items(owners[at : at + self.block], words[at : at + self.block], self.idf) for at in range(0, len(words), self.block)]
            bases = latent_bases(self.docs, blocks, self.total)
            yield self.docs.sparkSession.sparkContext.broadcast(Searcher(self.idf, ids, list(zip(blocks, bases, strict=True)), short))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", blocks: int = BLOCKS) -> DataFrame:
    """One row per document and benchmark item found in it: key, item_id, covered, answered, cosine."""
    rows = bare(docs, key, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def search(found) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id").to_pylist()
                    hits = found.value.find(part.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[h[0]] for h in hits], pa.int64()), pa.array([found.value.ids[h[1]] for h in hits], pa.int64()),
                            *[pa.array([h[c] for h in hits], pa.float64()) for c in (2, 3, 4)],
                        ],
                        names=["doc_id", "item_id", "covered", "answered", "cosine"],
                    )

        out = cut(rows.mapInArrow(tidy(run), "doc_id long, item_id long, covered double, answered double, cosine double"))
        found.destroy()
        return out

    out = None
    for found in Benchmark(rows, bare(benchmark, item_key, "text").toDF("item_id", "text"), blocks=blocks).searchers():
        part = search(found)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, covered double, answered double, cosine double")
    return out.withColumnRenamed("doc_id", key)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", benchmark_text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found; nothing is shuffled.

    Between the parts of a benchmark that has several, what is left is written to the shared folder.
    """
    place = docs.columns.index(text)

    def clean(rows: DataFrame, found) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = np.ones(batch.num_rows, dtype=bool)
                at = 0
                for part in slices(pa.RecordBatch.from_arrays([batch.column(place)], names=["text"]), "text"):
                    for hit in found.value.find(part.column(0)):
                        kept[at + hit[0]] = False
                    at += part.num_rows
                yield batch.filter(pa.array(kept))

        return rows.mapInArrow(tidy(run), docs.schema)

    items = bare(benchmark, item_key, benchmark_text).toDF("item_id", "text")
    last = None
    for found in Benchmark(bare(docs, text).toDF("text"), items, blocks=blocks).searchers():
        if last is not None:
            docs = cut(clean(docs, last))
            last.destroy()
        last = found
    return docs if last is None else clean(docs, last)
