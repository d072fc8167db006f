"""Quality classifier from weak labels (operator 10).

Overlapping heuristic labellers vote on every document: bad, good or nothing.  Where a table of reviewed
labels is given, it is one more labeller, and its documents' classes are held at what it says.  All documents' votes are counted by pattern, and
expectation-maximisation over the patterns estimates each labeller's chance of each vote for good and for
bad documents (Dawid and Skene's model, abstention being a third vote).  The posterior of a pattern is the
soft label of its documents; on a bounded sample of documents (``SAMPLE``, chosen by a hash of the row) it
trains a linear scorer over hashed words, word beginnings and text-shape buckets (logistic loss, follow
the regularised leader with an L1 term).  The scorer judges every whole text.

One labeller's lexicon is learnt, since abuse has other words in every language: from at most about
``LEXICON_LABELS`` reviewed documents, the word beginnings that stand, or stand densely, in toxic ones only, as
far as that can't be chance among all beginnings tested.  Copies and near copies, documents that share all minima of a band of
hashes of their word triples, count once for it: the one of the smallest id.

Defined results: null or empty texts have no features but the shape of an empty text and are judged like
any other row; rows are judged alone, so repeated rows and null ids each get their own (equal) judgement;
reviewed labels that contradict each other count as bad; without documents nothing is returned; filters
keep all columns of the input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparktools import Scratch, bare, cut, tidy
from .words import Words, _hash_words, mix, range_sums, slices, split_words, window_hashes

#: Abusive words of the lexicon labeller.
ABUSE = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()

SAMPLE = 20_000
#: Passes over the sample; rows and bytes of features that one task learns from, at most about.
EPOCHS, PART_ROWS, PART_BYTES = 6, 2_500, 32 << 20
#: Reviewed documents that the learnt lexicon is drawn from, at most about; lengths (bytes) of its word
#: beginnings; share of toxic documents among those that have one; the chance of a wrong entry; its entries.
LEXICON_LABELS, STEMS, PURE, CHANCE, ENTRIES = 10_000, (4, 5, 6), 0.98, 0.01, 4096
#: A beginning is dense in a text that has it twice or more, and once in so many words.
DENSE = 128
#: Bands of minima that tell near copies among those documents, minima in a band, words in a row that are hashed.
BANDS, BAND, SHINGLE = 6, 5, 3
DIMENSIONS = 1 << 18
PREFIX = 6
#: Documents whose score (log-odds of being good) is below this are rejected.
THRESHOLD = 0.0
#: How far a reviewed label is trusted; documents that have one keep it in the estimation.
TRUST = 0.98
GOOD, BAD, ABSTAIN = 1, 2, 0

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 ASCII letter, 2 other symbol, 3 digit, 4 beyond ASCII
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = 2
_CLASS[[c for c in range(0x80) if chr(c).isalpha()]] = 1
_CLASS[0x30:0x3A] = 3
_CLASS[0x80:] = 4
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".,;:?"])


def _abuse_hashes() -> np.ndarray:
    words = split_words(pa.array([" ".join(ABUSE)]))
    return np.sort(words.hash)


_ABUSIVE = _abuse_hashes()


def _dense(h: np.ndarray) -> np.ndarray:
    """Name of the item that says that a word beginning is dense in a text."""
    return (mix(h.astype(np.uint64) + np.uint64(1 << 40)) >> np.uint64(32)).astype(np.uint32)


def _is_dense(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (count >= 2) & (count * DENSE >= words)


def _learnt(words: Words, beginnings: list[np.ndarray], stems: np.ndarray) -> np.ndarray:
    """How many words of each text have a learnt beginning, or one that is learnt as dense and is dense there."""
    def among(h: np.ndarray) -> np.ndarray:
        return stems[np.minimum(np.searchsorted(stems, h), len(stems) - 1)] == h

    any_word, dense = np.zeros(len(words.hash), dtype=bool), np.zeros(len(words.counts), dtype=np.int64)
    owner = words.text_of
    for h in beginnings:
        h = (h >> np.uint64(32)).astype(np.uint32)
        any_word |= among(h)
        at = np.flatnonzero(among(_dense(h)))
        pairs, n = np.unique(owner[at].astype(np.int64) << 32 | h[at], return_counts=True)
        text = pairs >> 32
        some = _is_dense(n, words.counts[text])
        np.add.at(dense, text[some], n[some])
    return range_sums(any_word, words.first) + dense


class Shape:
    """Measures of each text of a slice, as one float array per name."""

    def __init__(self, column: pa.Array, stems: np.ndarray | None = None):
        self.words = words = split_words(column, lower=True)
        raw = split_words(column, hashes=False)
        data, texts = raw.data, raw.text_offsets
        kind = _CLASS[data]
        count = np.maximum(words.counts, 1).astype(np.float64)
        ascii_letters = range_sums(kind == 1, texts)
        visible = np.maximum(range_sums(kind > 0, texts), 1)
        upper = range_sums((data >= 0x41) & (data <= 0x5A), texts)
        last = kind[raw.ends - 1] if len(raw.ends) else np.zeros(0, np.uint8)
        same = np.zeros(len(words.hash), dtype=bool)
        if len(same) > 1:
            same[1:] = words.hash[1:] == words.hash[:-1]
        inside = words.first[:-1]
        same[inside[inside < len(same)]] = False
        # words without the punctuation at their end, for the lexicon
        stop = raw.ends.copy()
        for _ in range(3):
            trim = (stop > raw.starts) & ((_CLASS[data[stop - 1]] == 2) | (_CLASS[data[stop - 1]] == 0)) if len(stop) else np.zeros(0, bool)
            stop[trim] -= 1
        bare_words = _hash_words(words.data, words.starts, stop)
        at = np.searchsorted(_ABUSIVE, bare_words)
        abusive = _ABUSIVE[np.minimum(at, len(_ABUSIVE) - 1)] == bare_words
        self.beginnings = [_hash_words(words.data, words.starts, np.minimum(words.starts + n, words.ends)) for n in STEMS]
        self.learnt = _learnt(words, self.beginnings, stems) if stems is not None and len(stems) else np.zeros(len(words.counts), np.int64)
        self.n = words.counts
        self.symbols = range_sums(kind == 2, texts) / visible
        self.capitals = upper / np.maximum(ascii_letters, 1)
        self.repeated = range_sums(same, words.first) / count
        self.decorated = range_sums(last == 2, words.first) / count
        self.pipes = range_sums(data == 0x7C, texts) / count
        self.shouts = range_sums(data == 0x21, texts) / count
        self.stops = range_sums(_ENDS[data[raw.ends - 1]] if len(raw.ends) else last == 9, words.first) / count
        self.abuse = range_sums(abusive, words.first)
        self.distinct = np.array([len(np.unique(words.hash[a:b])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]) / count


LABELLERS = ("symbols", "capitals", "repeated", "few distinct words", "table", "shouting", "decorated words", "abuse", "learnt abuse", "prose", "reviewed")


def votes(shape: Shape, reviewed: np.ndarray) -> np.ndarray:
    """Votes (texts x labellers) of 0 nothing, 1 good, 2 bad; ``reviewed`` is the last labeller's column."""
    def bad(mark: np.ndarray) -> np.ndarray:
        return np.where(mark, BAD, ABSTAIN)

    some = shape.n >= 5
    prose = (shape.symbols < 0.03) & (shape.capitals < 0.3) & (shape.repeated < 0.1) & (shape.stops < 0.5) & ((shape.distinct > 0.3) | (shape.n > 2000))
    return np.stack(
        [
            bad(some & (shape.symbols > 0.1)), bad(some & (shape.capitals > 0.4)), bad(some & (shape.repeated > 0.2)),
            bad((shape.n >= 50) & (shape.distinct < 0.25) & (shape.repeated > 0.05)), bad(some & (shape.pipes > 0.1)), bad(some & (shape.shouts > 0.15)),
            bad(some & (shape.decorated > 0.3)), bad(shape.abuse > 0), bad(shape.learnt > 0), np.where(prose & (shape.abuse == 0) & (shape.learnt == 0), GOOD, ABSTAIN), reviewed,
        ],
        axis=1,
    ).astype(np.uint8)


def patterns(ballots: np.ndarray) -> np.ndarray:
    """One number per row of votes, base 3."""
    return ballots.astype(np.int64) @ (3 ** np.arange(ballots.shape[1], dtype=np.int64))


def estimate_labellers(pattern: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for every pattern, the vote chances (labeller, class, vote), and the share of good."""
    ballots = (pattern[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    onehot = np.stack([ballots == v for v in range(3)], axis=2).astype(float)
    against, favour = (ballots == BAD).sum(axis=1), (ballots == GOOD).sum(axis=1)
    reviewed = ballots[:, -1]
    known = np.where(reviewed == BAD, 1 - TRUST, TRUST)
    good = np.where(reviewed != ABSTAIN, known, np.where(against > 0, 0.1, np.where(favour > 0, 0.95, 0.6)))
    for _ in range(rounds):
        share = np.clip((good * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3)
        chances = []
        for weight in ((1 - good) * counts, good * counts):
            tally = np.einsum("p,plv->lv", weight, onehot) + 0.5
            chances.append(tally / tally.sum(axis=1, keepdims=True))
        table = np.log(np.stack(chances, axis=1))
        odds = np.log(share / (1 - share)) + np.einsum("plv,lv->p", onehot, table[:, 1] - table[:, 0])
        fresh = np.where(reviewed != ABSTAIN, known, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        if np.abs(fresh - good).max() < 1e-6:
            break
        good = fresh
    return good, np.exp(table), float(share)


def features(shape: Shape, chosen: np.ndarray | None = None) -> list[np.ndarray]:
    """Distinct hashed features of each text (or of the chosen ones): words, beginnings of longer words, buckets of the shape."""
    words = shape.words
    starts = shape.beginnings[STEMS.index(PREFIX)]
    low = (words.hash & np.uint64(DIMENSIONS - 1)).astype(np.int32)
    high = ((starts >> np.uint64(20)) & np.uint64(DIMENSIONS - 1)).astype(np.int32)
    buckets = np.stack(
        [np.minimum(15, (np.maximum(v, 0) * 20).astype(np.int64)) for v in (shape.symbols, shape.capitals, shape.repeated, shape.decorated, shape.pipes, shape.shouts, shape.stops, shape.distinct)]
        + [np.minimum(15, shape.abuse.astype(np.int64)), np.minimum(15, shape.learnt.astype(np.int64)), np.array([int(n).bit_length() for n in shape.n]) % 16],
        axis=1,
    )
    buckets = ((np.arange(buckets.shape[1]) * 16 + buckets + 1) * 7919 % DIMENSIONS).astype(np.int32)
    rows = range(len(shape.n)) if chosen is None else chosen.tolist()
    spans = [(int(words.first[i]), int(words.first[i + 1]), buckets[i]) for i in rows]
    return [np.unique(np.concatenate((low[a:b], high[a:b], row))) for a, b, row in spans]


class Learner:
    """State of a logistic scorer with soft labels that follows the regularised leader (L1 and L2 terms)."""

    RATE, L1, L2 = 0.3, 1.0, 1.0

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None, bias: float = 0.0):
        self.z = np.zeros(DIMENSIONS) if z is None else z.astype(np.float64)
        self.n = np.zeros(DIMENSIONS) if n is None else n.astype(np.float64)
        self.bias = bias

    def _lean(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.L1, 0.0, -(z - np.sign(z) * self.L1) / ((1.0 + root) / self.RATE + self.L2))

    def learn(self, rows: list[np.ndarray], soft: np.ndarray, seed: int) -> None:
        """One pass over the rows, in an order that the seed fixes."""
        for i in np.random.default_rng(seed).permutation(len(rows)).tolist():
            f = rows[i]
            z, n = self.z[f], self.n[f]
            w = self._lean(z, np.sqrt(n))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -30, 30))) - soft[i]
            self.z[f] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.RATE * w
            self.n[f] = n + g * g
            self.bias -= 0.02 * g

    def weights(self) -> np.ndarray:
        return self._lean(self.z, np.sqrt(self.n)).astype(np.float32)


def _learn(given, seed: int):
    """What each part's rows, which come one part after the other, change of the common state: places, changes, and the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n, bias = given.value
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            own = Learner(z, n, bias)
            own.learn([np.frombuffer(f, np.int32) for f in rows["f"].to_pylist()], rows["soft"].to_numpy(), seed + rows["part"][0].as_py())
            at = np.flatnonzero(own.n != n)
            change = [at.astype(np.int32), (own.z[at] - z[at]).astype(np.float32), (own.n[at] - n[at]).astype(np.float32)]
            return pa.RecordBatch.from_arrays([*[pa.array([c.tobytes()], pa.binary()) for c in change], pa.array([float(own.bias - bias)]), pa.array([1], pa.int32())], names=["at", "z", "n", "bias", "parts"])

        for batch in batches:
            part = np.asarray(batch.column("part"))
            ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)).tolist()
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                if begin == end:
                    continue
                if held and held[0].column("part")[0].as_py() != part[begin]:
                    yield flush()
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield flush()

    return run


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """Mean change of every place over the parts that changed it."""
    z, n, had = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for r in group.sort_values("at").itertuples():
        at = np.frombuffer(r.at, np.int32)
        z[at] += np.frombuffer(r.z, np.float32)
        n[at] += np.frombuffer(r.n, np.float32)
        had[at] += 1
    had = np.maximum(had, 1)
    return pd.DataFrame({"z": [(z / had).astype(np.float32).tobytes()], "n": [(n / had).astype(np.float32).tobytes()], "bias": [group["bias"].sum() / len(group)]})


def train(rows: DataFrame, epochs: int = EPOCHS, seed: int = 5) -> Learner:
    """Trains on rows (f: features as bytes, soft) in tasks.

    Rows are dealt, once, by a hash of their features to parts of bounded rows and bytes, written part by part, and in every
    epoch each part is read and learns from the common state; a feature's change is the mean over the parts that have it.  The parts' changes, sparse, are
    joined in Spark; the driver gets one state of fixed size.
    """
    spark = rows.sparkSession
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("f")), F.lit(0))).head()
    parts = max(1, -(-count // PART_ROWS), -(-size // PART_BYTES))
    part = F.pmod(F.xxhash64("f"), F.lit(parts)).cast("int")
    learner = Learner()
    with Scratch(spark) as scratch:
        dealt = scratch.save(rows.select(part.alias("part"), "f", "soft").repartition(parts, "part").sortWithinPartitions("part", "f", "soft"))
        for epoch in range(epochs):
            given = spark.sparkContext.broadcast((learner.z.astype(np.float32), learner.n.astype(np.float32), learner.bias))
            changes = dealt.mapInArrow(_learn(given, seed + 1000 * epoch), "at binary, z binary, n binary, bias double, parts int")
            # one group of at most ``parts`` sparse states, a number that the sample bounds
            moved = changes.groupBy("parts").applyInPandas(_joined, "z binary, n binary, bias double").head()
            given.destroy()
            if moved is None:
                break
            learner = Learner(learner.z + np.frombuffer(moved.z, np.float32), learner.n + np.frombuffer(moved.n, np.float32), learner.bias + moved.bias)
    return learner


def _reviews(labels: DataFrame) -> DataFrame:
    """(label_id, reviewed): the labels' vote on each document that has one."""
    vote = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), BAD).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), GOOD).otherwise(ABSTAIN)
    return bare(labels, "doc_id", "quality", "toxic").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(vote).alias("reviewed"))


class Scorer:
    """A fitted weak-label model and its linear scorer."""

    def __init__(self, weights: np.ndarray, bias: float, chances: np.ndarray, share: float, posterior: dict[int, float], stems: np.ndarray | None = None):
        self.weights, self.bias, self.chances, self.share, self.posterior, self.stems = weights, bias, chances, share, posterior, stems

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.array([self.weights[f].sum(dtype=np.float64) + self.bias for f in features(Shape(column, self.stems))])


def _band_keys(hashes: np.ndarray) -> np.ndarray:
    """One number per band of a text's (word hashes) shingle minima, and one for all of them."""
    shingles = window_hashes(hashes, min(SHINGLE, len(hashes)))
    lows = [mix(shingles ^ np.uint64(salt)).min() for salt in range(1, BANDS * BAND + 1)]
    out = np.zeros(BANDS + 1, dtype=np.uint64)
    for k, low in enumerate(lows):
        for at in (k // BAND, BANDS):
            out[at : at + 1] = mix(out[at : at + 1] ^ low)
    return out.view(np.int64)


def single_documents(rows: DataFrame) -> DataFrame:
    """One of each group of copies and near copies (id, toxic, keys, stems), at most about LEXICON_LABELS rows."""
    whole = cut(rows.groupBy(F.element_at("keys", -1).alias("copy")).agg(F.min(F.struct("id", "toxic", "keys", "stems")).alias("r")).select("copy", "r.*"))
    banded = whole.select(F.struct("id", "copy").alias("own"), F.posexplode(F.slice("keys", 1, BANDS)).alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("own").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = banded.join(F.broadcast(shared), ["band", "key"]).where("own > least").select("own.copy").distinct()
    return whole.join(F.broadcast(later), "copy", "left_anti")


def _items(begins: list[np.ndarray]) -> np.ndarray:
    """Word beginnings of a text, and the names of those that are dense in it."""
    out = []
    for h in begins:
        stem, n = np.unique(h, return_counts=True)
        out += [stem, _dense(stem[_is_dense(n, np.int64(len(h)))])]
    return np.unique(np.concatenate(out))


def learn_stems(docs: DataFrame, labels: DataFrame, labelled: int = LEXICON_LABELS) -> np.ndarray:
    """Sorted hashes of word beginnings (docs: id, text) that mark toxic documents."""
    said = bare(labels, "doc_id", "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    lot = max(1, -(-said.count() // labelled))
    said = said.where(F.pmod(F.xxhash64("label_id"), F.lit(lot)) == 0)  # at most about ``labelled`` rows of two numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"), lower=True)
                begins = [(_hash_words(words.data, words.starts, np.minimum(words.starts + n, words.ends)) >> np.uint64(32)).astype(np.uint32) for n in STEMS]
                some = np.flatnonzero(words.counts > 0)
                spans = [(int(words.first[i]), int(words.first[i + 1])) for i in some]
                keys = [_band_keys(words.hash[a:b]).tolist() for a, b in spans]
                stems = [_items([h[a:b] for h in begins]).tobytes() for a, b in spans]
                own = [part.column(c).take(pa.array(some)) for c in ("id", "toxic")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.list_(pa.int64())), pa.array(stems, pa.binary())], names=["id", "toxic", "keys", "stems"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b, np.uint32) for b in batch.column("stems").to_pylist()]
            toxic = np.repeat(np.asarray(batch.column("toxic")), [len(f) for f in found])
            stem, back = np.unique(np.concatenate([*found, np.zeros(0, np.uint32)]), return_inverse=True)
            n, bad = np.bincount(back, minlength=len(stem)), np.bincount(back, weights=toxic, minlength=len(stem))
            yield pa.RecordBatch.from_arrays([pa.array(stem.astype(np.int64)), pa.array(n), pa.array(bad.astype(np.int64))], names=["stem", "n", "bad"])

    near = docs.join(F.broadcast(said), F.col("id") == F.col("label_id")).select("id", "text", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"))
    single = cut(single_documents(near.mapInArrow(rows, "id long, toxic int, keys array<long>, stems binary")))
    total, toxic = single.agg(F.count("*"), F.sum("toxic")).head()
    if not toxic or toxic == total:
        return np.zeros(0, np.uint32)
    counts = cut(single.select("toxic", "stems").mapInArrow(each, "stem long, n long, bad long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    # n times the divergence of the share among the stem's documents from the overall share bounds the chance
    share, overall = F.col("bad") / F.col("n"), toxic / total
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - overall))).otherwise(0.0)
    evidence = F.col("n") * (share * F.log(share / overall) + other)
    least = float(np.log(max(1, counts.count()) / CHANCE))
    chosen = counts.where(share >= PURE).where(evidence > least).orderBy(evidence.desc(), "stem").limit(ENTRIES)
    return np.sort(np.array([r.stem for r in chosen.collect()], dtype=np.uint32))


def fit(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Scorer:
    """Fits on the votes of all documents and on a sample of at most about ``sample`` texts.

    One pass over the texts gives every document's votes and the sampled documents' features.
    """
    rows = bare(docs, key, text).toDF("id", "text")
    cast = rows.select(F.col("id").cast("long").alias("id"), "text")
    stems = np.zeros(0, np.uint32) if labels is None else learn_stems(cast, labels)
    lot = max(1, -(-rows.count() // sample))

    def vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                shape = Shape(part.column("text"), stems)
                found = patterns(votes(shape, np.zeros(part.num_rows, np.uint8)))
                chosen = np.flatnonzero(np.asarray(part.column("chosen").to_numpy(zero_copy_only=False)))
                own: list[bytes | None] = [None] * part.num_rows
                for i, f in zip(chosen.tolist(), features(shape, chosen), strict=True):
                    own[i] = f.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found), pa.array(own, pa.binary())], names=["id", "pattern", "f"])

    picked = cast.withColumn("chosen", F.pmod(F.xxhash64("id", "text", F.lit(1)), F.lit(lot)) == 0)
    with Scratch(docs.sparkSession) as scratch:
        # votes first, so that only ids and votes meet the labels in a shuffle
        voted = scratch.save(picked.mapInArrow(vote_rows, "id long, pattern long, f binary"))
        if labels is not None:
            said = voted.join(_reviews(labels), F.col("id") == F.col("label_id"), "left")
            voted = scratch.save(said.select((F.col("pattern") + F.coalesce("reviewed", F.lit(ABSTAIN)) * 3 ** (len(LABELLERS) - 1)).alias("pattern"), "f"))
        tally = voted.groupBy("pattern").count().collect()  # at most 3 ** labellers rows
        if not tally:
            return Scorer(np.zeros(DIMENSIONS, np.float32), 0.0, np.zeros((len(LABELLERS), 2, 3)), 0.5, {})
        pattern, counts = np.array([r[0] for r in tally]), np.array([r[1] for r in tally], dtype=float)
        good, chances, share = estimate_labellers(pattern, counts)
        posterior = dict(zip(pattern.tolist(), good.tolist(), strict=True))
        soft = docs.sparkSession.createDataFrame(list(posterior.items()), "pattern long, soft double")  # as small as the tally
        learner = train(voted.where("f IS NOT NULL").join(F.broadcast(soft), "pattern").select("f", "soft"))
    return Scorer(learner.weights(), learner.bias, chances, share, posterior, stems)


def score_documents(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: key, score (log-odds of good), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = shared.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores), pa.array(scores >= threshold)], names=["id", "score", "kept"])

    rows = bare(docs, key, text).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(tidy(run), "id long, score double, kept boolean").withColumnRenamed("id", key)


def keep_good(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the scorer accepts, all columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [shared.value.scores(part.column(0)) >= threshold for part in slices(pa.RecordBatch.from_arrays([batch.column(place)], names=["text"]), "text")]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))

    return docs.mapInArrow(tidy(run), docs.schema)
