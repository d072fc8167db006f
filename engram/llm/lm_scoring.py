"""Scores of whole texts under a gated recurrent language model, and under a unigram base (operator 6).

Tokens are lower-cased words and one end mark.  The training part of the corpus gives every token's count,
the base model, and the vocabulary of a class-factored output softmax: a word's class follows from its ending, the
end mark is a class of its own.  P(token) is P(class | state) P(slot | class, state): the ``SLOTS`` - 1 most frequent
words of a class have a slot each, driven by the state like the class itself; all other words of a class share its
last slot and go by their (smoothed) counts in it, an unseen token taking the slot's place for unseen ones.

The recurrent cell is gated and steps once per token: the state after all tokens so far predicts the next one, which
then is its input.  It is trained in numpy by back-propagation truncated
to ``WINDOW`` steps (more where few streams run on), over every training document once: in each of ``ROUNDS`` rounds every task starts
from the common weights, trains on its share of that round's documents, and Spark averages the tasks'
weights.  Documents are packed into parallel streams; the state is carried across windows to a document's
end and reset at its start, for training and for scoring alike.

Counts of frequent words (at most ``FREQUENT`` words can be that frequent) are broadcast; all others are
joined by shuffle, so nothing that grows with the vocabulary is held in one place.

Defined results: null and empty texts are the end mark alone; a null id belongs to the training part;
repeated rows count and are scored each; a very long text is scored whole, its state carried from window to window;
without training documents every token is unseen and the class
probabilities are equal; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparktools import Scratch, bare, cut, one_thread
from .words import Words, chunks, mix, slices, split_words

#: Words with at least 1 / FREQUENT of all training tokens have their counts broadcast.
FREQUENT = 1 << 20
#: Classes of endings and, last, the end mark's; slots of a class, the last for all words without one of their own.
CLASSES, SLOTS = 32, 64
ENDINGS, REST = CLASSES - 1, SLOTS - 1
#: Codes are class * SLOTS + slot; the last one stands for no token.
CODES = CLASSES * SLOTS
END_CODE = ENDINGS * SLOTS
WINDOW, STREAMS = 16, 512
#: A window has up to so many times WINDOW steps where few streams still run.
LONGER = 16
EMBED, HIDDEN = 8, 16
ROUNDS, RATE, SEED = 3, 0.01, 11
#: Damps the steps of weights that rarely have a gradient.
DAMP = 1e-3
#: Tokens that a task packs into streams at once.
HELD = 1 << 20
_TREE = 16


def ending_class(words: Words) -> np.ndarray:
    """Class (0 .. ENDINGS - 1) of each word by its last three bytes."""
    data, last = words.data, words.ends - 1
    code = np.zeros(len(last), dtype=np.uint64)
    for i in range(3):
        at = last - i
        byte = np.where(at >= words.starts, data[np.maximum(at, 0)], 0).astype(np.uint64) if len(last) else code
        code = code * np.uint64(256) + byte
    return (mix(code + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, ending class, count) of a task's texts."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h, kind, n = (np.concatenate(c) for c in zip(*held, strict=True))
        h, at, back = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind[at]), pa.array(np.bincount(back, weights=n).astype(np.int64))], names=["h", "ending", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"), lower=True)
            if len(words.hash):
                h, at, n = np.unique(words.hash, return_index=True, return_counts=True)
                held.append((h, ending_class(words)[at], n))
                size += len(h)
            if size > 2 * HELD:
                yield from chunks(flush())
                held, size = [], 0
    if held:
        yield from chunks(flush())


class Vocabulary:
    """Counts of the frequent words, their codes, and the denominators of both models."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, endings: np.ndarray, tokens: int, kinds: int, docs: int, mass: np.ndarray, types: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.endings = hashes[order], counts[order], endings[order]
        self.tokens, self.docs = tokens, docs
        self.base_total = tokens + 0.5 * (kinds + 1)
        # a class's most frequent words get its slots
        ranked = np.lexsort((self.hashes, -self.counts, self.endings))
        first = np.searchsorted(self.endings[ranked], np.arange(ENDINGS + 1))
        nth = np.arange(len(ranked)) - np.repeat(first[:-1], np.diff(first)) if len(ranked) else np.zeros(0, np.int64)
        self.codes = np.empty(len(ranked), dtype=np.int64)
        self.codes[ranked] = self.endings[ranked] * SLOTS + np.minimum(nth, REST)
        share = np.zeros((CLASSES, SLOTS))
        np.add.at(share.ravel(), self.codes[self.codes % SLOTS < REST], self.counts[self.codes % SLOTS < REST])
        rest_types = types.astype(float) - (share[:ENDINGS, :REST] > 0).sum(axis=1)
        share[:ENDINGS, REST] = mass - share[:ENDINGS, :REST].sum(axis=1)
        self.rest_total = share[:ENDINGS, REST] + 0.5 * (rest_types + 1)
        share[ENDINGS, 0] = docs
        classes = share.sum(axis=1)
        self.log_class = np.log((classes + 0.5) / (classes.sum() + 0.5 * CLASSES))
        self.log_slot = np.full((CLASSES, SLOTS), NEVER)
        for c in range(CLASSES):
            used = share[c] > 0
            used[0 if c == ENDINGS else REST] = True
            self.log_slot[c, used] = np.log((share[c, used] + 0.5) / (share[c, used] + 0.5).sum())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word among the frequent ones, -1 outside."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


_RARE = np.dtype([("h", np.int64), ("ending", np.int64), ("m", np.int64)])


def _encode(shared):
    """A row per document: its codes, sums over its frequent tokens, and its rare words (packed)."""
    schema = pa.schema([
        ("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
        ("base", pa.float64()), ("inner", pa.float64()), ("codes", pa.binary()), ("rare", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"), lower=True)
                distinct, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
                place = v.find(distinct)
                ending = ending_class(words)[at] if len(at) else np.zeros(0, np.int64)
                found = place >= 0
                count = np.where(found, v.counts[np.maximum(place, 0)] if len(v.counts) else 0, 0).astype(float)
                code = np.where(found, v.codes[np.maximum(place, 0)] if len(v.codes) else 0, ending * SLOTS + REST)
                base = np.where(found, np.log10((count + 0.5) / v.base_total), 0.0)
                inner = np.where(found & (code % SLOTS == REST), np.log10((count + 0.5) / v.rest_total[ending]), 0.0)
                a, b = words.first[:-1], words.first[1:]
                sums = [np.concatenate(([0.0], np.cumsum(x[back]))) for x in (base, inner, found)]
                base, inner, known = (x[b] - x[a] for x in sums)
                coded = code[back].astype(np.uint16)
                mark = np.array([END_CODE], dtype=np.uint16).tobytes()
                end = np.log10((v.docs + 0.5) / v.base_total)
                unknown = np.flatnonzero(~found[back])
                pairs, m = np.unique(words.text_of[unknown].astype(np.int64) * max(1, len(distinct)) + back[unknown], return_counts=True)
                rare = np.empty(len(pairs), dtype=_RARE)
                which, owner = pairs % max(1, len(distinct)), pairs // max(1, len(distinct))
                rare["h"], rare["ending"], rare["m"] = distinct[which].view(np.int64), ending[which], m
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("uid"), part.column("doc_id"), part.column("held_out"), pa.array(words.counts + 1, pa.int64()),
                        pa.array(known.astype(np.int64) + int(v.docs > 0)), pa.array(base + end), pa.array(inner),
                        pa.array([coded[i:j].tobytes() + mark for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()),
                        pa.array([rare[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


_ENCODED = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, codes binary, rare binary"


def _rare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, h, ending, m) of every rare word of a document."""
    for batch in batches:
        uid = np.asarray(batch.column("uid"))
        for at in range(0, batch.num_rows, 256):
            packed = [np.frombuffer(r, _RARE) for r in batch.column("rare").slice(at, 256).to_pylist()]
            rows = np.concatenate([np.zeros(0, _RARE), *packed])
            owner = np.repeat(uid[at : at + len(packed)], [len(r) for r in packed])
            yield from chunks(pa.RecordBatch.from_arrays([pa.array(owner), *[pa.array(np.ascontiguousarray(rows[c])) for c in _RARE.names]], names=["uid", *_RARE.names]))


# The recurrent model ------------------------------------------------------------------------------

#: Stands for the logarithm of 0 where a slot has no word.
NEVER = -30.0
_SHAPES = (
    ("embed", (CODES + 1, EMBED)), ("into", (EMBED, 3 * HIDDEN)), ("again", (HIDDEN, 3 * HIDDEN)), ("gate", (3 * HIDDEN,)),
    ("out", (HIDDEN, CLASSES)), ("lean", (CLASSES,)), ("inner", (CLASSES, HIDDEN, SLOTS)), ("inner_lean", (CLASSES, SLOTS)),
)
SIZE = sum(int(np.prod(s)) for _, s in _SHAPES)


def fresh_weights(log_class: np.ndarray, log_slot: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Weights that start from the unigram shares of classes and slots."""
    rng = np.random.default_rng(seed)
    given = {"lean": log_class, "inner_lean": log_slot}
    scale = {"gate": 0.0, "out": 0.05, "inner": 0.02, "embed": 0.3}
    parts = [given[name].ravel() if name in given else (rng.standard_normal(shape) * scale.get(name, 0.2)).ravel() for name, shape in _SHAPES]
    return np.concatenate(parts).astype(np.float32)


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES:
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    out["embed"][CODES] = 0.0  # stands for no token
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _softmax(logits: np.ndarray, picked: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each row's picked column; if asked for, the logits become the loss's slopes."""
    np.minimum(logits, 60.0, out=logits)  # far beyond what the cell can give; keeps the sums finite
    at = (np.arange(len(logits)), picked)
    own = logits[at]
    np.exp(logits, out=logits)
    norm = logits @ np.ones(logits.shape[1], np.float32)
    if learn:
        logits *= (1.0 / norm)[:, None]
        logits[at] -= 1.0
    return logits, own - np.log(norm)


def window_pass(w: dict[str, np.ndarray], ids: np.ndarray, begins: np.ndarray, state: np.ndarray, learn: bool):
    """One window of steps: log-probability of every step's token (steps x streams; 0 where none is), the state after
    it and, if asked for, the gradient of the summed negative log-probability."""
    steps, streams = ids.shape
    real = ids < CODES
    # what each token gives the gates, looked up
    drive = np.take(w["embed"] @ w["into"] + w["gate"], ids, axis=0)
    # a last entry of 1 in every state takes the leanings into the products
    hs = np.ones((steps, streams, HIDDEN + 1), np.float32)
    out = np.vstack((w["out"], w["lean"]))
    inner = np.concatenate((w["inner"], w["inner_lean"][:, None]), axis=1)
    keep = []
    h = state
    for t in range(steps):
        if begins[t].any():
            h = h * ~begins[t][:, None]
        hs[t, :, :HIDDEN] = h
        g = h @ w["again"]
        zr = _sigmoid(drive[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        gc = g[:, 2 * HIDDEN :]
        c = np.tanh(drive[t, :, 2 * HIDDEN :] + r * gc)
        on = real[t][:, None]
        if learn:
            keep.append((z, r, c, gc, on))
        h = np.where(on, c + z * (h - c), h)
    # tokens by class, so that a class's slots are one product
    place = np.flatnonzero(real.ravel())
    code = ids.ravel()[place]
    order = np.argsort((code // SLOTS).astype(np.uint8), kind="stable")
    place, code = place[order], code[order]
    kind, slot = code // SLOTS, code % SLOTS
    flat = np.take(hs.reshape(-1, HIDDEN + 1), place, axis=0)
    p, own = _softmax(flat @ out, kind, learn)
    bounds = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    grad = np.zeros(SIZE, np.float32) if learn else None
    if learn:
        d = _views(grad)
        both = flat.T @ p
        d["out"][...], d["lean"][...] = both[:HIDDEN], both[HIDDEN]
        dflat = p @ w["out"].T
    for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a == b or c == ENDINGS:  # the end mark is alone in its class
            continue
        hc = flat[a:b]
        q, inside = _softmax(hc @ inner[c], slot[a:b], learn)
        own[a:b] += inside
        if learn:
            both = hc.T @ q
            d["inner"][c], d["inner_lean"][c] = both[:HIDDEN], both[HIDDEN]
            dflat[a:b] += q @ w["inner"][c].T
    logp = np.zeros(steps * streams, np.float32)
    logp[place] = own
    logp = logp.reshape(steps, streams)
    if not learn:
        return logp, h, None
    dhs = np.zeros((steps * streams, HIDDEN), np.float32)
    dhs[place] = dflat
    dhs = dhs.reshape(steps, streams, HIDDEN)
    dh = np.zeros((streams, HIDDEN), np.float32)
    ddrive = np.empty((steps, streams, 3 * HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, c, gc, on = keep[t]
        up = dh * on
        dc = up * (1 - z) * (1 - c * c)
        before = hs[t, :, :HIDDEN]
        dz = up * (before - c) * z * (1 - z)
        dr = dc * gc * r * (1 - r)
        ddrive[t, :, :HIDDEN], ddrive[t, :, HIDDEN : 2 * HIDDEN], ddrive[t, :, 2 * HIDDEN :] = dz, dr, dc
        dg = np.concatenate((dz, dr, dc * r), axis=1)
        d["again"] += before.T @ dg
        dh = up * z + dh * ~on + dg @ w["again"].T + dhs[t]
        if begins[t].any():
            dh = dh * ~begins[t][:, None]
    flat_drive = ddrive.reshape(-1, 3 * HIDDEN)
    d["gate"][...] = flat_drive.sum(axis=0)
    # gradients of the tokens' inputs, summed by token
    tokens = ids.ravel().astype(np.uint16)
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    given, seen = np.add.reduceat(np.take(flat_drive, order, axis=0), first, axis=0), tokens[first]
    d["into"][...] = w["embed"][seen].T @ given
    d["embed"][seen] = given @ w["into"].T
    d["embed"][CODES] = 0.0
    return logp, h, grad


def pack(texts: list[np.ndarray], streams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid into streams, longest first into the emptiest: tokens (steps, streams), begin marks, each step's text
    (-1: none), and the streams' lengths, longest first, so that those still running always are the first ones."""
    import heapq

    heap = [(0, s) for s in range(streams)]
    put = []
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        used, s = heapq.heappop(heap)
        put.append((i, used, s))
        heapq.heappush(heap, (used + len(texts[i]), s))
    lengths = np.zeros(streams, dtype=np.int64)
    for used, s in heap:
        lengths[s] = used
    rank = np.argsort(-lengths, kind="stable")
    row = np.empty(streams, dtype=np.int64)
    row[rank] = np.arange(streams)
    steps = int(lengths.max())
    ids = np.full((steps, streams), CODES, dtype=np.int32)
    begins, owner = np.zeros((steps, streams), dtype=bool), np.full((steps, streams), -1, dtype=np.int32)
    for i, used, s in put:
        at = slice(used, used + len(texts[i]))
        ids[at, row[s]] = texts[i]
        begins[used, row[s]] = True
        owner[at, row[s]] = i
    return ids, begins, owner, lengths[rank]


def _streams_for(texts: list[np.ndarray]) -> int:
    """Fewer streams for little text, so that it still gives enough updates."""
    return int(np.clip(sum(map(len, texts)) // (WINDOW * 40), 16, STREAMS))


def _running(lengths: np.ndarray, at: int) -> int:
    """Streams that have a step ``at``."""
    return int(np.searchsorted(-lengths, -at, "left"))


def _window_end(n: int, streams: int, at: int, steps: int) -> int:
    """End of the window from ``at`` on, in which n of the streams run: the fewer they are, the more steps, so that its
    cost is spread over as many tokens."""
    return min(steps, at + WINDOW * min(LONGER, max(1, streams // n)))


def train_texts(flat: np.ndarray, texts: list[np.ndarray], rate: float) -> np.ndarray:
    """One pass of truncated back-propagation (Adam) over the texts, from and to flat weights.

    Windows give their gradients to a step once it has half the tokens of a full window, so the rest of one long text,
    alone in its window, doesn't move the weights by a few tokens at a time.
    """
    flat = flat.copy()
    ids, begins, _, lengths = pack(texts, _streams_for(texts))
    state = np.zeros((ids.shape[1], HIDDEN), np.float32)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    total, tokens, k = np.zeros_like(flat), 0, 0
    at = 0
    while at < len(ids):
        n = _running(lengths, at)
        upto = _window_end(n, ids.shape[1], at, len(ids))
        part = ids[at:upto, :n]
        _, state, grad = window_pass(_views(flat), part, begins[at:upto, :n], state[:n], True)
        at = upto
        total += grad
        tokens += int((part < CODES).sum())
        if 2 * tokens >= WINDOW * ids.shape[1] or at == len(ids):
            k += 1
            total /= max(1, tokens)
            m += 0.1 * (total - m)
            total *= total
            v += 0.01 * (total - v)
            flat -= (rate / (1 - 0.9**k)) * m / (np.sqrt(v / (1 - 0.99**k)) + DAMP)
            total[:], tokens = 0.0, 0
    return flat


def _train_task(weights, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        flat, seen = weights.value, 0
        texts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for raw in batch.column("codes").to_pylist():
                texts.append(np.frombuffer(raw, np.uint16))
                held += len(texts[-1])
                if held > HELD:
                    flat, seen, texts, held = train_texts(flat, texts, rate), seen + held, [], 0
        if held:
            flat, seen = train_texts(flat, texts, rate), seen + held
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], names=["seen", "flat"])

    return run


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    total = rows["seen"].sum()
    flat = sum(np.frombuffer(f, np.float32).astype(np.float64) * (s / total) for f, s in zip(rows["flat"], rows["seen"], strict=True))
    return pd.DataFrame({"seen": [total], "flat": [flat.astype(np.float32).tobytes()]})


def fit(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Weights trained on every training text once; tasks' weights are averaged in Spark after each round."""
    sc = encoded.sparkSession.sparkContext
    flat = fresh_weights(vocabulary.log_class, vocabulary.log_slot)
    train = encoded.where("NOT held_out").select("uid", "codes")
    for k in range(rounds):
        share = train.where(F.pmod(F.xxhash64("uid"), F.lit(rounds)) == k).select("codes")
        given = sc.broadcast(flat)
        tasks = share.mapInArrow(_train_task(given, rate / (1 + k)), "seen double, flat binary")
        grouped = tasks.withColumn("branch", F.pmod(F.xxhash64("flat"), F.lit(_TREE))).groupBy("branch").applyInPandas(_average, "seen double, flat binary")
        done = grouped.collect()  # at most _TREE rows
        given.destroy()
        if done:
            flat = np.frombuffer(_average(pd.DataFrame(done, columns=["seen", "flat"]))["flat"][0], np.float32).copy()
    return flat


def text_scores(flat: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text's codes, state carried through the whole text."""
    w = _views(flat.copy())
    ids, begins, owner, lengths = pack(texts, min(len(texts), _streams_for(texts)))
    state = np.zeros((ids.shape[1], HIDDEN), np.float32)
    out = np.zeros(len(texts))
    at = 0
    while at < len(ids):
        n = _running(lengths, at)
        upto = _window_end(n, STREAMS, at, len(ids))
        logp, state, _ = window_pass(w, ids[at:upto, :n], begins[at:upto, :n], state[:n], False)
        own = owner[at:upto, :n].ravel()
        some = own >= 0
        out += np.bincount(own[some], weights=logp.ravel()[some].astype(np.float64), minlength=len(texts))
        at = upto
    return out / np.log(10)


_SCORED = ("uid", "doc_id", "held_out", "n_tokens", "known", "base", "inner")


def _score_task(weights):
    """A document's row with its score in place of its codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        kept: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(text_scores(weights.value, texts))], names=[*_SCORED, "outer"])

        for batch in batches:
            codes = batch.column("codes")
            begin = 0
            for i, size in enumerate(np.diff(np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]).tolist()):
                held += size // 2
                if held > HELD or i == batch.num_rows - 1:
                    texts += [np.frombuffer(raw, np.uint16) for raw in codes.slice(begin, i + 1 - begin).to_pylist()]
                    kept.append(batch.select(list(_SCORED)).slice(begin, i + 1 - begin))
                    begin = i + 1
                if held > HELD:
                    yield flush()
                    kept, texts, held = [], [], 0
        if texts:
            yield flush()

    return run


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = bare(docs, key, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_fold, F.lit(False))
    rows = rows.withColumn("held_out", held)
    with Scratch(spark) as scratch:
        train = rows.where("NOT held_out")
        counts = train.select("text").mapInArrow(_word_counts, "h long, ending long, n long").groupBy("h", "ending").agg(F.sum("n").alias("n"))
        counts = scratch.save(counts)
        per_class = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()  # one row per ending class
        mass, types = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for ending, n, k in per_class:
            mass[ending], types[ending] = n, k
        n_docs = train.count()
        tokens, kinds = int(mass.sum()) + n_docs, int(types.sum()) + (n_docs > 0)
        floor = max(1, -(-tokens // FREQUENT))
        frequent = counts.where(F.col("n") >= floor).toPandas()  # at most FREQUENT rows, by the floor
        v = Vocabulary(frequent["h"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64), frequent["ending"].to_numpy(np.int64), tokens, kinds, n_docs, mass, types)
        shared = spark.sparkContext.broadcast(v)
        encoded = scratch.save(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_encode(shared), _ENCODED))
        shared.destroy()
        given = spark.sparkContext.broadcast(fit(encoded, v))
        scored = encoded.select(*_SCORED, "codes").mapInArrow(_score_task(given), "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, outer double")
        totals = F.element_at(F.array(*[F.lit(float(t)) for t in v.rest_total]), (F.col("ending") + 1).cast("int"))
        c = F.coalesce(F.col("n"), F.lit(0)) + 0.5
        rare = encoded.where("length(rare) > 0").select("uid", "rare").mapInArrow(_rare_rows, "uid long, h long, ending long, m long")
        rare = rare.join(counts.select("h", "n"), "h", "left").groupBy("uid").agg(
            F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("r_known"),
            F.sum(F.col("m") * F.log10(c / v.base_total)).alias("r_base"),
            F.sum(F.col("m") * F.log10(c / totals)).alias("r_inner"),
        )
        out = scored.join(rare, "uid", "left").select(
            F.col("doc_id").alias(key), "held_out", "n_tokens",
            (F.col("known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"),
            (F.col("outer") + F.col("inner") + F.coalesce("r_inner", F.lit(0.0))).alias("score"),
        )
        out = cut(out)
        given.destroy()
        return out
