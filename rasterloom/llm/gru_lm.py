"""Scoring by a gated recurrent language model in numpy, with a class-factored output.

Word counts of all learning texts come from one aggregation. From them follow, whatever the corpus: the most frequent
words (the output vocabulary), which fall into classes of equal size by frequency; and classes of rarer words, by the
letters they are made of. A word's probability is that of its class, given the state, times that of the word within
its class: a softmax over the class for frequent words, and smoothed counts over the whole corpus for rarer ones. Each
rare class keeps a share for words that were never seen, so all probabilities add up to one.

The network learns from all learning texts, once each, by truncated backpropagation. The driver begins with about
train_tokens tokens of whole texts, chosen by a hash of id and text. All other texts are dealt by the same hash to parts
of about PART_TOKENS tokens, in ROUNDS rounds: in each, the executors go on from the same weights with one part each,
and the weights and Adagrad sums that they reach are averaged. Texts are scored on the executors in lanes: windows of steps over many
texts at once, the state carried from window to window to the end of each text.

Texts are split into words twice: for the counts, and once more when all of them are encoded. Learning and scoring read the
encoded texts. Arrow splits and looks up the words of many texts at once.

Words beyond the head of the count table are not looked up from a broadcast: each text's tail words are joined with
the count table by a shuffle.

Cases: a null or empty text is its end token alone; without learning texts the base is 0 and the model knows only its
rare classes; rows that repeat an id are scored one by one; a very long text takes a lane of its own and linear time.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

END = b""
CLASS_WORDS, CLASSES = 64, 64
VOCABULARY = CLASS_WORDS * CLASSES
RARE_CLASSES = 16
#: The classes of rarer words begin with the letters of so many words, drawn by a hash, and then learn from all in rounds.
SPELLER_WORDS = 10_000
SPELLER_ROUNDS = 2
UNITS = 32
#: Words whose counts are broadcast, at most.
HEAD_WORDS = 150_000
TRAIN_TOKENS = 1_500_000
STEPS = 16
TRAIN_LANES = 64
#: Learning on the executors: rounds of averaging, tokens of a part, its lanes, and pieces that weights are summed in.
ROUNDS = 4
PART_TOKENS = 2_000_000
PART_LANES = 256
PIECES = 64
LANES = 512
LOGITS = 60.0
#: Rows that pass through the output layer at once, and states that are gathered for it.
BLOCK, POUR = 2048, 65_536
#: Words of a task that are scored together.
CHUNK_WORDS = 3_000_000
_BIGRAMS = 1 << 9
_GATES = np.arange(3)[:, None]
#: Words of a task that are counted together, bytes of texts that are encoded together, bytes of a word that are added side by side.
COUNTED_WORDS = 3_000_000
ENCODED_BYTES = 8_000_000
WORD_BYTES = 256


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased texts (null: none), one text after the other, and how many each has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, ends = parts.flatten().cast(pa.binary()), parts.offsets.to_numpy()
    filled = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves empty parts
    before = np.r_[0, np.cumsum(filled.to_numpy(zero_copy_only=False))]
    return words.filter(filled), np.diff(before[ends])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ENCODED_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= ENCODED_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def count_words(learn: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) of all tokens of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def table() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays(found.flatten(), ["word", "c"])

        for batch in batches:
            words, _ = split_words(batch.column(0))
            held.append(words)
            size, texts = size + len(words), texts + len(batch)
            if size >= COUNTED_WORDS:
                yield table()
                held, size = [], 0
        if size:
            yield table()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], ["word", "c"])

    partial = common.in_arrow(learn.select(F.col(text_col).cast("string").alias("text")), run, "word binary, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Speller:
    """Classes of words by their byte bigrams: a mixture of multinomials with whole-number log weights."""

    weights: np.ndarray  # (bigrams, classes) int32
    prior: np.ndarray

    @staticmethod
    def slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        pairs = ((data[:-1] * np.uint32(257) + data[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(23)
        return pairs, np.r_[0, np.cumsum(lengths + 1)[:-1]]

    def sums(self, pairs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each word, the weights of its bigrams added up: those of all words side by side, the longest words first."""
        sizes = np.diff(np.r_[starts, len(pairs)])
        order = np.argsort(-sizes, kind="stable")
        first, sizes = starts[order], sizes[order]
        found = np.zeros((len(starts), RARE_CLASSES), np.int32)  # WORD_BYTES weights fit
        longer = np.searchsorted(-sizes, -np.arange(min(sizes[0], WORD_BYTES)))
        for k, n in enumerate(longer):
            found[:n] += self.weights.take(pairs[first[:n] + k], axis=0)
        spread = np.empty(found.shape, np.int64)
        spread[order] = found
        for i in np.flatnonzero(sizes > WORD_BYTES):
            spread[order[i]] += self.weights[pairs[first[i] + WORD_BYTES : first[i] + sizes[i]]].sum(axis=0)
        return spread + self.prior

    def classes(self, words: list[bytes]) -> np.ndarray:
        found = []
        for at in range(0, len(words), 20_000):
            pairs, starts = self.slots(words[at : at + 20_000])
            found.append(self.sums(pairs, starts).argmax(axis=1))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Whole numbers (classes, bigrams + 1): how much of each bigram, and last of the words, falls to each class."""
        total = np.zeros((RARE_CLASSES, _BIGRAMS + 1), np.int64)
        for at in range(0, len(words), 20_000):
            pairs, starts = self.slots(words[at : at + 20_000])
            scores = self.sums(pairs, starts) / 1000
            share = np.exp(scores - scores.max(axis=1, keepdims=True))
            share = np.rint(share / share.sum(axis=1, keepdims=True) * 1000).astype(np.int64)
            owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pairs)]))
            for k in range(RARE_CLASSES):  # sums below 2 ** 53 are exact in floating point
                total[k, :-1] += np.bincount(pairs, share[owner, k], _BIGRAMS).astype(np.int64)
            total[:, -1] += share.sum(axis=0)
        return total

    @classmethod
    def of(cls, expected: np.ndarray) -> Speller:
        letters = expected[:, :-1] / 1000 + 0.1
        words = expected[:, -1] / 1000 + 1
        return cls((np.log(letters / letters.sum(axis=1, keepdims=True)).T * 1000).astype(np.int32), (np.log(words / words.sum()) * 1000).astype(np.int32))

    @classmethod
    def learn(cls, words: list[bytes], rounds: int = 20, seed: int = 3) -> Speller:
        """By expectation maximisation over a list of words, from random weights."""
        start = np.random.default_rng(seed).dirichlet(np.full(_BIGRAMS, 0.3), RARE_CLASSES)
        found = cls.of(np.c_[start * 1e6, np.ones(RARE_CLASSES)])
        for _ in range(rounds if words else 0):
            found = cls.of(found.expected(words))
        return found

    def learned_from(self, counts: DataFrame, but: set[bytes]) -> Speller:
        """A round over all words of a (word, c) table but some, on the executors."""
        shared = counts.sparkSession.sparkContext.broadcast((self, but))  # of a bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, but = shared.value
            total = np.zeros(RARE_CLASSES * (_BIGRAMS + 1), np.int64)
            for batch in batches:
                words = [w for w in batch.column(0).to_pylist() if w not in but]
                if words:
                    total += own.expected(words).ravel()
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["cell", "n"])

        found = np.zeros(RARE_CLASSES * (_BIGRAMS + 1), np.int64)
        for cell, n in common.in_arrow(counts.select("word"), run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
            found[cell] = n
        return Speller.of(found.reshape(RARE_CLASSES, -1)) if found.any() else self


@dataclass
class Lexicon:
    """What the corpus counts give, of bounded size: the head of the count table and totals."""

    head: dict[bytes, int]  # word -> place, by falling count
    counts: np.ndarray  # of the head
    total: int  # N
    distinct: int  # V
    least: int  # every word with at least this count is in the head
    speller: Speller
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of the head: place, or VOCABULARY + rare class
    rare_mass: np.ndarray = field(default_factory=lambda: np.zeros(RARE_CLASSES))  # tokens of each rare class
    rare_norm: np.ndarray = field(default_factory=lambda: np.zeros(RARE_CLASSES))  # log10 of its smoothed mass

    def encode(self, texts: pa.Array, head: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """Of texts, with the words of the head as an array: how many tokens each has, the code of each token, its place in
        the head or -1, and the distinct tail words of each text as (text, place in the words, times, words)."""
        words, sizes = split_words(texts)
        sizes = sizes + 1
        ends = np.cumsum(sizes) - 1
        inside = np.ones(len(words) + len(sizes), bool)
        inside[ends] = False
        places = np.full(len(inside), self.head.get(END, -1), np.int64)
        places[inside] = pc.index_in(words, value_set=head).fill_null(-1).to_numpy()
        codes = self.codes[places] if len(self.codes) else np.zeros(len(places), np.int32)
        missing = np.flatnonzero(places < 0)
        owner = np.searchsorted(ends, missing)
        at = np.where(inside[missing], missing - owner, len(words))  # ends are in the tail only if they are not in the head
        tail = pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(at)).dictionary_encode()
        kinds, own = tail.dictionary, tail.indices.to_numpy().astype(np.int64)
        listed = kinds.to_pylist()
        classes = self.speller.classes(listed)
        classes[[i for i, w in enumerate(listed) if w == END]] = 0
        codes[missing] = VOCABULARY + classes[own]
        met, times = np.unique(owner * max(1, len(kinds)) + own, return_counts=True)
        return sizes, codes, places, (met // max(1, len(kinds)), met % max(1, len(kinds)), times, kinds)


def build_lexicon(counts: DataFrame) -> Lexicon:
    """Read a (word, c) table; only numbers and at most HEAD_WORDS words reach the driver."""
    level = F.floor(F.log2("c") * 64).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).collect(), reverse=True)
    total, distinct = sum(r["c"] for r in levels), sum(r["n"] for r in levels)
    taken, least = 0, 1 << 62
    for r in levels:
        if taken + r["n"] > HEAD_WORDS:
            break
        taken, least = taken + r["n"], r["least"]
    rows = counts.where(F.col("c") >= least).collect() if taken else []
    rows = sorted(((r["c"], bytes(r["word"])) for r in rows), key=lambda r: (-r[0], r[1]))
    words = [w for _, w in rows]
    if END in words[VOCABULARY - 1 :]:  # the end token always has a place in the vocabulary
        at = words.index(END)
        rows.insert(VOCABULARY - 1, rows.pop(at))
        words = [w for _, w in rows]
    frequent = {*words[:VOCABULARY], END}
    begin = sorted(words[VOCABULARY:], key=lambda w: (zlib.crc32(w), w))[:SPELLER_WORDS]
    speller = Speller.learn(begin)
    for _ in range(SPELLER_ROUNDS):
        speller = speller.learned_from(counts, frequent)
    lexicon = Lexicon({w: i for i, w in enumerate(words)}, np.array([c for c, _ in rows], np.int64), total, distinct, least, speller)
    lexicon.codes = np.arange(len(words), dtype=np.int32)
    lexicon.codes[VOCABULARY:] = VOCABULARY + speller.classes(words[VOCABULARY:])
    def rare_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, kinds = np.zeros(RARE_CLASSES, np.int64), np.zeros(RARE_CLASSES, np.int64)
        for batch in batches:
            pairs = [(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w not in frequent]
            if pairs:
                own = speller.classes([w for w, _ in pairs])
                np.add.at(mass, own, [c for _, c in pairs])
                kinds += np.bincount(own, minlength=RARE_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(RARE_CLASSES), pa.int32()), pa.array(mass), pa.array(kinds)], ["k", "mass", "kinds"])

    found = common.in_arrow(counts, rare_totals, "k int, mass long, kinds long").groupBy("k").agg(F.sum("mass"), F.sum("kinds")).collect()
    mass, kinds = np.zeros(RARE_CLASSES), np.zeros(RARE_CLASSES)
    for k, a, b in found:
        mass[k], kinds[k] = a, b
    lexicon.rare_norm = np.log10(mass + 0.5 * (kinds + 1))
    lexicon.rare_mass = mass
    return lexicon


def _sign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: like tanh between -1 and 1, and much cheaper. Its slope is (1 - |result|) ** 2."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


def _gates(x: np.ndarray) -> np.ndarray:
    """Between 0 and 1, in place."""
    x = _sign(x)
    x *= 0.5
    x += 0.5
    return x


def _slope(signed: np.ndarray) -> np.ndarray:
    """(1 - |signed|) ** 2"""
    found = np.abs(signed)
    np.subtract(1, found, out=found)
    found *= found
    return found


def _weights(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised probabilities, in place, and their sums; logits beyond LOGITS count as LOGITS."""
    np.clip(logits, -LOGITS, LOGITS, out=logits)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], logits.dtype)


def _cells(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A flat view of a contiguous array, and in it the places of one column of each row."""
    return rows.reshape(-1), np.arange(0, rows.size, rows.shape[1]) + columns


@dataclass
class Gru:
    inputs: np.ndarray  # (VOCABULARY + RARE_CLASSES, 3 * UNITS): what a word adds to update, reset and candidate
    loop: np.ndarray  # (UNITS, 3 * UNITS)
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray  # (CLASSES, UNITS, CLASS_WORDS)
    word_bias: np.ndarray

    @classmethod
    def start(cls, lexicon: Lexicon, seed: int = 5) -> Gru:
        """Random weights; biases that give the corpus's own frequencies."""
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        counts = np.zeros(VOCABULARY)
        counts[: min(VOCABULARY, len(lexicon.counts))] = lexicon.counts[:VOCABULARY]
        table = counts.reshape(CLASSES, CLASS_WORDS) + 1e-2
        mass = np.r_[table.sum(axis=1), lexicon.rare_mass + 1]
        return cls(
            normal(0.1, VOCABULARY + RARE_CLASSES, 3 * UNITS),
            normal(1 / np.sqrt(UNITS), UNITS, 3 * UNITS),
            normal(0.02, UNITS, CLASSES + RARE_CLASSES),
            np.log(mass / mass.sum()).astype(np.float32),
            normal(0.02, CLASSES, UNITS, CLASS_WORDS),
            np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32),
        )

    def parts(self, h: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(update, reset, what the loop adds to the candidate, candidate) of a step, each contiguous."""
        g = self.inputs.reshape(-1, UNITS).take(code * np.intp(3) + _GATES, axis=0)
        a = np.matmul(h, self.loop.reshape(UNITS, 3, UNITS).transpose(1, 0, 2))
        g[:2] += a[:2]
        update, reset = _gates(g[:2])
        candidate = reset * a[2]
        candidate += g[2]
        return update, reset, a[2], _sign(candidate)

    def step(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        update, _, _, candidate = self.parts(h, code)
        h = h - candidate
        h *= update
        h += candidate
        return h

    def word_logits(self, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Logits of the words of each row's class, the classes met, and the rows of each; rows are in the order of classes."""
        cuts = np.searchsorted(own, np.arange(CLASSES + 1))
        met = np.flatnonzero(np.diff(cuts))
        runs = [(k, slice(cuts[k], cuts[k + 1])) for k in met.tolist()]
        logits = np.empty((len(own), CLASS_WORDS), h.dtype)
        for k, rows in runs:
            np.matmul(h[rows], self.to_word[k], out=logits[rows])
            logits[rows] += self.word_bias[k]
        return logits, met, runs

    def log_probs(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Natural log of P(class), times P(word | class) for frequent words, for each row of states."""
        own = np.where(code < VOCABULARY, code // CLASS_WORDS, CLASSES + code - VOCABULARY)
        order = np.argsort(own.astype(np.uint8), kind="stable")
        code, own, h = code[order], own[order], h.take(order, axis=0)
        ratio = np.empty(len(own), h.dtype)
        for at in range(0, len(own), BLOCK):  # as much as caches hold
            rows = slice(at, at + BLOCK)
            logits = h[rows] @ self.to_class
            logits += self.class_bias
            weights, sums = _weights(logits)
            cells, places = _cells(weights, own[rows])
            ratio[rows] = cells[places] / sums
        frequent = np.searchsorted(own, CLASSES)
        for at in range(0, frequent, BLOCK):
            rows = slice(at, min(at + BLOCK, frequent))
            weights, sums = _weights(self.word_logits(h[rows], own[rows])[0])
            cells, places = _cells(weights, code[rows] % CLASS_WORDS)
            ratio[rows] *= cells[places] / sums
        found = np.empty(len(own))
        found[order] = np.log(np.maximum(ratio, np.float32(1e-38)))
        return found


def start_sums(model: Gru) -> dict[str, np.ndarray]:
    return {k: np.full_like(v, 1e-4) for k, v in vars(model).items()}


def train(lexicon: Lexicon, texts: list[np.ndarray], rate: float = 0.05, epochs: int = 1, seed: int = 9) -> Gru:
    """A model that learned from texts alone."""
    model = Gru.start(lexicon)
    learn_texts(model, start_sums(model), texts, TRAIN_LANES, rate, epochs, seed)
    return model


def learn_texts(model: Gru, squares: dict[str, np.ndarray], texts: list[np.ndarray], lanes: int, rate: float = 0.05, epochs: int = 1, seed: int = 9) -> None:
    """Adagrad over windows of STEPS tokens in lanes; gradients stop at the window, states do not. Changes model and squares."""
    rng = np.random.default_rng(seed)
    if not texts:
        return

    def move(name: str, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        """An Adagrad step of a whole array or of some of its rows; gradient is used up."""
        sums, weights = squares[name], getattr(model, name)
        if rows is not None and len(rows) < len(sums):
            own = sums[rows]
            own += gradient * gradient
            sums[rows] = own
        else:
            rows = None
            sums += gradient * gradient
            own = sums
        gradient *= rate
        gradient /= np.sqrt(own)
        if rows is None:
            weights -= gradient
        else:
            weights[rows] -= gradient

    for _ in range(epochs):
        order = rng.permutation(len(texts))
        stream = np.concatenate([texts[i] for i in order])
        fresh = np.zeros(len(stream), bool)
        fresh[np.r_[0, np.cumsum([len(texts[i]) for i in order])[:-1]]] = True
        lanes = min(lanes, len(stream))
        length = -(-len(stream) // lanes)  # the last lane fills up from the first text, so that no token is left out
        stream, fresh = (np.resize(x, lanes * length).reshape(lanes, length).T for x in (stream, fresh))
        h = np.zeros((lanes, UNITS), np.float32)
        for at in range(0, length, STEPS):
            h, gradients, (words, on_words) = window_gradients(model, h, stream[at : at + STEPS], fresh[at : at + STEPS])
            for name in ("to_word", "word_bias"):
                met, gradient = gradients[name]
                move(name, gradient, met)
            move("to_class", gradients["to_class"])
            move("class_bias", gradients["class_bias"])
            move("loop", np.clip(gradients["loop"], -1, 1))
            move("inputs", np.clip(on_words, -1, 1), words)


def window_gradients(model: Gru, h: np.ndarray, codes: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, dict, tuple[np.ndarray, np.ndarray]]:
    """One window (steps, lanes): the state after it, the gradients of the loss summed over its tokens and divided by the
    lanes, and those of the words met. fresh marks where a text begins: there the state starts from zero.

    Gradients of to_word and word_bias are (classes met, gradients of these).
    """
    steps, lanes = codes.shape
    kind = model.loop.dtype
    kept, states = [], np.empty((steps, lanes, UNITS), kind)
    for t, (code, first) in enumerate(zip(codes, fresh, strict=True)):
        if first.any():
            h = h * ~first[:, None]
        states[t] = h
        update, reset, added, candidate = model.parts(h, code)
        kept.append((h, added, update, reset, candidate, first))
        h = h - candidate
        h *= update
        h += candidate
    states = states.reshape(-1, UNITS)
    # The output layer, with the tokens in the order of their classes.
    code = codes.ravel()
    own = np.where(code < VOCABULARY, code // CLASS_WORDS, CLASSES + code - VOCABULARY).astype(np.uint8)
    order = np.argsort(own, kind="stable")
    code, own, state = code[order], own[order], states.take(order, axis=0)
    share = kind.type(1 / lanes)
    back = np.empty_like(state)
    on_class, on_class_bias = np.zeros_like(model.to_class), np.zeros_like(model.class_bias)
    ones = np.ones(len(own), kind)
    for at in range(0, len(own), BLOCK):
        rows = slice(at, at + BLOCK)
        p = state[rows] @ model.to_class
        p += model.class_bias
        p, sums = _weights(p)
        p *= (share / sums)[:, None]
        cells, places = _cells(p, own[rows])
        cells[places] -= share
        np.matmul(p, model.to_class.T, out=back[rows])
        on_class += state[rows].T @ p
        on_class_bias += ones[: len(p)] @ p
    gradients = {"to_class": on_class, "class_bias": on_class_bias}
    # Words within classes: products by class, all else over all rows at once.
    frequent = np.searchsorted(own, CLASSES)
    q, met, runs = model.word_logits(state[:frequent], own[:frequent])
    q, sums = _weights(q)
    q *= (share / sums)[:, None]
    cells, places = _cells(q, code[:frequent] % CLASS_WORDS)
    cells[places] -= share
    on_word, on_bias, more = np.empty((len(met), UNITS, CLASS_WORDS), kind), np.empty((len(met), CLASS_WORDS), kind), np.empty((frequent, UNITS), kind)
    for i, (k, rows) in enumerate(runs):
        own_q = q[rows]
        np.matmul(own_q, model.to_word[k].T, out=more[rows])
        np.matmul(state[rows].T, own_q, out=on_word[i])
        np.matmul(ones[: len(own_q)], own_q, out=on_bias[i])
    back[:frequent] += more
    gradients |= {"to_word": (met, on_word), "word_bias": (met, on_bias)}
    spread = np.empty_like(back)
    spread[order] = back
    back = spread.reshape(steps, lanes, UNITS)
    # Back through the steps. Of each token: what reaches the candidate, the gates, and what the loop adds to the candidate.
    through = np.zeros((lanes, UNITS), kind)
    reached = np.empty((4, steps, lanes, UNITS), kind)
    loops = model.loop.reshape(UNITS, 3, UNITS).transpose(1, 2, 0)
    for t in range(steps - 1, -1, -1):
        before, added, update, reset, candidate, first = kept[t]
        on_candidate, on_update, on_reset, on_added = reached[:, t]
        kept_share = 1 - update
        slope = _slope(candidate)
        slope *= kept_share
        np.multiply(through, slope, out=on_candidate)
        # The slope of a gate 0.5 + 0.5 s is 0.5 (1 - |s|) ** 2, which is 2 min(gate, 1 - gate) ** 2.
        np.minimum(update, kept_share, out=kept_share)
        kept_share *= kept_share
        kept_share *= 2
        np.subtract(before, candidate, out=on_update)
        on_update *= kept_share
        on_update *= through
        np.subtract(1, reset, out=slope)
        np.minimum(reset, slope, out=slope)
        slope *= slope
        slope *= 2
        slope *= added
        np.multiply(on_candidate, slope, out=on_reset)
        np.multiply(on_candidate, reset, out=on_added)
        by_loop = np.matmul(reached[1:, t], loops)
        through *= update
        through += back[t]
        for x in by_loop:
            through += x
        if first.any():
            through *= ~first[:, None]
    reached = reached.reshape(4, -1, UNITS)
    gradients["loop"] = np.matmul(states.T, reached[1:]).transpose(1, 0, 2).reshape(UNITS, 3 * UNITS)
    flat = codes.ravel()
    by_word = np.argsort(flat.astype(np.uint16), kind="stable")
    in_order = flat[by_word]
    begins = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
    gates = by_word[:, None] + np.array([1, 2, 0]) * len(flat)  # rows of update, reset and candidate side by side
    summed = run_sums(reached.reshape(-1, UNITS).take(gates, axis=0).reshape(len(flat), -1), begins)
    return h, gradients, (in_order[begins], summed)


def run_sums(rows: np.ndarray, begins: np.ndarray, few: int = 8) -> np.ndarray:
    """Sum of the rows of each run. The first few rows of all runs are added side by side, as most runs are short."""
    ends = np.r_[begins[1:], len(rows)]
    lengths = ends - begins
    found = rows[begins]
    for k in range(1, few):
        longer = np.flatnonzero(lengths > k)
        found[longer] += rows[begins[longer] + k]
    for i in np.flatnonzero(lengths > few):
        found[i] += rows[begins[i] + few : ends[i]].sum(axis=0)
    return found


def to_vector(model: Gru, squares: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in (*vars(model).values(), *squares.values())])


def from_vector(vector: np.ndarray, like: Gru) -> tuple[Gru, dict[str, np.ndarray]]:
    """Copies of the weights and sums in a vector."""
    found, at = [], 0
    for x in (*vars(like).values(), *vars(like).values()):
        found.append(vector[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    half = len(found) // 2
    return Gru(*found[:half]), dict(zip(vars(like), found[half:], strict=True))


def score_texts(model: Gru, texts: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log likelihood of each whole text. Texts are dealt to lanes, which advance step by step together; a lane's
    state is carried on between windows and is cleared where a text begins."""
    lengths = np.array([len(t) for t in texts])
    by_length = np.argsort(-lengths, kind="stable")
    lanes = min(lanes, len(texts))
    queues: list[list[int]] = [[] for _ in range(lanes)]
    loads = [(0, k) for k in range(lanes)]
    for i in by_length:
        load, k = heapq.heappop(loads)
        queues[k].append(int(i))
        heapq.heappush(loads, (load + int(lengths[i]), k))
    queues.sort(key=lambda q: -int(lengths[q].sum()))
    order = [i for q in queues for i in q]
    flat = np.concatenate([texts[i] for i in order]).astype(np.int32)
    owner = np.repeat(np.array(order), lengths[order])
    fresh = np.zeros(len(flat), bool)
    fresh[np.r_[0, np.cumsum(lengths[order])[:-1]]] = True
    sizes = np.array([lengths[q].sum() for q in queues])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    found = np.zeros(len(texts))
    h = np.zeros((lanes, UNITS), np.float32)
    states, places, held = [], [], 0

    def pour() -> None:
        nonlocal states, places, held
        where = np.concatenate(places)
        found[:] += np.bincount(owner[where], weights=model.log_probs(np.concatenate(states), flat[where]), minlength=len(texts))
        states, places, held = [], [], 0

    active = lanes
    for t in range(int(sizes[0])):
        while sizes[active - 1] <= t:
            active -= 1
        where = starts[:active] + t
        first = fresh[where]
        h = h[:active]
        if first.any():
            h = np.where(first[:, None], np.float32(0), h)
        states.append(h)
        places.append(where)
        held += active
        if held >= POUR:
            pour()
        h = model.step(h, flat[where])
    if held:
        pour()
    return found


def dealing(lexicon: Lexicon, train_tokens: int) -> tuple[int, int]:
    """The bar, of 1 << 32, below which the driver takes a text, and the number of parts of a round."""
    return int(min(1.0, train_tokens / max(lexicon.total, 1)) * (1 << 32)), max(1, -(-max(0, lexicon.total - train_tokens) // (ROUNDS * PART_TOKENS)))


def encoded(docs: DataFrame, held_out: Column, lexicon: Lexicon, train_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """Of each row of docs: row, doc_id, held_out; part, by a hash of id and text (-1: the driver's, else 0 and on; null: not
    to be learned from); codes; its distinct tail words, joined by spaces, and how often each occurs; what the head of the
    counts says of it."""
    bar, parts = dealing(lexicon, train_tokens)
    text = F.col(text_col).cast("string")
    place = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), text), 32)
    part = F.when(place < bar, F.lit(-1)).otherwise(F.floor((place - bar) * F.lit(ROUNDS * parts) / F.lit(float(max(1, (1 << 32) - bar))))).cast("int")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # of a bounded size
    log_all = float(np.log10(lexicon.total + 0.5 * (lexicon.distinct + 1)))
    schema = "row long, doc_id long, held_out boolean, part int, codes binary, tail binary, times binary, n_known long, base double, score double"
    names = [f.split()[0] for f in schema.split(", ")]

    def joined(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The bytes of so many entries in a row."""
        ends = np.r_[0, np.cumsum(sizes * data.itemsize)].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        head = pa.array(list(lexicon.head), pa.binary())
        logs, norm = np.r_[np.log10(lexicon.counts + 0.5), 0.0], lexicon.rare_norm  # a place of -1 finds 0
        for batch in gathered(batches):
            sizes, codes, places, (owner, word, times, kinds) = lexicon.encode(batch.column(4), head)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            own = logs[places]
            rare = np.flatnonzero(codes >= VOCABULARY)
            of_rare = np.zeros(len(codes))
            of_rare[rare] = own[rare] - norm[codes[rare] - VOCABULARY]
            tails = np.bincount(owner, minlength=len(batch))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tails)].astype(np.int32)), kinds.take(pa.array(word)))
            found = [joined(codes.astype(np.uint16), sizes), pc.binary_join(lists, b" "), joined(times.astype(np.int32), tails)]
            sums = [pa.array(np.add.reduceat(x, starts)) for x in ((places >= 0).astype(np.int64), own, of_rare)]
            sums[1] = pc.subtract(sums[1], pa.array(sizes * log_all))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *found, *sums], names)

    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.when(~held_out, part).alias("part"), text.alias("text"))
    return common.in_arrow(chosen, run, schema)


def learn_round(coded: DataFrame, model: Gru, squares: dict[str, np.ndarray], first: int, parts: int) -> tuple[Gru, dict[str, np.ndarray], int]:
    """Learn from parts first to first + parts - 1 of the table, each from the same weights, and average by tokens.

    Weights and sums travel in pieces, each summed in one place, so that only one model reaches the driver.
    """
    context = coded.sparkSession.sparkContext
    shared = context.broadcast((model, squares))  # of a fixed size

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> pa.RecordBatch:
            own, sums = from_vector(to_vector(*shared.value), shared.value[0])
            n = sum(map(len, texts))
            learn_texts(own, sums, texts, max(1, min(PART_LANES, n // (4 * STEPS))))
            found = [x.tobytes() for x in np.array_split(to_vector(own, sums), PIECES)]
            return pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([n] * PIECES, pa.int64()), pa.array(found, pa.binary())], ["piece", "n", "vector"])

        at, texts = None, []
        for batch in batches:
            for part, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != at and texts:
                    yield pieces()
                    texts.clear()
                at = part
                texts.append(np.frombuffer(codes, np.uint16))
        if texts:
            yield pieces()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        tokens: Counter[int] = Counter()
        for batch in batches:
            for piece, n, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(vector, np.float32) * np.float64(n)
                sums[piece] = sums[piece] + x if piece in sums else x
                tokens[piece] += n
        found = [(x / tokens[k]).astype(np.float32).tobytes() for k, x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([tokens[k] for k in sums], pa.int64()), pa.array(found, pa.binary())], ["piece", "n", "vector"])

    schema = "piece int, n long, vector binary"
    own = coded.where((F.col("part") >= first) & (F.col("part") < first + parts)).select("part", "codes")
    dealt = own.repartitionById(parts, F.col("part") - F.lit(first)).sortWithinPartitions("part", "codes")
    rows = common.in_arrow(common.in_arrow(dealt, learned, schema).repartition("piece"), summed, schema).collect()
    shared.unpersist()
    if not rows:
        return model, squares, 0
    vector = np.concatenate([np.frombuffer(r["vector"], np.float32) for r in sorted(rows, key=lambda r: r["piece"])])
    return *from_vector(vector, model), rows[0]["n"]


def fit(learn: DataFrame, lexicon: Lexicon, train_tokens: int = TRAIN_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> tuple[Gru, int]:
    """The model of all learning texts, and the number of tokens that it learned from, which is that of all."""
    coded = kept_on_disk(encoded(learn, F.lit(False), lexicon, train_tokens, id_col, text_col))
    found = fit_encoded(coded, lexicon, train_tokens)
    coded.unpersist()
    return found


def kept_on_disk(coded: DataFrame) -> DataFrame:
    """On the executors' disks, as every round and the scoring read it."""
    with common.small_batches(coded.sparkSession):
        return coded.persist(StorageLevel.DISK_ONLY)


def fit_encoded(coded: DataFrame, lexicon: Lexicon, train_tokens: int) -> tuple[Gru, int]:
    """The model of the rows of an encoded table that have a part, and the number of its tokens."""
    with common.small_batches(coded.sparkSession):
        begun = [np.frombuffer(x, np.uint16) for x in sorted(bytes(r[0]) for r in coded.where("part < 0").select("codes").collect())]
    model = Gru.start(lexicon)
    squares = start_sums(model)
    learn_texts(model, squares, begun, TRAIN_LANES)
    learned = sum(map(len, begun))
    _, parts = dealing(lexicon, train_tokens)
    for k in range(ROUNDS if learned < lexicon.total else 0):
        model, squares, n = learn_round(coded, model, squares, k * parts, parts)
        learned += n
    return model, learned


def score_table(docs: DataFrame, held_out: Column, train_tokens: int = TRAIN_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the log10 probability under smoothed counts of single tokens; score is the model's.
    """
    spark = docs.sparkSession
    with common.Staging(spark) as own:
        counts = common.stage(count_words(docs.where(~held_out), text_col), "counts")
        lexicon = build_lexicon(counts)
        coded = kept_on_disk(encoded(docs, held_out, lexicon, train_tokens, id_col, text_col))
        model, _ = fit_encoded(coded, lexicon, train_tokens)
        rows = common.stage(scored(coded, model), "scored")  # a lost executor repeats no scoring
        coded.unpersist()
        joined = rows.join(counts.where(F.col("c") < lexicon.least), "word", "left")
        tail_log = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).otherwise(F.lit(0.0))
        summed = joined.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            (F.coalesce(F.sum("n_known"), F.lit(0)) + F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(F.lit(0)))).alias("n_known"),
            (F.sum("base") + F.sum(tail_log)).alias("base_score"),
            (F.sum("score") + F.sum(tail_log)).alias("score"),
        )
        found = summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lexicon.total).cast("long").alias("train_tokens"), "base_score", "score")
        return own.keep(common.stage(found, "scores"))


def scored(coded: DataFrame, model: Gru) -> DataFrame:
    """Of each row of an encoded table what the head of the counts and the network say of it, and a row (row, word, times) for
    each of its words beyond the head."""
    shared = coded.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    schema = "row long, doc_id long, held_out boolean, word binary, times long, n_tokens long, n_known long, base double, score double"
    kinds, names = common.arrow_types(schema), [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        size = 0

        def of_texts() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            logs = score_texts(shared.value, texts) / np.log(10)
            # A key with a space in it is no word: it finds no count, and spreads these rows over the tasks.
            keys = [b" " + struct.pack(">q", r) for r in rows["row"].to_pylist()]
            sizes = [len(t) for t in texts]
            found = [rows["row"], rows["doc_id"], rows["held_out"], pa.array(keys, kinds[3]), pa.array([0] * len(keys), kinds[4]), pa.array(sizes, kinds[5]), rows["n_known"], rows["base"], pc.add(rows["score"], pa.array(logs))]
            return pa.Table.from_arrays(found, names).combine_chunks().to_batches()[0]

        def of_tails(batch: pa.RecordBatch) -> pa.RecordBatch:
            times = [np.frombuffer(x, np.int32) for x in batch.column("times").to_pylist()]
            met = pa.array([len(x) > 0 for x in times])
            words = pc.split_pattern(batch.column("tail").filter(met), " ").flatten().cast(kinds[3])
            row = np.repeat(batch.column("row").to_numpy(), [len(x) for x in times])
            none = [pa.nulls(len(row), k) for k in kinds]
            return pa.RecordBatch.from_arrays([pa.array(row), *none[1:3], words, pa.array(np.concatenate(times).astype(np.int64)), *none[5:]], names)

        for batch in batches:
            held.append(batch.select(["row", "doc_id", "held_out", "n_known", "base", "score"]))
            found = [np.frombuffer(x, np.uint16) for x in batch.column("codes").to_pylist()]
            texts += found
            size += sum(map(len, found))
            yield of_tails(batch)
            if size >= CHUNK_WORDS:
                yield of_texts()
                held, texts, size = [], [], 0
        if texts:
            yield of_texts()

    return common.in_arrow(coded.drop("part"), run, schema)
