"""Document quality by a linear-chain conditional random field over lines.

Each line of a text is good (1) or bad (0). Its score for good is linear in features of the line and of its two
neighbours; neighbouring labels have weights of their own. Forward-backward gives each line's marginal probability of being
good, and a document's quality is the mean of these, weighted by length and then calibrated by a logistic curve. The field is fitted by
gradient ascent on documents with a known label, which all of a document's lines take.

Features are shares of character and word classes of a line, computed for a block of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, give_back, text_or_empty
from .repeats import BLOCK, U, buffers, byte_symbols, hashes, mix, prefix_sums, word_places

#: The model is fitted on so many labelled documents at most, chosen by a hash of doc_id, none of which is longer than MOST_CHARS.
SAMPLE, MOST_CHARS = 4000, 50_000
ROUNDS = 150

_CLASSES = {
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "symbol": list(b"#*$%&<>@^_=~+\\/{}[]"),
    "pipe": list(b"|"),
    "bang": list(b"!"),
    "point": list(b".,;:?'\"()-"),
}
_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?:;\"'", 0xBB, 0x9D]] = True
N_FEATURES = 21
#: The feature that a line occurs again in its text.
REPEATED = 10


def _repeated(lines: np.ndarray) -> np.ndarray:
    """Whether a hash of a line occurs again."""
    _, same, often = np.unique(lines, return_inverse=True, return_counts=True)
    return often[same] > 1


def _block_features(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word of some texts: the text of each, its length in bytes, its features, a hash of its text and content."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    begin = np.union1d(cuts[:-1][cuts[:-1] < n], breaks + 1)
    begin = begin[begin < n]
    end = np.append(begin[1:], n)
    at, stop = word_places(data, cuts)
    if not len(begin) or not len(at):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, N_FEATURES)), np.zeros(0, U)
    line = np.searchsorted(begin, at, "right") - 1
    words = np.bincount(line, minlength=len(begin))
    full = words > 0
    sums = prefix_sums(byte_symbols(data))
    word = hashes(sums, at, stop)
    text_of_word = np.searchsorted(cuts, at, "right")
    twice = np.zeros(len(at), bool)
    twice[1:] = (word[1:] == word[:-1]) & (text_of_word[1:] == text_of_word[:-1])

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line[flags], minlength=len(begin))

    def chars(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[end] - total[begin]

    length = np.bincount(line, weights=stop - at, minlength=len(begin))
    counts = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, np.uint8)
        table[members] = 1
        counts[name] = chars(table[data])
    capital = np.zeros(n, bool)  # Latin-1 capitals, two bytes each
    capital[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = counts["upper"] + 2 * chars(capital)
    loud = per_line((data[stop - 1] == 33) & (data[np.maximum(stop - 2, 0)] == 33))
    last = np.cumsum(words) - 1
    ended = _ENDS[data[stop[np.maximum(last, 0)] - 1]]
    text = np.searchsorted(cuts, begin, "right") - 1
    own = mix(hashes(sums, begin, np.maximum(begin, stop[np.maximum(last, 0)])) ^ mix(text.astype(U) + U(1)))
    repeated = np.zeros(len(begin), bool)
    repeated[full] = _repeated(own[full])
    w, c = np.maximum(1, words), np.maximum(1, length)
    stutter, symbols, pipes = per_line(twice) / w, counts["symbol"] / w, counts["pipe"] / w
    x = np.column_stack(
        [
            np.log1p(words) / 4,
            np.minimum(3, length / w / 6),
            upper / c,
            counts["digit"] / c,
            np.minimum(1, symbols),
            np.minimum(1, pipes),
            loud / w,
            np.minimum(1, counts["bang"] / w),
            np.minimum(1, counts["point"] / w),
            stutter,
            repeated,
            ended,
            per_line(stop - at > 24) / w,
            per_line(stop - at <= 2) / w,
            upper / c > 0.5,
            symbols > 0.2,
            pipes > 0.2,
            loud / w > 0.2,
            stutter > 0.2,
            words < 4,
            np.ones(len(begin)),
        ]
    ).astype(np.float64)
    return text[full], length[full], x[full], own[full]


@dataclass
class Lines:
    """Lines of some texts, in order: where each text's begin, lengths and features. A text without a word has one
    line of length 1 whose only feature is the constant."""

    first: np.ndarray
    count: np.ndarray
    length: np.ndarray
    x: np.ndarray


def features(texts: pa.Array) -> Iterator[Lines]:
    """Lines of successive texts, a block at a time; whether a line is repeated is told over the whole text. A line longer than a block of
    BLOCK bytes counts as several, cut between words; only a word as long as a block is cut itself."""
    data, cuts = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + BLOCK, "right")) - 1)
        parts, lo = [], cuts[i]
        while True:
            hi = cuts[j]
            if hi - lo > 2 * BLOCK:  # one long text: cut it after a line
                breaks = np.flatnonzero(data[lo : lo + BLOCK] == 10)
                if not len(breaks):
                    breaks = np.flatnonzero(np.isin(data[lo : lo + BLOCK], [9, 11, 12, 13, 32]))
                hi = lo + (int(breaks[-1]) + 1 if len(breaks) else BLOCK)
            inner = cuts[i : j + 1] - lo if hi == cuts[j] and lo == cuts[i] else np.array([0, hi - lo])
            parts.append(_block_features(data[lo:hi], inner))
            lo = hi
            if hi == cuts[j]:
                break
        text, length, x, own = (np.concatenate(c) for c in zip(*parts, strict=True))
        if len(parts) > 1:
            x[:, REPEATED] = _repeated(own)
        count = np.bincount(text, minlength=j - i)
        if (count == 0).any():
            none = np.flatnonzero(count == 0)
            blank = np.zeros((len(none), N_FEATURES))
            blank[:, -1] = 1
            text, length, x = np.append(text, none), np.append(length, np.ones(len(none))), np.concatenate([x, blank])
            order = np.argsort(text, kind="stable")
            length, x = length[order], x[order]
            count = np.maximum(1, count)
        yield Lines(np.cumsum(count) - count, count, length, x)
        i = j


def neighbours(lines: Lines) -> np.ndarray:
    """Features of each line, of the line before and of the line after; zeros beyond a text's ends."""
    before, after = np.zeros_like(lines.x), np.zeros_like(lines.x)
    before[1:], after[:-1] = lines.x[:-1], lines.x[1:]
    before[lines.first], after[lines.first + lines.count - 1] = 0, 0
    return np.concatenate([lines.x, before, after], axis=1)


@dataclass
class Model:
    weights: np.ndarray  # of a line being good, by features of it and its neighbours
    moves: np.ndarray  # of label a before label b
    slope: float = 1.0
    shift: float = 0.0

    def passes(self, lines: Lines, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised forward and backward messages of each line, and its potentials."""
        e = np.clip(x @ self.weights, -30, 30) / 2
        local = np.exp(np.column_stack([-e, e]))
        move = np.exp(self.moves)
        order = np.argsort(-lines.count, kind="stable")
        first, count = lines.first[order], lines.count[order]
        longest = int(count[0]) if len(count) else 0
        reach = np.searchsorted(-count, -np.arange(longest), "left")  # texts with a line after the t-th
        forward, backward = local.copy(), np.ones_like(local)
        for t in range(1, longest):
            at = first[: reach[t]] + t
            f = forward[at - 1] @ move * local[at]
            forward[at] = f / f.sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            at = first[: reach[t + 1]] + t
            b = (backward[at + 1] * local[at + 1]) @ move.T
            backward[at] = b / b.sum(axis=1, keepdims=True)
        return forward, backward, local

    def raw(self, lines: Lines, x: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each text."""
        forward, backward, _ = self.passes(lines, x)
        both = forward * backward
        good = both[:, 1] / both.sum(axis=1)
        mean = np.add.reduceat(good * lines.length, lines.first) / np.add.reduceat(lines.length, lines.first)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: pa.Array) -> np.ndarray:
        got = [self.raw(lines, neighbours(lines)) for lines in features(texts)]
        return 1 / (1 + np.exp(-(self.slope * np.concatenate(got) + self.shift))) if got else np.zeros(0)


def _ascend(gradient, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Adam."""
    at, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, rounds + 1):
        g = gradient(at)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        at = at + rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return at


def fit(texts: list[str], labels: list[int], rounds: int = ROUNDS, decay: float = 1.0) -> Model:
    """The field that makes the labels of all lines likeliest, under a normal prior, and its calibration. Without documents of
    both labels, every text's score is the share of good ones, with one imagined document of each."""
    y = np.array(labels, np.int64)
    n, d = len(y), 3 * N_FEATURES
    share = (y.sum() + 1) / (n + 2)
    if not n or y.min() == y.max():
        return Model(np.zeros(d), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    got = [(lines, neighbours(lines)) for lines in features(pa.array(texts, pa.string()))]
    count = np.concatenate([lines.count for lines, _ in got])
    lines = Lines(np.cumsum(count) - count, count, np.concatenate([lines.length for lines, _ in got]), np.concatenate([lines.x for lines, _ in got]))
    x = np.concatenate([x for _, x in got])
    line_y = np.repeat(y, lines.count)
    inner = np.ones(len(line_y), bool)
    inner[lines.first + lines.count - 1] = False
    left = np.flatnonzero(inner)
    # documents count alike, however many lines they have
    weight = np.repeat(1 / lines.count, lines.count)
    seen = np.zeros((2, 2))
    np.add.at(seen, (line_y[left], line_y[left + 1]), weight[left])

    def gradient(p: np.ndarray) -> np.ndarray:
        model = Model(p[:d], p[d:].reshape(2, 2))
        forward, backward, local = model.passes(lines, x)
        both = forward * backward
        good = both[:, 1] / both.sum(axis=1)
        pair = forward[left][:, :, None] * np.exp(model.moves)[None] * (local[left + 1] * backward[left + 1])[:, None, :]
        pair *= (weight[left] / pair.sum(axis=(1, 2)))[:, None, None]
        return np.concatenate([x.T @ (weight * (line_y - good)), (seen - pair.sum(axis=0)).ravel()]) - decay * p

    p = _ascend(gradient, np.zeros(d + 4), rounds, 0.15)
    model = Model(p[:d], p[d:].reshape(2, 2))
    z = model.raw(lines, x)

    def calibration(q: np.ndarray) -> np.ndarray:
        off = y - 1 / (1 + np.exp(-np.clip(q[0] * z + q[1], -500, 500)))
        return np.array([(off * z).sum(), off.sum()]) - 0.01 * q * np.array([1, 0])

    model.slope, model.shift = map(float, _ascend(calibration, np.array([0.5, 0.0]), 400, 0.05))
    model.slope = max(model.slope, 0.05)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_chars: int = MOST_CHARS) -> Model:
    """Fits on labelled documents that aren't held out, `sample` at most. Labels without doc_id or quality don't count; of several
    labels of a document the smallest does. The chosen ids are few enough to be broadcast. One task fits on the sample, a bounded amount, and
    the driver gets the weights only."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").where(F.length("text") <= most_chars)
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, label = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            label += batch.column("label").to_pylist()
        model = fit(texts, label)
        yield pa.RecordBatch.from_pylist([{"weights": model.weights.tolist(), "moves": model.moves.ravel().tolist(), "slope": model.slope, "shift": model.shift}])

    for r in found.coalesce(1).mapInArrow(frugal(run), "weights array<double>, moves array<double>, slope double, shift double").collect():
        return Model(np.array(r["weights"]), np.array(r["moves"]).reshape(2, 2), r["slope"], r["shift"])
    return fit([], [])


def scorer(model: Model):
    """A column function: the score of a text, nulls as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array(model.score(texts))
        give_back()
        return out

    return lambda text: score(F.coalesce(text, F.lit("")))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is likelier good) and predicted (1 from threshold on) of every row.

    A null or blank text gets the score of a text without lines. A null doc_id is carried, equal texts get equal scores. An empty table
    gives no rows; without labels of both kinds all scores are equal. Other columns are ignored.
    """
    score = scorer(train(docs, labels, sample))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs with a score of threshold or more, with all their columns."""
    return docs.where(scorer(train(docs, labels, sample))(F.col("text")) >= threshold)
