"""Language of whole texts by a small convolutional network over bytes.

Bytes are embedded; filters two, three and four bytes wide run over windows of fixed
length; each filter's greatest response in a window goes through one softmax layer. The
network is trained in numpy on a bounded sample of labelled rows: at most
``docs_per_language`` rows of each label, and ``max_docs`` of all (but one at least of
each), chosen by a hash of the id; of a long text, ``pieces`` stretches from places
all over it, chosen by a hash too. A text's prediction is the mean over all its windows,
weighted by their lengths.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is
every text if nothing was learnt; rows without id or label teach nothing; equal texts
get equal results; the order and number of rows don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

WINDOW, EMBED, FILTERS, WIDTHS = 256, 6, 8, (2, 3, 4)
WIDEST = max(WIDTHS)
PLACES = WINDOW - WIDEST + 1
FEATURES = FILTERS * len(WIDTHS)
UNDETERMINED = "und"
_BLOCK = 64  # windows in one step; their responses stay in the cache


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDEST * EMBED x FEATURES; zero beyond a filter's width
    bias: np.ndarray
    weights: np.ndarray  # FEATURES x languages
    prior: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of embedded bytes, and every filter's response to each."""
        bytes_in = self.embed[windows]
        n, (a, b, c) = len(windows), bytes_in.strides
        stretches = np.lib.stride_tricks.as_strided(
            bytes_in, (n, PLACES, WIDEST * EMBED), (a, b, c)
        ).reshape(n * PLACES, WIDEST * EMBED)
        return stretches, (stretches @ self.filters).reshape(n, PLACES, FEATURES)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for begin in range(0, len(windows), _BLOCK):
            _, out = self.responses(windows[begin : begin + _BLOCK])
            pooled = np.maximum(out.max(axis=1) + self.bias, 0)
            parts.append(_softmax(pooled @ self.weights + self.prior))
        return np.concatenate(parts)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of each text, from all windows of it."""
        found = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.languages:
            return found
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for begin in range(0, len(known), 32):
            mine = known[begin : begin + 32]
            cut = [windows_of(texts[i]) for i in mine]
            chances = self.probabilities(np.concatenate([w for w, _ in cut]))
            sizes = np.concatenate([n for _, n in cut])
            ends = np.cumsum([len(n) for _, n in cut])
            sums = np.add.reduceat(chances * sizes[:, None], np.r_[0, ends[:-1]])
            means = sums / sums.sum(axis=1, keepdims=True)
            for i, mean in zip(mine, means):
                best = int(mean.argmax())
                found[i] = self.languages[best], float(min(1.0, mean[best]))
        return found


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes in rows of WINDOW, the last filled with zeros; their lengths."""
    data = np.frombuffer(text.encode(), np.uint8)
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = data
    sizes = np.full(rows, WINDOW)
    sizes[-1] = len(data) - (rows - 1) * WINDOW
    return out.reshape(rows, WINDOW), sizes


def train(
    samples: list[tuple[str, str]], seed: int = 42, epochs: int = 8, rate: float = 0.01
) -> Network:
    """A network from (text, language) pairs, by Adam on cross entropy."""
    languages = sorted({language for _, language in samples})
    rng = np.random.default_rng(seed)
    # A filter of k bytes leaves the rest of the widest stretch out.
    mask = np.zeros((WIDEST * EMBED, FEATURES), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
    shape = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "filters": rng.normal(0, 0.3, mask.shape) * mask,
        "bias": np.zeros(FEATURES),
        "weights": rng.normal(0, 0.3, (FEATURES, len(languages))),
        "prior": np.zeros(len(languages)),
    }
    net = Network(languages, **{k: v.astype(np.float32) for k, v in shape.items()})
    cut = [(windows_of(text)[0], language) for text, language in samples if text]
    if not cut:
        return Network([], net.embed, net.filters, net.bias, net.weights, net.prior)
    windows = np.concatenate([w for w, _ in cut])
    labels = np.concatenate([[languages.index(x)] * len(w) for w, x in cut])
    first = {k: np.zeros(v.shape, np.float32) for k, v in shape.items()}
    second = {k: np.zeros(v.shape, np.float32) for k, v in shape.items()}
    # Rare languages count as much as frequent ones.
    share = np.bincount(labels, minlength=len(languages))
    weight = (len(labels) / len(languages) / np.maximum(share, 1)).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for begin in range(0, len(order), _BLOCK):
            pick = order[begin : begin + _BLOCK]
            grads = _gradients(net, windows[pick], labels[pick], weight, mask)
            step += 1
            for name, grad in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.99 * second[name] + 0.01 * grad * grad
                up = first[name] / (1 - 0.9**step)
                down = np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8
                getattr(net, name).__isub__((rate * up / down).astype(np.float32))
    return net


def _gradients(net, windows, labels, weight, mask) -> dict[str, np.ndarray]:
    n, rows = len(windows), np.arange(len(windows))
    stretches, out = net.responses(windows)
    where = out.argmax(axis=1)
    best = np.take_along_axis(out, where[:, None], 1)[:, 0] + net.bias
    pooled = np.maximum(best, 0)
    error = _softmax(pooled @ net.weights + net.prior)
    error[rows, labels] -= 1
    error *= weight[labels, None] / n
    back = (error @ net.weights.T) * (best > 0)
    used = stretches.reshape(n, PLACES, -1)[rows[:, None], where]  # n, FEATURES, width
    to_bytes = back[:, :, None] * net.filters.T[None]
    at = where[:, :, None] + np.arange(WIDEST)
    embed = np.zeros_like(net.embed)
    np.add.at(
        embed,
        windows[rows[:, None, None], at],
        to_bytes.reshape(n, FEATURES, WIDEST, EMBED),
    )
    return {
        "embed": embed,
        "filters": np.einsum("nf,nfk->kf", back, used) * mask,
        "bias": back.sum(axis=0),
        "weights": pooled.T @ error,
        "prior": error.sum(axis=0),
    }


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 2 by 4."""
    crc = F.crc32(id_col.cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def _stretches(text: Column, id_col: Column, pieces: int, seed: int) -> Column:
    """The text itself if it isn't longer than ``pieces`` windows, else as many of it.

    A piece is short enough to fill one window even if many characters take two bytes.
    """
    size = WINDOW * 3 // 4
    beyond = F.char_length(text) - size + 1

    def piece(k: Column) -> Column:
        place = F.pmod(F.xxhash64(F.lit(seed), id_col, k), beyond.cast("long"))
        return F.substr(text, (place + 1).cast("int"), F.lit(size))

    cut = F.transform(F.sequence(F.lit(1), F.lit(pieces)), piece)
    return F.when(F.char_length(text) <= pieces * WINDOW, F.array(text)).otherwise(cut)


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = 300,
    pieces: int = 5,
    max_docs: int = 20_000,
    seed: int = 42,
) -> Network:
    """Train on a bounded sample of the labelled rows that aren't held out.

    Every label found is learnt, however many there are.
    """
    usable = docs.where(docs[id_col].isNotNull() & ~held_out(docs[id_col]))
    usable = usable.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    labels = usable.groupBy(docs[lang_col].alias("lang")).count().orderBy("lang").collect()
    if not labels:
        return train([])
    per_label = max(1, min(docs_per_language, max_docs // len(labels)))
    # Twice as many as wanted, and a few, are expected below a label's share of the hash.
    shares = []
    for row in labels:
        part = min(1.0, (2 * per_label + 20) / row["count"])
        shares += [F.lit(row["lang"]), F.lit(int(part * (1 << 30)))]
    draw = F.pmod(F.xxhash64(F.lit(seed), docs[id_col]), F.lit(1 << 30))
    text = docs[text_col]
    drawn = usable.where(draw < F.create_map(*shares)[docs[lang_col]]).select(
        draw.alias("draw"),
        docs[id_col].cast("string").alias("id"),
        docs[lang_col].alias("lang"),
        _stretches(text, docs[id_col], pieces, seed).alias("sample"),
    )
    order = Window.partitionBy("lang").orderBy("draw", "id", "sample")
    rows = drawn.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= per_label
    )
    taken = rows.select("lang", "place", "sample").orderBy("lang", "place").collect()
    return train([(piece, row["lang"]) for row in taken for piece in row["sample"]], seed)


def _lettered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([any(map(str.isalpha, x.as_py() or "")) for x in batch], pa.bool_())


_lettered.__annotations__ = {
    "batches": Iterator[pa.Array],
    "return": Iterator[pa.Array],
}


def has_letter(text_col: Column) -> Column:
    """Whether a text has a letter, by the same rule as ``predict``."""
    return F.arrow_udf(_lettered, returnType="boolean")(text_col)


def with_language(
    docs: DataFrame, network: Network, text_col: str = "text", into: str = "language"
) -> DataFrame:
    """``docs`` with a column ``into`` of {lang_pred, score}; one of that name goes."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for begin in range(0, len(batch), 256):
                texts = batch.slice(begin, 256).to_pylist()
                found += shared.value.predict(texts)
            yield pa.StructArray.from_arrays(
                [
                    pa.array([x for x, _ in found], pa.string()),
                    pa.array([x for _, x in found], pa.float64()),
                ],
                names=["lang_pred", "score"],
            )

    predict.__annotations__ = {
        "batches": Iterator[pa.Array],
        "return": Iterator[pa.Array],
    }
    udf = F.arrow_udf(predict, returnType="struct<lang_pred: string, score: double>")
    # Called so, it isn't evaluated once more for a filter on its result.
    return docs.withColumn(into, udf.asNondeterministic()(docs[text_col]))
