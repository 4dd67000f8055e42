"""Language identification by a byte convolutional network in numpy.

Filters of several widths run over windows of a fixed number of bytes. As a byte is one of 256, a filter bank
is a table of 256 rows for each of its places, and a convolution is a sum of looked-up rows. Each filter's
maximum over a window (max pooling) goes through a rectifier into a softmax over languages. A text is cut
into windows from end to end, these are batched, and the text's prediction is the mean of its windows' log
probabilities.

The network is fitted on a bounded sample of labelled rows: at most ``per_language`` documents of each
language by the order of a hash, a few windows of each. It never sees rows held out (crc32 of the id's
text, modulo 4, is 2), and neither lang, source nor doc_id when it predicts.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled row
all are ``und``; rows with null lang are predicted, not learned from; a null doc_id isn't held out; texts
of any length are read whole; repeated rows get the same prediction; an empty table gives an empty one.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 20
#: Bounds of the training sample.
PER_LANGUAGE = 900
CROPS = 3
#: Languages whose share is broadcast, at most (a name and a number each); beyond that what is cropped is shuffled.
BROADCAST_LANGUAGES = 10_000
#: Windows that go through the network at once: 10 MB of activations.
BATCH = 512
UNKNOWN = "und"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, crops: int = CROPS) -> list[tuple[str, bytes]]:
    """(language, bytes) of windows of the training rows: at most per_language * crops for a language, of WINDOW characters.

    Only what is cropped from a text leaves its scan, and of it only what can be among the first of a language.
    """
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)))
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.shiftrightunsigned(own, 11).alias("h"), "doc_id", "text")  # h: 53 bits
    starts = [(F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int") for k in range(crops)]
    cropped = rows.select("lang", "h", "doc_id", F.xxhash64("text").alias("th"), F.array(*[F.col("text").substr(s, F.lit(WINDOW)) for s in starts]).alias("parts"))
    # Hashes are even, so by its count a language has some 4 * per_language rows below its reach, however many it has in all.
    reach = Scratch(docs.sparkSession, "language").put(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.count("*")).alias("reach")), "reach")
    few = reach.count() <= BROADCAST_LANGUAGES
    near = cropped.join(F.broadcast(reach) if few else reach.hint("merge"), "lang").filter(F.col("h") <= F.col("reach") * F.lit(float(1 << 53)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "th"))  # rows that share an id go by their texts
    picked = near.select("lang", "h", "doc_id", "th", "parts").withColumn("place", place).filter(F.col("place") <= per_language)
    return sorted((r["lang"], p.encode("utf-8", "surrogatepass")) for r in picked.select("lang", "parts").collect() for p in r["parts"])


def windows(data: bytes) -> np.ndarray:
    """Rows of WINDOW bytes, end to end, with the first bytes of the next window (or spaces) after each."""
    reach = max(WIDTHS) - 1
    n = max(1, -(-len(data) // WINDOW))
    flat = np.full(n * WINDOW + reach, 32, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, WINDOW + reach), (WINDOW, 1))


class Network:
    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.banks = [[rng.normal(0, 0.15, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Each filter's maximum over each window, and where it stands."""
        tops, places = [], []
        for bank in self.banks:
            total = bank[0][rows[:, :WINDOW]]
            for k, weights in enumerate(bank[1:], 1):
                total += weights[rows[:, k : k + WINDOW]]
            if where:
                places.append(total.argmax(axis=1))
            tops.append(total.max(axis=1))
        return (np.concatenate(tops, axis=1), places) if where else np.concatenate(tops, axis=1)

    def log_softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled, 0) @ self.out + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Log probabilities of windows, BATCH at a time."""
        parts = [self.log_softmax(self.pooled(rows[i : i + BATCH])) for i in range(0, len(rows), BATCH)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def fit(self, rows: np.ndarray, labels: np.ndarray, epochs: int = 6, size: int = 128, rate: float = 0.01, seed: int = 3) -> None:
        """Cross entropy by Adam; only the places of the maxima pass gradients to the banks."""
        rng = np.random.default_rng(seed)
        weights = [self.out, self.bias, *(t for bank in self.banks for t in bank)]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        share = 1.0 / np.maximum(1, np.bincount(labels, minlength=len(self.languages)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), size):
                take = order[i : i + size]
                x, y = rows[take], labels[take]
                pooled, places = self.pooled(x, where=True)
                active = np.maximum(pooled, 0)
                probability = np.exp(self.log_softmax(pooled))
                probability[np.arange(len(y)), y] -= 1
                balance = share[y] / share[y].sum()
                delta = probability * balance[:, None].astype(np.float32)
                back = (delta @ self.out.T) * (pooled > 0)
                grads = [active.T @ delta, delta.sum(axis=0)]
                columns = np.arange(FILTERS)
                for b, (bank, at) in enumerate(zip(self.banks, places, strict=True)):
                    part = back[:, b * FILTERS : (b + 1) * FILTERS]
                    for k in range(len(bank)):
                        g = np.zeros((256, FILTERS), np.float32)
                        np.add.at(g, (x[np.arange(len(x))[:, None], at + k], columns[None, :]), part)
                        grads.append(g)
                step += 1
                for w, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def train(examples: list[tuple[str, bytes]], seed: int = 5) -> Network | None:
    """Windows of full length and shorter ones, so that short texts are known too."""
    if not examples:
        return None
    languages = sorted({lang for lang, _ in examples})
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i, (lang, data) in enumerate(examples):
        cut = data if i % 3 else data[: int(rng.integers(8, WINDOW))]
        rows.append(windows(cut[:WINDOW])[0])
        labels.append(languages.index(lang))
    network = Network(languages, seed)
    network.fit(np.array(rows), np.array(labels))
    return network


def predict_texts(network: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; windows of several texts go through the network together."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    held: list[tuple[int, np.ndarray]] = []
    count = 0

    def settle() -> None:
        logs, at = network.predict(np.concatenate([w for _, w in held])), 0
        for i, w in held:
            mean = logs[at : at + len(w)].mean(axis=0, dtype=np.float64)
            at += len(w)
            p = np.exp(mean - mean.max())
            p /= p.sum()
            best = int(p.argmax())
            names[i], scores[i] = network.languages[best], float(p[best])
        held.clear()

    for i, text in enumerate(texts):
        if network and text and any(map(str.isalpha, text)):
            held.append((i, windows(text.encode("utf-8", "surrogatepass"))))
            count += len(held[-1][1])
        if count >= 2 * BATCH:
            settle()
            count = 0
    if held:
        settle()
    return names, scores


#: Texts that pass through Python at once.
CHUNK = 500


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(i, CHUNK)
                names, scores = predict_texts(network, batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    return identify(docs, train(sample(docs)))


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents, unchanged, without those that are ``und`` or score under ``least``. Without labelled rows all stay."""
    network = train(sample(docs))
    if network is None:
        return docs
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(i, CHUNK)
                names, scores = predict_texts(network, batch.column(text).to_pylist())
                yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
