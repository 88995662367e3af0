"""Toxicity: a convolutional classifier over hashed word embeddings, trained here in numpy.

A word's embedding is the sum of three hashed rows: of the word, and of its first four and five bytes, so that an
unseen form of a known stem is not unknown. Filters of several widths run over the whole text, each keeps its largest value
(max pooling), and a logistic unit reads these. Training takes a bounded sample of labelled documents
(``SAMPLE_PER_CLASS`` of each label, those first in a hash order); a text is never cut. The model has a fixed size, so it is
sent to all tasks. All labelled documents that it was not trained on (a part of the sample is held back for small tables) are
scored in Spark and counted by language, label and score; these counts place the score (0.5 is the best single threshold there) and
calibrate one threshold per language.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_CLASS = 4000
# Rows of the tables of words, of stems of four and of stems of five bytes, as bits.
TABLE_BITS = (20, 17, 17)
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
# Passes over the sample, more of them if it is small.
EPOCHS, LEAST_STEPS = 4, 1000
BATCH_DOCS = 32
RATE = 0.1
# So many labelled ids (8 bytes each) may be sent to all tasks.
BROADCAST_KEYS = 500_000
CHUNK_WORDS = 200_000
# Scores are counted in steps of 1 / BINS, up to 2 * MOST_BINS of them.
BINS, MOST_BINS = 64, 2**15
# Lower case for A-Z, a blank for other ASCII characters that are no letter or digit.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


class _Rows(dict):
    """Word to its rows in the three tables (in one number), kept for recent words; the size is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = 0
        for part, bits in zip((word, word[:4], word[:5]), TABLE_BITS):
            value = value << bits | xxhash.xxh64_intdigest(part, bits) >> (64 - bits)
        self[word] = value
        return value


def table_rows(rows: np.ndarray) -> list[np.ndarray]:
    """The rows in each table, taken apart again."""
    found = []
    for bits in reversed(TABLE_BITS):
        found.append(rows & (2**bits - 1))
        rows = rows >> bits
    return found[::-1]


def word_rows(text: bytes | None, rows: _Rows) -> np.ndarray:
    words = (text or b"").translate(_FOLD).split()
    return np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))


@dataclass
class Model:
    tables: list = field(default_factory=list)
    filters: list = field(default_factory=list)
    bias: list = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    cut: float = 0.0
    slope: float = 1.0
    thresholds: dict = field(default_factory=dict)
    # Without both labels there is nothing to learn; every score is then this one.
    constant: float | None = None

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        return sum(table[row] for table, row in zip(self.tables, table_rows(rows)))


def new_model(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.01, shape).astype(np.float32)
    wide = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
    return Model(
        tables=[small(2**bits, DIMENSIONS) for bits in TABLE_BITS],
        filters=[wide(width, DIMENSIONS, FILTERS) for width in WIDTHS],
        bias=[np.full(FILTERS, 0.05, dtype=np.float32) for _ in WIDTHS],
        out=rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32),
    )


def _padded(docs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings of all words with zeros before and after each text so that no filter spans two; starts; and the words' places."""
    gap = max(WIDTHS) - 1
    lengths = np.array([len(d) + gap + 1 for d in docs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    places = np.concatenate([s + gap + np.arange(len(d)) for s, d in zip(starts, docs)]).astype(np.int64)
    x = np.zeros((int(lengths.sum()), DIMENSIONS), dtype=np.float32)
    x[places] = model.embedded(np.concatenate(docs))
    return x, starts, places


def _convolved(x: np.ndarray, model: Model, k: int) -> np.ndarray:
    width = WIDTHS[k]
    y = np.zeros((len(x), FILTERS), dtype=np.float32)
    for j in range(width):
        y[: len(x) - j] += x[j:] @ model.filters[k][j]
    y += model.bias[k]
    return np.maximum(y, 0, out=y)


def logits(docs: list[np.ndarray], model: Model) -> np.ndarray:
    x, starts, _ = _padded(docs, model)
    pooled = np.concatenate([np.maximum.reduceat(_convolved(x, model, k), starts, axis=0) for k in range(len(WIDTHS))], axis=1)
    return pooled @ model.out + model.out_bias


def train(docs: list[np.ndarray], toxic: np.ndarray, model: Model, seed: int = 11) -> None:
    """Stochastic gradient descent with step sizes per parameter (Adagrad); only the places that won the pooling get a gradient."""
    rng = np.random.default_rng(seed)
    table_sums = [np.full(2**bits, 1e-8, dtype=np.float32) for bits in TABLE_BITS]
    filter_sums = [np.full_like(f, 1e-2) for f in model.filters]
    out_sum = np.full_like(model.out, 1e-2)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH_DOCS // len(docs)))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH_DOCS):
            part = order[at : at + BATCH_DOCS]
            own = [docs[i] for i in part]
            x, starts, places = _padded(own, model)
            rows = np.full(len(x), -1, dtype=np.int64)
            rows[places] = np.concatenate(own)
            ends = np.append(starts[1:], len(x))
            pooled, winners = [], []
            for k in range(len(WIDTHS)):
                y = _convolved(x, model, k)
                won = np.stack([s + y[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
                winners.append(won)
                pooled.append(np.take_along_axis(y, won, axis=0))
            features = np.concatenate(pooled, axis=1)
            score = 1 / (1 + np.exp(-np.clip(features @ model.out + model.out_bias, -30, 30)))
            error = ((score - toxic[part]) / len(part)).astype(np.float32)
            inner = error[:, None] * model.out[None, :] * (features > 0)
            grad = features.T @ error
            out_sum += grad**2
            model.out -= RATE * grad / np.sqrt(out_sum)
            model.out_bias -= RATE * float(error.sum())
            touched, gradients = [], []
            for k, width in enumerate(WIDTHS):
                g = inner[:, k * FILTERS : (k + 1) * FILTERS]
                # Before the filters move: what their inputs have to do.
                for j in range(width):
                    place = np.minimum(winners[k] + j, len(x) - 1)
                    touched.append(place.ravel())
                    gradients.append((g[:, :, None] * model.filters[k][j].T[None, :, :]).reshape(-1, DIMENSIONS))
                for j in range(width):
                    place = np.minimum(winners[k] + j, len(x) - 1)
                    step = np.einsum("bfd,bf->df", x[place], g)
                    filter_sums[k][j] += step**2
                    model.filters[k][j] -= RATE * step / np.sqrt(filter_sums[k][j])
                model.bias[k] -= RATE * g.sum(axis=0)
            place, gradient = np.concatenate(touched), np.concatenate(gradients)
            word = rows[place]
            place, gradient, word = place[word >= 0], gradient[word >= 0], word[word >= 0]
            for table, sums, row in zip(model.tables, table_sums, table_rows(word)):
                found, where = np.unique(row, return_inverse=True)
                total = np.zeros((len(found), DIMENSIONS), dtype=np.float32)
                np.add.at(total, where, gradient)
                sums[found] += (total**2).sum(axis=1)
                table[found] -= RATE * total / np.sqrt(sums[found])[:, None]


def _best_cut(values: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the best weighted F1; in the middle of the gap to the next value below."""
    order = np.argsort(-values, kind="stable")
    v, t, w = values[order], toxic[order].astype(bool), weight[order]
    hits, alarms, all_toxic = np.cumsum(w * t), np.cumsum(w * ~t), (w * t).sum()
    f1 = 2 * hits / (hits + alarms + all_toxic)
    f1[:-1][v[:-1] == v[1:]] = -1
    best = int(f1.argmax())
    below = v[best + 1] if best + 1 < len(v) else v[best] - 1.0
    return float((v[best] + below) / 2)


def fit(docs: list[np.ndarray], toxic: np.ndarray) -> tuple[Model, np.ndarray]:
    """Train on four fifths of the sample; also gives the places of these, none if the rest lacks a label and all had to be taken."""
    if not toxic.any() or toxic.all():
        return Model(constant=float(toxic.mean()) if len(toxic) else 0.0), np.empty(0, dtype=np.int64)
    model = new_model()
    rng = np.random.default_rng(3)
    held = np.zeros(len(docs), dtype=bool)
    for label in (0, 1):
        places = np.flatnonzero(toxic == label)
        held[rng.permutation(places)[: len(places) // 5]] = True
    if not (toxic[held] == 0).any() or not (toxic[held] == 1).any():
        train(docs, toxic.astype(np.float32), model)
        return model, np.empty(0, dtype=np.int64)
    train([d for d, h in zip(docs, held) if not h], toxic[~held].astype(np.float32), model)
    return model, np.flatnonzero(~held)


def calibrate(model: Model, langs: list, toxic: np.ndarray, bins: np.ndarray, n: np.ndarray, counts: dict) -> None:
    """Place the score and the thresholds by the counted ``bins``; weights undo that the labels were not left out of the count evenly."""
    values = (bins + 0.5) / BINS
    weights = n * np.array([counts[t] / n[toxic == t].sum() for t in toxic.tolist()])
    model.cut = _best_cut(values, toxic, weights)
    # A slope that brings the median of either label to a clear score.
    spread = _median(values[toxic == 1], n[toxic == 1]) - _median(values[toxic == 0], n[toxic == 0])
    model.slope = float(8.0 / max(spread, 1e-3))
    places: dict = {}
    for k, lang in enumerate(langs):
        places.setdefault(lang, []).append(k)
    for lang, mine in places.items():
        if lang is not None and 0 < toxic[mine].sum() < len(mine):
            model.thresholds[lang] = float(place_score(_best_cut(values[mine], toxic[mine], weights[mine]), model))


def _median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    so_far = np.cumsum(n[order])
    return float(values[order][np.searchsorted(so_far, so_far[-1] / 2)])


def place_score(values: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * (values - model.cut), -50, 50)))


def text_logits(texts: list[bytes | None], model: Model, rows: _Rows) -> np.ndarray:
    """One value per text; long batches are taken in pieces of whole texts."""
    result, held, size = [], [], 0
    for text in texts:
        held.append(word_rows(text, rows))
        size += len(held[-1])
        if size >= CHUNK_WORDS:
            result.append(logits(held, model))
            held, size = [], 0
    if held:
        result.append(logits(held, model))
    return np.concatenate(result).astype(np.float64) if result else np.empty(0)


def scores(texts: list[bytes | None], model: Model, rows: _Rows) -> np.ndarray:
    """One score per text."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    return place_score(text_logits(texts, model, rows), model)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document stay unseen: crc32 of the id as text is divisible by 5 (a null id as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _counted(docs: DataFrame, usable: DataFrame, trained: list[int], model: Model, few: bool) -> list:
    """(lang, toxic, bin, n) over all labelled documents but the held-out and the ``trained`` ones."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vars(model))  # plain arrays: workers may lack this module

    def valued(batches):
        rows, own = _Rows(), Model(**sent.value)
        for batch in batches:
            values = text_logits(batch.column("text").to_pylist(), own, rows)
            bins = np.clip(np.floor(values * BINS), -MOST_BINS, MOST_BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(bins, pa.int32())], names=["doc_id", "lang", "bin"])

    # At most twice SAMPLE_PER_CLASS ids.
    left_out = F.broadcast(spark.createDataFrame([(i,) for i in trained], "doc_id bigint"))
    rows = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(left_out, "doc_id", "left_anti")
    if few:
        rows = rows.join(F.broadcast(usable.select("doc_id")), "doc_id", "left_semi")
    # With more labels all texts are scored before the join, so that no text is shuffled.
    rows = rows.select("doc_id", "lang", F.col("text").cast("binary").alias("text")).mapInArrow(valued, "doc_id bigint, lang string, bin int")
    found = rows.join(usable, "doc_id").groupBy("lang", "toxic", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    sent.unpersist()
    return sorted(found, key=lambda r: (r.lang or "", r.lang is None, r.toxic, r.bin))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most ``SAMPLE_PER_CLASS`` labelled documents of each label, calibrate on all others; never on held-out ones."""
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    docs = docs.select("doc_id", "lang", "text")
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = sum(counts.values()) <= BROADCAST_KEYS
    chosen = None
    for label in (0, 1):
        first = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
        chosen = first if chosen is None else chosen.unionByName(first)
    # At most twice SAMPLE_PER_CLASS ids and labels.
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "lang", F.col("text").cast("binary").alias("text"))

    def hashed(batches):
        rows = _Rows()
        for batch in batches:
            found = [word_rows(t, rows).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), batch.column("lang"), pa.array(found, pa.binary())],
                names=["doc_id", "toxic", "lang", "words"],
            )

    found = sample.mapInArrow(hashed, "doc_id bigint, toxic int, lang string, words binary").collect()
    found.sort(key=lambda r: (r.toxic, xxhash.xxh64_intdigest(bytes(r.words)), r.lang or ""))
    words = [np.frombuffer(r.words, dtype=np.int64) for r in found]
    toxic = np.array([r.toxic for r in found], dtype=np.int64)
    model, trained = fit(words, toxic)
    if model.constant is None:
        bins = _counted(docs, usable, sorted({found[k].doc_id for k in trained}), model, few)
        if {r.toxic for r in bins} != {0, 1}:
            bins = _counted(docs, usable, [], model, few)
        bins = [r for r in bins if r.toxic in (0, 1)]
        own, at, n = (np.array([r[name] for r in bins], dtype=np.int64) for name in ("toxic", "bin", "n"))
        calibrate(model, [r.lang for r in bins], own, at, n, counts)
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per document doc_id, held_out, score, predicted (score >= 0.5), its language's threshold and ``flagged`` by it.

    Empty and null texts get the score of a text without words. A language without both labels has the threshold 0.5.
    Repeated rows are scored alike, equal texts too; very long texts are read whole; other columns are not looked at; an empty table
    gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def scored(batches):
        rows, own = _Rows(), Model(**sent.value)
        for batch in batches:
            result = scores(batch.column("text").to_pylist(), own, rows)
            limits = np.array([own.thresholds.get(lang, 0.5) for lang in batch.column("lang").to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(result, pa.float64()),
                    pa.array((result >= 0.5).astype(np.int32)), pa.array(limits), pa.array(result >= limits),
                ],
                names=["doc_id", "held_out", "score", "predicted", "threshold", "flagged"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(
        scored, "doc_id bigint, held_out boolean, score double, predicted int, threshold double, flagged boolean"
    )
