"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped arrays.

Counting. Tasks count the words (then the word pairs) of their documents in numpy and send one sorted,
packed piece per shard; a shard merges its pieces. So a frequent word or pair reaches its shard once
per task. Word shards are ranges of the 64-bit word hash, and a word's number is its place among all
sorted hashes. Pair shards are ranges of (first, second) with about equally many tokens; the pairs of a very
frequent first word are spread over several shards by the second word. The number of shards
follows the size of the texts, so a shard's size does not.

Model. Each shard writes its sorted arrays to the shared folder in one piece (a temporary name first, so that
a repeated task does no harm). Workers map these files into memory and look sorted batches up in
them; nothing of the model is sent through the driver but its shard bounds and discounts. The folder
(spark.checkpoint.dir) has to be mounted on all workers, as files elsewhere cannot be mapped.

    P(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) P(w)
    P(w)   = max(n(w) - D'(n(w)), 0) / n + g' / (V + 1)

n(w) counts the words before w, n all distinct pairs, V the distinct tokens; g and g' hand on what the three
discounts (for counts 1, 2, 3 and more) take away. An unknown word has n(w) = 0; after an unknown word P(w) is taken.
"""

import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.frames import kept
from clientele.llm.words import WordHashes
from clientele.session import scratch_path

BYTES_PER_TOKEN = 6
WORDS_PER_SHARD = 2_000_000  # tokens, so at most so many words
PAIRS_PER_SHARD = 1_000_000
FLUSH_TOKENS = 3_000_000
SCORE_TOKENS = 500_000
END = xxhash.xxh64_intdigest(b" ")  # no word holds a blank
STATS = np.dtype([("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("before", "<u4")])


def mounted(path: str) -> str:
    """The path below which workers open a folder of the shared storage."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: files are mapped into memory, so spark.checkpoint.dir has to be a mounted folder")
    return unquote(parts.path) if parts.scheme else path


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array whole or not at all; a second attempt of a task writes the same."""
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(part, "wb") as file:
        np.save(file, array)
    os.replace(part, os.path.join(folder, f"{name}.npy"))


def load(folder: str, name: str) -> np.ndarray:
    return np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")


def pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes: the mostly empty high planes compress to nothing in the shuffle."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def merged(keys: np.ndarray, *sums: np.ndarray) -> tuple:
    """Sorted distinct keys and the sums of the other arrays by key."""
    if not len(keys):
        return (keys, *sums)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[starts], *(np.add.reduceat(s[order], starts) for s in sums))


@dataclass
class Model:
    folder: str
    word_shards: int = 1
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(2, dtype=np.int64))
    bounds: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint64))
    tokens: int = 0
    pairs: int = 0
    discounts: tuple = (0.0, 0.0, 0.0)
    word_discounts: tuple = (0.0, 0.0, 0.0)
    word_rest: float = 1.0
    begin: tuple = (0, 0, 0, 0)

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        bits = self.word_shards.bit_length() - 1
        return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes, -1 for words that training has not seen."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        for shard, part in _runs(self.shard_of(hashes)):
            if self.offsets[shard] == self.offsets[shard + 1]:
                continue
            known = load(self.folder, f"words-{shard}")
            at = np.minimum(np.searchsorted(known, hashes[part]), len(known) - 1)
            found[part] = np.where(known[at] == hashes[part], at + self.offsets[shard], -1)
        return found

    def about(self, ids: np.ndarray, name: str, empty: np.ndarray) -> np.ndarray:
        """Entries of the arrays ``name`` for sorted ids; ``empty`` for -1."""
        result = np.full(len(ids), empty, dtype=empty.dtype)
        shards = np.searchsorted(self.offsets, ids, side="right") - 1
        for shard, part in _runs(shards):
            if shard >= 0:
                result[part] = load(self.folder, f"{name}-{shard}")[ids[part] - self.offsets[shard]]
        return result

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted pair keys, 0 for unseen pairs."""
        counts = np.zeros(len(keys), dtype=np.int64)
        for shard, part in _runs(np.searchsorted(self.bounds, keys, side="right")):
            if not os.path.exists(os.path.join(self.folder, f"pairs-{shard}.npy")):
                continue
            known, small = load(self.folder, f"pairs-{shard}"), load(self.folder, f"counts-{shard}")
            at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
            own = np.where(known[at] == keys[part], small[at], 0).astype(np.int64)
            large = own == 255
            if large.any():
                places, values = load(self.folder, f"large-{shard}")
                own[large] = values[np.searchsorted(places, at[large])]
            counts[part] = own
        return counts


def _runs(sorted_values: np.ndarray):
    """(value, slice) of every run of equal values."""
    if len(sorted_values):
        starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
        for start, end in zip(starts, np.append(starts[1:], len(sorted_values))):
            yield int(sorted_values[start]), slice(start, end)


def text_hashes(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The tokens of a text: its words in lower case (A-Z) and one end."""
    return np.append(hashes.of((text or b"").lower().split()), np.uint64(END))


def _flushes(batches, hashes: WordHashes, limit: int):
    """Token arrays of whole texts, as many as reach ``limit`` tokens, with the length of each text."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.append(text_hashes(text, hashes))
            size += len(held[-1])
            if size >= limit:
                yield np.concatenate(held), np.array([len(h) for h in held])
                held, size = [], 0
    if held:
        yield np.concatenate(held), np.array([len(h) for h in held])


def discounts(counts) -> tuple:
    """Discounts for counts 1, 2 and 3 or more, from how many things were counted once, twice, three and four times."""
    n1, n2, n3, n4 = (float(c) for c in counts)
    if n1 == 0 or n2 == 0:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(value, 0.1), float(k)) for k, value in enumerate(raw, 1))


def _tally(values: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(values, 5).astype(np.int64), minlength=6)[1:5]


def _count_words(texts: DataFrame, model: Model, step: int) -> None:
    """Write the words and their counts; sets tokens, offsets and the pair bounds of ``model``."""
    folder = model.folder

    def sent(batches):
        hashes = WordHashes()
        for tokens, _ in _flushes(batches, hashes, FLUSH_TOKENS):
            keys, counts = np.unique(tokens, return_counts=True)
            rows = [(shard, keys[part].tobytes(), pack(counts[part])) for shard, part in _runs(model.shard_of(keys))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                names=["shard", "keys", "counts"],
            )

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in frame["keys"]])
        keys, counts = merged(keys, np.concatenate([unpack(c, np.int64) for c in frame["counts"]]))
        save(folder, f"words-{shard}", keys)
        save(folder, f"uses-{shard}", counts)
        # Words before which another ``step`` tokens are full: a frequent word comes several times.
        total = np.cumsum(counts)
        cuts = np.searchsorted(total, np.arange(step, total[-1], step)).astype(np.int64)
        return pd.DataFrame({"shard": [shard], "words": [len(keys)], "tokens": [int(total[-1])], "cuts": [cuts.tobytes()]})

    pieces = texts.mapInArrow(sent, "shard int, keys binary, counts binary")
    made = kept(pieces.groupBy("shard").applyInPandas(merge, "shard int, words long, tokens long, cuts binary"), "words").collect()
    sizes = np.zeros(model.word_shards, dtype=np.int64)
    for row in made:
        sizes[row.shard] = row.words
    model.offsets = np.concatenate([[0], np.cumsum(sizes)])
    model.tokens = sum(row.tokens for row in made)
    if model.words >= 2**32 - 1:
        raise ValueError("more than 2^32 distinct words")
    cuts = [np.frombuffer(row.cuts, np.int64) + model.offsets[row.shard] for row in made]
    cuts = np.sort(np.concatenate(cuts)) if cuts else np.empty(0, dtype=np.int64)
    # The beginning of a text is a context of its own, with the number after the last word.
    texts_begun = int(model.about(model.ids(np.array([END], dtype=np.uint64)), "uses", np.zeros(1, dtype=np.int64))[0])
    cuts = np.concatenate([cuts, np.full(texts_begun // step + 1, model.words)])
    bounds = []
    for word, part in _runs(cuts):
        times = part.stop - part.start
        bounds += [(word << 32) + k * (model.words + 1) // times for k in range(times)]
    model.bounds = np.array(bounds, dtype=np.uint64)


def _pairs(model: Model, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the tokens, of the tokens before them, and whether both are known."""
    distinct, places = np.unique(tokens, return_inverse=True)
    ids = model.ids(distinct)[places]
    before = np.concatenate([[0], ids[:-1]])
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = model.words
    return ids, before, (ids >= 0) & (before >= 0)


def _count_pairs(texts: DataFrame, model: Model) -> None:
    """Write the pairs, their counts, and what is known of each word; sets the discounts of ``model``."""
    folder, last = model.folder, model.word_shards

    def sent(batches):
        hashes = WordHashes()
        for tokens, lengths in _flushes(batches, hashes, FLUSH_TOKENS):
            ids, before, _ = _pairs(model, tokens, lengths)
            keys, counts = np.unique(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), return_counts=True)
            rows = []
            for shard, part in _runs(np.searchsorted(model.bounds, keys, side="right")):
                first = np.diff((keys[part] >> np.uint64(32)).astype(np.uint32), prepend=np.uint32(0))
                second = (keys[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((shard, pack(first), pack(second), pack(counts[part].astype(np.uint32))))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(next(columns), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
                names=["shard", "first", "second", "counts"],
            )

    def by_word_shard(ids: np.ndarray):
        shards = np.searchsorted(model.offsets, ids, side="right") - 1
        # The beginning lies behind all words and has a shard of its own.
        shards[ids == model.words] = last
        return _runs(shards)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        first = np.concatenate([np.cumsum(unpack(f, np.uint32), dtype=np.uint32) for f in frame["first"]])
        second = np.concatenate([unpack(s, np.uint32) for s in frame["second"]])
        keys = first.astype(np.uint64) << np.uint64(32) | second
        keys, counts = merged(keys, np.concatenate([unpack(c, np.uint32) for c in frame["counts"]]).astype(np.int64))
        large = np.flatnonzero(counts >= 255)
        save(folder, f"pairs-{shard}", keys)
        save(folder, f"counts-{shard}", np.minimum(counts, 255).astype(np.uint8))
        save(folder, f"large-{shard}", np.stack([large, counts[large]]))
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = [(-1, "tally", _tally(counts).astype(np.int64).tobytes(), b"")]
        contexts, total, n1, n2, n3 = merged(first, counts, (counts == 1) * 1, (counts == 2) * 1, (counts >= 3) * 1)
        for place, part in by_word_shard(contexts):
            numbers = np.stack([total[part], n1[part], n2[part], n3[part]])
            rows.append((place, "context", pack(contexts[part]), pack(numbers.ravel())))
        seconds, times = merged(second, np.ones(len(second), dtype=np.int64))
        for place, part in by_word_shard(seconds):
            rows.append((place, "second", pack(np.diff(seconds[part], prepend=0)), pack(times[part])))
        return pd.DataFrame(rows, columns=["word_shard", "kind", "keys", "numbers"])

    pieces = texts.mapInArrow(sent, "shard int, first binary, second binary, counts binary")
    stats = kept(pieces.groupBy("shard").applyInPandas(merge, "word_shard int, kind string, keys binary, numbers binary"), "pairs")

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["word_shard"].iloc[0])
        start = model.words if shard == last else int(model.offsets[shard])
        size = 1 if shard == last else int(model.offsets[shard + 1]) - start
        own = np.zeros(size, dtype=STATS)
        for kind, keys, numbers in zip(frame["kind"], frame["keys"], frame["numbers"]):
            if kind == "context":
                at = unpack(keys, np.int64) - start
                for name, values in zip(("total", "n1", "n2", "n3"), unpack(numbers, np.int64).reshape(4, -1)):
                    own[name][at] += values.astype(own.dtype[name])
            else:
                at = np.cumsum(unpack(keys, np.int64)) - start
                own["before"][at] += unpack(numbers, np.int64).astype(np.uint32)
        save(folder, f"stats-{shard}", own)
        before = own["before"].astype(np.int64)
        return pd.DataFrame({"tally": [[*_tally(before).tolist(), int((before >= 3).sum()), int(before.sum())]]})

    by_shard = stats.filter("word_shard >= 0").groupBy("word_shard").applyInPandas(gather, "tally array<long>")
    tallies = np.array([r.tally for r in kept(by_shard, "word_stats").collect()] or [[0] * 6], dtype=np.int64).sum(axis=0)
    pair_tally = np.zeros(4, dtype=np.int64)
    for row in stats.filter("word_shard < 0").select("keys").collect():
        pair_tally += np.frombuffer(row.keys, np.int64)
    model.discounts, model.word_discounts = discounts(pair_tally), discounts(tallies[:4])
    model.pairs = int(tallies[5])
    if model.pairs:
        d1, d2, d3 = model.word_discounts
        model.word_rest = (d1 * tallies[0] + d2 * tallies[1] + d3 * tallies[4]) / model.pairs
        model.begin = tuple(load(folder, f"stats-{last}")[0].tolist()[:4])


def _discount(counts: np.ndarray, values: tuple) -> np.ndarray:
    return np.array([0.0, *values])[np.minimum(counts, 3)]


def train(docs: DataFrame) -> Model:
    """Count all of ``docs`` (text); the model's arrays go to the shared folder."""
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + BYTES_PER_TOKEN)).first()[0] or 0
    tokens = size // BYTES_PER_TOKEN + 1
    shards = 1 << max(0, (int(tokens) // WORDS_PER_SHARD).bit_length())
    model = Model(mounted(scratch_path(docs.sparkSession, "bigrams")), word_shards=shards)
    model.offsets = np.zeros(shards + 1, dtype=np.int64)
    _count_words(texts, model, PAIRS_PER_SHARD)
    if model.tokens:
        _count_pairs(texts, model)
    return model


def token_scores(model: Model, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: training count, base probability and model probability, both as log10."""
    distinct, places = np.unique(tokens, return_inverse=True)
    ids = model.ids(distinct)
    by_id = np.argsort(ids, kind="stable")
    uses, stats = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=STATS)
    uses[by_id] = model.about(ids[by_id], "uses", np.zeros((), dtype=np.int64))
    if model.pairs:
        stats[by_id] = model.about(ids[by_id], "stats", np.zeros((), dtype=STATS))
    uses = uses[places]
    base = np.log10((uses + 1) / (model.tokens + model.words + 1))
    if not model.pairs:
        return uses, base, np.full(len(tokens), -np.log10(model.words + 1.0))
    before = stats["before"].astype(np.int64)
    word = np.maximum(before - _discount(before, model.word_discounts), 0) / model.pairs + model.word_rest / (model.words + 1)
    d1, d2, d3 = model.discounts
    begin = np.array([(*model.begin, 0)], dtype=STATS)
    context = np.concatenate([stats, begin])
    total = context["total"].astype(np.float64)
    rest = np.where(total > 0, (d1 * context["n1"] + d2 * context["n2"] + d3 * context["n3"]) / np.maximum(total, 1), 1.0)
    previous = np.concatenate([[0], places[:-1]])
    previous[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = len(ids)
    numbers = np.append(ids, model.words)
    known = (numbers[places] >= 0) & (numbers[previous] >= 0)
    keys = numbers[previous][known].astype(np.uint64) << np.uint64(32) | numbers[places][known].astype(np.uint64)
    pairs, where = np.unique(keys, return_inverse=True)
    counts = np.zeros(len(tokens), dtype=np.int64)
    counts[known] = model.pair_counts(pairs)[where]
    high = np.maximum(counts - _discount(counts, model.discounts), 0) / np.maximum(total[previous], 1)
    return uses, base, np.log10(high + rest[previous] * word[places])


def in_training(doc_id: Column, modulus: int = 7, held: int = 2) -> Column:
    """Documents whose crc32 of the id as text (a null id: the empty text) does not leave the held-out remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus != held


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    A null text is an empty one, whose only token is the end. Repeated rows are scored alike; an empty table gives an
    empty result; without any training text every token has probability 1 / (V + 1) = 1.
    """

    def scored(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts, at = [], 0
            while at < len(texts):
                tokens, lengths = [], []
                while at < len(texts) and sum(lengths) < SCORE_TOKENS:
                    tokens.append(text_hashes(texts[at], hashes))
                    lengths.append(len(tokens[-1]))
                    at += 1
                lengths = np.array(lengths)
                uses, base, score = token_scores(model, np.concatenate(tokens), lengths)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                sums = [np.add.reduceat(values, starts) for values in ((uses > 0) * 1, base, score)]
                parts.append((lengths, *sums))
            lengths, known, base, score = (np.concatenate(p) for p in zip(*parts)) if parts else [np.empty(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(lengths.astype(np.int64)), pa.array(known.astype(np.int64)),
                    pa.array(np.full(len(texts), model.tokens, dtype=np.int64)), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    pa.array(10 ** (-score / np.maximum(lengths, 1)), pa.float64()),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    rows = docs.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(
        scored,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double",
    )


def bigram_scores(docs: DataFrame) -> DataFrame:
    """Learn from the documents in training, score all."""
    return score_texts(docs, train(docs.filter(in_training(F.col("doc_id")))))
