"""Collocations: frequent phrases of each language, by mergeable Misra-Gries summaries and an exact second pass.

First pass: the phrases of up to four words are hashed (with their language) and dealt by hash to partitions of
bounded mass. Each task sends, per partition, summaries of what it read; the summaries of a partition are merged into one
whose capacity exceeds the partition's mass divided by the threshold (``SPARE`` times). Such a summary
loses less than the threshold of any phrase, and it knows how much at most: whatever can reach the threshold survives. Equal hashes
of different phrases only add up, so they keep a phrase too many and never lose one.

Second pass: the survivors become a bit per (partition, hash), a filter of bounded size; occurrences that pass it are
counted exactly, as words, and those below the threshold go. More survivors than one filter holds are
counted in several passes, each over a range of partitions.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.frames import kept
from clientele.llm.words import mixed

THRESHOLD = 30
LONGEST = 4
TOP = 2000
SUBSUMED_PERCENT = 80
SCALE = 2_000_000

SPARE = 2
PARTITION_MASS = 4_000_000
BUFFER = 3_000_000
# Occurrences with their words take more room than hashes.
EXACT_BUFFER = 1_000_000
SLICE_BYTES = 1 << 20
TOKENS = 500_000
WORDS_AT_MOST = 400_000
# The filter has 64 bits for a survivor where they fit, 8 at least, and never more than 64 MB.
FILTER_BITS = 1 << 29
SALTS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_STOP = b"."
_TABLE = bytes(_STOP[0] if c in _BREAKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BETWEEN = re.compile(rb"[\x20\x09-\x0D.,;:!?]")
_STEP = 0x9E3779B97F4A7C15


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, with a full stop as a token wherever a piece ends (no word holds one)."""
    return text.translate(_TABLE).replace(_STOP, b" . ").split()


def slices(text: bytes):
    """A text in parts of about a megabyte, cut between words."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = _BETWEEN.search(text, at + SLICE_BYTES)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


class Vocabulary(dict):
    """Numbers of the words a task has met, exact, and a 64-bit hash of each. Number 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_STOP: 0})
        self.words = [_STOP]
        self._hashes = np.zeros(1024, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        if number == len(self._hashes):
            self._hashes = np.concatenate([self._hashes, np.zeros_like(self._hashes)])
        self._hashes[number] = xxhash.xxh64_intdigest(word)
        return number

    def numbers(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.int32, count=len(found))

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        return self._hashes[numbers]


def _stretches(batches, longest: int):
    """Stretches of tokens as (vocabulary, languages, word numbers, language number, whether phrases ending here count)."""
    vocabulary, langs = Vocabulary(), {}
    parts: list[tuple[np.ndarray, int, int]] = []
    held = 0

    def joined():
        numbers = np.concatenate([part for part, _, _ in parts])
        lang = np.concatenate([np.full(len(part), code, dtype=np.int32) for part, code, _ in parts])
        counts = np.concatenate([np.arange(len(part)) >= seen for part, _, seen in parts])
        return vocabulary, list(langs), numbers, lang, counts & (numbers > 0)

    stop = np.zeros(1, dtype=np.int32)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            code = langs.setdefault(lang, len(langs))
            before = stop[:0]
            for part in slices(text):
                numbers = np.concatenate([before, vocabulary.numbers(tokens(part))])
                parts += [(numbers, code, len(before)), (stop, code, 0)]
                held += len(numbers) + 1
                before = numbers[len(numbers) - min(len(numbers), longest - 1) :]
                if held >= TOKENS:
                    yield joined()
                    parts, held = [], 0
                if len(vocabulary.words) > WORDS_AT_MOST:
                    if parts:
                        yield joined()
                        parts, held = [], 0
                    carried = [vocabulary.words[n] for n in before]
                    vocabulary, langs = Vocabulary(), {lang: 0}
                    code, before = 0, vocabulary.numbers(carried)
    if parts:
        yield joined()


def _phrases(stretch, longest: int):
    """For each phrase length: the places where the phrases end, and their 64-bit hashes."""
    vocabulary, langs, numbers, lang, counts = stretch
    factors = [np.uint64(pow(_STEP, k + 1, 2**64) | 1) for k in range(longest + 1)]
    tags = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in langs], dtype=np.uint64)
    total = tags[lang] * factors[longest]
    words = vocabulary.hashes(numbers)
    place = np.arange(len(numbers))
    inside = place - np.maximum.accumulate(np.where(numbers == 0, place, -1))  # words of the piece so far
    for size in range(1, longest + 1):
        total[size - 1 :] += words[: len(words) - size + 1] * factors[size - 1]
        ends = np.flatnonzero(counts & (inside >= size))
        yield size, ends, mixed(total[ends] + np.uint64(pow(_STEP, longest + 1 + size, 2**64)))


def _cells(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Partition and 32-bit key of a hash in one number that sorts by partition."""
    part = ((hashes >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)
    return (part << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit keys and their counts, as compressed differences."""
    gaps = np.diff(keys.astype(np.uint32), prepend=np.uint32(0))
    planes = np.stack([gaps, np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)]).view(np.uint8).reshape(2, -1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    both = np.ascontiguousarray(planes.reshape(2, 4, -1).transpose(0, 2, 1)).view(np.uint32)[:, :, 0]
    return np.cumsum(both[0], dtype=np.uint32), both[1].astype(np.int64)


def merged(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The Misra-Gries summary of (key, count) rows: at most ``capacity`` keys, and what any key lost at most."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    keys, counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    lost = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    stay = counts > lost
    return keys[stay], counts[stay] - lost, lost


def _summaries(longest: int, partitions: int):
    """Texts to rows (part, mass, entries, summary): what a buffer of phrases has in one partition."""

    def emitted(buffer):
        cells, counts = np.unique(np.concatenate(buffer), return_counts=True)
        part = (cells >> np.uint64(32)).astype(np.int64)
        found, first = np.unique(part, return_index=True)
        edges = [*first.tolist(), len(cells)]
        masses = np.add.reduceat(counts, first)
        return pa.RecordBatch.from_pydict({
            "part": pa.array(found.astype(np.int32)),
            "mass": pa.array(masses.astype(np.int64)),
            "entries": pa.array(np.diff(edges).astype(np.int32)),
            "summary": pa.array([packed(cells[s:e], counts[s:e]) for s, e in zip(edges, edges[1:])], pa.binary()),
        })

    def counted(batches):
        buffer, held = [], 0
        for stretch in _stretches(batches, longest):
            for _, ends, hashes in _phrases(stretch, longest):
                buffer.append(_cells(hashes, partitions))
                held += len(ends)
            if held >= BUFFER:
                yield emitted(buffer)
                buffer, held = [], 0
        if held:
            yield emitted(buffer)

    return counted


def _survivors(threshold: int):
    """All summaries of a partition merged: the keys that can have reached the threshold."""

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        mass = int(frame["mass"].sum())
        capacity = SPARE * mass // threshold + 1
        keys, counts, lost = np.empty(0, np.uint32), np.empty(0, np.int64), 0
        waiting, held = [], 0
        rows = len(frame)
        for k, (entries, summary) in enumerate(zip(frame["entries"], frame["summary"])):
            waiting.append(unpacked(summary))
            held += entries
            if held >= 4 * capacity or k == rows - 1:
                keys, counts, more = merged(
                    np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([counts, *(x for _, x in waiting)]), capacity
                )
                lost += more
                waiting, held = [], 0
        stay = keys[counts + lost >= threshold]
        return pd.DataFrame({"part": frame["part"].iloc[:1].to_numpy(), "survivors": [len(stay)], "keys": [stay.tobytes()]})

    return joined


def _bits(first: int, log_bits: int):
    """The partition's part of the filter: a bit for the leading bits of each key."""

    def marked(frames):
        for frame in frames:
            made = []
            for keys in frame["keys"]:
                places = np.frombuffer(keys, dtype=np.uint32) >> np.uint32(32 - log_bits)
                bits = np.zeros(1 << log_bits, dtype=np.uint8)
                bits[places] = 1
                made.append(np.packbits(bits, bitorder="little").tobytes())
            yield pd.DataFrame({"part": frame["part"] - first, "bits": made})

    return marked


def _exact(longest: int, partitions: int, first: int, last: int, log_bits: int, filter_bits):
    """Texts to rows (lang, size, phrase, f): exact counts of the phrases that pass the filter, summed over a buffer."""

    def counted(batches):
        bits = np.frombuffer(filter_bits.value, dtype=np.uint8)

        def passing(hashes):
            cells = _cells(hashes, partitions)
            part = (cells >> np.uint64(32)).astype(np.int64) - first
            inside = (part >= 0) & (part < last - first)
            place = (np.where(inside, part, 0) << log_bits) | ((cells & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - log_bits)).astype(np.int64)
            return inside & ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)

        def emitted(vocabulary, langs, buffer):
            hashes = np.concatenate([h for h, _ in buffer])
            rows = np.concatenate([r for _, r in buffer])
            _, at, group, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            if not np.array_equal(rows[at][group], rows):  # two phrases of one hash
                _, at, count = np.unique(rows, axis=0, return_index=True, return_counts=True)
            rows, words = rows[at], vocabulary.words
            text = [b" ".join([words[n] for n in row if n > 0]) for row in rows[:, 1:].tolist()]
            return pa.RecordBatch.from_pydict({
                "lang": pa.array([langs[k] for k in rows[:, 0].tolist()], pa.string()),
                "size": pa.array((rows[:, 1:] > 0).sum(axis=1).astype(np.int32)),
                "phrase": pa.array(text, pa.binary()).cast(pa.string()),
                "f": pa.array(count.astype(np.int64)),
            })

        buffer, held, now = [], 0, None
        for stretch in _stretches(batches, longest):
            vocabulary, langs, numbers, lang, _ = stretch
            if now is not None and now[0] is not vocabulary and held:
                yield emitted(*now, buffer)
                buffer, held = [], 0
            now = (vocabulary, langs)
            for size, ends, hashes in _phrases(stretch, longest):
                stay = passing(hashes)
                ends, hashes = ends[stay], hashes[stay]
                rows = np.zeros((len(ends), longest + 1), dtype=np.int32)
                rows[:, 0] = lang[ends]
                for k in range(size):
                    rows[:, k + 1] = numbers[ends - (size - 1 - k)]
                buffer.append((hashes, rows))
                held += len(ends)
            if held >= EXACT_BUFFER:
                yield emitted(*now, buffer)
                buffer, held = [], 0
        if held:
            yield emitted(*now, buffer)

    return counted


def _word_counts(batches):
    spaces = bytes(0x20 if c in _BREAKS else c for c in range(256))
    for batch in batches:
        counts: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts[lang] = counts.get(lang, 0) + sum(len(part.translate(spaces).split()) for part in slices(text or b""))
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def language_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_totals(docs: DataFrame) -> DataFrame:
    """lang, n: the word occurrences of each language."""
    return language_texts(docs).mapInArrow(_word_counts, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, words: int, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """lang, size, phrase, f: every phrase of up to ``longest`` words that occurs at least ``threshold`` times in its language.

    ``words`` is the number of word occurrences in all texts (it sets the number of hash partitions).
    """
    texts = language_texts(docs)
    partitions = max(1, -(-words * longest // PARTITION_MASS))
    sent = texts.mapInArrow(_summaries(longest, partitions), "part int, mass bigint, entries int, summary binary")
    stay = kept(sent.groupBy("part").applyInPandas(_survivors(threshold), "part int, survivors bigint, keys binary"), "survivors")
    total, most = stay.agg(F.coalesce(F.sum("survivors"), F.lit(0)), F.coalesce(F.max("survivors"), F.lit(0))).first()
    rounds = max(1, -(-total * 8 // FILTER_BITS))
    width = -(-partitions // rounds)
    # As wide as 64 bits for each survivor of the fullest partition, as far as the bound allows.
    log_bits = max(3, min(max(most, 1) * 64 - 1, FILTER_BITS // width, (1 << 32) - 1).bit_length() - 1)
    found = None
    for first in range(0, partitions, width):
        last = min(first + width, partitions)
        segments = stay.filter(F.col("part").between(first, last - 1)).select("part", "keys").mapInPandas(_bits(first, log_bits), "part int, bits binary")
        bits = np.zeros(((last - first) << log_bits) >> 3, dtype=np.uint8)
        for row in segments.toLocalIterator():  # 64 MB in all, by the width above
            at = (row["part"] << log_bits) >> 3
            bits[at : at + len(row["bits"])] = np.frombuffer(row["bits"], dtype=np.uint8)
        sent_bits = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
        counted = texts.mapInArrow(
            _exact(longest, partitions, first, last, log_bits, sent_bits), "lang string, size int, phrase string, f bigint"
        )
        exact = kept(counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= threshold), "phrases")
        found = exact if found is None else found.unionByName(exact)
    return found


def _whole(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (two words or more) with their lowest-scoring cut: lang, size, phrase, a, l, r, score."""
    words = F.split("phrase", " ")
    cuts = phrases.filter("size > 1").select(
        "lang", "size", "phrase", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang", "size", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    left = phrases.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_phrase"), F.col("f").alias("l"))
    right = phrases.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_phrase"), F.col("f").alias("r"))
    cuts = cuts.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase")))
    cuts = cuts.join(right, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
    # Whole numbers beyond 64 bits: decimals divided without a remainder.
    cuts = cuts.withColumn("score", F.expr(f"CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    lowest = cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _not_subsumed(candidates: DataFrame, phrases: DataFrame, percent: int) -> DataFrame:
    """The candidates that no longer one holds with at least ``percent`` of their occurrences."""
    longer = phrases.filter("size > 2").select("lang", "size", F.col("f"), F.split("phrase", " ").alias("words"))
    inner = longer.select("lang", "f", "words", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("part"))
    inner = inner.select("lang", "f", "words", "part", F.explode(F.expr("sequence(1, size - part + 1)")).alias("at"))
    inner = inner.select(F.col("lang").alias("i_lang"), F.array_join(F.slice("words", F.col("at"), F.col("part")), " ").alias("i_phrase"), "f")
    largest = inner.groupBy("i_lang", "i_phrase").agg(F.max("f").alias("longer"))
    held = candidates.join(largest, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")), "left")
    gone = F.coalesce(_whole(F.col("longer")) * 100 >= _whole(F.col("a")) * percent, F.lit(False))
    return held.filter(~gone).drop("i_lang", "i_phrase", "longer")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, percent: int = SUBSUMED_PERCENT
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text; other columns are not looked at. Null languages count as ``und``, null and empty texts have no words,
    very long texts are read in parts of a megabyte that overlap by a phrase, repeated rows count as often as they are there, and an
    empty table gives no rows. Ties in score and count go by the phrase's bytes.
    """
    totals = kept(word_totals(docs), "word_totals")
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    phrases = frequent_phrases(docs, words, threshold, longest)
    candidates = _not_subsumed(scored(phrases), phrases, percent)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language is first cut to its best phrases in each of several parts, so that no task orders all of one language.
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    counts = totals.select(F.col("lang").alias("t_lang"), "n")
    return best.join(counts, F.col("lang") == F.col("t_lang")).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
