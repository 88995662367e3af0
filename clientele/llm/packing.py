"""Packing tokenized documents into sequences of fixed length by a grouping genetic algorithm on islands.

Documents become token ids, and those longer than a sequence are cut. Full pieces are sequences by themselves; the others are
dealt by a hash to shards of some ten thousand pieces. Several islands evolve packings of each shard: a crossover injects whole
well-filled sequences of one parent into the other, drops the sequences that hold any of their pieces, and places the displaced
pieces again by best fit; a mutation dissolves the worst-filled sequences. Between the epochs the best packing of every island
migrates to the next one. The first packing of each island is best fit decreasing, so none gets worse than that.

Afterwards the sequences with room left are pooled over all shards and evolved again, starting from what they
are: a shard's rest meets the rest of others, and the shards cost no sequences in the end.
"""

import functools
import json
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from clientele.llm.frames import kept, whole_row

LENGTH = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0

SHARD_PIECES = 16_384
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 24
# So many generations without a sequence less end an epoch.
PATIENCE = 8
ROUNDS = 2
WELL_FILLED = 0.97
SEED = 7
CACHE_WORDS = 500_000
GROUP_BYTES = 2_000_000
_MARKS = b".,;:!?"
# Letters of Latin-1 in UTF-8: they have no other composed form, and neither the cross nor the division sign is one.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer's file, read once by the driver (a few MB) and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as file:
        return file.read()


class _Numbers(dict):
    """Words numbered as they come; ``new`` holds those that nobody has looked at yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


@functools.lru_cache(maxsize=1)
def _tokenizers(text: str) -> tuple[tokenizers.Tokenizer, tokenizers.Tokenizer, np.ndarray]:
    """The tokenizer, a bare one, and which ids end a word. Parsing takes a second, so a Python worker keeps them for its next tasks."""
    tokenizer = tokenizers.Tokenizer.from_str(text)
    # Lower-case ASCII letters and marks pass the normalizer and the splitting unchanged; without these they go a quarter faster.
    bare = {**json.loads(text), "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
    names = tokenizer.get_vocab()
    ends = np.zeros(max(names.values()) + 1, dtype=bool)
    ends[[number for name, number in names.items() if name.endswith("</w>")]] = True
    return tokenizer, tokenizers.Tokenizer.from_str(json.dumps(bare)), ends


class Encoder:
    """Token ids of texts (UTF-8). No token spans a blank, so each word is encoded once and looked up afterwards.

    A word of Latin letters with marks behind it is cut there, as the tokenizer does itself; the parts are far fewer than the words, and
    are encoded many at a time.
    """

    def __init__(self, text: str):
        self._tokenizer, self._bare, self._ends = _tokenizers(text)
        self._clear()

    def _clear(self):
        self._words, self._parts = _Numbers(), _Numbers()
        self._halves = np.zeros((0, 2), dtype=np.int64)
        # Part 0 is empty.
        self._parts[b""] = 0
        self._starts = np.zeros(2, dtype=np.int64)
        self._ids = np.empty(0, dtype=np.uint32)

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of new parts. Whole words (a blank before them) are encoded one by one, plain parts as one text."""
        whole = np.fromiter((part[:1] == b" " for part in parts), dtype=bool, count=len(parts))
        sizes = np.zeros(len(parts), dtype=np.int64)
        ascii_only = np.fromiter(map(bytes.isascii, parts), dtype=bool, count=len(parts))
        bare, latin, other, found = np.flatnonzero(~whole & ascii_only), np.flatnonzero(~whole & ~ascii_only), np.flatnonzero(whole), []
        for plain, tokenizer in ((bare, self._bare), (latin, self._tokenizer)):
            for at in range(0, len(plain), 5000):
                some = plain[at : at + 5000]
                text = b" ".join([parts[k] for k in some.tolist()]).decode()
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
                last = np.flatnonzero(self._ends[ids])
                assert len(last) == len(some)
                sizes[some] = np.diff(last, prepend=-1)
                found.append(ids)
        one_by_one = self._tokenizer.encode_batch_fast([parts[k][1:].decode() for k in other.tolist()], add_special_tokens=False)
        lists = [e.ids for e in one_by_one]
        sizes[other] = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        found.append(np.array([i for ids in lists for i in ids], dtype=np.uint32))
        # Back to the order of their numbers.
        order = np.concatenate([bare, latin, other])
        starts, own = np.cumsum(sizes) - sizes, sizes[order]
        ids = np.empty(int(sizes.sum()), dtype=np.uint32)
        ids[np.repeat(starts[order] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = np.concatenate(found)
        return sizes, ids

    def _learn(self):
        """The parts of all new words."""
        number, halves = self._parts.__getitem__, []
        for word in self._words.new:
            letters = word.rstrip(_MARKS)
            if letters.isalpha():
                halves += (number(letters.lower()), number(word[len(letters) :]))
            elif letters and _LATIN.fullmatch(letters):
                halves += (number(letters.decode().lower().encode()), number(word[len(letters) :]))
            else:
                # By a name that no plain part has.
                halves += (number(b" " + word), 0)
        self._words.new = []
        sizes, ids = self._encoded(self._parts.new)
        self._parts.new = []
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(sizes)])
        self._ids = np.concatenate([self._ids, ids])
        self._halves = np.concatenate([self._halves, np.array(halves, dtype=np.int64).reshape(-1, 2)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self._words) > CACHE_WORDS:
            self._clear()
        number = self._words.__getitem__
        numbered = []
        for text in texts:
            words = text.split()
            numbered.append(np.fromiter(map(number, words), dtype=np.int64, count=len(words)))
        if self._words.new:
            self._learn()
        done = []
        for numbers in numbered:
            parts = self._halves[numbers].ravel()
            starts = self._starts[parts]
            sizes = self._starts[parts + 1] - starts
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            done.append(self._ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)])
        return done


@functools.lru_cache(maxsize=1)
def _encoder(text: str) -> Encoder:
    """One encoder for all tasks of a Python worker, one after the other: words that a task has learned the next one looks up."""
    return Encoder(text)


def _slices(text: bytes):
    at = 0
    while len(text) - at > GROUP_BYTES:
        cut = _BLANK.search(text, at + GROUP_BYTES)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def _cut(tokenizer, length: int, with_ids: bool):
    """Rows (row, text) to rows (row, piece, start, length, ids_crc32[, ids])."""

    def pieces(batches):
        encoder = _encoder(tokenizer.value)

        def rows(source, texts):
            out = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for k, ids in zip(source, texts):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    out["row"].append(k)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    out["ids"].append(part.astype(np.int64) if with_ids else None)
            return out

        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (held == 0 or held + len(texts[end] or b"") <= GROUP_BYTES):
                    held += len(texts[end] or b"") + 1
                    end += 1
                if end == at + 1:
                    encoded = [np.concatenate([ids for part in _slices(texts[at] or b"") for ids in encoder.encode([part])])]
                else:
                    encoded = encoder.encode([text or b"" for text in texts[at:end]])
                out = rows(range(at, end), encoded)
                taken = batch.column("row").take(pa.array(out["row"], pa.int64()))
                columns = [taken, pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
                names = ["row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = end

    return pieces


def token_pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: row (its columns but the text), piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its token ids and then id 0; only one longer than ``length`` is cut. ``tokenizer`` is the tokenizer's file.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))
    rows = docs.select(whole_row(docs.drop("text")).alias("row"), F.col("text").cast("binary").alias("text"))
    schema = rows.select("row").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    schema = schema.add("ids", ArrayType(LongType())) if with_ids else schema
    return rows.mapInArrow(_cut(sent, length, with_ids), schema)


class Packing:
    """Pieces in bins of one length: ``bin`` of each piece, numbered from 0 without gaps."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, length: int):
        _, self.bins = np.unique(bins, return_inverse=True)
        self.fill = np.bincount(self.bins, weights=sizes).astype(np.int64)
        self.sizes, self.length = sizes, length

    @property
    def fitness(self) -> tuple:
        """Fewer bins first, then the evenness of the rest: full bins beside empty ones beat half-full ones."""
        return -len(self.fill), float(np.square(self.fill / self.length).sum())


def best_fit(sizes: np.ndarray, bins: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Places the pieces of ``order``, one after the other, in the bin with the least room that is enough. ``bins`` has -1 for them."""
    placed = bins >= 0
    count = int(bins.max()) + 1 if placed.any() else 0
    room = length - np.bincount(bins[placed], weights=sizes[placed], minlength=count).astype(np.int64)
    # One list of bins for each room, and a bit for each room that has any.
    having: dict[int, list[int]] = {}
    for number, left in enumerate(room.tolist()):
        if 0 < left < length:
            having.setdefault(left, []).append(number)
    mask = 0
    for left in having:
        mask |= 1 << left
    bins = bins.copy()
    for piece in order.tolist():
        size = int(sizes[piece])
        fitting = mask >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            number = having[left].pop()
            if not having[left]:
                mask ^= 1 << left
        else:
            number, left, count = count, length, count + 1
        bins[piece] = number
        left -= size
        if left:
            having.setdefault(left, []).append(number)
            mask |= 1 << left
    return bins


def _by_size(sizes: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    return pieces[np.argsort(-sizes[pieces], kind="stable")]


def crossover(into: Packing, source: Packing, random: np.random.Generator) -> Packing:
    """Whole well-filled bins of ``source`` injected into ``into``; what they displace is placed again by best fit."""
    sizes, length = into.sizes, into.length
    good = np.flatnonzero(source.fill >= WELL_FILLED * length)
    if not len(good):
        good = np.argsort(-source.fill)[: max(1, len(source.fill) // 4)]
    chosen = random.choice(good, size=max(1, int(len(good) * random.uniform(0.05, 0.5))), replace=False)
    injected = np.isin(source.bins, chosen)
    hit = np.zeros(len(into.fill), dtype=bool)
    hit[into.bins[injected]] = True
    bins = np.where(hit[into.bins], -1, into.bins)
    bins[injected] = len(into.fill) + source.bins[injected]
    return Packing(sizes, best_fit(sizes, bins, _by_size(sizes, np.flatnonzero(bins < 0)), length), length)


def mutated(packing: Packing, random: np.random.Generator) -> Packing:
    """The worst-filled bins and a few others dissolved, their pieces placed again by best fit in nearly descending order."""
    count = len(packing.fill)
    worst = np.argsort(packing.fill)[: max(2, count // 10)]
    others = random.choice(count, size=max(1, count // 20), replace=False)
    gone = np.zeros(count, dtype=bool)
    gone[worst], gone[others] = True, True
    bins = np.where(gone[packing.bins], -1, packing.bins)
    free = np.flatnonzero(bins < 0)
    noisy = packing.sizes[free] * random.uniform(0.9, 1.1, len(free))
    return Packing(packing.sizes, best_fit(packing.sizes, bins, free[np.argsort(-noisy, kind="stable")], packing.length), packing.length)


def evolve(population: list[Packing], random: np.random.Generator, generations: int = GENERATIONS, size: int = POPULATION) -> list[Packing]:
    """The population after some generations, best first. It stops early at the least number of bins that can hold the pieces."""
    first = population[0]
    least = math.ceil(int(first.sizes.sum()) / first.length)
    # Pieces of over half a sequence need one each.
    least = max(least, int((first.sizes * 2 > first.length).sum()))
    population = sorted(population, key=lambda p: p.fitness, reverse=True)
    idle = 0
    for _ in range(generations):
        if len(population[0].fill) <= least or idle == PATIENCE:
            break
        best = len(population[0].fill)
        a, b = sorted(random.choice(len(population), size=2, replace=len(population) < 2).tolist())
        child = crossover(population[a], population[b], random) if a != b else mutated(population[a], random)
        child = max(child, mutated(child, random), key=lambda p: p.fitness)
        population = sorted([*population, child], key=lambda p: p.fitness, reverse=True)[:size]
        idle = 0 if len(population[0].fill) < best else idle + 1
    return population


def _first_population(sizes: np.ndarray, start: np.ndarray, length: int, random: np.random.Generator) -> list[Packing]:
    everything = np.arange(len(sizes))
    empty = np.full(len(sizes), -1, dtype=np.int64)
    made = [Packing(sizes, best_fit(sizes, empty, _by_size(sizes, everything), length), length)]
    if (start >= 0).all():
        made.append(Packing(sizes, start, length))
    for _ in range(2):
        noisy = sizes * random.uniform(0.8, 1.2, len(sizes))
        made.append(Packing(sizes, best_fit(sizes, empty, np.argsort(-noisy, kind="stable"), length), length))
    return made


STATE = "shard int, island int, elite boolean, bins binary, count int, evenness double"


def _epoch(length: int, islands: int, epoch: int):
    """One island's packings of one shard, evolved; its best one also for the next island."""

    def evolved(dealt: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        columns = ["shard", "island", "elite", "bins", "count", "evenness"]
        if not len(dealt):
            return pd.DataFrame(columns=columns)
        row = dealt.iloc[0]
        sizes = np.frombuffer(row["sizes"], dtype=np.int32).astype(np.int64)
        random = np.random.default_rng([SEED, int(row["shard"]), int(row["island"]), epoch])
        if len(states):
            population = [Packing(sizes, np.frombuffer(b, dtype=np.int32), length) for b in states.sort_values(["elite", "count", "evenness"])["bins"]]
        else:
            population = _first_population(sizes, np.frombuffer(row["groups"], dtype=np.int64), length, random)
        population = evolve(population, random)
        out = []
        for k, packing in enumerate(population):
            count, evenness = packing.fitness
            kept_row = (row["shard"], row["island"], False, packing.bins.astype(np.int32).tobytes(), -count, evenness)
            out.append(kept_row)
            if k == 0 and islands > 1:
                out.append((row["shard"], (row["island"] + 1) % islands, True, *kept_row[3:]))
        return pd.DataFrame(out, columns=columns)

    return evolved


def _dealt(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("uid")
    return pd.DataFrame({
        "shard": frame["shard"].iloc[:1].to_numpy(), "uids": [frame["uid"].to_numpy(np.int64).tobytes()],
        "sizes": [frame["length"].to_numpy(np.int32).tobytes()], "groups": [frame["group"].to_numpy(np.int64).tobytes()],
    })


def _placed(length: int):
    """A shard's best packing as rows (uid, sequence, offset, fill)."""

    def rows(batches):
        for frame in batches:
            for shard, uids, sizes, bins in zip(frame["shard"], frame["uids"], frame["sizes"], frame["bins"]):
                uids, sizes = np.frombuffer(uids, dtype=np.int64), np.frombuffer(sizes, dtype=np.int32).astype(np.int64)
                bins = np.frombuffer(bins, dtype=np.int32).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                until = np.cumsum(sizes[order])
                first = np.flatnonzero(np.diff(bins[order], prepend=-1))
                before = np.repeat(until[first] - sizes[order][first], np.diff(np.append(first, len(order))))
                fill = np.bincount(bins, weights=sizes).astype(np.int64)
                yield pd.DataFrame({
                    "uid": uids[order], "length": sizes[order], "sequence_id": (int(shard) << 32) | bins[order],
                    "offset": until - sizes[order] - before, "fill": fill[bins[order]],
                })

    return rows


def _evolved(pieces: DataFrame, length: int, first_shard: int, shards: int, islands: int, epochs: int) -> DataFrame:
    """uid, length, sequence_id, offset, fill for pieces (uid, length, group); pieces of one group (-1: none) stay in one shard."""
    home = F.when(F.col("group") >= 0, F.xxhash64("group")).otherwise(F.xxhash64("uid"))
    sharded = pieces.select((F.pmod(home, F.lit(shards)) + first_shard).cast("int").alias("shard"), "uid", "length", "group")
    dealt = kept(sharded.groupBy("shard").applyInPandas(_dealt, "shard int, uids binary, sizes binary, groups binary"), "dealt")
    everywhere = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).groupBy("shard", "island")
    states = dealt.filter("false").selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in STATE.split(", "))])
    for epoch in range(epochs):
        states = kept(everywhere.cogroup(states.groupBy("shard", "island")).applyInPandas(_epoch(length, islands, epoch), STATE), "islands")
    best = states.groupBy("shard").agg(F.min(F.struct("count", (-F.col("evenness")).alias("uneven"), "island", "bins")).alias("best"))
    chosen = dealt.join(best.select(F.col("shard").alias("_shard"), "best.bins"), F.col("shard") == F.col("_shard"))
    return chosen.select("shard", "uids", "sizes", "bins").mapInPandas(
        _placed(length), "uid bigint, length bigint, sequence_id bigint, offset bigint, fill bigint"
    )


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (text and any other columns, given as ``row``) with their place: sequence_id and offset.

    Null and empty texts are one id; very long texts are cut into full sequences and a rest; equal rows are packed each for itself;
    an empty table gives no rows. Pieces of one sequence follow each other without gaps from offset 0.
    """
    cut = token_pieces(docs, length, tokenizer, with_ids)
    stored = kept(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    places = pack_sizes(stored.filter(F.col("length") < length).select("uid", "length"), length).withColumnRenamed("uid", "_uid")
    full = stored.filter(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("bigint")})
    rest = stored.filter(F.col("length") < length).join(places.drop("length"), F.col("uid") == F.col("_uid"))
    return full.drop("uid").unionByName(rest.drop("uid", "_uid"))


def pack_sizes(
    pieces: DataFrame, length: int = LENGTH, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS,
    epochs: int = EPOCHS, rounds: int = ROUNDS,
) -> DataFrame:
    """uid, length, sequence_id, offset for pieces (uid, length; each shorter than ``length``; stored)."""
    left, done, first_shard = pieces.withColumn("group", F.lit(-1).cast("bigint")), None, 0
    for k in range(rounds):
        shards = max(1, -(-left.count() // shard_pieces))
        placed = kept(_evolved(left, length, first_shard, shards, islands, epochs), "placed")
        first_shard += shards
        last = k == rounds - 1 or shards == 1
        final = placed if last else placed.filter(F.col("fill") == length)
        done = final if done is None else done.unionByName(final)
        if last:
            break
        left = placed.filter(F.col("fill") < length).select("uid", "length", F.col("sequence_id").alias("group"))
    return done.drop("fill")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from ``pack`` with ids. A sequence is at most its fixed length, however many rows there are."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(ordered.alias("parts"))
    return joined.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
