"""SimHash near-duplicates by meeting in the middle.

Fingerprints link at ``distance`` or fewer differing bits. Every distinct fingerprint emits the
variants of itself within half that distance; the variants are shuffled, and fingerprints that emitted
the same variant collide. For an odd distance the half is rounded down for fingerprints with an even number
of set bits and up for the others: two at exactly that distance differ in parity, so one of each kind meets.
For distance 3 the latter flip pairs of bits only within one half of the 64 bits: of three differing bits two
lie in the same half, so no pair is lost and 992 instead of 2016 variants do.

The fingerprints that share a variant number at most as many as there are variants of it, so no bucket
grows with a group of copies. Within one variant all are linked to one that is within the smaller half, which keeps
them connected with one link each instead of all pairs; every link is verified by its bits.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.components import components, forest
from clientele.llm.frames import kept, whole_row
from clientele.llm.words import mixed

SHINGLE_WORDS = 3
DISTANCE = 3
SEED = 42
BUCKET_VARIANTS = 2_000_000
TASK_VARIANTS = 5_000_000
CHUNK = 4096


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is in over half of the hashes of its word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())),
        dtype=np.uint64, count=len(words) - shingle + 1,
    )
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def with_fingerprints(rows: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Rows of (key columns..., text) as (key columns..., fp: bigint). The text is replaced, the rest passes through."""
    keys = [c for c in rows.columns if c != "text"]
    schema = rows.select(*keys).withColumn("fp", F.lit(0).cast("bigint")).schema

    def hashed(batches):
        for batch in batches:
            prints = [fingerprint(text, shingle) for text in batch.column("text").to_pylist()]
            fps = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [fps], names=[*keys, "fp"])

    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(hashed, schema)


def masks(distance: int, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bits to flip for each variant, and how many they are."""
    low, high = distance // 2, distance // 2 + distance % 2
    flips = [bits for r in range(low + 1) for bits in combinations(range(64), r)]
    if odd and high > low:
        top = combinations(range(64), high)
        flips += [bits for bits in top if distance != 3 or bits[0] // 32 == bits[1] // 32]
    values = np.array([sum(1 << bit for bit in bits) for bits in flips], dtype=np.uint64)
    return values, np.array([len(bits) for bits in flips], dtype=np.uint8)


def _bit_count(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def _emit(distance: int, buckets: int):
    """Distinct fingerprints to rows (bucket, variants, fingerprints, flips), one per bucket and chunk."""

    def emitted(batches):
        kinds = [masks(distance, odd) for odd in (False, True)]
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), CHUNK):
                chunk = fps[k : k + CHUNK]
                odd = _bit_count(chunk) % 2 == 1
                variants, flips = [], []
                for own, (mask, count) in zip((chunk[~odd], chunk[odd]), kinds):
                    variants.append((own[:, None] ^ mask[None, :]).ravel())
                    flips.append(np.tile(np.arange(len(mask), dtype=np.uint16), len(own)))
                variants, flips = np.concatenate(variants), np.concatenate(flips)
                bucket = (mixed(variants) % np.uint64(buckets)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[order], return_index=True)
                parts = np.split(order, first[1:])
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(found.astype(np.int32)),
                    "variants": pa.array([variants[p].tobytes() for p in parts], pa.binary()),
                    "flips": pa.array([flips[p].tobytes() for p in parts], pa.binary()),
                })

    return emitted


def _meet(distance: int):
    """All emitted variants of one bucket to links between the fingerprints that collide."""

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        mask, count = masks(distance, True)
        variants = np.frombuffer(b"".join(frame["variants"]), dtype=np.uint64)
        flips = np.frombuffer(b"".join(frame["flips"]), dtype=np.uint16)
        order = np.argsort(variants)
        variants, flips = variants[order], flips[order]
        same = variants[1:] == variants[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        variants, flips = variants[shared], flips[shared]
        if not len(variants):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        fps, radius = variants ^ mask[flips], count[flips]
        # By variant, those within the smaller half first: the first of each variant is what the others link to.
        order = np.lexsort((fps, radius > distance // 2, variants))
        variants, fps, radius = variants[order], fps[order], radius[order]
        starts = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
        head = np.repeat(starts, np.diff(np.append(starts, len(variants))))
        a, b = fps[head], fps
        true = (_bit_count(a ^ b) <= distance) & (radius[head] <= distance // 2) & (a != b)
        a, b = forest(a[true], b[true])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return met


def close_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """From distinct fingerprints (fp, stored) to links (a, b) that connect exactly those that distances up to ``distance`` connect."""
    emissions = prints.count() * sum(len(masks(distance, odd)[0]) for odd in (False, True)) // 2
    buckets = max(1, -(-emissions // BUCKET_VARIANTS))
    # Few fingerprints make many variants: as many tasks as these need.
    dealt = prints.select("fp").repartition(max(1, -(-emissions // TASK_VARIANTS)))
    sent = dealt.mapInArrow(_emit(distance, buckets), "bucket int, variants binary, flips binary")
    return sent.groupBy("bucket").applyInPandas(_meet(distance), "a bigint, b bigint")


def near_groups(rows: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """Rows of (key columns..., text) as (key columns..., fp, group): group is the same for rows that links connect."""
    hashed = kept(with_fingerprints(rows, shingle), "fingerprints")
    prints = kept(hashed.select("fp").distinct(), "distinct_fingerprints")
    roots = components(close_links(prints, distance)).withColumnRenamed("node", "_node")
    joined = hashed.join(roots, F.col("fp") == F.col("_node"), "left")
    return joined.select(*hashed.columns, F.coalesce("root", "fp").alias("group"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """Per document doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id of its group.

    Null and empty texts have fingerprint zero and link like any other; very long texts are hashed whole; a null doc_id counts for a group only if it has
    no other; repeated rows come back as often as they are there; an empty table gives an empty result.
    """
    grouped = kept(near_groups(docs.select("doc_id", "text"), shingle, distance), "near_groups")
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("group", "_group")
    joined = grouped.join(least, F.col("group") == F.col("_group"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` (all columns), one of each group: that with the smallest doc_id, of equals that with the smallest text hash.

    A null doc_id comes last. Of rows equal in both any one stays.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    grouped = near_groups(rows, shingle, distance)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    chosen = grouped.groupBy("group").agg(F.min(first).alias("f"))
    # Rows can be equal in id and text: they are one group's, and only one of them stays.
    chosen = chosen.select(F.col("f.doc_id").alias("_doc_id"), F.col("f.tie").alias("_tie"))
    keyed = docs.select(whole_row(docs).alias("row"), "doc_id", F.xxhash64("text").alias("tie"))
    stay = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tie") == F.col("_tie")), "left_semi")
    several = kept(
        grouped.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col("doc_id").alias("_doc_id"), F.col("tie").alias("_tie")),
        "repeated",
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tie") == F.col("_tie"))
    single = stay.join(several, same, "left_anti").select("row.*")
    once = stay.join(several, same, "left_semi").groupBy("doc_id", "tie").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(once)
