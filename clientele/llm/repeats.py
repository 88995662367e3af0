"""Passages that stand earlier in the corpus: word suffixes split by variable-length prefixes, and their nodes at the depth of a window.

The subtrees themselves are not built: below a prefix only the node at the depth of a window is looked up, by a hash of its path. Real
subtrees need the words behind every suffix in its group, some twenty times what is sent now, which the disk does not hold.

A window of ``WINDOW`` words is a repeat if the same words also start earlier (in a smaller document, or
earlier in this one). All suffixes of all documents would be one huge tree; three steps keep to the parts that matter.

1. *Prefixes.* Of every window the prefix-length run with the least hash is its anchor; equal windows have equal anchors, and a text
   has about one anchor in seven words. Anchors are counted over all documents. A window whose anchor stands
   only once lies on a path without a branch, and is left out.
2. *Groups.* The suffixes of the other windows are split by their first ``PREFIX`` words, and by all words of the window where
   that prefix is too frequent for one group. The number of groups follows the size of the texts.
3. *Nodes.* Within a group, suffixes with the same path down to the depth of a window share a deep internal node.
   The first one in document order stays; at all others a repeat starts. A run of neighbouring starts is a passage that stands earlier.

Tasks combine before the shuffle: of the suffixes of one node a task sends only its first, since the others have
an earlier one already. So a passage that stands in a third of all documents is one suffix per task. The same
holds for anchors. Paths are compared by 64-bit hashes of their words.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.frames import kept
from clientele.llm.ngrams import pack, unpack
from clientele.llm.words import WordHashes, gram_hashes

WINDOW = 20
PREFIX = 8
GROUP_ENTRIES = 1_000_000
HELD_ENTRIES = 1_500_000
NO_ID = 2**63 - 1  # the place of a null doc_id: behind all others


def sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of every ``width`` neighbours."""
    if len(values) < width:
        return values[:0]
    span, out = 1, values
    while 2 * span <= width:
        out = least(out[:-span], out[span:])
        span *= 2
    return least(out[: len(values) - width + 1], out[width - span :]) if span < width else out


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of every window of a text, from the word hashes of the text."""
    return sliding(gram_hashes(hashes, PREFIX), WINDOW - PREFIX + 1, np.minimum)


def _by_bucket(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return zip(found.tolist(), np.split(order, first[1:]))


def _doc_runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct neighbours and their run lengths (entries come in document order)."""
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, dtype=np.int64)
    return doc[starts], np.diff(np.append(starts, len(doc)))


def _packed(keys: np.ndarray, values: np.ndarray, parts: int) -> pd.DataFrame:
    """Values with the documents' keys as a few rows, one for each part of the keys."""
    order = np.lexsort((values, keys, keys.view(np.uint64) % np.uint64(parts)))
    keys, values = keys[order], values[order]
    rows = []
    for part, places in _by_bucket((keys.view(np.uint64) % np.uint64(parts)).astype(np.int64)):
        own, runs = _doc_runs(keys[places])
        rows.append((part, own.tobytes(), pack(runs.astype(np.uint32)), pack(values[places])))
    return pd.DataFrame(rows, columns=["part", "keys", "runs", "found"])


PACKED = "part int, keys binary, runs binary, found binary"


def _by_document(packed: DataFrame, kind) -> DataFrame:
    """(key, found) with one row per document: its values, which are no more than its words."""

    def gathered(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.repeat(np.frombuffer(k, np.int64), unpack(r, np.uint32)) for k, r in zip(frame["keys"], frame["runs"])])
        values = np.concatenate([unpack(f, kind) for f in frame["found"]])
        order = np.argsort(keys, kind="stable")
        own, runs = _doc_runs(keys[order])
        parts = np.split(values[order], np.cumsum(runs)[:-1]) if len(own) else []
        return pd.DataFrame({"key": own, "found": pd.Series([p.tobytes() for p in parts], dtype=object)})

    return packed.filter("part >= 0").groupBy("part").applyInPandas(gathered, "key bigint, found binary")


def _repeated_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """The repeated anchors by document, packed; in part -1 the heavy prefixes."""

    def sent(batches):
        hashes, held, size = WordHashes(), [], 0

        def flushed():
            anchors, times, keys = (np.concatenate(part) for part in zip(*held))
            distinct, places = np.unique(anchors, return_inverse=True)
            counts = np.bincount(places, weights=times).astype(np.int64)
            # One entry of each anchor goes to the anchor's bucket; of a locally repeated anchor the others need no
            # answer and go to a bucket of their document.
            first = np.zeros(len(anchors), dtype=bool)
            first[np.unique(places, return_index=True)[1]] = True
            count = counts[places]
            bucket = np.where(first, anchors, keys.view(np.uint64)) % np.uint64(buckets)
            rows = []
            for place, part in _by_bucket(bucket.astype(np.int64)):
                # Documents' entries stay together, so that their key is sent once.
                own, runs = _doc_runs(keys[part])
                rows.append((place, anchors[part].tobytes(), own.tobytes(), pack(runs.astype(np.uint32)), pack(np.where(first, count, 0)[part].astype(np.uint32))))
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(next(columns), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
                names=["bucket", "anchors", "keys", "runs", "counts"],
            )

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                words = hashes.of((text or b"").split())
                found = np.unique(window_anchors(words))
                if len(found):
                    # A text may repeat itself: an anchor counts as often as its words stand there.
                    runs, times = np.unique(gram_hashes(words, PREFIX), return_counts=True)
                    held.append((found, times[np.searchsorted(runs, found)], np.full(len(found), key, dtype=np.int64)))
                    size += len(found)
                    if size >= HELD_ENTRIES:
                        yield flushed()
                        held, size = [], 0
        if held:
            yield flushed()

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        anchors = np.concatenate([np.frombuffer(a, np.uint64) for a in frame["anchors"]])
        keys = np.concatenate([np.repeat(np.frombuffer(k, np.int64), unpack(r, np.uint32)) for k, r in zip(frame["keys"], frame["runs"])])
        counts = np.concatenate([unpack(c, np.uint32) for c in frame["counts"]]).astype(np.int64)
        answered, asked = counts == 0, np.flatnonzero(counts > 0)
        distinct, places = np.unique(anchors[asked], return_inverse=True)
        total = np.bincount(places, weights=counts[asked], minlength=len(distinct))
        repeated = np.concatenate([np.flatnonzero(answered), asked[total[places] >= 2]])
        heavy = distinct[total >= GROUP_ENTRIES]
        found = _packed(keys[repeated], anchors[repeated], buckets)
        if len(heavy):
            found.loc[len(found)] = (-1, b"", b"", pack(heavy))
        return found

    pieces = texts.mapInArrow(sent, "bucket int, anchors binary, keys binary, runs binary, counts binary")
    return kept(pieces.groupBy("bucket").applyInPandas(counted, PACKED), "anchors")


def _repeat_starts(candidates: DataFrame, buckets: int, heavy: np.ndarray) -> DataFrame:
    """From (key, doc_id, text, anchors) to the places where a repeat starts, by document, packed."""

    def sent(batches):
        hashes, held, docs, size = WordHashes(), [], [], 0

        def flushed():
            ids, keys = np.array([d[0] for d in docs]), np.array([d[1] for d in docs])
            rank = np.empty(len(docs), dtype=np.int64)
            # Repeated rows are one document: equal ranks.
            order = np.lexsort((keys, ids))
            rank[order] = np.cumsum(np.concatenate([[0], (np.diff(ids[order]) != 0) | (np.diff(keys[order]) != 0)]))
            by_rank = np.empty(rank.max() + 1, dtype=np.int64)
            by_rank[rank] = np.arange(len(docs))
            lengths = [len(h[0]) for h in held]
            path, prefix, place = (np.concatenate(part) for part in zip(*held))
            at = np.repeat(rank, lengths) << 32 | place
            order = np.lexsort((at, path))
            path, prefix, at = path[order], prefix[order], at[order]
            new = np.concatenate([[True], (path[1:] != path[:-1]) | (at[1:] != at[:-1])])
            path, prefix, at = path[new], prefix[new], at[new]
            first = np.concatenate([[True], path[1:] != path[:-1]])
            key_bucket = keys[by_rank[at >> 32]].view(np.uint64)
            label = np.where(np.isin(prefix, heavy), path, prefix) if len(heavy) else prefix
            bucket = np.where(first, label, key_bucket) % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            path, at, first, bucket = path[order], at[order], first[order], bucket[order]
            rows = []
            for number, part in _by_bucket(bucket.astype(np.int64)):
                for known in (False, True):
                    mine = part[first[part] != known]
                    if not len(mine):
                        continue
                    own, runs = _doc_runs(at[mine] >> 32)
                    own = by_rank[own]
                    rows.append((
                        number, known, b"" if known else path[mine].tobytes(), ids[own].tobytes(), keys[own].tobytes(),
                        pack(runs.astype(np.uint32)), pack(np.diff(at[mine] & 0xFFFFFFFF, prepend=0).astype(np.int32)),
                    ))
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), *(pa.array(c, pa.binary()) for c in columns[2:])],
                names=["bucket", "known", "paths", "ids", "keys", "runs", "places"],
            )

        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("doc_id", "key", "text", "anchors"))
            for doc_id, key, text, anchors in zip(*columns):
                words = hashes.of((text or b"").split())
                places = np.flatnonzero(np.isin(window_anchors(words), np.frombuffer(anchors, np.uint64)))
                held.append((gram_hashes(words, WINDOW)[places], gram_hashes(words, PREFIX)[places], places))
                docs.append((NO_ID if doc_id is None else doc_id, key))
                size += len(places)
                if size >= HELD_ENTRIES:
                    yield flushed()
                    held, docs, size = [], [], 0
        if docs and size:
            yield flushed()

    def grown(frame: pd.DataFrame) -> pd.DataFrame:
        """The nodes of one group: places that share one with an earlier place."""
        paths, ids, keys, places, known = [], [], [], [], []
        for _, row in frame.iterrows():
            runs = unpack(row["runs"], np.uint32)
            own = np.cumsum(unpack(row["places"], np.int32).astype(np.int64))
            paths.append(np.frombuffer(row["paths"], np.uint64) if not row["known"] else np.zeros(len(own), dtype=np.uint64))
            ids.append(np.repeat(np.frombuffer(row["ids"], np.int64), runs))
            keys.append(np.repeat(np.frombuffer(row["keys"], np.int64), runs))
            places.append(own)
            known.append(np.full(len(own), row["known"]))
        paths, ids, keys, places, known = (np.concatenate(part) for part in (paths, ids, keys, places, known))
        asked = np.flatnonzero(~known)
        order = asked[np.lexsort((places[asked], keys[asked], ids[asked], paths[asked]))]
        p = paths[order]
        node = np.concatenate([[0], np.cumsum(p[1:] != p[:-1])]) if len(order) else np.empty(0, dtype=np.int64)
        head = order[np.concatenate([[True], p[1:] != p[:-1]])][node] if len(order) else order
        # A repeated row is the same document and place, not a later one.
        later = order[(ids[head] != ids[order]) | (keys[head] != keys[order]) | (places[head] != places[order])]
        found = np.concatenate([np.flatnonzero(known), later])
        return _packed(keys[found], places[found].astype(np.uint32), buckets)

    pieces = candidates.mapInArrow(sent, "bucket int, known boolean, paths binary, ids binary, keys binary, runs binary, places binary")
    return pieces.groupBy("bucket").applyInPandas(grown, PACKED)


def covered_words(starts: np.ndarray, count: int) -> np.ndarray:
    """Which of ``count`` words a window at one of ``starts`` covers."""
    change = np.zeros(count + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return np.cumsum(change[:count]) > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_words, n_removed, kept_text (the words left, joined by one space) and spans.

    A span is a run of words of which every window stands earlier, as long as possible: two passages side by side are two spans, unless the
    windows across their border stand earlier too.

    A null text has no words; texts shorter than a window lose none; a null doc_id comes after all others. Rows equal in doc_id and text are one document:
    they lose the same words, and none to each other. Very long texts are read whole. Rows that share a doc_id only are ordered by a hash. An empty table gives an empty result.
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # One anchor in about forty bytes, a candidate suffix in about twenty.
    buckets = int(max(1, -(-size // (20 * GROUP_ENTRIES))))
    found = _repeated_anchors(keyed.select("key", "text"), buckets)
    # At most one heavy prefix for GROUP_ENTRIES anchors.
    heavy = [unpack(r.found, np.uint64) for r in found.filter("part < 0").select("found").collect()]
    heavy = np.sort(np.concatenate(heavy)) if heavy else np.empty(0, dtype=np.uint64)
    by_doc = _by_document(found, np.uint64).withColumnsRenamed({"key": "_key", "found": "anchors"})
    candidates = keyed.join(by_doc, F.col("key") == F.col("_key")).drop("_key")
    starts = kept(_repeat_starts(candidates, buckets, heavy), "starts")
    by_doc = _by_document(starts, np.uint32).withColumnsRenamed({"key": "_key", "found": "starts"})

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, starts in zip(*(batch.column(name).to_pylist() for name in ("doc_id", "text", "starts"))):
                words = (text or b"").split()
                if starts:
                    places = np.unique(np.frombuffer(starts, np.uint32)).astype(np.int64)
                    gone = covered_words(places, len(words))
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                    runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
                    spans = [{"start": int(run[0]), "n_words": int(run[-1] - run[0]) + WINDOW} for run in runs]
                else:
                    left, spans = words, []
                rows.append({"doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(left), "kept_text": b" ".join(left), "spans": spans})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))),
    ])
    joined = keyed.join(by_doc, F.col("key") == F.col("_key"), "left").select("doc_id", "text", "starts")
    result = joined.mapInArrow(
        cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text binary, spans array<struct<start: bigint, n_words: bigint>>"
    )
    return result.withColumn("kept_text", F.col("kept_text").cast("string"))
