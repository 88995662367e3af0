"""Spelling variants: words at one edit, found by walking a trie that is an edge table, level by level.

The trie of all words is a table of edges (depth, node, character, child); a node is the hash of its prefix. States
(word, position, node, edits) start on each word's own path. At each level they join that level's edges: without an edit
so far, a word steps along any other character of the node (a replacement), or skips its own character (a
deletion); with one edit it follows its next character. A deletion read backwards is the insertion, so insertions need no states of
their own. The edit stands where the two words part for the first time, so every pair is met once from
each side. An edge below which only one word is left compares the rest at once; a level without states ends the walk.
Every pair met is verified by its edit distance, so equal hashes of two prefixes add work and never a pair.
"""

import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.frames import kept

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
TYPO_EVERY = 199
# A level's edges are sent to all tasks up to so many rows (about 60 MB); else the states are shuffled to them.
SENT_EDGES = 500_000
COUNTER_WORDS = 500_000
SLICE = 1 << 20

# In Latin-1 the letters A-Z, a-z and U+00C0 to U+00FF are single bytes; all else becomes a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 0x20 for c in range(256))

_NO_LETTER = re.compile(r"[^A-Za-z\u00C0-\u00FF]")


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def typed(key: str, found: list[bytes], every: int = TYPO_EVERY) -> list[bytes]:
    """The runs of a document with the letters deleted that its hashes choose."""
    start = zlib.crc32(f"{key}:".encode())
    plain = [w if w.isascii() else w.decode("latin-1").encode() for w in found]
    hashes = np.fromiter(map(zlib.crc32, plain, repeat(start)), dtype=np.int64, count=len(plain))
    for k in np.flatnonzero(hashes % every == 0).tolist():
        at = int(hashes[k]) % len(found[k])
        found[k] = found[k][:at] + found[k][at + 1 :]
    return found


def _pieces(text: str):
    """A long text in parts of about a million characters, cut before a character that is no letter."""
    at = 0
    while len(text) - at > SLICE:
        cut = _NO_LETTER.search(text, at + SLICE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _counted(least_length: int, every: int):
    def counted(batches):
        counts: Counter = Counter()

        def emitted():
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for part in _pieces(text or ""):
                    counts.update(w for w in typed(key, runs(part), every) if len(w) >= least_length)
                if len(counts) > COUNTER_WORDS:
                    yield emitted()
                    counts.clear()
        if counts:
            yield emitted()

    return counted


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = TYPO_EVERY) -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough. A null doc_id is the empty text in the hash."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    counts = texts.mapInArrow(_counted(least_length, every), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def trie_edges(words: DataFrame) -> DataFrame:
    """depth, node, char, child, words, only: the edges of the trie of ``words`` (word, n).

    ``char`` is empty where a word ends. ``words`` is the number of words below, ``only`` the word (and its n) if there is one.
    """
    length = F.char_length("word")
    paths = words.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("depth"))
    paths = paths.select(
        "depth",
        F.xxhash64(F.expr("substring(word, 1, depth)")).alias("node"),
        F.expr("substring(word, depth + 1, 1)").alias("char"),
        F.xxhash64(F.expr("substring(word, 1, depth + 1)")).alias("child"),
        F.struct("word", "n").alias("w"),
    )
    return paths.groupBy("depth", "node", "char", "child").agg(F.count(F.lit(1)).alias("words"), F.min("w").alias("only"))


def _level(words: DataFrame, states: DataFrame | None, edges: DataFrame, depth: int, small: bool) -> DataFrame:
    """All states that stand at ``depth`` moved along one edge: word, n, at (the next position), and the edge's columns."""
    sides = edges.filter(F.col("depth") == depth).drop("depth")
    sides = F.broadcast(sides) if small else sides
    own = words.filter(F.char_length("word") > depth).select("word", "n", F.lit(depth).alias("at"), F.xxhash64(F.expr(f"substring(word, 1, {depth})")).alias("here"))
    replaced = own.join(sides.filter("char <> ''"), F.col("here") == F.col("node")).filter(F.expr("char <> substring(word, at + 1, 1)"))
    skipped = own.withColumn("at", F.col("at") + 1).filter(F.expr("substring(word, at, 1) <> substring(word, at + 1, 1)"))
    edited = skipped if states is None else skipped.unionByName(states.select("word", "n", "at", F.col("node").alias("here")))
    edited = edited.withColumn("next", F.expr("substring(word, at + 1, 1)"))
    followed = edited.join(sides, (F.col("here") == F.col("node")) & (F.col("next") == F.col("char"))).drop("next")
    moved = replaced.unionByName(followed)
    return moved.select("word", "n", (F.col("at") + 1).alias("at"), "char", "child", "words", "only")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: both directions of all pairs of ``words`` (word, n; stored) at exactly one edit."""
    edges = kept(trie_edges(words).sortWithinPartitions("depth"), "trie")
    rows = dict(edges.groupBy("depth").count().collect())  # one row for each length of word
    found, states, depth = [], None, 0
    while depth in rows:
        moved = kept(_level(words, states, edges, depth, rows[depth] <= SENT_EDGES), "states")
        # The path is at an end, or only one word is left below it: the rest decides.
        rest = F.expr(f"substring(word, at + 1) = substring(only.word, {depth + 2})")
        ended = (F.col("char") == "") | ((F.col("words") == 1) & rest)
        met = moved.filter(ended & (F.col("only.word") != F.col("word")) & (F.levenshtein("word", "only.word", 1) == 1))
        found.append(met.select("word", "n", F.col("only.word").alias("near"), F.col("only.n").alias("near_n")))
        states = moved.filter("char <> '' AND words > 1").select("word", "n", "at", F.col("child").alias("node"))
        depth += 1
    if not found:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    # Replacements are met from both sides, deletions from the longer word.
    shorter = pairs.filter(F.char_length("near") < F.char_length("word"))
    back = shorter.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select("word", "near", "near_n").unionByName(back)


def roots(links: DataFrame) -> DataFrame:
    """word, root from (word, form): the last form of every chain, by doubling the steps until none moves."""
    steps = kept(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("from"), F.col("root").alias("next"))
        longer = steps.join(further, F.col("root") == F.col("from"), "left")
        longer = kept(longer.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return steps


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``words`` (word, n).

    A word's form is its near word of largest n (of equals the first in code-point order), if that n is at least ``ratio`` times its own.
    """
    words = kept(words.select("word", "n"), "words")
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    best = best.select(F.col("word").alias("_word"), "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    strong = F.col("near_n") >= F.col("n") * ratio
    joined = words.join(best, F.col("word") == F.col("_word"), "left")
    forms = kept(
        joined.select(
            "word", F.when(strong, F.col("near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(strong, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(forms.filter("form IS NOT NULL")).select(F.col("word").alias("_word"), "root")
    whole = forms.join(ends, F.col("word") == F.col("_word"), "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (doc_id, text) with their near words, forms and roots, one row per word.

    Null and empty texts have no words; very long texts are read in parts; repeated rows count as often as they are there; ties go by
    code points; an empty table gives no rows. Other columns are not looked at.
    """
    return variant_groups(vocabulary(docs))
