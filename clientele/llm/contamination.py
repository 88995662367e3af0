"""Benchmark decontamination with column functions only.

Windows as long as an item are laid over a document wherever it shares a shingle with the item (any other window has similarity
zero), and get a SimHash of their shingles. A multi-index over Hamming blocks finds the items of that length: the
64 bits are four blocks of 16, two fingerprints within ``RADIUS`` differ in at most ``RADIUS // 4`` bits of some
block, so an item is stored under every value of each block within that many bits, and a window looks up its own four.
All fingerprints within the radius are found this way. What is found is verified exactly:

    similarity = sum w(s) min(c, d) / sum w(s) max(c, d)

over the shingles s (five words) with their counts c in the item and d in the window. A shingle that several items
share weighs w(s) = 1 / (number of items); one the item lacks weighs as much as the item's do on average, so that items which
stand in the benchmark many times are judged like others. The similarity is not below that with all weights 1: weights
may add pairs, and drop none. Windows with the same words are looked up and verified once, however many documents hold them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.frames import kept, whole_row

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS = 4, 16
RADIUS = 15
# So many rows of a few numbers may be sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def normal_words(text: Column) -> Column:
    """Words for comparison: runs of letters, marks and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def with_shingles(df: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``_words`` to ``_shingles``, a hash for every ``size`` consecutive words (none if there are fewer)."""
    df = df.withColumn("_ones", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_shingles", F.col("_ones"))
    for k in range(1, size):
        count = F.greatest(F.size("_ones") - k, F.lit(0))
        df = df.withColumn(
            "_shingles", F.zip_with(F.slice("_shingles", 1, count), F.slice("_ones", F.lit(1 + k), count), lambda x, y: F.xxhash64(x, y))
        )
    return df.drop("_ones")


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of an array of hashes: a bit is set if it is in over half of them."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.when(
            2 * F.aggregate(shingles, F.lit(0).cast("bigint"), lambda n, h: n + F.call_function("getbit", h, b)) > F.size(shingles),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), b),
        ).otherwise(F.lit(0).cast("bigint")),
    )
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def block_value(fp: Column, block: Column) -> Column:
    shifted = F.call_function("shiftrightunsigned", fp, (block * BLOCK_BITS).cast("int"))
    return shifted.bitwiseAND(F.lit(2**BLOCK_BITS - 1))


def _flips(spark) -> DataFrame:
    """All 16-bit values with at most RADIUS // BLOCKS set bits."""
    few = F.bit_count("id") <= RADIUS // BLOCKS
    return spark.range(2**BLOCK_BITS).filter(few).agg(F.collect_list("id").alias("flips"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, step, shingles, weighted): the items with words. An item of fewer than five words is one shingle of ``step`` words."""
    words = benchmark.filter("item_id IS NOT NULL").select("item_id", normal_words(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    words = words.withColumn("step", F.least(F.size("_words"), F.lit(SHINGLE)))
    every = None
    for step in range(1, SHINGLE + 1):
        own = with_shingles(words.filter(F.col("step") == step), step)
        every = own if every is None else every.unionByName(own)
    items = every.select("item_id", "step", F.size("_words").alias("size"), F.col("_shingles").alias("shingles")).distinct()
    single = items.select("item_id", "step", "size", "shingles", F.explode(F.array_distinct("shingles")).alias("h"))
    shared = single.groupBy("step", "h").agg(F.count_distinct("item_id").alias("items"))
    times = F.size(F.filter("shingles", lambda x: x == F.col("h")))
    weighted = F.struct("h", times.alias("c"), (1.0 / F.col("items")).alias("w"), F.array_position("shingles", F.col("h")).alias("at"))
    return single.join(shared, ["step", "h"]).groupBy("item_id", "step", "size", "shingles").agg(F.sort_array(F.collect_list(weighted)).alias("weighted"))


def _sent(few: DataFrame) -> DataFrame:
    """A stored table as the small side of a join if its row count is below the bound."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few


def _windows(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """(key, start, size, step, shingles): the windows of documents that share a shingle with an item, from (key, text)."""
    every = None
    steps = [r.step for r in items.select("step").distinct().collect()]  # five numbers at most
    for step in steps or [SHINGLE]:
        anchors = kept(
            items.filter(F.col("step") == step).select(F.explode("weighted").alias("x"), "size")
            .select(F.col("x.h").alias("h"), F.col("x.at").alias("at"), F.col("size").alias("item_size")).distinct(),
            "anchors",
        )
        shingled = with_shingles(keyed.select("key", normal_words(F.col("text")).alias("_words")), step)
        # The outer form: a plain one adds a filter on the array's size, which would compute the array many times over.
        placed = shingled.select("key", F.size("_words").alias("n"), F.posexplode_outer("_shingles").alias("place", "h"))
        size = F.least("item_size", "n")
        # Of an item only the first place of a shingle is needed: where the item stands, it is met there.
        start = F.least(F.greatest(F.col("place") + 2 - F.col("at"), F.lit(1)), F.col("n") - size + 1)
        own = placed.join(_sent(anchors), "h").select("key", start.cast("int").alias("start"), size.alias("length"), "item_size", F.lit(step).alias("step"))
        every = own if every is None else every.unionByName(own)
    # A document has at most one window for each of its words and each item length.
    by_doc = every.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "length", "item_size", "step")).alias("windows"))
    by_doc = kept(by_doc.withColumnRenamed("key", "_key"), "windows")
    # A row here is as long as its windows are many: those are counted.
    windows = by_doc.agg(F.sum(F.size("windows"))).first()[0] or 0
    small = F.broadcast(by_doc) if windows <= BROADCAST_ROWS else by_doc
    found = keyed.join(small, F.col("key") == F.col("_key")).select("key", "text", "windows").dropDuplicates(["key"])
    found = found.select("key", "windows", normal_words(F.col("text")).alias("_words"))
    result = None
    for step in range(1, SHINGLE + 1):
        mine = found.withColumn("windows", F.filter("windows", lambda w: w["step"] == step)).filter(F.size("windows") > 0)
        own = with_shingles(mine, step)
        own = own.select("key", "_shingles", F.explode("windows").alias("w"))
        own = own.select(
            "key", "w.start", "w.length", F.col("w.item_size").alias("size"), "w.step",
            F.slice("_shingles", F.col("w.start"), F.greatest(F.col("w.length") - F.col("w.step") + 1, F.lit(0))).alias("shingles"),
        )
        result = own if result is None else result.unionByName(own)
    return result


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and an item it holds: doc_id, item_id, start (word place of the best window, from 1), n_words, distance and similarity.

    Null and empty texts hold nothing; items without an id or without words are left out; a document shorter than an item is one
    window; repeated rows come once; a null doc_id is kept as null; empty tables give an empty result.
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    return _hits(keyed, benchmark).select("doc_id", "item_id", "start", "n_words", "distance", "similarity")


def _hits(keyed: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = keyed.sparkSession
    items = kept(benchmark_items(benchmark).withColumn("fp", simhash(F.col("shingles"))), "items")
    windows = _windows(keyed.select("key", "text"), items).filter(F.size("shingles") > 0)
    windows = kept(windows.withColumn("words", F.xxhash64("shingles", "step")), "window_texts")
    # Windows with the same words are one class.
    classes = kept(windows.groupBy("size", "step", "words").agg(F.first("shingles").alias("shingles")).withColumn("fp", simhash(F.col("shingles"))), "classes")
    flips = _flips(spark).first().flips  # 697 numbers
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    index = (
        items.select("item_id", "size", "step", F.col("fp").alias("item_fp"), block)
        .withColumn("value", block_value(F.col("item_fp"), F.col("block")))
        .withColumn("value", F.explode(F.transform(F.lit(flips), lambda f: F.col("value").bitwiseXOR(f))))
    )
    asked = classes.select("size", "step", "words", "fp", block).withColumn("value", block_value(F.col("fp"), F.col("block")))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    found = (
        asked.join(index, ["size", "step", "block", "value"]).withColumn("distance", near).filter(F.col("distance") <= RADIUS)
        .select("size", "step", "words", "item_id", "distance").distinct()
    )
    pairs = found.join(classes.select("size", "step", "words", "shingles"), ["size", "step", "words"]).join(
        items.select("item_id", "size", "step", "weighted"), ["item_id", "size", "step"]
    )
    # Per shingle of the item: its weight, its count there and in the window.
    counted = F.transform(
        "weighted", lambda x: F.struct(x["w"].alias("w"), x["c"].alias("c"), F.size(F.filter("shingles", lambda h: h == x["h"])).alias("d"))
    )
    pairs = pairs.withColumn("counted", counted)
    total = lambda value: F.aggregate("counted", F.lit(0.0), lambda a, x: a + value(x))
    foreign = F.size("shingles") - F.aggregate("counted", F.lit(0), lambda a, x: a + x["d"])
    mean = total(lambda x: x["w"] * x["c"]) / total(lambda x: x["c"])
    weighted = total(lambda x: x["w"] * F.least(x["c"], x["d"])) / (total(lambda x: x["w"] * F.greatest(x["c"], x["d"])) + mean * foreign)
    plain = total(lambda x: F.least(x["c"], x["d"])) / (total(lambda x: F.greatest(x["c"], x["d"])) + foreign)
    true = pairs.withColumn("similarity", F.greatest(weighted, plain)).filter(F.col("similarity") >= SIMILARITY).select("size", "step", "words", "item_id", "distance", "similarity")
    # Few classes are true; the windows of a common one are split by Spark if they are too many for a task.
    hits = windows.select("key", "start", "length", "size", "step", "words").join(kept(true, "matches"), ["size", "step", "words"])
    best = F.struct("similarity", (-F.col("start")).alias("s"), F.col("length").alias("n_words"), (-F.col("distance")).alias("d"))
    hits = hits.groupBy("key", "item_id").agg(F.max(best).alias("b")).select(
        F.col("key").alias("_key"), "item_id", (-F.col("b.s")).alias("start"), F.col("b.n_words"), (-F.col("b.d")).alias("distance"), "b.similarity"
    )
    ids = keyed.select("key", "doc_id")
    return ids.join(_sent(kept(hits, "hits")), F.col("key") == F.col("_key")).drop("_key").dropDuplicates(["key", "item_id"])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no item."""
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select("doc_id", key.alias("key"), "text")
    gone = kept(_hits(keyed, benchmark).select(F.col("key").alias("_key")).distinct(), "contaminated")
    rows = docs.select(whole_row(docs).alias("row"), key.alias("key"))
    return rows.join(_sent(gone), F.col("key") == F.col("_key"), "left_anti").select("row.*")
