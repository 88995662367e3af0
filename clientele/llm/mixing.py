"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's expected number of copies is its source's
target over its source's size; the whole part is certain, the rest is the probability to get one copy
more. Of the documents of a source, those lowest in (random odds / inclusion odds) get that copy, in
this order and as long as they fit into what is left of the target. One that does not fit is passed
over for the next that does, through the whole order: a source misses its target by less than its smallest
document that got no copy. Within a source the inclusion odds are equal, so there the order is that of the random numbers.

Only ids, sizes and hashes move. The order is cut into ranges of about ``RANGE_ROWS`` documents that
are summed first. A round takes the ranges that fit whole, goes through the first one that does not document by document, and
hands what is left on to the documents behind it that are small enough. So a source with a third of all rows costs no task more
than one range, and the rounds end when nothing behind fits.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.frames import kept, whole_row
from clientele.llm.words import words_column

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
RANGE_ROWS = 2048


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size, source_docs), one row per source, to the same with ``target``.

    Targets share 150 % of all words by weight and stop at twice the size of the source; what is beyond is shared
    by weight among the others until none is above. With the sources in order of size over weight this is
    closed: the first ones stop, and a source is among them if the share of what those before it leave is too much for it.
    """
    # One row per source reaches these windows, the only ones without a partition.
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * MOST_COPIES)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (
        rows.withColumn("total", F.sum("source_size").over(all_rows) * (SHARE_PERCENT / 100.0))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("stops", F.col("left_words") * F.col("weight") >= F.col("cap") * F.col("left_weight"))
    )
    rows = (
        rows.withColumn("free_words", F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(all_rows), F.lit(0.0)))
        .withColumn("free_weight", F.sum(F.when(~F.col("stops"), F.col("weight")).otherwise(0.0)).over(all_rows))
    )
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("free_words") * F.col("weight") / F.col("free_weight"))
    return rows.select("source", "source_size", "source_docs", target.alias("target"))


def with_sizes(docs: DataFrame, seed: str) -> DataFrame:
    """Adds nothing of the text but its word count: doc_id, source, ``size``, ``u`` in (0, 1) and a tie breaker."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return docs.select(
        "doc_id", "source",
        F.size(words_column(F.col("text"))).cast("bigint").alias("size"),
        ((number.cast("double") + 0.5) / float(2**52)).alias("u"),
        F.xxhash64("text").alias("tie"),
    )


def _with_targets(sized: DataFrame) -> DataFrame:
    """``sized`` (stored) with source_size, source_docs and target of its source."""
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs")
    )
    targets = kept(source_targets(sums), "targets").withColumnRenamed("source", "_source")
    # Stored, so that its size is known: few sources are sent to all tasks, many are joined by a shuffle with skew handling.
    return sized.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def mixed(sized: DataFrame) -> DataFrame:
    """``sized`` with target, source_size and ``copies`` (whole number) of each document."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        _with_targets(sized)
        .withColumn("certain", F.least(F.floor(ratio), F.lit(MOST_COPIES)).cast("bigint"))
        .withColumn("chance", ratio - F.col("certain"))
        # Sizes are whole, so what is beyond a whole number of words is never filled.
        .withColumn("room", F.floor(F.col("target") - (F.col("certain") * F.col("source_size")).cast("double")).cast("bigint"))
        # Random odds over inclusion odds; the sure and the impossible need no order.
        .withColumn("rank", F.when(
            (F.col("chance") > 0) & (F.col("chance") < 1),
            (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance"))),
        ).otherwise(F.col("u")))
        # u and rank order alike within a source, so ranges of u are ranges of the order, of about equal count.
        .withColumn("range", F.floor(F.col("u") * F.ceil(F.col("source_docs") / RANGE_ROWS)).cast("bigint"))
        .drop("chance", "u", "source_docs")
    )
    rows = kept(rows, "ranked")
    state = rows.groupBy("source").agg(F.max("room").alias("left"), F.lit(-1).cast("bigint").alias("last"))
    spans, edges = None, None
    while True:
        state = kept(state, "left")
        here = rows.join(_sides(state, "source", "left", "last"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        behind = here.filter((F.col("range") > F.col("last")) & (F.col("size") <= F.col("left")) & (F.col("size") > 0))
        sums = behind.groupBy("source", "range").agg(F.sum("size").alias("range_size"), F.max("left").alias("left"))
        sums = sums.withColumn("end", F.sum("range_size").over(Window.partitionBy("source").orderBy("range")))
        # The first range that does not fit whole; none if all do.
        first = sums.groupBy("source").agg(
            F.min(F.when(F.col("end") > F.col("left"), F.struct("range", (F.col("left") - F.col("end") + F.col("range_size")).alias("rest")))).alias("e")
        )
        span = kept(
            first.join(_sides(state, "source", "left", "last"), F.col("source").eqNullSafe(F.col("_source")))
            .select("source", "last", F.col("left").alias("most"), F.col("e.range").alias("edge"), F.col("e.rest").alias("rest")),
            "spans",
        )
        spans = span if spans is None else spans.unionByName(span)
        if span.filter("edge IS NOT NULL").isEmpty():
            break
        found = kept(_filled(rows, span.filter("edge IS NOT NULL")), "edges")
        edges = found if edges is None else edges.unionByName(found)
        state = found.groupBy("source").agg(F.min("left").alias("left"), F.max("range").alias("last")).filter("left > 0")
    spans = spans.groupBy(F.col("source").alias("_source")).agg(F.collect_list(F.struct("last", "most", "edge")).alias("spans"))
    rows = rows.join(kept(spans, "spans"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    at_edge = F.coalesce(F.exists("spans", lambda s: s["edge"] == F.col("range")), F.lit(False))
    taken = F.exists(
        "spans", lambda s: (F.col("range") > s["last"]) & (F.col("size") <= s["most"]) & (s["edge"].isNull() | (F.col("range") < s["edge"]))
    )
    columns = ["doc_id", "source", "size", "tie", "source_size", "target", "certain", "extra"]
    every = rows.filter(~at_edge).withColumn("extra", F.when(taken, 1).otherwise(0)).select(columns)
    every = every if edges is None else every.unionByName(edges.select(columns))
    return every.withColumn("copies", F.col("certain") + F.col("extra")).drop("certain", "extra")


def _sides(state: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per source, to be joined by ``_source``."""
    return state.select(F.col(key).alias(f"_{key}"), *columns)


def _filled(rows: DataFrame, span: DataFrame) -> DataFrame:
    """The documents of the edge ranges in order, each taken (``extra`` 1) if it fits into what is left by then."""
    here = rows.join(_sides(span, "source", "edge", "rest"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("edge")))
    # A range has about RANGE_ROWS documents, whatever the size of its source.
    own = F.struct("rank", F.col("doc_id").isNull().alias("last"), "doc_id", "size", "tie", "source_size", "target", "certain")
    ordered = here.groupBy("source", "range", "rest").agg(F.array_sort(F.collect_list(own)).alias("docs"))
    start = F.struct(F.col("rest").alias("left"), F.array().cast("array<int>").alias("extra"))
    walk = F.aggregate("docs", start, lambda a, x: F.struct(
        F.when(x["size"] <= a["left"], a["left"] - x["size"]).otherwise(a["left"]).alias("left"),
        F.array_append(a["extra"], F.when(x["size"] <= a["left"], 1).otherwise(0)).alias("extra"),
    ))
    walked = ordered.withColumn("walk", walk).select("source", "range", "walk.left", F.explode(F.arrays_zip("docs", "walk.extra")).alias("d"))
    return walked.select("source", "range", "left", "d.docs.*", F.col("d.extra").alias("extra"))


def mix_report(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document doc_id, size, source_size, target (its source's) and taken, the words the mix takes.

    A null text has size 0 and takes nothing; a null source is a source like others, the last; repeated rows
    each count, and may get different copies; an empty table gives an empty result.
    """
    sized = kept(with_sizes(docs, seed), "sizes")
    return mixed(sized).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` (all columns), each as many times as the mix takes it.

    Copies find their rows by doc_id, text hash and source; rows alike in these share their copies evenly.
    Documents without a word are not taken.
    """
    sized = kept(with_sizes(docs, seed), "sizes")
    taken = (
        mixed(sized).groupBy("doc_id", "tie", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"))
        .filter("copies > 0 AND size > 0")
        .withColumnsRenamed({"doc_id": "_doc_id", "tie": "_tie", "source": "_source"})
    )
    rows = docs.select(whole_row(docs).alias("row"), "doc_id", F.xxhash64("text").alias("tie"), "source")
    joined = rows.join(
        taken,
        F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tie") == F.col("_tie"))
        & F.col("source").eqNullSafe(F.col("_source")),
    )
    # Rows alike in id, text and source share their copies evenly; one of them also gets the odd ones.
    share = F.floor(F.col("copies") / F.col("rows"))
    each = joined.select("row", share.cast("int").alias("n"))
    odd = (
        joined.filter(F.col("copies") % F.col("rows") > 0)
        .groupBy("_doc_id", "_tie", "_source")
        .agg(F.first("row").alias("row"), F.first(F.col("copies") % F.col("rows")).cast("int").alias("n"))
        .select("row", "n")
    )
    shared = each.unionByName(odd).filter("n > 0")
    return shared.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
