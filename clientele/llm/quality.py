"""Quality rules with thresholds that adapt to the language and source of a document.

Every document gets its measures with column functions. One mergeable quantile sketch per language, source and
measure then describes what is usual in that group, and a document is rejected for a measure that lies far beyond the usual range of
its own group. The sketch is a histogram of steps of 1 / ``STEPS``: it merges by adding, has a bounded size, errs by less than
a step, and gives the same fences in every run, whatever the order of the rows. A group that holds a third of all rows is one
small state per task. A group of fewer than ``LEAST_GROUP`` documents takes the fences of its language, a language of fewer
those of all: no document sets its own fence.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.frames import kept, whole_row
from clientele.llm.words import BLANKS, words_column

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
STEPS, LARGEST = 1024, 64
LEAST_GROUP = 30
# A fence lies SPANS times the distance from the median to the USUAL quantile beyond the median.
USUAL, SPANS = 0.85, 3.0
# Least distance by measure, so that a group of equals does not reject its nearest neighbours.
LEAST_SPAN = {"symbol_share": 0.02, "dup_line_share": 0.15, "word_length": 1.0}
TWO_SIDED = ("word_length",)


def _halves(values: str, step: int) -> Column:
    """Hashes of neighbouring runs joined: place i gets the hash of the values at i and i + step."""
    count = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, 1, count), F.slice(values, F.lit(1 + step), count), lambda x, y: F.xxhash64(x, y))


def _with_repeated_words(df: DataFrame) -> DataFrame:
    """Adds ``_repeat``: how many of ``_words`` lie in a window of eight words that the text has at least twice.

    Each step is a column of its own, as an expression inside a lambda is computed for every element.
    """
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        df = df.withColumn("_hashes", _halves("_hashes", step))
    # Most texts repeat no window at all; only the others are sorted.
    placed = F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("_placed", placed)

    def repeated(x, j):
        after, before = F.get("_placed", j + 1)["h"], F.get("_placed", j - 1)["h"]
        return x["h"].eqNullSafe(before) | x["h"].eqNullSafe(after)

    df = df.withColumn("_places", F.sort_array(F.transform(F.filter("_placed", repeated), lambda x: x["i"])))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + (i + WINDOW - F.greatest(a["end"], i))).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"].cast("bigint"),
    )
    return df.withColumn("_repeat", covered).drop("_hashes", "_placed", "_places")


def with_measures(docs: DataFrame) -> DataFrame:
    """One row per document: ``row`` (all its columns), ``lang``, ``source`` and the counts ``q``.

    A null text counts as an empty one.
    """
    body = F.coalesce("text", F.lit(""))
    counted = docs.select(whole_row(docs).alias("row"), "lang", "source", body.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = counted.withColumn("_words", words_column(F.col("_text"))).withColumn("_lines", lines)
    return _with_repeated_words(counted).select(
        "row", "lang", "source",
        F.struct(
            F.size("_words").cast("bigint").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
            F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
            F.col("_repeat").alias("n_repeat_words"),
            F.size("_lines").cast("bigint").alias("n_lines"),
        ).alias("q"),
    )


def measures(q: Column) -> dict[str, Column]:
    """Shares and means that can be compared between texts of any length."""
    n_words, n_lines = F.greatest(q["n_words"], F.lit(1)), F.greatest(q["n_lines"], F.lit(1))
    return {
        "symbol_share": q["n_symbols"] / n_words,
        "dup_line_share": q["n_dup_lines"] / n_lines,
        "word_length": q["word_chars"] / n_words,
    }


def base_failed(q: Column) -> Column:
    """Fewer than 20 words, or more than 30 % of them in repeated windows."""
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > REPEAT_PERCENT * q["n_words"])


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, step, n: the histogram of each group. Documents that fail the base rule say nothing about what is usual.

    A value beyond ``LARGEST`` counts as that.
    """
    usable = measured.filter(~base_failed(F.col("q")))
    steps = [
        F.struct(F.lit(name).alias("measure"), F.floor(F.least(c, F.lit(float(LARGEST))) * STEPS).cast("int").alias("step"))
        for name, c in measures(F.col("q")).items()
    ]
    return usable.select("lang", "source", F.inline(F.array(*steps))).groupBy("lang", "source", "measure", "step").agg(F.count(F.lit(1)).alias("n"))


def _ranked(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_docs and the fences of each group of a histogram."""
    summed = histogram.groupBy(*keys, "measure", "step").agg(F.sum("n").alias("n"))
    # A group has at most LARGEST * STEPS steps for a measure.
    group = Window.partitionBy(*keys, "measure")
    summed = summed.withColumn("until", F.sum("n").over(group.orderBy("step"))).withColumn("n_docs", F.sum("n").over(group))

    def at(rank: float) -> Column:
        return F.min(F.when(F.col("until") >= F.ceil(F.col("n_docs") * rank), F.col("step"))) / float(STEPS)

    ranks = summed.groupBy(*keys, "measure").agg(F.max("n_docs").alias("n_docs"), at(1 - USUAL).alias("low"), at(0.5).alias("mid"), at(USUAL).alias("high"))
    by_name = F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "mid", "high"))))
    whole = ranks.groupBy(*keys).agg(F.max("n_docs").alias("n_docs"), by_name.alias("r"))
    columns = []
    for name, least in LEAST_SPAN.items():
        r = F.col("r")[name]
        columns.append((r["mid"] + SPANS * F.greatest(r["high"] - r["mid"], F.lit(least))).alias(f"{name}_high"))
        if name in TWO_SIDED:
            columns.append((r["mid"] - SPANS * F.greatest(r["mid"] - r["low"], F.lit(least))).alias(f"{name}_low"))
    return whole.select(*keys, "n_docs", F.struct(*columns).alias("fences"))


def fences(measured: DataFrame) -> DataFrame:
    """One row per language and source of ``measured`` (stored): the fences ``<measure>_high`` and ``word_length_low``.

    Where no document at all passes the base rule they are null, and nothing is left to judge by them.
    """
    histogram = kept(sketches(measured), "sketches")
    own, lang, every = _ranked(histogram, ["lang", "source"]), _ranked(histogram, ["lang"]), _ranked(histogram.withColumn("all", F.lit(0)), ["all"])
    # One row per group, language and in all: these joins are small however many documents there are.
    groups = measured.select("lang", "source").distinct()
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("n_docs").alias("l_docs"), F.col("fences").alias("l_fences"))
    own = own.select(F.col("lang").alias("o_lang"), F.col("source").alias("o_source"), F.col("n_docs").alias("o_docs"), F.col("fences").alias("o_fences"))
    joined = groups.join(own, F.col("lang").eqNullSafe(F.col("o_lang")) & F.col("source").eqNullSafe(F.col("o_source")), "left")
    joined = joined.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    joined = joined.withColumn("all", F.lit(0)).join(every.select("all", F.col("fences").alias("a_fences")), "all", "left")
    chosen = F.when(F.col("o_docs") >= LEAST_GROUP, F.col("o_fences")).when(F.col("l_docs") >= LEAST_GROUP, F.col("l_fences")).otherwise(F.col("a_fences"))
    return joined.select("lang", "source", chosen.alias("f")).select("lang", "source", "f.*")


def judged(measured: DataFrame) -> DataFrame:
    """``measured`` (a stored table: it is read twice) with ``base_failed`` and ``kept``.

    The fences are stored as well, so their size is known when the join is planned: a few groups
    are sent to all tasks by Spark's own limit, many are joined by a shuffle in which skewed groups are split.
    """
    limits = kept(fences(measured), "fences").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(
        limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    q = F.col("q")
    usual = F.lit(True)
    for name, c in measures(q).items():
        usual &= c <= F.col(f"{name}_high")
        if name in TWO_SIDED:
            usual &= c >= F.col(f"{name}_low")
    failed = base_failed(q)
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(usual, F.lit(True)))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per document doc_id, its counts, ``base_failed`` and ``kept``.

    Null texts count as empty and fail, null languages and sources are a group like others, very long texts are measured whole, repeated
    rows are judged one by one, an empty table gives an empty result. A value at a fence is within it.
    """
    measured = kept(
        with_measures(docs.select("doc_id", "lang", "source", "text")).withColumn("row", F.struct("row.doc_id")), "measured"
    )
    return judged(measured).select(
        "row.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept"
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents (all columns, any extra ones included) that are kept."""
    return judged(kept(with_measures(docs), "measured")).filter("kept").select("row.*")
