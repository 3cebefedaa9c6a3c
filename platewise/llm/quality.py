"""Quality rules with adaptive thresholds, in DataFrame functions only.

``features`` counts on whole texts.  ``sketches`` keeps, per language, source
and measure, a log-linear histogram: values keep their six leading bits, so a
bucket is within 1/32 of its values, a group has a few hundred buckets at
most, and two sketches merge by adding counts (in any order, with the same
result).  ``limits`` reads quartiles from the sketches and sets fences around
them; groups with little support take the fences of their language, then of
all documents.  ``judge`` joins the fences to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.store import Scratch, small

SPACE = r"[ \t\n\x0B\f\r]"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: spread units beyond the quartiles at which a fence stands
REACH = 6
#: documents that a group's sketch must hold, else the next wider group's is read
SUPPORT = 100
#: measure: (expression over the counts, least spread, side that is judged)
MEASURES = {
    "symbol_permille": ("if(word_chars = 0, 0, 1000 * n_symbols div word_chars)", 10, "high"),
    "word_length_tenths": ("if(n_words = 0, 0, 10 * word_chars div n_words)", 6, "both"),
    "dup_line_permille": ("if(n_lines = 0, 0, 1000 * n_dup_lines div n_lines)", 30, "high"),
    "repeat_permille": ("if(n_words = 0, 0, 1000 * n_repeat_words div n_words)", 30, "high"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a text (null: empty).

    n_repeat_words counts the words that lie in a five-word window which the
    text holds twice or more.  Windows are compared by a 64-bit hash of their
    words: equal hashes next to each other in sorted order are repeats, and
    only texts with repeats sort the windows with their places.
    """
    out = df.withColumn("__text", F.coalesce(text, F.lit(""))) \
        .withColumn("__words", F.array_remove(F.split("__text", SPACE + "+"), "")) \
        .withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(NOT_SPACE)))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count("__text", F.lit(SYMBOL)).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__windows": F.when(F.size("__words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("__words") - WINDOW),
            lambda i: F.xxhash64(*(F.get("__words", i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>")),
    }).drop("__text", "__words", "__lines")
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h: bigint, i: int>>")
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed).otherwise(nothing)) \
        .drop("__windows")
    twice = F.filter("__sorted", lambda e, k: F.coalesce(F.get("__sorted", k - 1)["h"] == e["h"], F.lit(False))
                     | F.coalesce(F.get("__sorted", k + 1)["h"] == e["h"], F.lit(False)))
    out = out.withColumn("__places", F.array_sort(F.transform(twice, lambda e: e["i"]))).drop("__sorted")
    # a repeated window covers its words up to the next repeated window's start
    covered = F.transform("__places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__places", k + 1) - p, F.lit(WINDOW))))
    return out.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long")).drop("__places")


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, count: the mergeable sketch of every language and source."""
    values = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), F.col(name).cast("long").alias("value")) for name in MEASURES)))
    shift = "greatest(length(bin(value)) - 6, 0)"
    return counted.select("lang", "source", values.alias("m")).select("lang", "source", "m.*") \
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(value, {shift}), {shift})")) \
        .groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("count"))


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source, and low_ and high_ fences of every measure."""
    levels = [["lang", "source"], ["lang"], []]
    fences = []
    for keys in levels:
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("count").alias("count"))
        whole = Window.partitionBy(*keys, "measure")  # a few hundred buckets
        merged = merged.withColumn("total", F.sum("count").over(whole)).withColumn("upto", F.sum("count").over(whole.orderBy("bucket")))
        quartiles = merged.groupBy(*keys, "measure", "total").agg(
            F.min(F.when(F.expr("4 * upto >= total"), F.col("bucket"))).alias("q1"),
            F.min(F.when(F.expr("4 * upto >= 3 * total"), F.col("bucket"))).alias("q3"))
        least = F.create_map(*(F.lit(x) for name, (_, spread, _) in MEASURES.items() for x in (name, spread)))
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")].cast("long"))
        fences.append(quartiles.select(*keys, "measure", "total", F.struct((F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")).alias("fence")))
    own, wide, every = fences
    chosen = own.alias("o").join(wide.alias("w"), F.expr("o.measure = w.measure and o.lang <=> w.lang")) \
        .join(every.alias("e"), F.expr("o.measure = e.measure")) \
        .selectExpr("o.lang", "o.source", "o.measure",
                    f"case when o.total >= {SUPPORT} then o.fence when w.total >= {SUPPORT} then w.fence else e.fence end as fence")
    each = [F.max(F.when(F.col("measure") == name, F.col(f"fence.{end}"))).alias(f"{end}_{name}") for name in MEASURES for end in ("low", "high")]
    return chosen.groupBy("lang", "source").agg(*each)


def judge(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row (a struct of the carried columns), the counts, base_failed and kept of every document.

    Null, empty and wordless texts have all counts 0 and fail the base rule.
    A null language or source is a group like any other.  Repeated rows are
    judged one by one; carried columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), "lang", "source", F.col("text").alias("__source_text"))
    counted = features(rows, F.col("__source_text")).drop("__source_text")
    counted = counted.withColumns({name: F.expr(value) for name, (value, _, _) in MEASURES.items()})
    counted = scratch.write(counted, "counted")
    fences = scratch.write(limits(scratch.write(sketches(counted), "sketches")), "limits")
    judged = counted.alias("c").join(small(fences).alias("f"), F.expr("c.lang <=> f.lang and c.source <=> f.source"), "left")
    good = F.lit(True)
    for name, (_, _, side) in MEASURES.items():
        good &= F.col(name) <= F.col(f"high_{name}")
        if side == "both":
            good &= F.col(name) >= F.col(f"low_{name}")
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    return judged.select("row", *COUNTS, failed.alias("base_failed"), (~failed & good).alias("kept"))
