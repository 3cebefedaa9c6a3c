"""URL filter: explicit rules, and for the rest a character language-model ratio.
DataFrame functions only.

Two variable-order Markov models (contexts of up to ``ORDER`` characters,
Witten-Bell interpolation down to single characters) are counted on the URLs
that the rules allow and block.  A URL's score is the difference of its two
log-likelihoods per character; the cut is calibrated on a quarter of the ruled
URLs, which the models do not see.  Counts and scores are per distinct host and
path, with their multiplicity; a gram is scored once however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.store import Scratch

ORDER = 4
START = "^"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: score units a natural logarithm, and units a bucket of the calibration
_UNITS, _BUCKET = 1_000_000, 10_000
_CLASSES = ("allow", "block")


def parse(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host and path (both empty without ``://`` or url)."""
    text = F.coalesce(F.col(url), F.lit(""))
    return urls.withColumns({
        "host": F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), _UPPER, _LOWER),
        "path": F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)})


def match(parsed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``parsed`` with rule and ruled: the longest fitting rule and its verdict, else null.

    A rule (verdict, ``host/path``) fits its host and all subdomains of it if
    the path starts with the rule's.
    """
    best, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):  # longer ones last: they win
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        best, said = F.when(fits, F.lit(rule)).otherwise(best), F.when(fits, F.lit(verdict)).otherwise(said)
    return parsed.withColumns({"rule": best, "ruled": said})


def _grams(texts: DataFrame) -> DataFrame:
    """A row per character: ``gram`` is the character after its ``ORDER`` predecessors."""
    marked = F.concat(F.lit(START * ORDER), "host", "path")
    return texts.withColumn("__s", marked).withColumn("__i", F.explode(F.sequence(F.lit(1), F.length("__s") - ORDER))) \
        .withColumn("gram", F.expr(f"substring(__s, __i, {ORDER + 1})")).drop("__s", "__i")


def _counted(texts: DataFrame) -> DataFrame:
    """gram and its occurrences in allowed and blocked texts."""
    each = [F.sum(F.when(F.col("ruled") == c, F.col("weight")).otherwise(0)).alias(f"n_{c}") for c in _CLASSES]
    return _grams(texts).groupBy("gram").agg(*each)


def gram_scores(counts: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """gram and units: the scaled difference of the models' log-probabilities of its last character.

    ``counts`` has gram, n_allow, n_block; ``wanted`` the grams to score.
    """
    scored = None
    for order in range(ORDER + 1):
        of_order = counts.groupBy(F.expr(f"right(gram, {order + 1})").alias("gram")).agg(*(F.sum(f"n_{c}").alias(f"n_{c}") for c in _CLASSES))
        of_order = scratch.write(of_order, f"counts-{order}")
        grams = wanted.select(F.expr(f"right(gram, {order + 1})").alias("gram")).distinct()
        found = grams.join(of_order, "gram", "left").fillna(0, [f"n_{c}" for c in _CLASSES])
        if order == 0:
            total = of_order.agg(F.count("*").alias("v"), *(F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(c) for c in _CLASSES)).first()
            chance = {c: (F.col(f"n_{c}") + 1.0) / (total[c] + total["v"] + 1.0) for c in _CLASSES}
        else:
            context = F.expr(f"left(gram, {order})")
            contexts = of_order.groupBy(context.alias("context")).agg(
                *(F.sum(f"n_{c}").alias(f"c_{c}") for c in _CLASSES),
                *(F.sum((F.col(f"n_{c}") > 0).cast("long")).alias(f"t_{c}") for c in _CLASSES))
            found = found.withColumn("context", context).join(scratch.write(contexts, f"contexts-{order}"), "context", "left") \
                .fillna(0, [f"{x}_{c}" for x in "ct" for c in _CLASSES]) \
                .withColumn("shorter", F.expr(f"right(gram, {order})")).join(scored.withColumnRenamed("gram", "shorter"), "shorter")
            chance = {c: F.when(F.col(f"c_{c}") == 0, F.col(f"p_{c}")).otherwise(
                (F.col(f"n_{c}") + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"c_{c}") + F.col(f"t_{c}"))) for c in _CLASSES}
        scored = scratch.write(found.select("gram", *(chance[c].alias(f"q_{c}") for c in _CLASSES))
                               .toDF("gram", *(f"p_{c}" for c in _CLASSES)), f"chance-{order}")
    return scored.select("gram", F.round(_UNITS * (F.ln("p_allow") - F.ln("p_block"))).cast("long").alias("units"))


def cut_of(scored: DataFrame) -> int:
    """The bucket from which on texts are allowed: the best sum of both classes'
    right shares on ruled texts (nearest 0 among equals; 0 if a class has none)."""
    buckets = scored.groupBy("bucket").agg(*(F.sum(F.when(F.col("ruled") == c, F.col("weight")).otherwise(0)).alias(c) for c in _CLASSES))
    rows = sorted(map(tuple, buckets.collect()))  # scores are within +-20, buckets 0.01 wide: a few thousand at most
    allowed, blocked = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allowed or not blocked:
        return 0
    best, right_allow, right_block = (0, 0, 0), allowed, 0
    for bucket, allow, block in rows:
        best = max(best, (right_allow * blocked + right_block * allowed, -abs(bucket), bucket))
        right_allow, right_block = right_allow - allow, right_block + block
    return best[2]


def judge(urls: DataFrame, rules: list[tuple[str, str]], key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict and score (null where a rule decides) of every row.

    A row with neither host nor path (null url, no ``://``) fits no rule and is
    blocked.  Repeated rows and null keys are judged one by one.
    """
    scratch = Scratch(urls.sparkSession, "urls")
    ruled = match(parse(urls.select(F.col(key).alias("__key"), "url")), rules).drop("url")
    quarter = F.crc32(F.concat("host", "path").cast("binary")) % 4 == 0
    texts = ruled.where("host <> '' or path <> ''").groupBy("host", "path", "ruled").agg(F.count("*").alias("weight")) \
        .withColumn("calibrates", quarter)
    texts = scratch.write(texts, "texts")
    counts = scratch.write(_counted(texts.where("ruled is not null and not calibrates")), "counts")
    open_texts = texts.where("ruled is null or calibrates")
    places = scratch.write(_grams(open_texts.select("host", "path")), "places")
    scores = scratch.write(gram_scores(counts, places.select("gram"), scratch), "scores")
    per_text = places.join(scores, "gram").groupBy("host", "path").agg(F.expr("sum(units) div count(*)").alias("units"))
    per_text = scratch.write(open_texts.join(per_text, ["host", "path"]).withColumn("bucket", F.floor(F.col("units") / _BUCKET)), "per-text")
    cut = cut_of(per_text.where("ruled is not null"))
    free = per_text.where("ruled is null").select("host", "path", (F.col("units") / _UNITS).alias("score"),
                                                   F.when(F.col("bucket") >= cut, "allow").otherwise("block").alias("judged"))
    return ruled.join(free, ["host", "path"], "left").select(
        F.col("__key").alias(key), "host", "path", "rule", F.coalesce("ruled", "judged", F.lit("block")).alias("verdict"), "score")
