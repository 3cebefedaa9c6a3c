"""Substring search for a table of terms over a positional gram index.

``write_index`` stores every gram of one to three characters of each
lower-cased name with its place, in folders by a hash of the gram, sorted by
gram.  ``search_terms`` cuts each term into grams that cover it, reads only the
folders of those grams, and finds the names in which all of them stand at the
right distance: that is the whole term, so no name is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = 256
LONGEST = 3


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def write_index(names: DataFrame, path: str, key: str = "id", name: str = "name") -> None:
    """Index the names (null and empty ones have no grams, equal rows are one, a key may have several names)."""
    text = F.lower(F.col(name))

    def grams(n: int) -> Column:
        at = F.sequence(F.lit(0), F.length("_t") - n)
        each = F.transform(at, lambda i: F.struct(F.substring(F.col("_t"), i + 1, F.lit(n)).alias("gram"), i.alias("at")))
        return F.when(F.length("_t") >= n, each).otherwise(F.array().cast("array<struct<gram: string, at: int>>"))

    rows = names.select(F.col(key).alias("id"), text.alias("_t")).distinct().select(
        "id", F.xxhash64("_t").alias("of"), F.explode(F.concat(*(grams(n) for n in range(1, LONGEST + 1)))).alias("g")).select("id", "of", "g.gram", "g.at")
    (rows.withColumn("folder", _folder(F.col("gram"))).repartitionByRange("folder", "gram", "id").sortWithinPartitions("folder", "gram", "id")
     .write.mode("overwrite").partitionBy("folder").parquet(path))


def pieces(term: Column) -> Column:
    """The grams that cover a term: (gram, offset)."""
    size = F.length(term)
    starts = F.when(size <= LONGEST, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(size - LONGEST, F.lit(0)), F.lit(LONGEST)), F.array(size - LONGEST))))
    return F.transform(starts, lambda i: F.struct(F.substring(term, i + 1, F.lit(LONGEST)).alias("gram"), i.alias("offset")))


def postings(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The index rows in the folders of the wanted grams (at most ``FOLDERS`` numbers reach the driver)."""
    folders = {r["folder"] for r in wanted.select(_folder(F.col("gram")).alias("folder")).distinct().collect()}
    whole = spark.read.parquet(path)
    paths = sorted({f.rsplit("/", 1)[0] for f in whole.inputFiles() if int(f.rsplit("/", 2)[-2].split("=")[1]) in folders})
    return spark.read.schema(whole.schema).option("basePath", path).parquet(*paths) if paths else whole.limit(0)


def search_terms(spark: SparkSession, path: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """term and id: the names that contain each term, without regard to case, once each.

    Null and empty terms find nothing; a term that comes twice is one.
    """
    asked = terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct().withColumn("p", pieces(F.lower("term")))
    wanted = asked.select("term", F.size("p").alias("n"), F.explode("p").alias("p")).select("term", "n", "p.gram", "p.offset")
    met = postings(spark, path, wanted).join(wanted, "gram") \
        .groupBy("term", "id", "of", (F.col("at") - F.col("offset")).alias("start"), "n").agg(F.count("*").alias("found"))
    return met.where("found = n").select("term", "id").distinct()
