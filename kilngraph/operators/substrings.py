"""Substring search through posting lists of character 3-grams.

``build`` numbers the texts in their order and writes, per character position of a text, the gram of up to three characters
that starts there (shorter at the end) with the text's number, once per text; rows lie in buckets of the gram's first character, sorted by gram, so a lookup
reads one bucket and within it the pages of its grams.  A keyword of three or more characters needs all its grams: its
rarest ones (by the stored counts) are intersected, and what is left is verified on the texts.  A shorter keyword is a
prefix of grams.  So no text is read but those that hold the keyword's rarest grams.  ``summary`` counts the texts of
keywords of up to three characters from their numbers alone; the least number is that of the first text.

Defined cases: null texts and keys are left out; a text shorter than three characters has shorter grams only; an empty or
null keyword finds nothing; keywords that repeat are answered once; search is by code points and minds case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilngraph.lineage import cut
from kilngraph.operators.linking import bounded

#: Characters of a gram, buckets of grams and of texts, and grams of a keyword that are intersected.
GRAM, BUCKETS, RAREST = 3, 64, 3


def grams(text: Column) -> Column:
    """The distinct grams of a text, one from each position."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(GRAM))))


def _bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def _words(keywords: DataFrame, keyword_col: str) -> DataFrame:
    return cut(keywords.select(F.col(keyword_col).alias("keyword")).where("keyword <> ''").distinct())


@dataclass
class SubstringIndex:
    """Postings, gram counts and texts below ``root``."""

    spark: SparkSession
    root: str

    @classmethod
    def build(cls, rows: DataFrame, root: str, key_col: str = "id", text_col: str = "name") -> SubstringIndex:
        texts = rows.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).where("key is not null and text <> ''")
        # Numbered by partition and place in it, so the numbers are in the order of the texts.
        texts = cut(texts.orderBy("text", "key").withColumn("row", F.monotonically_increasing_id()))
        # Dealt out again, as the sorted texts are few bytes and each becomes many rows.
        postings = texts.select("text", "row").repartition("row").select(F.explode(grams(F.col("text"))).alias("gram"), "row").withColumn("bucket", _bucket(F.substring("gram", 1, 1)))
        # Rebalancing deals a bucket that is too large to several tasks.
        postings.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{root}/postings")
        out = cls(rows.sparkSession, root)
        counts = out._read("postings").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        counts.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{root}/counts")
        texts = texts.withColumn("bucket", _bucket(F.col("row")))
        texts.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "row").write.partitionBy("bucket").parquet(f"{root}/texts")
        return out

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def _of(self, table: str, grams: DataFrame) -> DataFrame:
        """The rows of a gram table in the buckets that ``grams`` (bounded: those of keywords) lie in."""
        at = [r.bucket for r in grams.select(_bucket(F.substring("gram", 1, 1)).alias("bucket")).distinct().collect()]
        return self._read(table).where(F.col("bucket").isin(at)).drop("bucket")

    def candidates(self, keywords: DataFrame, keyword_col: str = "keyword") -> DataFrame:
        """keyword, row: every text (by number) that holds the keyword, and perhaps some that hold its rarest grams only."""
        words = _words(keywords, keyword_col)
        long, short = words.where(F.length("keyword") >= GRAM), words.where(F.length("keyword") < GRAM)
        mine = long.select("keyword", F.explode(F.filter(grams(F.col("keyword")), lambda g: F.length(g) == GRAM)).alias("gram"))
        mine = cut(mine)
        counted = bounded(mine).join(self._of("counts", mine), "gram", "left").select("keyword", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
        # A gram that no text has has the count 0 and comes first: such a keyword finds nothing.
        rare = cut(counted.groupBy("keyword").agg(F.slice(F.array_sort(F.collect_list("g")), 1, RAREST).alias("rare")))
        needed = rare.select("keyword", F.size("rare").alias("needed"), F.explode("rare").alias("g")).where("g.n > 0").select("keyword", "needed", "g.gram")
        found = self._of("postings", needed).join(bounded(needed), "gram").select("keyword", "needed", "row")
        # A text has a gram once, so one needed gram needs no grouping.
        some = found.where("needed > 1").groupBy("keyword", "row").agg(F.count("*").alias("had"), F.first("needed").alias("needed"))
        found = found.where("needed = 1").select("keyword", "row").unionByName(some.where("had = needed").select("keyword", "row"))
        starts = short.select("keyword", F.col("keyword").alias("gram"))
        for size in range(1, GRAM):
            prefix = self._of("postings", starts).withColumn("start", F.substring("gram", 1, size))
            these = bounded(short.where(F.length("keyword") == size))
            found = found.unionByName(prefix.join(these, F.col("start") == F.col("keyword")).select("keyword", "row").distinct())
        return found

    def _verified(self, keywords: DataFrame, keyword_col: str = "keyword") -> DataFrame:
        """keyword, row, key, text of every text that contains a keyword."""
        found = cut(self.candidates(keywords, keyword_col))
        at = [r.bucket for r in found.select(_bucket(F.col("row")).alias("bucket")).distinct().collect()]  # BUCKETS at most
        texts = self._read("texts").where(F.col("bucket").isin(at)).drop("bucket")
        return texts.join(found, "row").where(F.contains("text", F.col("keyword"))).select("keyword", "row", "key", "text")

    def find(self, keywords: DataFrame, keyword_col: str = "keyword") -> DataFrame:
        """keyword, key, text of every text that contains a keyword."""
        return self._verified(keywords, keyword_col).drop("row")

    def summary(self, keywords: DataFrame, keyword_col: str = "keyword") -> DataFrame:
        """keyword, n, first_text: how many texts contain each keyword that any contains, and the first of them."""
        words = _words(keywords, keyword_col)
        # A keyword that is a gram or begins one is in all its candidates; numbers are counted, no texts are joined.
        sure = self.candidates(words.where(F.length("keyword") <= GRAM))
        found = sure.unionByName(self._verified(words.where(F.length("keyword") > GRAM)).select("keyword", "row"))
        counts = cut(found.groupBy("keyword").agg(F.count("*").alias("n"), F.min("row").alias("row")))
        at = [r.bucket for r in counts.select(_bucket(F.col("row")).alias("bucket")).distinct().collect()]  # BUCKETS at most
        texts = self._read("texts").where(F.col("bucket").isin(at)).select("row", F.col("text").alias("first_text"))
        return texts.join(bounded(counts), "row").select("keyword", "n", "first_text")

    def search(self, keyword: str) -> DataFrame:
        """key, text of every text that contains ``keyword``."""
        return self.find(self.spark.createDataFrame([(keyword,)], "keyword string")).select("key", "text")
