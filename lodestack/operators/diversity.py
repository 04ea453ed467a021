"""Topics of records and a choice of records that covers many topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE, strip
from ..functions.urls import url_host

# Tags that say nothing about a topic.
GENERIC = ("article", "bookmark", "news", "web", "あとで読む", "未分類")
# What counts as a word of a title.
TITLE_WORDS = r"([A-Za-z][A-Za-z0-9.+#-]{2,}|[一-龯ァ-ヶー]{2,12})"


def topics(tags: Column, title: Column, url: Column, most: int = 3) -> Column:
    """Topics of a record: its tags, else the first words of its title, else its host."""
    given = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull())
    plain = F.transform(given, lambda t: F.regexp_replace(F.regexp_replace(F.lower(strip(t)), "^#+", ""), f"[{WHITE}]+", "-"))
    useful = lambda words: F.array_distinct(F.filter(words, lambda t: (t != "") & ~t.isin(*GENERIC)))
    from_tags = useful(plain)
    words = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(TITLE_WORDS), 1), F.lower)
    from_title = F.slice(useful(words), 1, most)
    host = F.regexp_replace(F.coalesce(F.nullif(url_host(url), F.lit("")), F.lit("unknown")), r"^www\.", "")
    return F.when(F.size(from_tags) > 0, from_tags).when(F.size(from_title) > 0, from_title).otherwise(F.array(host))


def topic_counts(df: DataFrame, topic_column: str = "topics") -> DataFrame:
    return df.select(F.explode(topic_column).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def select_diverse(df: DataFrame, key: str, is_covered: Column, order: list[Column], n: int) -> DataFrame:
    """n records that take turns over topics: key, topic, turn.

    Records that are covered already are left out, and their topics count as covered; the
    others are counted under all of their topics, and each stands for one of them.
    """
    covered = df.where(is_covered).select(F.explode("topics").alias("topic")).distinct()
    rest = df.where(~F.coalesce(is_covered, F.lit(False)))
    counts = topic_counts(rest)
    chosen = choose_topic(rest, key, counts, covered)
    sizes = counts.join(chosen.select("topic").distinct(), "topic", "left_semi").join(covered.withColumn("covered", F.lit(True)), "topic", "left")
    return round_robin(chosen.join(rest, key), "topic", order, sizes, n).select(key, "topic", "turn")


def choose_topic(df: DataFrame, key: str, counts: DataFrame, covered: DataFrame) -> DataFrame:
    """One topic a record: the most frequent, uncovered before covered, then by name."""
    known = counts.join(covered.select("topic").distinct().withColumn("covered", F.lit(True)), "topic", "left")
    rows = df.select(key, F.explode("topics").alias("topic")).join(known, "topic")
    order = F.struct(F.col("n"), F.col("covered").isNull(), F.lit(0))
    # the greatest by count and cover; names are compared downwards by a second aggregation
    best = rows.groupBy(key).agg(F.max(order).alias("__o"))
    return rows.join(best, key).where(order == F.col("__o")).groupBy(key).agg(F.min("topic").alias("topic"))


def round_robin(df: DataFrame, topic: str, order: list[Column], sizes: DataFrame, n: int) -> DataFrame:
    """n rows that take turns over topics, largest and largest uncovered in alternation.

    ``sizes`` holds topic, n (of all records that have it, chosen for it or not) and covered;
    of equal sizes, uncovered topics come first.  Rounds visit topics in the same order and pass over
    exhausted ones, so the choice is that of the rows with the least (rank in topic, place of
    topic).
    """
    # places beyond the n-th of either order cannot be reached: n rows are ranked, a parameter
    sizes = sizes.withColumn("covered", F.coalesce("covered", F.lit(False)))
    order_of = [F.desc("n"), F.asc("covered"), F.asc("topic")]
    first = sizes.orderBy(*order_of).limit(n).withColumn("__i", F.row_number().over(Window.orderBy(*order_of)) - 1).select("topic", "__i")
    fresh = sizes.where(~F.col("covered")).orderBy(*order_of).limit(n).withColumn("__j", F.row_number().over(Window.orderBy(*order_of)) - 1).select("topic", "__j")
    both = first.join(fresh, "topic", "full")
    places = both.select(F.col("topic").alias(topic), F.least(F.col("__i") * 2, F.col("__j") * 2 + 1).alias("__p"))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(topic).orderBy(*order))).where(F.col("__r") <= n)
    return ranked.join(places, topic).orderBy("__r", "__p").limit(n).withColumn("turn", F.col("__r").cast("int")).drop("__r", "__p")
