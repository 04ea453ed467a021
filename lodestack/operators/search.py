"""A trigram index over text fields, and substring search by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of a text in lower case; none for shorter ones."""
    # one pass over the text: an empty match at every place that three characters follow, but not inside a surrogate pair
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(...))"), F.lit(1))), F.array().cast("array<string>"))


def build_index(docs: DataFrame, key: str, fields: list[str], only: list[str] | None = None) -> DataFrame:
    """(gram, field, key): an inverted index, one row for each gram of a field, or for those of the grams ``only``.

    Null and short fields give no rows.  To be written partitioned or bucketed by gram.
    """
    rows = None
    for f in fields:
        grams = trigrams(F.col(f))
        if only is not None:  # before the rows are multiplied
            grams = F.array_intersect(grams, F.array(*map(F.lit, only)))
        one = docs.where(F.length(f) >= 3).select(F.explode(grams).alias("gram"), F.lit(f).alias("field"), F.col(key))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def index_counts(index: DataFrame, key: str) -> DataFrame:
    """Documents and postings of each field."""
    return index.groupBy("field").agg(F.count_distinct(key).alias("documents"), F.count("*").alias("postings"))


def grams_of(term: str) -> list[str]:
    """The grams that a text must hold to hold a term; none for a term of less than three characters."""
    low = term.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def search(index: DataFrame, docs: DataFrame, key: str, field: str, term: str) -> DataFrame:
    """Keys of documents whose field holds a term, whatever the case.

    The index gives those that hold all grams of the term, an exact test decides.  Terms of
    less than three characters have no grams: they are looked for in the texts.
    """
    low = term.lower()
    hit = F.contains(F.lower(F.col(field)), F.lit(low))
    grams = grams_of(term)
    if not grams:
        return docs.where(hit).select(key)
    found = index.where((F.col("field") == field) & F.col("gram").isin(grams)).groupBy(key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    return docs.join(found, key, "left_semi").where(hit).select(key)


def rebuild(docs: DataFrame, key: str, fields: list[str], path: str, generation: int, force: bool = False) -> bool:
    """Writes the index of a generation of the documents; an index of that generation stays.

    The new index and its generation are one version of a table (see :mod:`.tables`), so a crash
    leaves the one before.  Rows are sorted by gram, so a search reads few row groups.
    """
    before = tables.manifest(docs.sparkSession, path)
    if not force and before is not None and before["note"] == str(generation):
        return False
    tables.write_table(build_index(docs, key, fields).repartitionByRange("gram").sortWithinPartitions("gram"), path, str(generation))
    return True


def generation_of(spark: SparkSession, path: str) -> str | None:
    """The generation of the index at a path; None if there is no index."""
    before = tables.manifest(spark, path)
    return before["note"] if before else None
