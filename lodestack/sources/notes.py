"""Folders of notes and ledgers of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import merge_tags, normalize_tag


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """path, text and time of change of all Markdown files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return raw.select(F.col("path"), F.decode("content", "UTF-8").alias("text"), F.unix_micros("modificationTime").alias("modified"))


def front_value(text: str, field: str):
    """A scalar of a note's front matter; empty if there is none."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    return F.regexp_replace(F.regexp_extract(head, rf"(?m)^{field}:[ \t]*(.*)$", 1), r"""^["']|["']$""", "")


def front_list(text: str, field: str):
    """A list of a note's front matter, in brackets or on lines of its own."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    inline = F.regexp_extract(head, rf"(?m)^{field}:[ \t]*\[(.*)\]", 1)
    block = F.regexp_extract(head, rf"(?m)^{field}:[ \t]*\n((?:[ \t]*-[ \t].*\n?)*)", 1)
    split = F.when(inline != "", F.split(inline, ",")).otherwise(F.split(F.regexp_replace(block, r"(?m)^[ \t]*-[ \t]", ""), "\n"))
    return F.filter(F.transform(split, lambda v: F.regexp_replace(F.trim(v), r"""^["']|["']$""", "")), lambda v: v != "")


def managed_paths(notes: DataFrame, kind_field: str = "kind") -> DataFrame:
    """item_id, kind, path and text: of several notes of one item and kind the first by path.

    Notes without an item or a kind are not managed.
    """
    rows = notes.select(front_value("text", "source_item_id").alias("item_id"), front_value("text", kind_field).alias("kind"), "path", "text").where("item_id <> '' and kind <> ''")
    one = rows.groupBy("item_id", "kind").agg(F.min_by(F.struct("path", "text"), "path").alias("n"))
    return one.select("item_id", "kind", "n.path", "n.text")


def has_summary(text: Column | str) -> Column:
    """Whether a note's summary was written by a model; a note without front matter counts as done."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    return F.when(head == "", True).otherwise(front_value(text, "summary_model") != "")


def preference(text: Column | str, modified: Column, name: Column) -> Column:
    """What orders notes of one item: with a summary, the newest summary, the newest file, the greatest name."""
    made = F.coalesce(F.unix_micros(F.try_to_timestamp(F.nullif(front_value(text, "summary_generated_at"), F.lit("")))), F.lit(0))
    return F.struct((front_value(text, "summary_model") != "").alias("has"), made.alias("made"), modified.alias("modified"), name.alias("name"))


def unique_notes(notes: DataFrame, key: Column) -> DataFrame:
    """Of the notes (path, text, modified) of each key the preferred one; null keys are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = notes.select(key.alias("key"), "path", "text", preference("text", F.col("modified"), name).alias("p")).where("key is not null")
    return rows.groupBy("key").agg(F.max_by(F.struct("path", "text"), "p").alias("n")).select("key", "n.path", "n.text")


def summary_text(text: Column | str) -> Column:
    """The section of a note that is called Summary; empty if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, r"(?ms)^## Summary\s*\n+(.*?)(?=^##\s|\z)", 1), r"^\s+|\s+$", ""))


def summaries_to_send(notes: DataFrame) -> DataFrame:
    """key and summary of the notes (path, text, modified) that have both: what a remote note may get."""
    key = F.try_to_number(F.nullif(front_value("text", "raindrop_id"), F.lit("")), F.lit("999999999999999999")).cast("long")
    ready = notes.where((front_value("text", "summary_model") != "") & (summary_text("text") != ""))
    return unique_notes(ready, key).select("key", summary_text("text").alias("summary"))


def tags_to_send(notes: DataFrame, existing: DataFrame, base_tags: list[str]) -> DataFrame:
    """key and the tags that a remote item (key, tags) lacks of those in its note, without tags that all notes have."""
    key = F.try_to_number(F.nullif(front_value("text", "raindrop_id"), F.lit("")), F.lit("999999999999999999")).cast("long")
    ready = unique_notes(notes.where(front_value("text", "summary_model") != ""), key)
    own = front_list("text", "llm_tags")
    general = F.array(*map(F.lit, base_tags)).cast("array<string>")
    given = F.filter(front_list("text", "tags"), lambda t: ~F.array_contains(F.transform(general, normalize_tag), normalize_tag(t)))
    wanted = merge_tags(F.when(F.size(own) > 0, own).otherwise(given))
    joined = ready.select("key", wanted.alias("wanted")).join(existing.select("key", "tags"), "key", "left")
    return joined.select("key", F.array_except("wanted", merge_tags("tags")).alias("missing")).where(F.size("missing") > 0)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger of JSON lines; lines that are no JSON are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_ledger(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
