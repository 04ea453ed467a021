"""Notes of resources made from summaries: their text, their merge, their files; and what a run retries and reports on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .latest import first_rows


def source_note(resource_id: Column, title: Column, link: Column, model: Column, summary: Column) -> Column:
    """A note of a resource from a summary (note_title, summary, key_points, tags, content_type); sections without anything are left out."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    name = F.coalesce(some(summary["note_title"]), some(title), F.lit("Untitled"))
    tags = F.coalesce(summary["tags"], F.array().cast("array<string>"))
    solid = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), text.strip), lambda t: t != "")
    head = text.front_matter({"resource_id": resource_id, "source": link, "title": name, "model": model}, lists={"tags": tags}, plain={"managed": F.lit(True)})
    points, words = solid(summary["key_points"]), solid(tags)
    section = lambda title_, body, present: F.when(present, F.concat(F.lit(f"## {title_}\n\n"), body, F.lit("\n")))
    end = F.concat(F.lit("- "), F.coalesce(link, F.lit("")), F.lit("\n- Content type: "), F.coalesce(summary["content_type"], F.lit("")))
    body = F.concat_ws(
        "\n", F.concat(head, F.lit("\n")), F.concat(F.lit("# "), text.heading(name), F.lit("\n")), section("Summary", text.strip(F.coalesce(summary["summary"], F.lit(""))), F.lit(True)),
        section("Key Points", F.array_join(F.transform(points, lambda p: F.concat(F.lit("- "), p)), "\n"), F.size(points) > 0), section("Tags", F.array_join(F.transform(words, lambda t: F.concat(F.lit("#"), t)), " "), F.size(words) > 0),
        section("Source", end, F.lit(True)),
    )
    return F.concat(F.regexp_replace(body, f"[{text.WHITE}]+$", ""), F.lit("\n"))


def put_notes(notes: DataFrame, batch: DataFrame) -> DataFrame:
    """Notes (resource_id, run_id, markdown, created_at) after a batch, with ``action``: of each resource one, left alone if its text is the same."""
    old = notes.select("resource_id", F.struct("run_id", "markdown", "created_at").alias("o"))
    new = batch.select("resource_id", F.struct("run_id", "markdown", "created_at").alias("n"))
    both = old.join(new, "resource_id", "full")
    action = F.when(F.col("n").isNull(), "keep").when(F.col("o").isNull(), "insert").when(F.col("o.markdown").eqNullSafe(F.col("n.markdown")), "unchanged").otherwise("update")
    pick = F.when(action.isin("insert", "update"), F.col("n")).otherwise(F.col("o"))
    return both.select("resource_id", pick.alias("p"), action.alias("action")).select("resource_id", "p.run_id", "p.markdown", "p.created_at", "action")


def note_files(notes: DataFrame, revisions: DataFrame) -> DataFrame:
    """path and document of each note: the start of its resource's title and id; resources without a title are Untitled."""
    titles = revisions.groupBy("resource_id").agg(F.max("title").alias("title"))
    rows = notes.join(titles, "resource_id", "left")
    return rows.select(text.note_name("title", F.substring("resource_id", 1, 8)).alias("path"), F.col("markdown").alias("document"))


def audited_items(outcomes: DataFrame, items: DataFrame, providers: list[str]) -> DataFrame:
    """The items that the outcome of an item (source_id, resource_id, fetched_body) is recorded for: of a body that was fetched all of its resource's, else itself."""
    shared = items.where(F.col("provider").isin(*providers)).select("resource_id", F.col("source_id").alias("other")).distinct()
    got = outcomes.join(shared, (outcomes["resource_id"] == shared["resource_id"]) & outcomes["fetched_body"], "left")
    return got.select(outcomes["source_id"], F.coalesce("other", outcomes["source_id"]).alias("recorded"))


def retries(backlog: DataFrame, due: DataFrame, handled: DataFrame, n: int) -> DataFrame:
    """The first n resources of a backlog (resource_id, fetched_at) that are due (resource_id, due) and that the run has not handled, with ``seq``: never fetched first, then the oldest."""
    rows = backlog.join(due.where("due").select("resource_id"), "resource_id", "left_semi").join(handled.select("resource_id"), "resource_id", "left_anti")
    return first_rows(rows, [F.col("fetched_at").asc_nulls_first(), F.col("resource_id")], n)
