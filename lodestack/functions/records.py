"""Records that come as loosely typed JSON: normalised fields, errors, events of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WHITE, strip
from .urls import _c

#: Lengths of the fields of a summary, and numbers and lengths of its lists.
TITLE, SUMMARY, POINTS, POINT, TAGS, TAG = 80, 300, 4, 80, 6, 40


def _cut(c: Column, n: int) -> Column:
    """At most n characters, without white space at the end."""
    return F.regexp_replace(F.substring(strip(c), 1, n), f"[{WHITE}]+$", "")


def _texts(v: Column) -> Column:
    """A list of texts of a list, or of a text with commas or line breaks."""
    as_list = F.try_variant_get(v, "$", "array<string>")
    as_text = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), as_list).otherwise(F.split(as_text, "[,\n]"))


def _few(v: Column, n: int, length: int) -> Column:
    items = F.transform(F.coalesce(_texts(v), F.array().cast("array<string>")), lambda t: _cut(F.coalesce(t, F.lit("")), length))
    return F.slice(F.filter(items, lambda t: t != ""), 1, n)


def normal_summary(col: Column | str) -> Column:
    """A summary from JSON: texts cut to length, lists from lists or separated text, an error if it has no title or text.

    Null and what is no JSON object have empty fields and an error.
    """
    v = F.try_parse_json(_c(col))
    at = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    text = lambda k, n: _cut(F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")), n)
    title, summary = text("note_title", TITLE), text("summary", SUMMARY)
    error = F.when((title == "") | (summary == ""), F.lit("title and summary are required"))
    return F.struct(
        title.alias("note_title"), summary.alias("summary"), _few(at("key_points"), POINTS, POINT).alias("key_points"), _few(at("tags"), TAGS, TAG).alias("tags"),
        text("content_type", TAG).alias("content_type"), error.alias("error"),
    )


def summary_problems(col: Column | str) -> Column:
    """What keeps a summary in JSON from being used, as a list: fields missing or unexpected, of a wrong type, too long or too many.

    Null and what is no JSON object have one problem.
    """
    v = F.try_parse_json(_c(col))
    known = {"note_title": TITLE, "summary": SUMMARY, "key_points": (POINTS, POINT), "tags": (TAGS, TAG), "content_type": TAG}
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("VOID"))
    keys = F.json_object_keys(_c(col))
    found: list[Column] = []
    for k, most in known.items():
        missing = ~F.coalesce(F.array_contains(keys, k), F.lit(False))
        if isinstance(most, int):
            text = F.try_variant_get(v, f"$.{k}", "string")
            rule = F.when(kind(k) != "STRING", f"{k} is no text").when(F.length(text) > most, f"{k} is too long")
        else:
            items = F.try_variant_get(v, f"$.{k}", "array<string>")
            rule = F.when(~kind(k).startswith("ARRAY"), f"{k} is no list").when(F.size(items) > most[0], f"{k} has too many entries").when(F.exists(items, lambda t: F.length(t) > most[1]), f"{k} has too long an entry")
        found.append(F.when(missing, f"{k} is missing").otherwise(rule))
    extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)))), lambda k: F.concat(k, F.lit(" is unexpected")))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.concat(F.filter(F.array(*found), lambda p: p.isNotNull()), extra)).otherwise(F.array(F.lit("no object")))


def sanitized_error(col: Column | str, *secrets: str, most: int = 8192) -> Column:
    """An error text fit to be kept: no bearer tokens, no home folders, none of the given words, cut to length."""
    s = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"(?i)(bearer\s+)[A-Za-z0-9._~+/=\-]+", "$1[removed]")
    s = F.regexp_replace(s, r"(?:/home/|/Users/|[A-Za-z]:\\Users\\)[^\s/\\:\"']+", "[home]")
    for word in secrets:
        if word:
            s = F.replace(s, F.lit(word), F.lit("[removed]"))
    return F.substring(s, 1, most)


def error_class(status: Column, message: Column) -> Column:
    """Class of a failed call by status and message, as far as another try may help."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status.isin(401, 403), "auth")
        .when(status == 429, "rate limit")
        .when((status >= 500) | m.contains("connection") | m.contains("temporarily"), "unavailable")
        .when(m.contains("timed out") | m.contains("timeout"), "timeout")
        .when(status >= 400, "protocol")
        .otherwise("other")
    )


def last_message(events: DataFrame) -> DataFrame:
    """Last message and usage of each run from (run_id, seq, line) of its JSON event log.

    Lines that are no JSON are passed over; a run without messages has a null one.
    """
    v = events.select("run_id", "seq", F.try_parse_json("line").alias("v")).where("v is not null")
    e = v.select(
        "run_id", "seq", F.try_variant_get("v", "$.type", "string").alias("type"), F.try_variant_get("v", "$.item.type", "string").alias("item"),
        F.try_variant_get("v", "$.item.text", "string").alias("text"), F.try_variant_get("v", "$.usage.input_tokens", "long").alias("tokens_in"), F.try_variant_get("v", "$.usage.output_tokens", "long").alias("tokens_out"),
    )
    said = (F.col("type") == "item.completed") & (F.col("item") == "agent_message")
    done = F.col("type") == "turn.completed"
    pick = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("seq")))
    return e.groupBy("run_id").agg(pick("text", said).alias("message"), pick("tokens_in", done).alias("tokens_in"), pick("tokens_out", done).alias("tokens_out"))
