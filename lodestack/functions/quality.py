"""How good an extraction is, and which of two is better."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE
from .urls import _c

# Fixed value: the mark of a page that scripts fill.
SCRIPT_SHELL = """(?i)<(?:div|main)[^>]+id=["'](?:app|root|__next|__nuxt)["']"""
REPLACEMENT = "�"


def compact_length(text: Column | str) -> Column:
    """Characters that are no white space; 0 for null."""
    return F.length(F.regexp_replace(F.coalesce(_c(text), F.lit("")), f"[{WHITE}]+", "")).cast("long")


def lost_characters(text: Column | str) -> Column:
    """Replacement characters in a text."""
    t = F.coalesce(_c(text), F.lit(""))
    return (F.length(t) - F.length(F.replace(t, F.lit(REPLACEMENT), F.lit("")))).cast("long")


def _share_lost(text: Column | str) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return lost_characters(text) / F.greatest(F.length(t), F.lit(1))


def high_confidence(text: Column | str, least: int = 200, lost: float = 0.001) -> Column:
    """Long enough and hardly any character lost."""
    return (compact_length(text) >= least) & (_share_lost(text) < lost)


def needs_rendering(text: Column | str, html: Column | str, title: Column | str) -> Column:
    """Whether a page has to be rendered before its text can be had."""
    t = F.coalesce(_c(text), F.lit(""))
    n = compact_length(text)
    bare = lambda c: F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"[{WHITE}]+", "")
    shell = F.coalesce(_c(html), F.lit("")).rlike(SCRIPT_SHELL)
    return (
        F.when(t == "", True)
        .when(_share_lost(text) >= 0.001, True)
        .when((n >= 40) & (bare(title) != "") & F.contains(bare(text), bare(title)), False)
        .when(n < 80, True)
        .otherwise((n < 200) & shell)
    )


def prefer_recall(precise: Column | str, recall: Column | str) -> Column:
    """Whether the lenient extraction is so much longer that it has to be taken."""
    p, r = compact_length(precise), compact_length(recall)
    empty = F.coalesce(_c(precise), F.lit("")) == ""
    return F.when(empty, F.coalesce(_c(recall), F.lit("")) != "").otherwise((p < 120) & (r >= 500) & (r >= p * 3))


def quality_score(text: Column | str) -> Column:
    """A struct that orders texts by quality."""
    return F.struct(high_confidence(text).alias("sure"), (-lost_characters(text)).alias("kept"), compact_length(text).alias("length"))


def better(a: Column | str, b: Column | str) -> Column:
    """The better of two texts, the first on a tie."""
    return F.when(quality_score(b) > quality_score(a), _c(b)).otherwise(_c(a))
