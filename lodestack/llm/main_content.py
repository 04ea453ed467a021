"""Problem 2, on DataFrames: the main body of pages by a site style tree.

First every page gives its nodes, once.  Pages of the same content, by a fingerprint that small
edits mostly leave alone, count once a host, and once over all hosts.  Nodes whose entropy over the pages
of a host is high have low importance on that host.  Nodes spread over the pages of many hosts
are added; their number is bounded by the threshold, whatever the number of pages, and they
go to every task, which then judges the lines of its pages.  The nodes of hosts go along if their
checked number is small enough, else they are joined to the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from . import furniture
from .spark_text import per_batch

#: A node has low importance on its host below this value of 1 - log m / log n: plain lines, list items and headings,
LOW = 0.6
#: sentences, which articles may share,
LOW_SENTENCE = 0.5
#: and titles, which a site's articles may share as well.
LOW_TITLE = 0.3
#: Sentences below this need no other furniture beside them.
SURE = 0.4
#: Nodes on fewer pages of a host with content of their own teach nothing about it.
MIN_HOST_PAGES = 3
#: Over all hosts, a node has low importance from this share of pages with different content,
MIN_SHARE = 0.0004
#: a sentence only from this one,
MIN_SENTENCE_SHARE = 0.002
#: of at least so many such pages,
MIN_PAGES = 6
#: and from this perplexity, the exponential of the entropy, of its distribution over hosts.
MIN_HOSTS = 4.0
#: The most nodes that can reach MIN_SHARE, at this number of candidate nodes a page on average.
NODES_A_PAGE = 400
#: Nodes of hosts that go to every task, 8 bytes each; beyond it they are joined.
MOST_HELD = 2_000_000

RECORD = ["table_name", "record_id"]


def host_of(url: Column) -> Column:
    """Hash of the host of a URL; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", F.xxhash64(host))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions and fetched pages with text: table_name, record_id, text, host.

    A page's host is that of its own URL, a revision's that of its capture (of several, one).
    """
    captures = runtime.table(spark, sf_dir, "fetch_capture").where(F.col("resource_revision_id").isNotNull())
    captures = captures.groupBy(F.col("resource_revision_id").alias("record_id")).agg(F.min(host_of(F.col("final_url"))).alias("host"))
    revisions = runtime.table(spark, sf_dir, "resource_revision").where(F.length("content_markdown") > 0).select(F.col("resource_revision_id").alias("record_id"), F.col("content_markdown").alias("text"))
    revisions = revisions.join(captures, "record_id", "left").select(F.lit("resource_revision").alias("table_name"), "record_id", "text", "host")
    fetched = runtime.table(spark, sf_dir, "page_fetch").where(F.length("text") > 0).select(F.lit("page_fetch").alias("table_name"), F.col("page_fetch_id").alias("record_id"), "text", host_of(F.col("url")).alias("host"))
    return revisions.unionByName(fetched)


def page_nodes(texts: DataFrame) -> DataFrame:
    """What each page of (table_name, record_id, text, host) gives: its host, content fingerprint, nodes, and nodes with a name masked."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [furniture.page_nodes(t) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 3)), pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[i] for g in got], pa.list_(pa.int64())) for i in (1, 2))],
                names=["table_name", "record_id", "host", "content", "nodes", "masked"],
            )

        return f

    return per_batch(texts.select(*RECORD, "text", "host"), make, "table_name string, record_id string, host long, content long, nodes array<long>, masked array<long>")


def with_firsts(nodes: DataFrame) -> DataFrame:
    """Adds whether a page is the first of its content on its host, and the first over all hosts; all others are dropped.

    Only hashes are aggregated: each group is cut to one page before the shuffle.
    """
    key = F.xxhash64(*RECORD)
    firsts = nodes.groupBy("content", "host").agg(F.min(key).alias("key"))
    overall = firsts.groupBy("content").agg(F.min("key").alias("key")).select("key", F.lit(1).alias("first"))
    firsts = firsts.select("key").join(overall, "key", "left").groupBy("key").agg(F.coalesce(F.max("first"), F.lit(0)).alias("first"))
    return nodes.withColumn("key", key).dropDuplicates(["key"]).join(firsts, "key").select("host", "first", "nodes", "masked")


def counts(firsts: DataFrame) -> DataFrame:
    """host, node, the pages of the host with the node (null for nodes with a name masked), and those that count over all hosts.

    A null node stands for the pages themselves.
    """
    one = F.concat(
        F.transform("nodes", lambda n: F.struct(n.alias("node"), F.lit(True).alias("own"))),
        F.transform("masked", lambda n: F.struct(n.alias("node"), F.lit(False).alias("own"))),
        F.array(F.struct(F.lit(None).cast("long").alias("node"), F.lit(True).alias("own"))),
    )
    rows = firsts.select("host", "first", F.explode(one).alias("n")).select("host", "n.node", "n.own", "first")
    return rows.groupBy("host", "node", "own").agg(F.count("*").alias("m"), F.sum("first").alias("wide"))


def nodes_of_hosts(counted: DataFrame) -> DataFrame:
    """host, node, sure: the nodes of low importance on their host, by entropy.

    A node on m of a host's n pages is spread evenly over them, so its entropy is log m of log n.
    """
    own = counted.where("own and host is not null")
    n = own.where("node is null").where(F.col("m") >= MIN_HOST_PAGES).select("host", F.col("m").alias("n"))
    importance = 1 - F.log(F.col("m").cast("double")) / F.log(F.col("n").cast("double"))
    sentence = F.col("node").bitwiseAND(1) == 1
    low = F.when(sentence, LOW_SENTENCE).when(F.col("node").bitwiseAND(6) == 6, LOW_TITLE).otherwise(LOW)
    found = own.where(F.col("node").isNotNull() & (F.col("m") >= MIN_HOST_PAGES)).join(n, "host").where(importance < low)
    return found.select("host", "node", F.when(sentence, importance < SURE).otherwise(True).alias("sure"))


def nodes_of_all(counted: DataFrame, total: int) -> DataFrame:
    """Ids of the nodes of low importance in the merged style trees of all hosts, of ``total`` pages."""
    rows = counted.where(F.col("node").isNotNull() & (F.col("wide") > 0) & (F.col("node").bitwiseAND(6) != 6))
    m = F.col("wide").cast("double")
    tree = rows.groupBy(F.col("node").bitwiseAND(~6).alias("node")).agg(F.sum("wide").alias("pages"), F.sum(m * F.log(m)).alias("mlogm"))  # of any kind
    perplexity = F.exp(F.log(F.col("pages").cast("double")) - F.col("mlogm") / F.col("pages"))
    sentence = F.col("node").bitwiseAND(1) == 1
    least = F.when(sentence, max(MIN_PAGES, MIN_SENTENCE_SHARE * total)).otherwise(max(MIN_PAGES, MIN_SHARE * total))
    return tree.where((F.col("pages") >= least) & (perplexity >= MIN_HOSTS)).select("node")


def learn(spark: SparkSession, sf_dir: str) -> tuple[list[int], DataFrame]:
    """The nodes of all hosts, at most NODES_A_PAGE / MIN_SHARE of them for any number of pages, and the nodes of each host."""
    total = sum(runtime.table(spark, sf_dir, t).count() for t in ("resource_revision", "page_fetch"))  # from the files' footers
    counted = runtime.checkpoint(counts(with_firsts(runtime.checkpoint(page_nodes(pages(spark, sf_dir))))).where((F.col("m") > 1) | (F.col("wide") > 0)))
    bound = int(NODES_A_PAGE / MIN_SHARE)
    rows = nodes_of_all(counted, total).limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} unimportant nodes: pages have more than {NODES_A_PAGE} candidate nodes on average")
    return [r["node"] for r in rows], runtime.checkpoint(nodes_of_hosts(counted))


def judged(texts: DataFrame, nodes: list[int], of_hosts: DataFrame, most_held: int = MOST_HELD, with_text: bool = False) -> DataFrame:
    """``lines``, the numbers of the furniture lines, of each page of (table_name, record_id, text, host), with its text if asked for.

    Null, empty and blank texts, and pages without any article, have none.
    """
    spark = texts.sparkSession
    small = of_hosts.count() <= most_held
    held_nodes = spark.sparkContext.broadcast(nodes)
    by_host: dict[int, tuple[list[int], list[int]]] = {}
    if small:
        for r in of_hosts.collect():
            for at, take in ((0, True), (1, r["sure"])):
                if take:
                    by_host.setdefault(r["host"], ([], []))[at].append(r["node"])
    held = spark.sparkContext.broadcast(by_host)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = furniture.Tree(held_nodes.value)
        sets: dict[int | None, tuple[frozenset, frozenset]] = {None: (frozenset(), frozenset())}
        for b in batches:
            got = []
            if not small:
                sets = {None: (frozenset(), frozenset())}
            for i, (text, host) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if host not in sets:
                    own, sure = held.value.get(host, ((), ())) if small else (b.column(4)[i].as_py() or (), b.column(5)[i].as_py() or ())
                    sets[host] = frozenset(own), frozenset(sure)
                got.append(furniture.furniture_lines(text, tree, *sets[host], host))
            kept = 3 if with_text else 2
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(got, pa.list_(pa.int32()))], names=[*b.schema.names[:kept], "lines"])

    texts = texts.select(*RECORD, "text", "host")
    if not small:
        lists = of_hosts.groupBy("host").agg(F.collect_list("node").alias("own"), F.collect_list(F.when(F.col("sure"), F.col("node"))).alias("sure"))
        texts = texts.join(lists, "host", "left").select(*RECORD, "text", "host", "own", "sure")
    return texts.mapInArrow(run, "table_name string, record_id string, " + "text string, " * with_text + "lines array<int>")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of records that belong to the page and not to its main body."""
    runtime.tune(spark)
    got = judged(pages(spark, sf_dir), *learn(spark, sf_dir)).where(F.size("lines") > 0)
    return got.groupBy(*RECORD).agg(F.max("lines").alias("lines")).select(*RECORD, F.explode("lines").alias("line_no"))


def p2_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every record, one row a record; its lines in order, furniture left out.

    Copies of a record are equal, so one of them is taken by its id, without comparing texts.
    """
    runtime.tune(spark)
    got = judged(pages(spark, sf_dir).dropDuplicates(RECORD), *learn(spark, sf_dir), with_text=True)
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("lines", (i + 1).cast("int")))
    return got.select(*RECORD, F.array_join(kept, "\n").alias("main"))
