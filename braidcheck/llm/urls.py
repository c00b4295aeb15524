"""URL filtering by rules and, where none fits, by a tree of path templates per host.

The tree is built a level at a time over counted prefixes. At each node, segments that look like
numbers or identifiers, or that are rare among many, become a wildcard; so do labelled branches whose share of blocked
cannot be told from their siblings'. A template is judged by the share of blocked
among its labelled URLs, smoothed towards the same template on all hosts, and that towards all
URLs. The labels are the rules' own verdicts. Built-in column expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, shared_dir, table, written

#: (host, path, verdict). A rule fits its host and all subdomains, and paths that begin with its path.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: A node with more children than this has its rare ones, of at most RARE URLs each, made a wildcard.
MANY, RARE = 8, 2
#: Siblings stay apart if their share of blocked differs from the pool's by more than so many standard errors.
APART = 1.96
#: Labelled URLs that a branch, and its siblings together, need before they can be called similar.
EVIDENCE = 4
#: The weight, in labelled URLs, of what a share is smoothed towards.
PRIOR = 4.0
BLOCK_FROM = 0.5
WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty where url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    found = url.isNotNull() & (at > 0)
    host = F.when(found, ascii_lower(F.regexp_extract(rest, "\\A([^/?#]*)", 1))).otherwise("")
    path = F.when(found, F.regexp_extract(rest, "\\A[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rule_for(host: Column, path: Column, rules=None) -> Column:
    """The longest rule that fits, as struct (size, rule, verdict); null if none does. Of rules as long, the greater text."""
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in (RULES if rules is None else rules)
    ]
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def looks_variable(segment: Column) -> Column:
    """Numbers, dates, hexadecimal identifiers, and segments with a number before an extension."""
    return segment.rlike("\\A(?:[0-9][0-9._:-]*|[0-9a-fA-F-]{16,}|[^.]*[0-9]{3,}[^.]*)(?:\\.[A-Za-z0-9]{1,5})?\\z")


def _step(segment: Column, other: Column | None = None) -> Column:
    """A segment's place in a template: a wildcard if it looks variable, or for another reason."""
    wild = looks_variable(segment) if other is None else looks_variable(segment) | other
    return F.when(wild, F.lit(WILD)).otherwise(segment)


def _level(paths: DataFrame, depth: int, folder: str) -> DataFrame:
    """paths (host, template, segments, n, allow, block), all with a segment at depth, with the templates a segment longer.

    `alone` tells of a path that shares its node with no other: its template is whole. Sums by node are
    written before they are joined, so that a host that a third of all paths have is split among tasks.
    """
    segment = F.get("segments", F.lit(depth))
    kids = paths.withColumn("segment", segment)
    kids = written(kids.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "allow", "block")], F.count(F.lit(1)).alias("paths")), folder, f"kids{depth}")
    node = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"), F.sum("paths").alias("all_paths"))
    kids = kids.join(written(node, folder, f"nodes{depth}"), ["host", "template"])
    rare = (F.col("kids") > MANY) & (F.col("n") <= RARE)
    # The child against all its siblings: two smoothed shares and the error of their difference.
    own, rest = F.col("allow") + F.col("block") + 2, F.col("all_allow") + F.col("all_block") - F.col("allow") - F.col("block") + 2
    share, other = (F.col("block") + 1) / own, (F.col("all_block") - F.col("block") + 1) / rest
    pooled = (F.col("all_block") + 2) / (own + rest)
    alike = F.abs(share - other) <= APART * F.sqrt(pooled * (1 - pooled) * (1 / own + 1 / rest))
    told = (own >= EVIDENCE + 2) & (rest >= EVIDENCE + 2)
    kids = kids.select("host", "template", "segment", _step(F.col("segment"), rare | (alike & told)).alias("step"), (F.col("all_paths") == 1).alias("alone"))
    stepped = paths.withColumn("segment", segment).join(written(kids, folder, f"steps{depth}"), ["host", "template", "segment"])
    # Nothing is left to tell a lone path from: the rest of it goes by the look of its segments.
    tail = F.transform(F.slice("segments", depth + 1, F.greatest(F.lit(0), F.size("segments") - depth)), lambda x: _step(x))
    longer = F.when(F.col("alone"), F.concat_ws("/", F.array("template"), tail)).otherwise(F.concat("template", F.lit("/"), "step"))
    return stepped.withColumn("template", longer).select(*paths.columns, "alone")


def templates(urls: DataFrame, folder: str) -> DataFrame:
    """(host, segments, template, block_share) for each host and list of segments in urls (host, path, label).

    label is allow, block or null. An empty path is the template of no segments. Counts are summed up
    before anything is shuffled. A level of the tree takes a few jobs and a written table, down to the last node that two paths share.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    paths = urls.withColumn("segments", segments).groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "allow").alias("allow"), F.count_if(F.col("label") == "block").alias("block")
    )
    live = written(paths.select("host", F.lit("").alias("template"), "segments", "n", "allow", "block"), folder, "level0")
    whole, depth = [], 0
    while True:
        whole.append(live.where(F.size("segments") <= depth))
        more = live.where(F.size("segments") > depth)
        if more.isEmpty():
            break
        stepped = written(_level(more, depth, folder), folder, f"level{depth + 1}")
        for name in ("kids", "nodes", "steps"):
            discard(urls.sparkSession, f"{folder}/{name}{depth}")
        whole.append(stepped.where("alone").drop("alone"))
        live, depth = stepped.where("not alone").drop("alone"), depth + 1
    paths = reduce(DataFrame.union, whole)

    def share(prior: Column) -> Column:
        return (F.col("block") + PRIOR * prior) / (F.col("allow") + F.col("block") + PRIOR)

    sums = [F.sum("allow").alias("allow"), F.sum("block").alias("block")]
    everywhere = paths.agg(*sums).select(share(F.lit(0.5)).alias("all_share")).first()["all_share"]
    everywhere = 0.5 if everywhere is None else everywhere
    by_host = written(paths.groupBy("host", "template").agg(*sums), folder, "by_host")
    by_template = written(by_host.groupBy("template").agg(*sums).select("template", share(F.lit(everywhere)).alias("template_share")), folder, "by_template")
    shares = written(by_host.join(by_template, "template").select("host", "template", share(F.col("template_share")).alias("block_share")), folder, "shares")
    return paths.select("host", "segments", "template").join(shares, ["host", "template"])


def judge(pages: DataFrame, rules=None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, block_share of every row of pages (page_id, url).

    Where a rule fits, its verdict holds; else the template's. A null url has empty host and path
    and is judged by the template of no segments. Rows that repeat are judged alike; an empty
    table gives no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    base = base.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("label"))
    known = templates(base.select("host", "path", "label"), shared_dir(spark))
    keyed = base.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != ""))
    out = keyed.join(known, ["host", "segments"], "left")
    verdict = F.coalesce("label", F.when(F.col("block_share") >= BLOCK_FROM, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "block_share")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, template, block_share of every row of pages; see judge for nulls, repeats and empty tables. Of rules that fit the longest holds, of as long ones the greater text."""
    return judge(table(spark, sf_dir, "pages"))
