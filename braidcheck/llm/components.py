"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, written


def _rows(df: DataFrame, a: str, b: str, *pairs: tuple[str, str]) -> DataFrame:
    """A row (a, b) for each of some pairs of columns. Both come from one pass; a union would plan and run all below it twice."""
    return df.select(F.explode(F.array(*[F.struct(F.col(x).alias(a), F.col(y).alias(b)) for x, y in pairs])).alias("x")).select(f"x.{a}", f"x.{b}")


def _least(pairs: DataFrame, node: str, near: str) -> DataFrame:
    """pairs with m, the least of a node and all that are near it. The least is summed up before it is shuffled; a hot node is split by the join."""
    least = pairs.groupBy(node).agg(F.min(near).alias("m")).select(node, F.least(node, "m").alias("m"))
    return pairs.join(least, node)


def _mark(edges: DataFrame) -> tuple:
    """The same for the same set of edges; two sets that differ share it by chance in 2**-90 at most."""
    way = F.when(F.col("u") > F.col("v"), F.xxhash64("u", "v")).otherwise(F.xxhash64("v", "u"))
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(way), F.sum(F.pmod(way, F.lit(1 << 30)))).first())


def large_star(edges: DataFrame) -> DataFrame:
    both = _rows(edges, "node", "near", ("u", "v"), ("v", "u"))
    return _least(both, "node", "near").where("near > node").select(F.col("near").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("upper"), F.least("u", "v").alias("lower"))
    stars = _least(down, "upper", "lower")
    return _rows(stars, "u", "v", ("lower", "m"), ("upper", "m")).where("u <> v").distinct()


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): the least node that each node of an edge (u, v) reaches.

    Every round writes its edges to folder, so a lost executor costs a round at most;
    the rounds end when the edges no longer change. Loops and repeated edges are ignored;
    without edges there are no rows.
    """
    spark = edges.sparkSession
    now = written(edges.select("u", "v").where("u <> v").distinct(), folder, "edges0")
    mark, at = _mark(now), 0
    while True:
        new = written(small_star(large_star(now)), folder, f"edges{at + 1}")
        discard(spark, f"{folder}/edges{at}")
        settle(spark)
        before, mark = mark, _mark(new)
        now, at = new, at + 1
        if mark == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
