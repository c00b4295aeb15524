"""Sequences and graph records made of the driver's relational tables.

Parts become segments, orders become paths and sources, customers become walks. Everything is
built-in expressions, so that SQL elsewhere can state the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: md5 digits become bases; the last two make some of them ambiguous.
DIGITS, BASES = "0123456789abcdef", "ACGTACGTACGTACNR"
#: What the steps of an order go by.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "orientation"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S records: (line_no, name, sequence) of each part."""
    p = table(spark, sf_dir, "part")
    bases = F.translate(F.md5(F.col("p_partkey").cast("string")), DIGITS, BASES)
    return p.select(F.col("p_partkey").cast("long").alias("line_no"), F.col("p_partkey").cast("string").alias("name"), F.substring(bases, F.lit(1), (F.col("p_size") % 25 + 8).cast("int")).alias("sequence"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(orderkey, step_no from 0, segment, orientation) of each lineitem."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("orderkey").orderBy(*ORDER)
    return ordered_items(spark, sf_dir).select("orderkey", (F.row_number().over(order) - 1).cast("long").alias("step_no"), F.col("l_partkey").cast("string").alias("segment"), "orientation")


def ordered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(orderkey, ORDER) of each lineitem."""
    orientation = F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("orientation")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("orderkey"), *ORDER[:-1], orientation)


def path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P records: (line_no, identifier, steps text, overlaps)."""
    s = steps(spark, sf_dir).groupBy("orderkey").agg(F.array_sort(F.collect_list(F.struct("step_no", F.concat("segment", "orientation").alias("t")))).alias("s"))
    return s.select(F.col("orderkey").alias("line_no"), F.concat(F.lit("o"), "orderkey").alias("identifier"), F.array_join(F.transform("s", lambda x: x["t"]), ",").alias("steps_text"), F.lit("*").alias("overlaps"))


def gfa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, line) of a whole GFA text: a header, segments, paths, and a deterministic set of damaged lines."""
    tab = F.lit("\t")
    head = spark.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit("H\tVN:Z:1.1").alias("line"))
    s = segments(spark, sf_dir)
    s = s.select((F.col("line_no") + 1).alias("line_no"), F.when(F.col("line_no") % 97 == 5, F.concat(F.lit("S\t"), "name")).when(F.col("line_no") % 97 == 6, F.concat(F.lit("S\t"), "name", F.lit("\t*"))).when(F.col("line_no") % 97 == 7, F.concat(F.lit("S\t"), "name", tab, "sequence", F.lit("X"))).otherwise(F.concat(F.lit("S\t"), "name", tab, "sequence", F.lit("\tLN:i:1"))).alias("line"))
    p = path_texts(spark, sf_dir)
    joints = F.size(F.split("steps_text", ",")) - 1
    zeros = lambda n: F.array_join(F.array_repeat(F.lit("0M"), n), ",")
    overlaps = F.when(F.col("line_no") % 89 == 3, F.lit("1M")).when(F.col("line_no") % 89 == 6, zeros(joints)).when(F.col("line_no") % 89 == 7, zeros(joints + 1)).otherwise(F.col("overlaps"))
    text = F.when(F.col("line_no") % 89 == 4, F.concat("steps_text", F.lit(","))).otherwise(F.col("steps_text"))
    p = p.select((F.col("line_no") + 1_000_000_000).alias("line_no"), F.when(F.col("line_no") % 89 == 5, F.concat(F.lit("P\t"), "identifier")).otherwise(F.concat(F.lit("P\t"), "identifier", tab, text, tab, overlaps)).alias("line"))
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("long")
    w = c.select(
        (key + 2_000_000_000).alias("line_no"),
        F.concat(
            F.lit("W\tc"), key, tab, F.when(key % 31 == 2, F.lit("x")).otherwise(F.lit("1")), F.lit("\tchr\t"),
            F.when(key % 7 == 0, F.lit("*")).otherwise((key % 5).cast("string")), tab,
            F.when(key % 7 == 0, F.lit("*")).otherwise((key % 11).cast("string")), tab,
            F.when(key % 13 == 1, F.lit("12")).otherwise(F.concat(F.lit(">"), key, F.lit("<"), key + 1)),
        ).alias("line"),
    )
    return head.union(s).union(p).union(w)


def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, line_no, line, error) of a FASTA text: each supplier is a header and two lines, the first of them empty for some; a block holds 100 records, so that some span none."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("long")
    bases = F.translate(F.md5(k.cast("string")), DIGITS, BASES)
    first = F.when(k % 5 == 0, F.lit("")).otherwise(F.substring(bases, F.lit(1), (k % 20).cast("int")))
    lines = F.array(F.concat(F.lit(">"), F.when(k % 3 == 0, F.lit(" ")).otherwise(F.lit("")), F.col("s_name"), F.lit(" of "), F.col("s_nationkey")), first, F.lower(F.substring(bases, 21, 12)))
    rows = s.select(k.alias("k"), F.posexplode(lines).alias("place", "line"))
    line_no = F.col("k") * 3 + F.col("place")
    return rows.select(F.floor(line_no / 100).cast("long").alias("block"), line_no.alias("line_no"), "line", F.lit(None).cast("string").alias("error"))


def graph_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(orderkey, graph) through the library's own joins."""
    from .functions.sequences import ordered_concat, segment_key
    from .functions.sequences import oriented as turned

    s = segments(spark, sf_dir).select(segment_key(F.col("name")).alias("key"), "sequence")
    # Rows go by the columns that number the steps, and are dealt to their order once, with their bases.
    made = ordered_items(spark, sf_dir).withColumn("key", segment_key(F.col("l_partkey").cast("string"))).join(s, "key")
    made = made.select("orderkey", *ORDER, turned(F.col("sequence"), F.col("orientation")).alias("bases")).repartition("orderkey")
    return made.groupBy("orderkey").agg(ordered_concat([F.col(c) for c in ORDER], F.col("bases")).alias("graph"))


def oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with their segment as read: (orderkey, step_no, segment, orientation, bases)."""
    from .functions.sequences import oriented as turned
    from .functions.sequences import segment_key

    s = segments(spark, sf_dir).select(segment_key(F.col("name")).alias("key"), "sequence")
    return steps(spark, sf_dir).withColumn("key", segment_key(F.col("segment"))).join(s, "key").select("orderkey", "step_no", "segment", "orientation", turned(F.col("sequence"), F.col("orientation")).alias("bases"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(identifier, source_index, sequence): each order's path, changed by the last digit of its key; 4 is withheld."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("orderkey"), (F.col("o_custkey") % 3 + 1).cast("long").alias("source_index"))
    r = o.join(graph_sequences(spark, sf_dir), "orderkey", "left")
    own = F.translate(F.md5(F.col("orderkey").cast("string")), DIGITS, BASES)
    g, n, d = F.col("graph"), F.length("graph"), F.col("orderkey") % 10
    half = F.floor(n / 2).cast("int")
    changed = (
        F.when(g.isNull(), own)
        .when(d == 0, F.concat(F.substring(g, F.lit(1), half), F.when(F.substring(g, half + 1, F.lit(1)) == "A", "C").otherwise("A"), F.substring(g, half + 2, n)))
        .when(d == 1, F.substring(g, F.lit(1), n - 1))
        .when(d == 2, F.concat(g, F.lit("A")))
        .when(d == 3, F.concat(F.substring(g, F.lit(1), half), F.substring(g, half + 2, n)))
        .otherwise(g)
    )
    return r.where(d != 4).select(F.concat(F.lit("o"), "orderkey").alias("identifier"), "source_index", changed.alias("sequence"))


def path_traversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P traversals in the form that the comparison takes."""
    s = ordered_items(spark, sf_dir).repartition("orderkey").groupBy("orderkey").agg(F.sort_array(F.collect_list(F.struct(*ORDER))).alias("s"))
    none = F.lit(None).cast("decimal(21,0)")
    return s.select(F.col("orderkey").alias("line_no"), F.concat(F.lit("o"), "orderkey").alias("identifier"), F.lit("P").alias("record_type"), none.alias("start"), none.alias("end"), F.transform("s", lambda x: F.struct(x["l_partkey"].cast("string").alias("segment"), x["orientation"].alias("orientation"))).alias("steps"))


def keyed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.sequences import is_valid, segment_key

    return segments(spark, sf_dir).select("line_no", "name", segment_key(F.col("name")).alias("key"), "sequence", is_valid(F.col("sequence")).alias("valid"))


def walk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, identifier, start, end, orderkey, custkey, graph, n): a walk per order of a customer, two bases apart; every seventh range is one too long."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("orderkey"), F.col("o_custkey").cast("long").alias("custkey"))
    r = o.join(graph_sequences(spark, sf_dir), "orderkey").withColumn("n", F.length("graph").cast("long"))
    w = Window.partitionBy("custkey").orderBy("orderkey").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + 2).over(w), F.lit(0))
    return r.select(F.col("orderkey").alias("line_no"), F.concat(F.lit("c"), "custkey", F.lit("#1#chr")).alias("identifier"), start.alias("start"), (start + F.col("n") + F.when(F.col("orderkey") % 7 == 0, 1).otherwise(0)).alias("end"), "orderkey", "custkey", "graph", "n")


def walk_traversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W traversals in the form that the comparison takes: the walks of walk_records with the steps of their orders."""
    steps_of = path_traversals(spark, sf_dir).select("line_no", "steps")
    w = walk_records(spark, sf_dir).select("line_no", "identifier", F.lit("W").alias("record_type"), F.col("start").cast("decimal(21,0)").alias("start"), F.col("end").cast("decimal(21,0)").alias("end"))
    return w.join(steps_of, "line_no")


def walk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(identifier, source_index, sequence) of each customer that has walks: their graphs with two bases after each; of every tenth customer the first base is another."""
    from .functions.sequences import ordered_concat

    # By customer first: walks are dealt by it already.
    w = walk_records(spark, sf_dir)
    s = w.groupBy("custkey").agg(F.first("identifier").alias("identifier"), ordered_concat([F.col("start")], F.concat("graph", F.lit("AA"))).alias("s"))
    other = F.when(F.substring("s", 1, 1) == "A", "C").otherwise("A")
    changed = F.when(F.col("custkey") % 10 == 0, F.concat(other, F.substring(F.col("s"), F.lit(2), F.length("s")))).otherwise(F.col("s"))
    return s.select("identifier", (F.col("custkey") % 2 + 1).alias("source_index"), changed.alias("sequence"))
