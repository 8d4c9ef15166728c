"""Connected components of a table of links, by large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import stage, unstage


#: Links of a partition, at least; rounds over few links run few tasks.
PART_ROWS = 200_000


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Link the neighbours of every node to the smallest of them.

    The smallest neighbours are staged, so that Spark may split the rows of a
    node with very many neighbours among tasks.
    """
    both = edges.union(edges.select("b", "a")) if large else edges
    least = stage(both.groupBy("a").agg(F.min("b").alias("low")).coalesce(parts), "least")
    low = F.least("a", "low")
    met = both.join(least, "a").select("a", "b", low.alias("low"))
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
    result = stage(out.filter("a > b").distinct().coalesce(parts), "edges")
    unstage(least)
    return result


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of (a, b): the smallest id it can reach.

    Links of a node with itself and links to null are left out. Rounds go on
    until nothing changes; their number grows as the logarithm of the longest
    path, and links never leave the executors.
    """
    valid = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    current = stage(
        valid.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = _mark(current)
    while before[0]:
        parts = 4 + 2 * before[0] // PART_ROWS
        wide = _star(current, True, parts)
        narrow = _star(wide, False, parts)
        after = _mark(narrow)
        same, before = before == after, after
        unstage(current)
        unstage(wide)
        current = narrow
        if same:
            break
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
