"""Connected components of a table of links, by contraction.

Every node is hooked to its smallest neighbour, the hooks are flattened by
pointer jumping, links are renamed to the roots and those inside a tree drop
out. The rest is a smaller graph of the same kind. Each step is a written table;
nothing but counts reaches the driver.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def _flatten(scratch: Scratch, up: DataFrame) -> DataFrame:
    """up: (node, label) with label <= node. Labels become roots, two jumps at a time."""
    while True:
        top = up.where("node <> label")
        once = top.select(F.col("node").alias("label"), F.col("label").alias("one"))
        twice = top.select(F.col("node").alias("one"), F.col("label").alias("two"))
        nxt = up.join(once, "label", "left").join(twice, "one", "left")
        nxt = nxt.select("node", F.coalesce("two", "one", "label").alias("label"), F.col("two").isNotNull().alias("moved"))
        nxt = scratch.keep(nxt, "jump", moves=F.col("moved"))
        scratch.drop(up)
        out = nxt.select("node", "label")
        out._scratch_path = nxt._scratch_path
        if not nxt.moves:
            return out
        up = out


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node
    of its component. Self links and repeated links do no harm."""
    rest = scratch.keep(links.select("a", "b"), "links")
    known = None
    while known is None or rest.n_rows:
        both = rest.select(F.col("a").alias("node"), "b").unionByName(rest.select(F.col("b").alias("node"), F.col("a").alias("b")))
        up = both.groupBy("node").agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))
        up = _flatten(scratch, scratch.keep(up, "up"))
        if known is None:
            known = scratch.keep(up, "known")
        else:
            top = up.select(F.col("node").alias("label"), F.col("label").alias("root"))
            nxt = scratch.keep(known.join(top, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "known")
            scratch.drop(known)
            known = nxt
        a, b = up.toDF("a", "la"), up.toDF("b", "lb")
        nxt = scratch.keep(rest.join(a, "a").join(b, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
        scratch.drop(rest, up)
        rest = nxt
    scratch.drop(rest)
    return known
