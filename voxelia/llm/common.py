"""What the operators of this subpackage share: shared folders, tables, words and links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space, as in the class [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="voxelia-")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is unset (tests, one machine) is a temporary folder made, one a process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or own_dir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query as soon as it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    Its shuffle files go once it is written. Otherwise they lie on local disks until the driver happens to collect
    garbage, so those of all steps may add up.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, label), spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind frames made by written() once nothing reads them any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = hadoop(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(col):
    """Lower-case A-Z only, in the JVM."""
    return F.translate(col, UPPER, LOWER)


def components(links: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of links(a, b) by distributed union-find with large-star and small-star steps.

    Returns (node, component) for every node in a link, component being the smallest reachable node.
    Every round groups edges by node; each node keeps an edge to its smallest neighbour only, so a hub
    never sends more than its own number of edges. Rounds end when the edge set stops changing, which
    takes O(log^2 n) rounds; each round is written to the shared folder. Null ends are ignored.
    """
    spark = links.sparkSession
    edges, now = marked(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)

    def step(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if small:  # neighbours are all below a: link them and a itself to the smallest
            return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        # neighbours above a: link them to the smallest around a
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    for _ in range(max_rounds):
        if now[0] == 0:
            break
        after, mark = marked(step(step(edges, False), True), label)
        remove(spark, edges)
        edges, before, now = after, now, mark
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def marked(edges: DataFrame, label: str) -> tuple[DataFrame, tuple[int, int]]:
    """edges written, with their number and a hash of the set of them, taken while writing."""
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")), label)
    return out, (seen.get["n"], seen.get["x"])


#: Residual and whole members of a group meet in blocks of so many rows each.
BLOCK = 2048


def in_several(rows: DataFrame, label: str) -> DataFrame:
    """The rows (key, ...) whose key occurs more than once, written.

    Keys are counted with a map-side combine and joined back, so no task needs all rows of a key together;
    a key of a third of all rows is split by the adaptive join.
    """
    counted = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    return written(rows.join(counted, "key"), label)


def grouped(members: DataFrame, label: str) -> DataFrame:
    """(pivot, node) of members (key, node, n), written: in every bucket of several nodes, its pivot and all nodes, pivot included.

    The pivot is the node with the most copies n (then by hash), which is the same in most buckets of a
    family: near copies are nearer to the text they come from than to one another.
    """
    rank = F.call_function("shiftleft", F.least("n", F.lit(32767)).cast("long"), F.lit(48)).bitwiseOR(F.shiftrightunsigned(F.xxhash64("node"), 16))
    pivots = members.groupBy("key").agg(F.count("*").alias("m"), F.max_by("node", rank).alias("pivot")).where("m > 1").select("key", "pivot")
    all_ = written(members.select("key", "node").join(pivots, "key").select("pivot", "node"), label)
    out = written(all_.distinct(), label)
    remove(members.sparkSession, all_)
    return out


def near_sketches(percent: int, n_words: int, x: str = "x", y: str = "y"):
    """The condition that two parity sketches and set sizes leave room for a similarity of percent.

    Every shingle flips one bit of a sketch, so the Hamming distance is at most the symmetric difference,
    and that is at most (100 - percent) / (100 + percent) of |A| + |B| in sets that link.
    """
    apart = sum((F.bit_count(F.col(f"{x}_w{k}").bitwiseXOR(F.col(f"{y}_w{k}"))) for k in range(n_words)), F.lit(0))
    sizes = (100 * F.col(f"{x}_n") >= percent * F.col(f"{y}_n")) & (100 * F.col(f"{y}_n") >= percent * F.col(f"{x}_n"))
    return sizes & ((100 + percent) * apart <= (100 - percent) * (F.col(f"{x}_n") + F.col(f"{y}_n")))


def prefixed(df: DataFrame, prefix: str, n_words: int, *more) -> DataFrame:
    return df.select(*more, *[F.col(c).alias(f"{prefix}_{c}") for c in ("node", "n", *(f"w{k}" for k in range(n_words)))])


def residual_pairs(groups: DataFrame, sketches: Callable[[DataFrame], DataFrame], percent: int, n_words: int, label: str) -> DataFrame:
    """Pairs (a, b) that still have to be verified in groups (pivot, node, c, rest).

    ``rest`` marks the members whose class c isn't the pivot's. Only these are held against all members of
    their group, so the class that the pivot has gathered is never joined with itself. Both sides are cut
    into blocks of about BLOCK rows and each pair of blocks is joined under a key of its own; only pairs
    whose sketches leave room for a link come out of the join. A group of two has been settled with its
    pivot, so it needs no sketches.
    """
    sizes = groups.groupBy("pivot").agg(F.count("*").alias("m"), F.sum(F.col("rest").cast("long")).alias("r")).where("r > 0 and m > 2")
    rows = groups.join(sizes, "pivot")
    rows = rows.join(sketches(rows.select("node").distinct()), "node")
    rows = rows.withColumn("bi", F.ceil(F.col("r") / BLOCK).cast("int")).withColumn("bj", F.ceil(F.col("m") / BLOCK).cast("int"))
    salt = F.xxhash64("node", F.lit(1))
    rows = written(rows.withColumn("i", F.pmod(salt, F.col("bi")).cast("int")).withColumn("j", F.pmod(salt, F.col("bj")).cast("int")).drop("m", "r"), label)
    x = prefixed(rows.where("rest").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("bj") - 1))), "x", n_words, "pivot", "i", F.col("at").alias("j"), F.col("c").alias("x_c")).alias("x")
    y = prefixed(rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("bi") - 1))), "y", n_words, "pivot", F.col("at").alias("i"), "j", F.col("c").alias("y_c"), F.col("rest").alias("y_rest")).alias("y")
    same = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    open_ = (F.col("x_c") != F.col("y_c")) & (F.col("y_node") != F.col("y.pivot")) & (~F.col("y_rest") | (F.col("x_node") < F.col("y_node")))
    pairs = x.join(y, same & open_ & near_sketches(percent, n_words)).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    out = written(pairs.distinct(), label)
    remove(groups.sparkSession, rows)
    return out


def classes(groups: DataFrame, sketches: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], percent: int, n_words: int, label: str, bound_first: bool = False) -> DataFrame:
    """Classes (node, component) of nodes under verified links between members of a group.

    groups has (pivot, node), as grouped() makes them; sketches takes nodes (node) and returns (node, n, w0,
    ...), their set sizes and parity sketches; verify takes pairs (a, b) and returns those that link. First
    every member is held against its pivot, as many pairs as members. Then residual_pairs() holds the members
    that aren't in their pivot's class against the rest of the group. No node and no pair of different classes
    is left out. With ``bound_first``, pairs with a pivot must pass the sketches' bound before they are verified.
    """
    spark = groups.sparkSession
    star = written(groups.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), label)
    if bound_first:
        own = sketches(groups.select("node").distinct())
        both = star.join(prefixed(own, "x", n_words), F.col("a") == F.col("x_node")).join(prefixed(own, "y", n_words), F.col("b") == F.col("y_node"))
        near = written(both.where(near_sketches(percent, n_words)).select("a", "b"), label)
        remove(spark, star)
        star = near
    links = written(verify(star), label)
    first = written(components(links, label), label)
    own = groups.join(first, "node", "left").withColumn("c", F.coalesce("component", "node")).select("pivot", "node", "c")
    centre = first.select(F.col("node").alias("pivot"), F.col("component").alias("centre"))
    own = written(own.join(centre, "pivot", "left").withColumn("rest", F.col("c") != F.coalesce("centre", "pivot")).select("pivot", "node", "c", "rest"), label)
    pairs = residual_pairs(own, sketches, percent, n_words, label)
    remove(spark, star, first, own)
    more = written(verify(pairs), label)
    found = components(links.union(more), label)
    remove(spark, pairs, links, more)
    return found
