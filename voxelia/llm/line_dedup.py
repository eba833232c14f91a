"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

Shingles of a line are the character windows at every place of it, and the Jaccard similarity of the sets
of them decides. The signature holds the least hashes of the same set (bottom-k MinHash), and each
neighbouring pair of them is a band. Each hash that two lines don't share parts one pair of neighbours at most,
so lines of up to BANDS + 1 windows with 3/4 of them in common always share a band; longer ones share one of
BANDS bands with probability 0.99 at that limit, and more above it. Lines that share a band are candidates:
they meet the band's pivot, and whatever isn't of the pivot's class meets the whole group (common.classes).
Distributed union-find makes components. Of every component, the line of the smallest document id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelia.llm.common import classes, grouped, remove, written

WINDOW, BANDS = 10, 8
SPACES = " \t\r\x0b\x0c"
BROADCAST_IDS = 1_000_000
#: Parity sketches of lines have so many 64-bit words.
SKETCH_WORDS = 32


def normal(line: Column) -> Column:
    """Lower case, no white space at the ends."""
    return F.lower(F.trim(line, F.lit(SPACES)))


def visible(line: Column) -> Column:
    """Whether a line has a character other than white space: where normal isn't empty, without making it."""
    return F.ltrim(line, F.lit(SPACES)) != ""


def windows(norm: Column) -> Column:
    """64-bit hashes of the windows at every character; of a line shorter than a window, the line's.

    A window is a slice of the UTF-32 form, four bytes a character, so it is cut without reading what is
    before it. The inner lambda is bound to the encoded line, so that each line is encoded once.
    """
    def cut(u: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(u) - 4 * WINDOW + 1, F.lit(1)), F.lit(4))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(u, i, F.lit(4 * WINDOW))))

    return F.transform(F.array(F.encode(norm, "UTF-32")), cut)[0]


def shingles(norm: Column) -> Column:
    """The set of windows."""
    return F.array_distinct(windows(norm))


def pairs_of(least: Column) -> Column:
    """Band keys: hashes of neighbours among the least hashes; of a single one, its own."""
    n = F.size(least) - 1
    return F.when(n > 0, F.zip_with(F.slice(least, 1, n), F.slice(least, 2, n), lambda a, b: F.xxhash64(a, b))).otherwise(least)


def with_bands(each: DataFrame) -> DataFrame:
    """each with keys, the band keys of norm. A line shorter than a window is like no other, so it has none.

    The least hashes are taken from the front of the sorted windows; only where so few of these differ are all of them made distinct.
    """
    most, none = 4 * (BANDS + 1), F.array().cast("array<bigint>")
    sorted_ = each.withColumn("s", F.when(F.char_length("norm") >= WINDOW, F.sort_array(windows(F.col("norm"))))).withColumn("least", F.array_distinct(F.slice("s", 1, most)))
    whole = (F.size("least") > BANDS) | (F.size("s") <= most)
    least = sorted_.withColumn("least", F.slice(F.when(whole, F.col("least")).otherwise(F.array_distinct("s")), 1, BANDS + 1))
    return least.select(*each.columns, F.coalesce(F.array_distinct(pairs_of(F.col("least"))), none).alias("keys"))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, number, norm, node, second): lines with a visible character; row tells rows by id and text.

    node is a hash of norm, second another one: lines are only taken as equal where both are.
    """
    # the text's hash is taken below the generator, so that no line carries its whole text along; without outer,
    # every text would be split once more to see whether it has parts
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.split(text_col, "\n").alias("parts"))
    each = rows.select("id", "row", F.posexplode_outer("parts").alias("number", "line")).where(visible(F.col("line"))).select("id", "row", "number", normal(F.col("line")).alias("norm"))
    return each.select("*", F.xxhash64("norm").alias("node"), F.xxhash64(F.lit(WINDOW), "norm").alias("second"))


def texts_of(docs: DataFrame, signed: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, norm, n) of the nodes, n the size of the set, written. One line of each node is cut out of its row again; lines of no node aren't made."""
    few = nodes.count() <= BROADCAST_IDS
    wanted = signed.select("node", "row", "number").join(F.broadcast(nodes) if few else nodes, "node").groupBy("node").agg(F.min(F.struct("row", "number")).alias("p"))
    wanted = wanted.groupBy(F.col("p.row").alias("row")).agg(F.collect_list(F.struct("p.number", "node")).alias("of"))
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text")).join(F.broadcast(wanted) if few else wanted, "row")
    each = rows.select(F.split("text", "\n").alias("parts"), "of").select("parts", F.explode("of").alias("of")).select(F.col("of.node").alias("node"), normal(F.get("parts", F.col("of.number"))).alias("norm"))
    # rows equal in id and text give their line again
    return written(each.where(F.xxhash64("norm") == F.col("node")).distinct().withColumn("n", F.size(shingles(F.col("norm")))), "texts")


def by_size(shared: DataFrame, text: DataFrame) -> DataFrame:
    """shared (key, node) under keys of a size class: sizes of a pair that links are within 4/3, in one class or in neighbours, so each has two."""
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)))
    both = shared.join(text.select("node", "n"), "node").select("key", "node", F.explode(F.array(size, size + 1)).alias("size"))
    return both.groupBy(F.xxhash64("key", "size").alias("key"), "node").agg(F.count("*").alias("n"))


def alike(pairs: DataFrame, text: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes, with x_n and y_n, whose sizes leave room for a similarity of percent."""
    x, y = (text.select(F.col("node").alias(k), F.col("n").alias(f"{t}_n")) for k, t in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where((100 * F.col("x_n") >= percent * F.col("y_n")) & (100 * F.col("y_n") >= percent * F.col("x_n")))


def verified(text: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of percent or more; text has their sizes n.

    Sizes are compared before any text moves, and only texts of the pairs left do.
    """
    pairs = written(alike(pairs, text, percent), "alike")
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "alike-nodes")
    few = nodes.count() <= BROADCAST_IDS
    needed = text.select("node", "norm").join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
    both = pairs.join(needed.withColumnsRenamed({"node": "a", "norm": "x"}), "a").join(needed.withColumnsRenamed({"node": "b", "norm": "y"}), "b")
    common = F.size(F.array_intersect(windows(F.col("x")), windows(F.col("y"))))  # without repeats
    out = written(both.where((100 + percent) * common >= percent * (F.col("x_n") + F.col("y_n"))).select("a", "b"), "verified")
    remove(text.sparkSession, pairs, nodes)
    return out


def sketched(text: DataFrame) -> DataFrame:
    """(node, n, w0, ...): the number of shingles and their parities, every shingle flipping one bit.

    Words of a node are made first, then set side by side, both where the node's text lies, so that only texts are shuffled.
    """
    # the array is a column of its own, as a generator over an interpreted lambda would be interpreted too; it is
    # never empty, and without outer Spark would make it once more to see that
    each = text.select("node", "norm").repartition("node").select("node", shingles(F.col("norm")).alias("all")).select("node", F.explode_outer("all").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(SKETCH_WORDS - 1)).cast("int")
    words = each.select("node", word.alias("word"), bit.alias("bit")).groupBy("node", "word").agg(F.bit_xor("bit").alias("bits"), F.count("*").alias("m"))
    return words.groupBy("node").agg(F.sum("m").alias("n"), *[F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(SKETCH_WORDS)])


def removed(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, numbers): which lines of each row of docs another line stands for."""
    spark = docs.sparkSession
    each = lines(docs, id_col, text_col)
    signed = written(with_bands(each).select("node", "second", "id", "row", "number", "keys"), "signed")
    rows = signed.select(F.explode("keys").alias("key"), "node")
    # a key of one line alone, however often, needs no text
    several = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    shared = written(rows.join(several, "key"), "shared")
    nodes = written(shared.select("node").distinct(), "nodes")
    text = texts_of(docs, signed, nodes, id_col, text_col)
    members = written(by_size(shared, text), "members")
    groups = grouped(members, "groups")
    remove(spark, shared, nodes, members)
    found = written(classes(groups, lambda wanted: sketched(text.join(wanted, "node", "left_semi")), lambda pairs: verified(text, pairs, percent), percent, SKETCH_WORDS, "links"), "classes")
    remove(spark, groups, text)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "number")
    # of nodes with one line and no link nothing goes; a node's lines are equal to the one with the least second hash, or else they are left alone
    nodes = signed.groupBy("node").agg(F.count("*").alias("n"), F.min("second").alias("least")).join(found, "node", "left").where("n > 1 or component is not null")
    linked = nodes.select("node", "least", F.coalesce("component", "node").alias("component"))
    kept = written(signed.select("node", "second", "id", "row", "number").join(linked, "node"), "lines")
    stays = kept.groupBy("component").agg(F.min(place).alias("stays"), F.count("*").alias("total")).where("total > 1").select("component", "stays")
    gone = kept.where("second = least").select("component", "id", "row", "number", place.alias("place")).join(stays, "component").where(~F.col("place").eqNullSafe(F.col("stays")))
    out = written(gone.groupBy("id", "row").agg(F.collect_set("number").alias("numbers")), "gone")
    remove(spark, signed, found, kept)
    return out


def dedup(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of text_col, and n_lines and n_removed (long) added.

    Of lines that are equal but for letter case and outer white space, or linked by a Jaccard similarity
    of percent or more, the one of the smallest id, then row and line, stays; a null id comes last. Lines
    without a visible character stay where they are and aren't counted. A null text stays null, with no
    lines. Rows equal in id and text get the same result. All rows and other columns stay as they are,
    but n_lines and n_removed are replaced if docs has them. An empty table gives an empty table.
    Lines shorter than a window of 10 characters link with equal lines only. Lines of any length are read whole.
    """
    gone = removed(docs, percent, id_col, text_col).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("numbers").alias("__numbers"))
    rows, numbers = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("__numbers")), F.lit(0))).first()
    gone = F.broadcast(gone) if rows + numbers <= BROADCAST_IDS else gone
    all_ = docs.withColumn("__own", F.xxhash64(id_col, text_col)).join(gone, (F.col("__own") == F.col("__row")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    parts = F.split(text_col, "\n")
    none = F.col("__numbers").isNull()
    text = F.when(none, F.col(text_col)).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__numbers", i)), "\n"))
    seen = F.coalesce(F.size(F.filter(parts, visible)), F.lit(0)).cast("long")
    numbered = all_.withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(seen))
    numbered = numbered.withColumn("n_removed", F.coalesce(F.size("__numbers"), F.lit(0)).cast("long"))
    numbered = numbered.withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long"))).withColumn(text_col, text)
    return numbered.drop("__own", "__row", "__id", "__numbers")
