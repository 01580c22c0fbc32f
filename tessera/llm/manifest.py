"""Merkle manifest of a dataset: levels built once as parent-linked node rows, proofs by a recursive query.

Each source has a tree of arity three over its rows in ascending doc_id; the subroots, ordered by source, have one more.
Five levels are built at a time: the 243 nodes of a block meet in one row of one shuffle, and each becomes
a node row with its siblings in these five levels and a link to the node above the block.  Building a dataset of n rows
takes log243(n) rounds, and all rows above the leaves together are n / 242.

``climb`` is Spark's recursive query: from every leaf it ascends link by link, appends the siblings it passes and
folds a hash (the leaf's own or a tampered one) with them.  A node that many leaves pass is stored in as many
salted rows (one for 243 leaves, up to 4,096), so the climb of one large source is not met by one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranking import cumulative
from tessera.session import checkpoint_dir, cut_lineage, release

ARITY = 3
HEIGHT = 5
BLOCK = ARITY**HEIGHT
MOST_SALTS = 4_096
#: key of the tree over the subroots; sources have "s" and their name, the null source the empty string
TOP = "t"


def _text(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """Digest of a row (binary), with another ``text`` if one is given."""
    fields = [docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], docs["text"] if text is None else text]
    return F.unhex(F.sha2(F.concat(*(_text(c) for c in fields)), 256))


def without_line_ends(docs: DataFrame) -> Column:
    """The tampering of the registered query: rows with an even crc32 of their decimal doc_id lose their line ends."""
    even = F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(2)) == 0
    return F.when(even, F.translate(docs["text"], "\n", "")).otherwise(docs["text"])


def _salts(leaves: Column) -> Column:
    return F.least(_div(leaves + BLOCK - 1, BLOCK), F.lit(MOST_SALTS)).cast("int")


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _div(c: Column, n: int) -> Column:
    return F.call_function("div", c, F.lit(n))


def _above(level: Column) -> Column:
    """Digests of the runs of three of a level."""
    runs = F.sequence(F.lit(0), _div(F.size(level) - 1, ARITY).cast("int"))
    return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(level, j * ARITY + 1, F.lit(ARITY)), ""), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """nodes: tree, pos, hash (binary), leaves, total (nodes of the tree at this level).  One row per block:
    tree, block, total, leaves, top, and members (pos, path: siblings before and after, level by level)."""
    grouped = nodes.groupBy("tree", _div(F.col("pos"), BLOCK).alias("block"), "total").agg(
        F.sum("leaves").alias("leaves"),
        F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("m"))
    height = F.lit(HEIGHT)
    for h in range(HEIGHT - 1, -1, -1):
        height = F.when(F.col("total") <= ARITY**h, F.lit(h)).otherwise(height)
    rows = grouped.withColumns({"height": height, "a0": F.transform("m", lambda x: _hex(x["hash"]))})
    for h in range(1, HEIGHT + 1):
        rows = rows.withColumn(f"a{h}", F.when(F.col("height") >= h, _above(F.col(f"a{h - 1}"))))
    top = F.coalesce(*(F.when(F.col("height") == h, F.col(f"a{h}")[0]) for h in range(HEIGHT + 1)))

    def path(i):
        steps = []
        for h in range(HEIGHT):
            at = _div(i, ARITY**h).cast("int")
            first = at - at % ARITY
            level = F.col(f"a{h}")
            steps.append(F.when(F.col("height") > h, F.struct(
                F.unhex(F.array_join(F.slice(level, first + 1, at - first), "")).alias("l"),
                F.unhex(F.array_join(F.slice(level, at + 2, first + ARITY - 1 - at), "")).alias("r"))))
        return F.filter(F.array(*steps), lambda s: s.isNotNull())

    members = F.transform("m", lambda x, i: F.struct(x["pos"].alias("pos"), path(i).alias("path")))
    return rows.select("tree", "block", "total", "leaves", F.unhex(top).alias("top"), members.alias("members"))


def _tree(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """Written node rows of each band (five levels) of the trees over ``nodes``, and what remains: tree, top, leaves.

    A node row: tree, band, pos, path, up_band (null for the last band), up_pos, up_salts, end (hash above a last block)."""
    bands, ends, band = [], [], 0
    while True:
        built = cut_lineage(_blocks(nodes))
        last = F.col("total") <= BLOCK
        bands.append(built.select(
            "tree", F.lit(band).alias("band"), F.when(~last, F.lit(band + 1)).alias("up_band"),
            F.when(~last, F.col("block")).alias("up_pos"), _salts(F.col("leaves")).alias("up_salts"),
            F.when(last, F.col("top")).alias("end"), F.inline("members")))
        ends.append(built.where(last).select("tree", "top", "leaves"))
        if largest <= BLOCK:
            break
        nodes = built.where(~last).select("tree", F.col("block").alias("pos"), F.col("top").alias("hash"), "leaves",
                                          _div(F.col("total") + BLOCK - 1, BLOCK).alias("total"))
        largest, band = -(-largest // BLOCK), band + 1
    done = ends[0]
    for more in ends[1:]:
        done = done.unionByName(more)
    return bands, done


class Manifest:
    """Written tables of a dataset's tree: ``start`` (a row per leaf: what the climb begins with), ``nodes`` (the
    salted node rows above) and ``root`` (hex; null for an empty dataset)."""

    def __init__(self, start: DataFrame, nodes: DataFrame, root: str | None):
        self.start, self.nodes, self.root = start, nodes, root


def build(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are no part of it).

    ``changed``: text from which the folded hash starts in place of the row's own.  Nulls are digested as ``-``; a
    null doc_id comes first in its source and the null source first of all.  Rows with one doc_id follow each other by digest,
    and repeated rows are leaves of their own."""
    own = leaf(docs)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("")).alias("tree"), docs["doc_id"].alias("doc_id"),
        own.alias("hash"), (own if changed is None else leaf(docs, changed)).alias("folded"),
        F.lit(1).cast("long").alias("leaves"), F.monotonically_increasing_id().alias("tie"))
    ranked = cumulative(rows, ["tree"], ["doc_id", "hash", "tie"], weight="leaves", before="pos").drop("tie")
    leaves = cut_lineage(ranked)
    largest = leaves.agg(F.max("total")).first()[0]
    if largest is None:
        empty = leaves.select("doc_id", "hash", *(F.lit(None).cast(t).alias(c) for c, t in START[2:]))
        return Manifest(empty, None, None)
    bands, subroots = _tree(leaves.select("tree", "pos", "hash", "leaves", "total"), largest)
    subroots = subroots.select("tree", F.col("top").alias("hash"), "leaves")
    at = cut_lineage(cumulative(subroots.withColumn("one", F.lit(1).cast("long")), [], ["tree"], weight="one", before="pos"))
    tops, root = _tree(at.select(F.lit(TOP).alias("tree"), "pos", "hash", "leaves", "total"), at.agg(F.max("total")).first()[0])
    root = bytes(root.first()["top"]).hex()

    # the last band of a source goes on in the tree over the subroots
    over = at.select("tree", F.col("pos").alias("over"), _salts(F.col("leaves")).alias("over_salts"))

    def linked(band):
        more = band["end"].isNotNull()
        return band.join(over.withColumnRenamed("tree", "own"), F.when(more, band["tree"]) == F.col("own"), "left").select(
            "tree", "band", "pos", "path", F.when(more, F.lit(TOP)).otherwise(F.col("tree")).alias("up_tree"),
            F.when(more, F.lit(0)).otherwise(F.col("up_band")).alias("up_band"),
            F.when(more, F.col("over")).otherwise(F.col("up_pos")).alias("up_pos"),
            F.when(more, F.col("over_salts")).otherwise(F.col("up_salts")).alias("up_salts"), F.col("end").alias("subroot"))

    above = [linked(b) for b in bands[1:]]
    above += [t.select("tree", "band", "pos", "path", F.when(F.col("end").isNull(), F.lit(TOP)).alias("up_tree"), "up_band",
                       "up_pos", "up_salts", F.lit(None).cast("binary").alias("subroot")) for t in tops]
    nodes = above[0]
    for more in above[1:]:
        nodes = nodes.unionByName(more)
    passed = _passed(bands, at, tops)
    salted = nodes.join(passed, ["tree", "band", "pos"]).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    nodes = cut_lineage(salted)
    mark = F.xxhash64("hash", "doc_id")
    first = leaves.join(linked(bands[0]).drop("band"), ["tree", "pos"])
    start = cut_lineage(first.select(
        "doc_id", "hash", mark.alias("mark"), F.col("up_tree").alias("tree"), F.col("up_band").alias("band"),
        F.col("up_pos").alias("pos"), F.pmod(mark, F.col("up_salts")).cast("int").alias("salt"),
        _siblings("path").alias("siblings"), _fold("path", _hex(F.col("folded"))).alias("folded"), "subroot"))
    release(leaves)
    return Manifest(start, nodes, root)


START = (("doc_id", "long"), ("hash", "binary"), ("mark", "long"), ("tree", "string"), ("band", "int"), ("pos", "long"),
         ("salt", "int"), ("siblings", "binary"), ("folded", "string"), ("subroot", "binary"))


def _passed(bands: list[DataFrame], subroots: DataFrame, tops: list[DataFrame]) -> DataFrame:
    """tree, band, pos and salts of every node above the leaves of its source."""
    links = [b.where("up_band is not null").select("tree", F.col("up_band").alias("band"), F.col("up_pos").alias("pos"),
                                                   F.col("up_salts").alias("salts")) for b in [*bands, *tops]]
    links.append(subroots.select(F.lit(TOP).alias("tree"), F.lit(0).alias("band"), "pos", _salts(F.col("leaves")).alias("salts")))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return every.distinct()


def _siblings(path: str) -> Column:
    return F.aggregate(path, F.lit(b""), lambda acc, p: F.concat(acc, p["l"], p["r"]))


def _fold(path: str, own: Column) -> Column:
    return F.aggregate(path, own, lambda acc, p: F.sha2(F.concat(_hex(p["l"]), acc, _hex(p["r"])), 256))


CLIMB = """
WITH RECURSIVE climb(doc_id, hash, mark, tree, band, pos, salt, siblings, folded, subroot) AS (
  SELECT doc_id, hash, mark, tree, band, pos, salt, siblings, folded, subroot FROM {start}
  UNION ALL
  SELECT c.doc_id, c.hash, c.mark, n.up_tree, n.up_band, n.up_pos, CAST(pmod(c.mark, n.up_salts) AS INT),
    concat(c.siblings, aggregate(n.path, X'', (acc, p) -> concat(acc, p.l, p.r))),
    aggregate(n.path, c.folded, (acc, p) -> sha2(concat(lower(hex(p.l)), acc, lower(hex(p.r))), 256)),
    coalesce(c.subroot, n.subroot)
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.band = n.band AND c.pos = n.pos AND c.salt = n.salt)
SELECT * FROM climb WHERE tree IS NULL"""


def climb(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, siblings (hex, from the leaf to the root), folded_root and verified for each leaf.

    The recursive query runs in a session of its own, as Spark bounds its rows by a setting (a million for all levels of
    all leaves together) that this dataset must lift and other queries keep."""
    start, nodes, root = manifest.start, manifest.nodes, manifest.root
    if root is not None:
        spark = start.sparkSession
        own = spark.newSession()
        own.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        mark = uuid.uuid4().hex
        names = {}
        for name, table in (("start", start), ("nodes", nodes)):
            names[name] = f"{name}_{mark}"
            own.read.parquet(table._written_path).createOrReplaceTempView(names[name])
        path = checkpoint_dir(spark).rstrip("/") + "/tables/" + mark
        own.sql(CLIMB.format(**names)).write.parquet(path)
        for view in names.values():
            own.catalog.dropTempView(view)
        start = spark.read.parquet(path)
    folded = F.col("folded")
    return start.select("doc_id", _hex(F.col("hash")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
                        F.lit(root).cast("string").alias("root"), _hex(F.col("siblings")).alias("siblings"), folded.alias("folded_root"),
                        (folded == F.lit(root)).alias("verified"))


def verify(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """``climb`` of a manifest built from ``docs``: one row per row; see ``build`` for odd rows.  No rows, no result."""
    return climb(build(docs, changed))
