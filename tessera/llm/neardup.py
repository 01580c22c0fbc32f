"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Its sketch is the k
smallest of them.  Inverted lists of retained values generate overlaps, the union sketch of two
sketches estimates their similarity and drops pairs that are far below the limit, and the full
sets confirm every remaining pair exactly.

How work stays linear in groups of copies, without losing a link between different texts:

* equal sets fall into one class first (an aggregate with map-side combine), the smallest id stands
  for it;
* a document is listed only under its rarest retained values: two sets with similarity of 3/4 share so
  many retained values that their rarest ones cannot all differ (``least_shared``, ``can_meet``), hence
  values of passages that many unrelated documents share make no candidates;
* inside a list no pairs are enumerated: one hub is tested against every member, confirmed links merge
  components, a hub leaves its lists after its round, and a list ends as soon as its members lie in one
  component;
* documents of the lists that remain go on with whole sets instead of sketches, whose bounds are
  exact, so texts that share much, but not enough, seldom meet again (16, 64, ... hubs a round).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import Words, checked_broadcast, text_chunks
from tessera.session import cut_lineage, release

WORDS = 5
SKETCH = 128
#: chance that a linked pair shares fewer retained values than the candidate search counts on
MISS = 1e-9


def _least_drawn(items: int, common: int, k: int, miss: float = MISS) -> int:
    """How many of ``common`` among ``items`` values are surely, but for a chance ``miss``, under the k smallest: the
    lower tail of k draws."""
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    tail, m = 0.0, max(0, k - (items - common))
    while m < min(k, common):
        tail += math.exp(log(common, m) + log(items - common, k - m) - log(items, k))
        if tail > miss:
            break
        m += 1
    return m


def _least_shared(n: int, k: int, share: float = 0.75) -> int:
    """Retained values that a set of n items has in common with any set of similarity ``share``.

    A set larger than its sketch: draws from the largest possible union (n / share items, n of them common).  One that its
    sketch holds whole: exact if the partner is held whole too, but of a partner of up to n / share items that is not, only
    k are drawn, and the common ones among these count."""
    if n > k:
        union = int(n / share)
        return _least_drawn(union, int(share * union), k)
    common = lambda m: math.ceil(share / (1 + share) * (n + m) - 1e-9)
    partners = range(k + 1, int(n / share + 1e-9) + 1)
    return min([math.ceil(share * n), *(_least_drawn(m, common(m), k) for m in partners)])


#: as a sketch size: sets are kept whole
WHOLE = 1 << 30
#: set sizes from here on count as endless
LARGE = 2048
ENDLESS = 1 << 24


def shared_bounds(k: int = SKETCH) -> list[int]:
    """For set sizes 0 to LARGE: how many retained values a linked pair surely (but for MISS) shares."""
    return [_least_shared(n if n < LARGE else ENDLESS, k) for n in range(LARGE + 1)]


BOUNDS = shared_bounds()
LEAST_SHARED = BOUNDS[-1]


def least_shared(n: Column, k: int = SKETCH) -> Column:
    """How many retained values a set of size n surely shares with any linked partner."""
    if k >= WHOLE:
        return F.ceil(n * 3 / 4 - 1e-9).cast("int")
    bounds = BOUNDS if k == SKETCH else shared_bounds(k)
    return F.element_at(F.array(*map(F.lit, bounds)), F.least(n, F.lit(LARGE)) + 1)


def can_meet(a: str, b: str, k: int = SKETCH) -> Column:
    """Whether two sets (columns a_n, a_at, a_least and those of b: size, place of a common retained value in
    the set's rarest-first order, ``least_shared``) can be linked and have that value as the first that they share: behind it, both must
    hold enough values.  Linked sets that lie in their sketches whole share 3/7 of their sizes' sum."""
    n = lambda s: F.col(f"{s}_n")
    whole = (n(a) <= k) & (n(b) <= k)
    need = F.when(whole, F.ceil((n(a) + n(b)) * 3 / 7 - 1e-9)).otherwise(F.greatest(f"{a}_least", f"{b}_least"))
    room = lambda s: F.least(n(s), F.lit(k)) - F.col(f"{s}_at") + 1
    return (4 * F.least(n(a), n(b)) >= 3 * F.greatest(n(a), n(b))) & (room(a) >= need) & (room(b) >= need)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole word sequence if it is shorter."""
    words = Words(texts, lower=True)
    at, grams = words.grams(WORDS)
    bounds = np.searchsorted(at, words.first)
    out = []
    short = (words.count > 0) & (words.count < WORDS)
    whole = np.zeros(len(texts), np.uint64)
    if short.any():
        i = np.flatnonzero(short)
        whole[i] = words.runs(words.first[i], words.first[i] + words.count[i])
    for i in range(len(texts)):
        out.append(whole[i:i + 1] if short[i] else np.unique(grams[bounds[i]:bounds[i + 1]]))
    return out


def _digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of signed numbers in the order of the unsigned ones, so that Spark's sort finds the k smallest."""
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = (np.concatenate([*arrays, np.zeros(0, np.uint64)]) ^ np.uint64(1 << 63)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """doc_id, n (set size), digest (of the whole set; null if empty), sketch (k smallest)."""

    def run(batches):
        for part, texts in text_chunks(batches):
            sets = _sets(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([_digest(s) for s in sets], pa.binary()), _lists([s[:k] for s in sets])],
                names=["doc_id", "n", "digest", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, digest binary, sketch array<long>")


def _full_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part, texts in text_chunks(batches, size=1 << 20):
            sets = _sets(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(s) for s in sets], pa.binary()),
                                              _lists(sets)], names=["node", "digest", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, digest binary, items array<long>")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph (columns a, b): a row (node, comp) for each node
    that has a link, comp being the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest
    neighbour, then its smaller neighbours.  Both are grouped minima joined back, so a node
    with very many links is never gathered.  The number of passes grows with the logarithm of the longest path."""
    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    links = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a > b").distinct())
    before = state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        links = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a > b").distinct())
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        links = cut_lineage(
            links.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a > b").distinct())
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, digest, items (the full set) of the given classes (node, digest)."""
    nodes = cut_lineage(nodes.distinct())
    wanted = docs.select("doc_id", "text").join(
        checked_broadcast(nodes.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi")
    full = cut_lineage(_full_sets(wanted).join(checked_broadcast(nodes), ["node", "digest"], "left_semi")
                       .dropDuplicates(["node", "digest"]))
    release(nodes)
    return full


def _listed(sets: DataFrame, k: int) -> DataFrame:
    """Inverted lists of sets (node, n, items; of which ``k`` are retained): value, node, n, least (see
    ``least_shared``) and at (place in the set's rarest-first order), for the values that a
    linked partner can be met under."""
    rows = sets.select("node", "n", F.explode("items").alias("value"))
    frequent = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = (rows.join(frequent, "value").groupBy("node")
              .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v")))
    single = F.least("n", F.lit(k)) - F.size("v")  # values no other document retains come first
    least = least_shared(F.col("n"), k)
    room = F.greatest(F.least("n", F.lit(k)) - least + 1 - single, F.lit(0)).cast("int")
    return (shared.select("node", "n", least.alias("least"), single.alias("s"),
                          F.posexplode(F.slice("v", F.lit(1), room)).alias("i", "e"))
            .select("node", "n", "least", (F.col("s") + F.col("i") + 1).alias("at"), F.col("e.value").alias("value")))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose similarity is 0.75 or more."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"),
                                    F.col("sketch").alias(f"s{s}"), F.col("digest").alias(f"d{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    size = F.size(union)
    whole = (F.col("na") <= k) & (F.col("nb") <= k) & (F.size(F.array_union("sa", "sb")) <= k)
    near = F.when(whole, common * 4 >= size * 3).otherwise(common >= LEAST_SHARED)
    left = cut_lineage(both.where(near).select("a", "b", "na", "nb", "da", "db"))
    full = _sets_of(left.select(F.col("a").alias("node"), F.col("da").alias("digest")).unionByName(
        left.select(F.col("b").alias("node"), F.col("db").alias("digest"))), docs)
    pick = lambda s: full.select(F.col("node").alias(s), F.col("digest").alias(f"d{s}"),
                                 F.col("items").alias(f"i{s}"))
    shared = F.size(F.array_intersect("ia", "ib"))
    out = cut_lineage(left.join(pick("b"), ["b", "db"]).join(pick("a"), ["a", "da"])
                      .select("a", "b", "na", "nb", shared.alias("shared"))
                      .where("100 * shared >= 75 * (na + nb - shared)").select("a", "b"))
    release(left, full)
    return out


def _undecided(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``lists`` with each node's component, without those that lie in one component; of lists with equal rows, one."""
    here = lists.withColumn("comp", F.col("node")) if labels is None else lists.join(
        labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = here.groupBy("value").agg(
        F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node", "at")).alias("h"), F.bit_xor(F.xxhash64("node", "at", F.lit(1))).alias("i")).where("x < y")
    split = split.groupBy("x", "y", "n", "h", "i").agg(F.min("value").alias("value"))
    return cut_lineage(here.join(split.select("value"), "value"))


def near_duplicates(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked at a Jaccard similarity of 0.75 or more of their sets of five-word
    shingles (A-Z lower-cased); component_id is the smallest doc_id reachable over links.
    Null or wordless texts have n_shingles 0 and their own component; a text of fewer than five words is
    one shingle.  Repeated rows come back repeated; texts that share a doc_id are one document, so number them
    first if they are not.  A null doc_id takes no part: component_id null, kept true.  Other columns are ignored."""
    sketched = cut_lineage(sketches(docs, k))
    classes = cut_lineage(
        sketched.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    rows = cut_lineage(sketched.select("doc_id", "n", "digest"))
    release(sketched)
    lists = cut_lineage(_listed(classes.withColumnRenamed("sketch", "items"), k))
    labels, hubs, kept = None, 1, k
    while True:
        here = _undecided(lists, labels)
        release(lists)
        if here.isEmpty():
            break
        if hubs == 1 << 4:
            # what one hub a list did not settle goes on with whole sets, whose bounds are exact
            full = _sets_of(here.select("node").distinct().join(classes.select("node", "digest"), "node"), docs)
            lists = cut_lineage(_listed(full.select("node", F.size("items").alias("n"), "items"), kept := WHOLE))
            release(here, full)
            here = _undecided(lists, labels)
            release(lists)
        # the member with the fewest rare values is the likeliest to be what the others were copied from
        chosen = here.groupBy("value", F.pmod(F.xxhash64("node"), F.lit(hubs)).alias("turn")).agg(
            F.min(F.struct("at", "node", "n", "least", "comp")).alias("h"))
        chosen = cut_lineage(chosen.select("value", *(F.col(f"h.{c}").alias(f"hub_{c}") for c in ("node", "n", "least", "at", "comp"))))
        own = here.select("value", F.col("node").alias("own_node"), F.col("n").alias("own_n"), F.col("least").alias("own_least"),
                          F.col("at").alias("own_at"), F.col("comp").alias("own_comp"))
        pairs = (own.join(chosen, "value").where("own_comp <> hub_comp").where(can_meet("own", "hub", kept))
                 .select(F.least("own_node", "hub_node").alias("a"), F.greatest("own_node", "hub_node").alias("b")).distinct())
        found = _confirmed(pairs, classes, docs, k)
        if not found.isEmpty():
            old = labels
            labels = cut_lineage(components(found if old is None else old.select(
                F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found)))
            release(old)
        lists = cut_lineage(here.join(chosen.select("value", F.col("hub_node").alias("node")), ["value", "node"],
                                      "left_anti").drop("comp"))
        release(here, chosen, found)
        hubs = 16 if hubs == 1 else hubs * 4
    member = classes.select("digest", F.col("node").alias("own"))
    out = rows.select("doc_id", "n", "digest").join(member, "digest", "left")
    if labels is not None:
        out = out.join(labels.select(F.col("node").alias("own"), "comp"), "own", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "own", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), root.alias("component_id"),
                      F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))
