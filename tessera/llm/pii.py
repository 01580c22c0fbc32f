"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans (email, ip, card, phone) are found by fixed patterns.  They are the seeds of a graph between lexical
patterns (the one and the two words of the text before it) and instances (the base spans, tokens that hold a digit,
runs of neighbouring numbers, and what looks like an address, also spelled with "(at)" or "at" and "dot"):
a pattern's confidence for a kind is the smoothed share of its instances' confidence, an instance's confidence
is that of the independent patterns it stands in; Spark iterates both by joins and grouped sums.  Instances behind
patterns of high confidence that are not base spans become spans of that kind.

Positions come from the pieces between matches.  The patterns below are rewritten without
backtracking (possessive quantifiers, starts at the first character of a run or where the last match ended),
which finds the same matches in linear time and constant stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import checked_broadcast, row_key, unused
from tessera.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must contain for a pattern to match
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: a number of digits, brackets and signs; it ends its token but for punctuation
_NUMBER = r"\(?+[0-9]++(?:[()./-]++[0-9]++)*+\)?+(?=[^A-Za-z0-9\s]*+(?:\s|\z))"
_DOT = r"\x20?[\[({<]dot[\])}>]\x20?"
#: addresses, also with the at sign written out
ADDRESS = (r"(?:[^\s@]*+@\S*+|(?i:[a-z0-9._%+-]++(?:"
           rf"\x20?[\[({{<]at[\])}}>]\x20?[a-z0-9-]++(?:(?:\.|{_DOT}|\x20dot\x20)[a-z][a-z0-9-]*+)*+"
           rf"|\x20at\x20[a-z0-9-]++(?:(?:{_DOT}|\x20dot\x20)[a-z][a-z0-9-]*+)++))(?!\S*@))")
#: instances: an address, neighbouring numbers, any other token with a digit
TOKEN = (rf"(?<!\S)(?:{ADDRESS}|\+?+{_NUMBER}(?:\x20(?![0-9]++\.[0-9]++\.[0-9]++\.){_NUMBER})*+|[^\s0-9]*+[0-9]\S*+)")
ROUNDS = 3
SUPPORT = 5
CONFIDENT = 0.8

_SPAN = "array<struct<s:int,e:int,v:string,before:array<string>>>"


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """All matches of ``pattern``: start and end in code points, the match, the last words before it (the nearest first)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("p"), hits.alias("m"))
    none = F.array().cast(_SPAN)

    def add(acc, x):
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        near = F.slice(F.reverse(F.split(F.concat(acc["tail"], x["p"]), r"\s+", -1)), 1, 3)
        return F.transform(F.array(near), lambda w: F.struct(
            end.alias("at"), F.concat(F.array_join(F.reverse(w), " "), x["m"]).alias("tail"),
            F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("v"), w.alias("before")))).alias("out")))[0]

    walked = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out")), add)["out"]
    return F.when(text.rlike(hint), walked).otherwise(none)


def _valid(kind: str):
    """Condition on a match of ``kind``."""
    def test(x):
        digits = F.regexp_replace(x["v"], "[^0-9]", "")
        if kind == "ip":
            part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
            return x["v"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")
        if kind == "card":
            return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
        if kind == "phone":
            return F.length(digits).between(9, 15)
        return F.lit(True)

    return test


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, base (array of kind number, s, e, v, before by kind, then start) and tokens (see TOKEN) of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), row_key().alias("key"))
    for kind in KINDS:
        rows = rows.withColumn(kind, F.filter(_matches(F.col("text"), PATTERNS[kind], HINTS[kind]), _valid(kind)))
    rows = rows.withColumn("tokens", _matches(F.col("text"), TOKEN, r"[0-9@]|(?i:\bat\b)"))

    def numbered(i):
        return lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"),
                                  x["before"].alias("before"))

    parts = [F.transform(kind, numbered(i)) for i, kind in enumerate(KINDS)]
    return rows.select("doc_id", "key", F.concat(*parts).alias("base"), "tokens")


def instances(found: DataFrame) -> DataFrame:
    """One row per instance and pattern: key, s, e, value, kind (of a base span, else null), pattern.  A base span that
    begins in another one is left out, and so are tokens that overlap base spans."""
    def first(b):
        return ~F.exists("base", lambda o: (o["e"] > b["s"]) & ((o["s"] < b["s"]) | ((o["s"] == b["s"]) & (o["kind"] < b["kind"]))))

    def row(x, value, kind):
        return F.struct(x["s"].alias("s"), (x["s"] + F.char_length(value)).alias("e"), value.alias("value"), kind.alias("kind"),
                        x["before"].alias("before"))

    seeds = F.transform(F.filter("base", first), lambda b: row(b, b["v"], b["kind"]))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (b["e"] > t["s"])))
    rest = F.transform(free, lambda t: row(t, F.regexp_replace(t["v"], r"[.,;:!?)\]\"']++$", ""), F.lit(None).cast("int")))
    words = F.filter(F.transform("i.before", lambda w: F.regexp_replace(F.lower(w), r"[(<\[{\"']++$", "")), lambda w: w != "")
    rows = found.select("key", F.explode(F.concat(seeds, rest)).alias("i")).select("key", "i.*", F.slice(words, 1, 2).alias("w"))
    pattern = F.explode(F.when(F.size("w") >= 2, F.array(F.col("w")[0], F.concat_ws(" ", F.col("w")[1], F.col("w")[0])))
                        .when(F.size("w") == 1, F.array(F.col("w")[0])).otherwise(F.array().cast("array<string>")))
    return rows.select("key", "s", "e", "value", "kind", pattern.alias("pattern"))


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT,
                       confident: float = CONFIDENT) -> DataFrame:
    """pattern, kind, confidence of the patterns to trust; edges: distinct pattern, value, and kind (of the seed, else null)."""
    pairs = cut_lineage(edges.groupBy("pattern", "value").agg(F.first("kind", ignorenulls=True).alias("kind")))
    size = cut_lineage(pairs.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= support))
    belief = cut_lineage(pairs.where("kind is not null").select("value", "kind", F.lit(1.0).alias("p")).distinct())
    seeds, trusted = belief, None
    for _ in range(rounds):
        scored = (pairs.select("pattern", "value").join(belief, "value").groupBy("pattern", "kind")
                  .agg(F.sum("p").alias("mass"), F.sum(F.when(F.col("p") > 0.5, 1).otherwise(0)).alias("n")).join(size, "pattern"))
        trusted = cut_lineage(scored.withColumn("confidence", F.col("mass") / (F.col("size") + 1))
                              .where((F.col("confidence") >= confident) & (F.col("n") >= support))
                              .select("pattern", "kind", "confidence"))
        doubt = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))
        reached = (pairs.where("kind is null").select("pattern", "value").join(trusted, "pattern")
                   .groupBy("value", "kind").agg((1 - doubt).alias("p")))
        belief = cut_lineage(seeds.unionByName(reached))
    return trusted


def find(docs: DataFrame) -> DataFrame:
    """doc_id, key (see ``row_key``), base and spans (arrays of kind number, s, e) for each row of
    ``docs`` (doc_id, text).

    ``spans`` has the base ones and those that patterns of high confidence discover outside them.  Null texts read
    as empty and have none; repeated rows have equal spans; a null doc_id is kept.  Other columns are ignored."""
    found = cut_lineage(base_spans(docs))
    seen = cut_lineage(instances(found.where(F.size("tokens") > 0).dropDuplicates(["key"])))
    trusted = confident_patterns(seen.select("pattern", "value", "kind"))
    alike = F.col("value").rlike("[0-9].*[0-9].*[0-9].*[0-9]") | (
        (F.col("kind") == KINDS.index("email")) & F.col("value").rlike(rf"^{ADDRESS}$"))
    new = (seen.where("kind is null").drop("kind").join(checked_broadcast(trusted), "pattern").where(alike)
           .groupBy("key", "s", "e").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best"))
           .groupBy("key").agg(F.collect_list(F.struct((-F.col("best.k")).alias("kind"), "s", "e")).alias("more")))
    slim = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e")))
    more = F.coalesce("more", F.array().cast("array<struct<kind:int,s:int,e:int>>"))
    return (found.select("doc_id", "key", slim.alias("base")).join(checked_broadcast(cut_lineage(new)), "key", "left")
            .select("doc_id", "key", "base", F.array_sort(F.concat("base", more)).alias("spans")))


def span_string(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["s"], x["e"])), ",")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans
    become one, named by the first.  Other columns are returned as they are, whatever their names."""
    key, own = unused(docs, "key"), unused(docs, "spans")
    spans = find(docs).where(F.size("spans") > 0).select(
        F.col("key").alias(key), F.col("spans").alias(own)).dropDuplicates([key])
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform(own, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def add(acc, x):
        outside = x["s"] >= acc["at"]
        text = F.when(outside, F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, x["s"] - acc["at"]), names[x["kind"]])
                      ).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), text.alias("out"))

    def finish(acc):
        return F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.char_length("text")))

    masked = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, finish)
    return (docs.withColumn(key, row_key()).join(
        checked_broadcast(cut_lineage(spans)), key, "left")
        .withColumn("text", F.when(F.col(own).isNotNull(), masked).otherwise(F.col("text"))).select(*docs.columns))
