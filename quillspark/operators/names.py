"""Names that are spelt almost alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import name_key
from quillspark.operators.components import components
from quillspark.session import cut

Q = 3  # characters of a gram


def similar(names: DataFrame, name: str, edits: int = 1) -> DataFrame:
    """a < b, edits: the pairs of different values that at most so many inserted, deleted or changed characters make equal.

    For one edit see ``_one_edit``: no pair is looked at that isn't in the result. For more, an edit touches Q of the overlapping grams of a padded name, so of the Q * edits + 1 rarest grams of one name another one within
    reach holds at least one among its own rarest: an equi-join on these prefixes finds all pairs. Names too short for that meet each other besides.
    Lengths that differ by more than ``edits`` are left out before the distance is worked out, which stops at ``edits``. Copies of a name are one name; nulls are left out.
    """
    need = Q * edits + 1
    known = cut(names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct().withColumn("size", F.char_length("name")))
    if edits == 1:
        return _one_edit(known)
    # a gram also carries how often it came before, so repeated grams count as often as they occur
    padded = F.concat(F.lit("\x01" * (Q - 1)), F.col("name"), F.lit("\x02" * (Q - 1)))
    grams = known.select("name", "size", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") + Q - 1), lambda k: F.substring(padded, k, Q))).alias("gram"))
    grams = grams.groupBy("name", "size", "gram").agg(F.count("*").alias("n")).select("name", "size", F.explode(F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n")), lambda k: F.struct("gram", k.alias("k")))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = grams.join(often, "gram").groupBy("name", "size").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "gram"))), 1, need).alias("grams"))  # a name's own grams
    by_gram = ranked.select("name", "size", F.explode(F.transform("grams", lambda g: F.concat(g["gram"]["gram"], F.lit("\x03"), g["gram"]["k"].cast("string")))).alias("key"))
    short = known.where(F.col("size") <= need - Q).select("name", "size", F.lit("").alias("key"))  # edits can touch all of their grams
    keyed = by_gram.unionByName(short)
    other = keyed.select(F.col("name").alias("b"), F.col("size").alias("b_size"), "key")
    pairs = keyed.withColumnRenamed("name", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.abs(F.col("size") - F.col("b_size")) <= edits))
    pairs = pairs.select("a", "b").distinct().withColumn("edits", F.levenshtein("a", "b", edits))
    return pairs.where("edits >= 0")


def _one_edit(known: DataFrame) -> DataFrame:
    """a < b, edits: the pairs of different names (with their size) that one edit makes equal, each found once.

    Names that differ in one place only are alike but for the character there: they meet by that place and the rest. A name that has one character more is the other one when that is taken out;
    of a run of equal characters only the last is taken out. Keys are as many as characters, and a key joins at most as many names as there are characters to put in its place, however regular the names are (serial numbers).
    """
    at = F.explode(F.sequence(F.lit(1), F.col("size"))).alias("at")
    before, after = lambda c: F.substring(F.col(c), F.lit(1), F.col("at") - 1), lambda c: F.substring(F.col(c), F.col("at") + 1, F.col("size"))
    placed = known.where("size > 0").select("name", "size", at)
    keyed = placed.select("name", "size", "at", F.xxhash64(before("name"), after("name")).alias("key"))
    # sorted, as Spark would judge by the names' own size and broadcast all of their keys
    same = keyed.withColumnRenamed("name", "a").join(keyed.select(F.col("name").alias("b"), "size", "at", "key").hint("merge"), ["key", "at", "size"])
    same = same.where((F.col("a") < F.col("b")) & (before("a") == before("b")) & (after("a") == after("b"))).select("a", "b")
    sizes = known.select((F.col("size") + 1).alias("size")).distinct()
    longer = placed.join(F.broadcast(sizes), "size", "left_semi")  # as many as there are lengths
    less = longer.where(F.substring("name", F.col("at"), F.lit(1)) != F.substring("name", F.col("at") + 1, F.lit(1))).select("name", F.concat(before("name"), after("name")).alias("less"))
    more = less.join(known.select(F.col("name").alias("less")).hint("merge"), "less").select(F.least("name", "less").alias("a"), F.greatest("name", "less").alias("b"))
    return same.unionByName(more).withColumn("edits", F.lit(1))


def resolved_alike(mentions: DataFrame, name: str, key: str, edits: int = 1) -> DataFrame:
    """mentions with entity_id: the least key (a whole number) of all mentions that chains of similar names lead to; case, white space and punctuation don't count. A null or blank name is its own entity's."""
    plain = F.when(name_key(F.col(name)) != "", name_key(F.col(name)))
    known = cut(mentions.where(plain.isNotNull()).groupBy(plain.alias("_name")).agg(F.min(key).cast("bigint").alias("_least")))
    pairs = similar(known, "_name", edits)
    at = lambda side: known.select(F.col("_name").alias(side), F.col("_least").alias(f"{side}_least"))
    links = pairs.join(at("a"), "a").join(at("b"), "b").select(F.col("a_least").alias("a"), F.col("b_least").alias("b"))
    found = known.join(components(links), F.col("_least") == F.col("node"), "left").select("_name", F.coalesce("component", "_least").alias("entity_id"))
    return mentions.withColumn("_name", plain).join(found, "_name", "left").drop("_name").withColumn("entity_id", F.coalesce("entity_id", F.col(key).cast("bigint")))
