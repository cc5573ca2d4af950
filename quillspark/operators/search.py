"""Texts found by their words: posting tables, and the best k texts for each question by BM25."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.session import cut

K1, B = 1.2, 0.75
UNIT = 1_000_000  # scores are whole numbers of this part, so they don't depend on the order of sums
SALTS = 32  # parts of a word's postings in a join, as one word may be in most texts
BROADCAST = 500_000  # words of all questions that are still broadcast
AHEAD = 10  # the first look takes words until so many times k postings are read


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _weight(often: Column, length: Column, mean: float) -> Column:
    """What a word that a text of this length has so often counts, but for how rare it is."""
    return often * (K1 + 1) / (often + K1 * ((1 - B) + B * length / F.lit(mean)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _counted(text: Column) -> Column:
    """array<struct<term, often, length>>: how often each word occurs, and how many words there are; null without words. Equal words stand together once sorted, so no rows are grouped."""

    def runs(ws: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(ws)), lambda i: ~F.get(ws, i - 1).eqNullSafe(F.get(ws, i)))
        run = lambda ends: lambda e, k: F.struct(F.get(ws, e - 1).alias("term"), (e - F.coalesce(F.get(ends, k - 1), F.lit(0))).cast("bigint").alias("often"), F.size(ws).alias("length"))
        return F.when(F.size(ws) > 0, _let(ends, lambda e: F.transform(e, run(e))))

    return _let(F.sort_array(words(text)), runs)


def index(texts: DataFrame, key: str, text: str, path: str, buckets: int = 64) -> None:
    """Write the posting tables of texts to path: postings (a folder a bucket of words), terms (how many texts have a word, and the most it counts in one), corpus.

    key is unique and not null. A null text has no words, but is a text. Postings are dealt once, by bucket and by a part of the keys, so those of a frequent word are spread over tasks.
    """
    spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
    postings = texts.select(F.col(key).alias("key"), F.explode(_counted(F.col(text))).alias("run"))
    postings = postings.select("key", "run.length", "run.term", "run.often", _bucket(F.col("run.term"), buckets).alias("bucket"))
    dealt = postings.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    dealt.sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = spark.read.schema(f"key {kind}, length int, term string, often bigint, bucket int").parquet(f"{path}/postings")
    counts = postings.agg(F.coalesce(F.sum("often"), F.lit(0)).alias("total")).crossJoin(texts.agg(F.count("*").alias("n")))
    counts.select("n", "total", F.lit(buckets).alias("buckets"), F.lit(kind).alias("kind")).write.parquet(f"{path}/corpus")
    n, total, _, _ = spark.read.parquet(f"{path}/corpus").first()
    terms = postings.groupBy("bucket", "term").agg(F.count("*").alias("texts"), F.max(_weight(F.col("often"), F.col("length"), total / n if total else 1.0)).alias("peak"))
    terms.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")


def _best(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, questions: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, rank (from 1), found, score: the k texts of an index that match each question best, ties to the smaller key of a text; texts without any of its words aren't found.

    Only the buckets of the questions' words are read. As long as all their words can be broadcast, the postings of these words are dealt once, by text, and meet the questions there; each task hands on its k best.
    With more questions, a first look at each question's strongest words gives a score that k texts reach. Words whose bounds together stay
    below it can't bring a new text in: their postings only meet texts found by the others, and of these only those that can still reach it. The result is that of scoring all, either way.
    """
    n, total, buckets, kind = spark.read.parquet(f"{path}/corpus").first()
    asked = questions.select(F.col(key).alias("question"), F.explode(F.array_distinct(words(F.col(text)))).alias("term")).withColumn("bucket", _bucket(F.col("term"), buckets))
    asked = cut(asked)
    hit = [r[0] for r in asked.select("bucket").distinct().collect()]  # as many as there are buckets at most
    table = lambda name, columns: spark.read.schema(f"{columns}, term string, bucket int").parquet(f"{path}/{name}").where(F.col("bucket").isin(hit))
    postings, terms = table("postings", f"key {kind}, length int, often bigint"), table("terms", "texts bigint, peak double")
    mean = total / n if total else 1.0
    scaled = lambda weight: F.floor(UNIT * (F.col("rare") * weight)).cast("bigint")
    score = scaled(_weight(F.col("often"), F.col("length"), mean)).alias("score")
    rare = F.log(1 + (F.lit(n) - F.col("texts") + 0.5) / (F.col("texts") + 0.5))
    known = asked.join(terms, ["bucket", "term"]).withColumn("rare", rare).withColumn("most", scaled(F.col("peak")))
    if asked.count() <= BROADCAST:
        known = cut(known.select("question", "bucket", "term", "rare"))
        read = postings.join(F.broadcast(known.select("bucket", "term")), ["bucket", "term"], "left_semi").repartition("key")
        whole = read.join(F.broadcast(known), ["bucket", "term"]).select("question", "key", score).groupBy("question", "key").agg(F.sum("score").alias("score"))
        return _best(whole, k).select(F.col("question").alias(key), "rank", F.col("key").alias("found"), "score")
    strongest = Window.partitionBy("question").orderBy(F.desc("most"), "term")  # a question's own words
    read = F.coalesce(F.sum("texts").over(strongest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("most").over(strongest.rowsBetween(0, Window.unboundedFollowing))
    known = cut(known.select("question", "bucket", "term", "rare", "most", (read < AHEAD * k).alias("first"), rest.alias("rest")))

    def matched(some: DataFrame) -> DataFrame:
        spread = some.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        parts = postings.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
        return spread.join(parts, ["bucket", "term", "salt"]).select("question", "key", score).groupBy("question", "key").agg(F.sum("score").alias("score"))

    reached = _best(matched(known.where("first")), k).where(F.col("rank") == k).select("question", F.col("score").alias("bar"))
    known = cut(known.join(reached, "question", "left").withColumn("bar", F.coalesce("bar", F.lit(0))))
    strong = known.where("rest >= bar")
    spare = known.groupBy("question").agg(F.first("bar").alias("bar"), F.coalesce(F.sum(F.when(F.col("rest") < F.col("bar"), F.col("most"))), F.lit(0)).alias("spare"))
    able = cut(matched(strong.drop("bar")).join(spare, "question").where(F.col("score") + F.col("spare") >= F.col("bar")).select("question", "key", "score"))
    weak = able.select("question", "key").join(known.where("rest < bar").select("question", "bucket", "term", "rare"), "question")
    more = weak.join(postings, ["bucket", "term", "key"]).select("question", "key", score)
    whole = able.unionByName(more).groupBy("question", "key").agg(F.sum("score").alias("score"))
    return _best(whole, k).select(F.col("question").alias(key), "rank", F.col("key").alias("found"), "score")
