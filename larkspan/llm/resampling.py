"""Importance resampling towards a target distribution, by hashed n-grams.

Words are put at their places by posexplode; for an order of n the n - 1 words
that follow come from lead() over the document's places.  Each run of words is
hashed to a bucket; counts of buckets in the corpus and in the target give the
bucket's gain, which is joined back to the runs and averaged a document.  The
largest sums of mean gain and Gumbel noise are drawn: a weighted sample without
replacement.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import discard, written

BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
#: What stands between words, before letters are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def runs(texts: DataFrame, orders: int) -> DataFrame:
    """(key, doc_id, order, run) of every run of 1 to ``orders`` consecutive words of ``texts`` (key, doc_id, text).

    A run that would pass the last word is null, and so is what stands before a
    first or behind a last separator; every text has one row at least.
    """
    placed = texts.select("key", "doc_id", F.posexplode(F.split("text", BETWEEN)).alias("place", "word"))
    placed = placed.select("key", "doc_id", "place", F.nullif(lower_ascii(F.col("word")), F.lit("")).alias("word"))
    if orders == 1:
        return placed.select("key", "doc_id", F.lit(1).alias("order"), F.col("word").alias("run"))
    ahead = Window.partitionBy("key").orderBy("place")
    wide = placed.select("key", "doc_id", "word", *[F.lead("word", k).over(ahead).alias(f"w{k}") for k in range(1, orders)])
    joined = [F.concat("word", *[x for k in range(1, n) for x in (F.lit(" "), F.col(f"w{k}"))]) for n in range(1, orders + 1)]
    return wide.select("key", "doc_id", F.posexplode(F.array(*joined)).alias("n", "run")).select("key", "doc_id", (F.col("n") + 1).alias("order"), "run")


def bucketed(found: DataFrame, buckets: int) -> DataFrame:
    return found.select("key", "doc_id", "order", F.pmod(F.crc32(F.col("run").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), one row a bucket: floor(1000 ln) of its smoothed share in ``target`` over that in ``corpus`` (both: bucket, null counts nothing)."""
    counts = [rows.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name)) for rows, name in ((corpus, "s"), (target, "t"))]
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = written(every.join(counts[0], "bucket", "left").join(counts[1], "bucket", "left").na.fill(0, ["s", "t"]), "resample-counts")
    whole = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up, down = ((F.col(one).cast("double") + 1) * (float(whole[all_]) + buckets) for one, all_ in (("t", "s"), ("s", "t")))
    return both.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def drawn(weighed: DataFrame, percent: int, least_words: int, seed: str) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for ``weighed`` (doc_id, n, total, words).

    A score is a whole number of a range that the logarithms of counts bound
    (some 100,000 values), so the documents before a score are summed over one
    row a score; only documents down to the last drawn score are sorted, each
    score by itself.
    """
    noise = F.expr(f"CAST(conv(substr(sha2(concat('{seed}:', coalesce(CAST(doc_id AS STRING), '')), 256), 1, 8), 16, 10) AS DOUBLE)")
    weight = F.expr("CASE WHEN n > 0 THEN (total - pmod(total, n)) div n ELSE 0L END")
    rows = weighed.select("doc_id", F.col("n").alias("n_features"), "words", weight.alias("weight"), F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long").alias("noise"))
    rows = written(rows.select("doc_id", "n_features", "words", "weight", (F.col("weight") + F.col("noise")).alias("score")), "resample-scores")
    enough = F.col("words") >= least_words
    by_score = rows.where(enough).groupBy("score").agg(F.count("*").alias("n"))
    take = (by_score.agg(F.sum("n")).first()[0] or 0) * percent // 100
    before = by_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("before"))
    reached = before.where(F.col("before") < take).select(F.col("score").alias("reached"), "before")
    marked = rows.join(F.broadcast(reached), enough & (F.col("score") == F.col("reached")), "left")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), F.desc("n_features")))
    ahead = marked.where("before IS NOT NULL").withColumn("place", place.cast("long"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ahead.select(*columns, F.when(F.col("place") <= take, F.col("place")).alias("rank")).unionByName(marked.where("before IS NULL").select(*columns, F.lit(None).cast("long").alias("rank")))


def importance_resampling(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    A null or empty text has no features and weight 0.  Rows that repeat an id
    are documents of their own with the same noise; a null id draws the noise of
    an empty name and stays null.  Of equal scores the smaller id is drawn first
    (null last), of one id and score the row with more features.  Without any
    target text all buckets gain by the corpus alone; an empty table gives an
    empty one.  Very long texts are rows like others: their words are exploded
    and, for orders above 1, sorted with room to spill.  Other columns are
    ignored.

    Rows are told apart by their place in the input, which has to be the same
    when a task runs again, as it is for files.  For orders above 1, where words
    move by it, the texts are written first.  Runs of a document stand together
    in a task, so one row a document leaves it; buckets are counted before they
    move and their gains, one a bucket, are broadcast.
    """
    def keyed(df: DataFrame, id_: Column) -> DataFrame:
        rows = df.select(F.monotonically_increasing_id().alias("key"), id_.cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        return written(rows, "resample-texts") if orders > 1 else rows

    tables = [keyed(docs, F.col(id_col)), keyed(target, F.lit(None))]
    corpus, wanted = (bucketed(runs(x, orders), buckets) for x in tables)
    gain = gains(corpus, wanted, buckets)
    weighed = corpus.join(F.broadcast(gain), "bucket", "left").groupBy("key", "doc_id").agg(F.count("gain").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"), F.count_if((F.col("order") == 1) & F.col("bucket").isNotNull()).alias("words"))
    result = drawn(weighed, percent, least_words, seed)
    if orders > 1:
        discard(*tables)
    return result
