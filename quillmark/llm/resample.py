"""Importance resampling towards a target distribution, by hashed n-grams.

Words are laid out as a position table, one row for each word of a text; a
window over the text puts the words that follow beside it, so a row holds one
feature of each order.  Features are hashed to buckets, bucket counts of source
and target give each bucket a gain, and gains are joined back to the features
and averaged over each text.  Texts are then drawn by their weight plus Gumbel
noise that a hash of the id gives, so the draw depends on the rows alone.

The position table is stored once, as bucket numbers only: both the counts and
the weights read it.  Texts are dealt by row before they are cut into words, so
neither the window nor anything after it shuffles words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.store import bound_batches, materialize
from quillmark.sources.readers import numbered

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All ASCII but digits and a-z parts words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased; none of a null text."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # ASCII alone: lower() changes no other letter
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UP, _LOW))
    return F.array_remove(F.split(low, BETWEEN), "")


def positions(rows: DataFrame, text: Column, keep: list[str], orders: int = 2, buckets: int = 10_000) -> DataFrame:
    """One row for each word of a text, with ``keep``, a number of its row, and the buckets b1, b2, ... of the runs of 1, 2, ... words that begin there.

    A run that would pass the end of its text has a null bucket; a text without
    words has one row without any.  ``rows`` is read once, by a scan whose order
    does not change when a task is repeated.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select(F.monotonically_increasing_id().alias("__row"), F.struct(*keep).alias("__keep") if keep else F.lit(0).alias("__keep"), text.alias("__text"))
    dealt = named.repartition(parts, "__row").sortWithinPartitions("__row")
    laid = dealt.select("__row", "__keep", F.posexplode_outer(words(F.col("__text"))).alias("pos", "word"))
    upto = Window.partitionBy("__row").orderBy("pos")
    runs = [F.col("word")]
    for n in range(1, orders):
        runs.append(F.concat(runs[-1], F.lit(" "), F.lead("word", n).over(upto)))
    hashed = [(F.crc32(r.cast("binary")) % buckets).cast("int").alias(f"b{n}") for n, r in enumerate(runs, 1)]
    return laid.select("__row", *([f"__keep.{c}" for c in keep] if keep else []), *hashed)


def bucket_counts(laid: DataFrame, orders: int = 2) -> DataFrame:
    """(bucket, n): at most as many rows as there are buckets; every task adds up its own first."""
    each = laid.select(F.explode(F.array(*[f"b{n}" for n in range(1, orders + 1)])).alias("bucket"))
    return each.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of all buckets: floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))).

    ``source`` and ``target`` are bucket counts; S and T their sums.  Both have
    at most ``buckets`` rows, and so has the result.
    """
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))
    s, t, s_all, t_all = (F.col(c).cast("double") for c in ("s", "t", "s_all", "t_all"))
    ratio = (t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))  # one row


def weights(laid: DataFrame, gain: DataFrame, keep: list[str], orders: int = 2) -> DataFrame:
    """keep, n_words, n_features and weight, the floored mean of gains over a text's features (none: 0), of every row of the table.

    Words of a text lie together, so each task adds up whole texts before the shuffle.
    """
    gain = F.broadcast(gain)  # a row for each bucket
    for n in range(1, orders + 1):
        laid = laid.join(gain.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"g{n}")), f"b{n}", "left")
    counts = [F.count(f"b{n}") for n in range(1, orders + 1)]
    sums = [F.coalesce(F.sum(f"g{n}"), F.lit(0)) for n in range(1, orders + 1)]
    each = laid.groupBy("__row", *keep).agg(counts[0].alias("n_words"), sum(counts[1:], counts[0]).alias("n_features"), sum(sums[1:], sums[0]).alias("__sum"))
    mean = F.when(F.col("n_features") > 0, F.expr("(__sum - pmod(__sum, n_features)) div n_features")).otherwise(0)
    return each.select(*keep, "n_words", "n_features", mean.cast("long").alias("weight"))


def noise(doc_id: Column, salt: str) -> Column:
    """floor(-1000 * ln(-ln(u))) of a u between 0 and 1 that the id's hash gives."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("long")


def draw(weighted: DataFrame, percent: int = 25, least_words: int = 20, salt: str = "7") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row: of the N texts with enough words, the floor(percent * N / 100) highest scores have ranks from 1.

    Ties go to the smaller doc_id, then to fewer features.  Ranks come from a
    table stored by range, so no task sorts all rows.  Rows with a null doc_id
    have no score and are neither drawn nor counted.
    """
    scored = materialize(weighted.withColumn("score", F.col("weight") + noise(F.col("doc_id"), salt)), "scored")
    fit = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    take = scored.where(fit).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    order = scored.where(fit).withColumn("__down", -F.col("score"))
    ranked = numbered(order, ["__down", "doc_id", "n_features"], "rank").select(*columns, F.when(F.col("rank") <= take, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, doc_id: Column, text: Column, target: DataFrame, target_text: Column, orders: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, salt: str = "7") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; those with a rank are the sample, in its order.

    Null, empty and wordless texts have no feature, a weight of 0 and no rank.
    Long texts are read whole; repeated rows count each time; an empty target
    leaves the gains to the counts of the documents alone.  ``doc_id`` is a
    whole number.
    """
    bound_batches(docs.sparkSession, 8)
    rows = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("__text"))
    laid = materialize(positions(rows, F.col("__text"), ["doc_id"], orders, buckets), "positions")
    aims = bucket_counts(positions(target.select(target_text.alias("__text")), F.col("__text"), [], orders, buckets), orders)
    gain = materialize(gains(materialize(bucket_counts(laid, orders), "counts"), materialize(aims, "aims"), buckets), "gains")
    return draw(weights(laid, gain, ["doc_id"], orders), percent, least_words, salt)


def drawn(docs: DataFrame, doc_id: Column, ranked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id has a rank, with all their columns."""
    chosen = ranked.where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(chosen, doc_id.cast("long") == F.col("__drawn"), "left_semi")
