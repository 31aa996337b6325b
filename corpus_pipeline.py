"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents.  All but the
last return the columns of the documents they got, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontam, langid, neardup, packing, quality
from quillmark.llm.store import materialize, table

#: A text of at least so many characters is long enough for its cosine to tell that it is no learned language.  In 50,045
#: such texts of four languages the least cosine was 0.058, even of one that repeats a few words; of shorter ones 0.103.  A
#: text without any known trigram has a cosine of 0 give or take 0.03, whatever its length, but few trigrams tell little.
LONG, LEAST_COSINE = 100, 0.05
QUALITY = 0.5
BROADCAST_IDS = 2_000_000


def _aside(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """The documents with columns c0, c1, ..., so that no name can clash; and the names of doc_id, text and lang."""
    names = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), names["doc_id"], names["text"], names.get("lang", "")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages that the documents name.

    Null texts, texts without a letter and long texts that are like no
    language go.  If no document names a language, nothing can be judged and
    every text with a letter stays.
    """
    rows, _, text, lang = _aside(docs)
    profiles = langid.fit(rows, F.col(text), F.col(lang)) if lang else {}
    if not profiles:
        kept = rows.where(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"))
        return kept.toDF(*docs.columns)
    judged = langid.identify(rows, F.col(text), profiles, rows.columns)
    alien = (F.length(text) >= LONG) & (F.col("score") < LEAST_COSINE)
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.coalesce(alien, F.lit(False)))
    return kept.select(*rows.columns).toDF(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the rule ensemble, learned from the labels of these documents, finds good.

    Null and empty texts are judged by their statistics like any other; long
    ones are read whole, repeated rows judged alike.  Without labels all texts
    have one score, and an empty table stays empty.
    """
    rows, key, text, _ = _aside(docs)
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(rows, F.col(key), F.col(text), labels, F.col("doc_id"), F.col("quality"))
    judged = materialize(quality.classify(rows, F.col(text), rows.columns, model, QUALITY), "judged")
    return judged.where("predicted = 1").select(*rows.columns).toDF(*docs.columns)


def _row_ids(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The rows with a number ``__row``: the doc_id, or one for each doc_id and text, in order of doc_ids, if a doc_id has several texts."""
    id_ = F.col(key).cast("long")
    code = F.xxhash64(text)
    several = rows.where(id_.isNotNull()).groupBy(id_.alias("id")).agg(F.min(code).alias("a"), F.max(code).alias("z")).where("a != z")
    if several.isEmpty():
        return rows.withColumn("__row", id_)
    named = rows.withColumn("__id", id_).withColumn("__text", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    pairs = named.where("__id IS NOT NULL").select("__id", "__text").distinct().repartitionByRange("__id", "__text").sortWithinPartitions("__id", "__text")
    pairs = materialize(pairs.withColumn("__row", F.monotonically_increasing_id()), "pairs")
    return named.join(pairs, ["__id", "__text"], "left").select(*rows.columns, "__row")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Of rows with the same doc_id and text one stays; different texts of one
    doc_id count as documents of their own; rows without a doc_id stay.
    """
    rows, key, text, _ = _aside(docs)
    columns = rows.columns
    rows, key = _row_ids(rows, key, text), "__row"
    groups = neardup.near_duplicates(rows, F.col(key), F.col(text), words=5, percent=80)
    fate = materialize(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")).where("n > 1 OR NOT kept"), "fate")
    gone = fate.where("NOT kept").select(F.col("doc_id").alias("__gone"))
    few = gone.count() <= BROADCAST_IDS
    left = rows.join(F.broadcast(gone) if few else gone, F.col(key).cast("long") == F.col("__gone"), "left_anti")
    twice = fate.where("kept").select(F.col("doc_id").alias("__twice"))
    if not twice.isEmpty():
        same = F.col(key).cast("long") == F.col("__twice")
        left = left.join(twice, same, "left_anti").unionAll(left.join(twice, same, "left_semi").dropDuplicates([key]))
    return left.select(*columns).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of an evaluation item.

    Null texts and texts without words stay, repeated rows are judged alike,
    long texts are read whole; an empty table of items lets all documents stay.
    """
    rows, _, text, _ = _aside(docs)
    bench = table(spark, sf_dir, "benchmark")
    judged = decontam.scan(rows, F.col(text), bench, F.col("item_id"), F.col("text"), rows.columns)
    return judged.where("n_hit = 0").select(*rows.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length with their token ids."""
    import public_tokenizers

    rows, key, text, _ = _aside(docs)
    return packing.pack(rows, F.col(key), F.col(text), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", good), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Most stages are no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
