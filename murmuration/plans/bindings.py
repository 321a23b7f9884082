"""The engine's relations, made from the test tables: each as a DataFrame and as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq): the distinct part names."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("seq")).distinct()


NAMES = "names AS (SELECT DISTINCT p_name AS seq FROM part)"


def user_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, seq): the first letters of a user's events, in order of time."""
    e = table(spark, sf_dir, "events")
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.substring("event_type", 1, 1).alias("c"))))
    return e.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda x: x["c"]), "").alias("seq"))


USER_SEQUENCES = "user_sequences AS (SELECT user_id, string_agg(event_type[1], '' ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, word_id, word_start, word_end, text, phones, event_id): a user's events as the words of an utterance."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("text"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    first = F.min("us").over(Window.partitionBy("user_id"))
    following = F.coalesce(F.lead("us").over(w), F.col("us") + F.lit(30_000_000_000))
    return e.select(
        F.concat_ws("-", (F.col("user_id") % 10).cast("string"), F.col("user_id").cast("string"), F.lit("0")).alias("filename"),
        F.row_number().over(w).alias("word_id"),
        ((F.col("us") - first) / F.lit(1e11)).alias("word_start"),
        ((following - first) / F.lit(1e11)).alias("word_end"),
        "text",
        F.when(F.col("text") == "error", "sil,sp").otherwise(F.array_join(F.split("text", ""), ",")).alias("phones"),
        "event_id",
    )


WORDS = """words AS (
  SELECT CAST(user_id % 10 AS VARCHAR) || '-' || CAST(user_id AS VARCHAR) || '-0' AS filename,
         row_number() OVER w AS word_id,
         (us - min(us) OVER (PARTITION BY user_id)) / 1e11::DOUBLE AS word_start,
         (coalesce(lead(us) OVER w, us + 30000000000) - min(us) OVER (PARTITION BY user_id)) / 1e11::DOUBLE AS word_end,
         text, CASE WHEN text = 'error' THEN 'sil,sp' ELSE array_to_string(string_split(text, ''), ',') END AS phones, event_id
  FROM (SELECT user_id, event_id, event_type AS text, epoch_us(ts) AS us FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))"""


def phone_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, idx, xmin, xmax, text): phones that straddle the words, from half of each word to half of its length past it."""
    w = words(spark, sf_dir)
    half = (F.col("word_end") - F.col("word_start")) / 2
    return w.select("filename", F.col("word_id").alias("idx"), (F.col("word_start") + half).alias("xmin"), (F.col("word_end") + half).alias("xmax"), F.upper(F.substring("text", 1, 1)).alias("text"))


PHONE_TIER = "phone_tier AS (SELECT filename, word_id AS idx, word_start + (word_end - word_start) / 2 AS xmin, word_end + (word_end - word_start) / 2 AS xmax, upper(text[1]) AS text FROM words)"


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frag_id, cluster_id, filename, begin, end): every third word, shifted and stretched, in seven clusters."""
    w = words(spark, sf_dir).filter("event_id % 3 = 0").withColumn("begin", F.col("word_start") + ((F.col("event_id") * 7919) % 11 - 5) * F.lit(0.03))
    end = F.when(F.col("event_id") % 2 == 0, F.col("word_end")).otherwise(F.col("begin") + F.lit(0.02) * (1 + F.col("event_id") % 5))
    return w.select(F.col("event_id").alias("frag_id"), (F.col("event_id") % 7).cast("int").alias("cluster_id"), "filename", "begin", end.alias("end")).filter("begin < end")


FRAGMENTS = """fragments AS (
  SELECT frag_id, cluster_id, filename, "begin", "end" FROM (
    SELECT event_id AS frag_id, CAST(event_id % 7 AS INT) AS cluster_id, filename, b AS "begin",
           CASE WHEN event_id % 2 = 0 THEN word_end ELSE b + 0.02::DOUBLE * (1 + event_id % 5) END AS "end"
    FROM (SELECT *, word_start + ((event_id * 7919) % 11 - 5) * 0.03::DOUBLE AS b FROM words WHERE event_id % 3 = 0))
  WHERE "begin" < "end")"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import clean_phones_eval

    return words(spark, sf_dir).select("filename", "word_start", "word_end", clean_phones_eval(F.col("phones")).alias("phones"), F.col("text").alias("word"))


GOLD = """gold AS (SELECT filename, word_start, word_end,
  list_transform(list_filter(string_split(phones, ','), lambda x: trim(x) NOT IN ('sil', 'sp', '', 'spn', 'nan')), lambda x: regexp_replace(x, '[012]', '', 'g')) AS phones, text AS word FROM words)"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, key, seq, phones, word): parts by brand; the name is the sequence."""
    p = table(spark, sf_dir, "part")
    return p.select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("cluster_id"), F.col("p_partkey").alias("key"), F.col("p_name").alias("seq"), F.split("p_name", "").alias("phones"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))


CLUSTERS = "clusters AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS cluster_id, p_partkey AS key, p_name AS seq, split_part(p_name, ' ', 1) AS word FROM part)"


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, vec): the vector with the lowest id of each label."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).select(F.col("label").alias("code"), "vec")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, t, vec): ten vectors an utterance."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 10").cast("string").alias("filename"), (F.col("vec_id") % 10).cast("int").alias("t"), F.col("embedding").alias("vec"), "vec_id")


CODES = """codebook AS (SELECT label AS code, arg_min(embedding, vec_id)::DOUBLE[] AS vec FROM embeddings GROUP BY label),
nearest AS (
  SELECT vec_id, arg_min(code, (d, code)) AS code FROM (
    SELECT e.vec_id, c.code, list_distance(e.embedding::DOUBLE[], c.vec) AS d FROM embeddings e, codebook c)
  GROUP BY vec_id)"""


def segments_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, text, speaker, seq): parts as spoken words; the type is the word, the brand the speaker, the name the encoding."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("text"), F.col("p_brand").alias("speaker"), F.col("p_name").alias("seq"))


def auc_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("label") == 3).cast("int").alias("label"), (-(F.col("vec_id") % 37)).cast("double").alias("score"))


AUC_SAMPLE = "auc_sample AS (SELECT CAST(label = 3 AS INT) AS label, CAST(-(vec_id % 37) AS DOUBLE) AS score FROM embeddings)"


def name_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, seq): the distinct names, numbered in text order."""
    from ..operators.ordered import dense_index

    return dense_index(names(spark, sf_dir), ["seq"])


NAME_NODES = NAMES + ", name_nodes AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS node_id, seq FROM names)"


def dirty_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, phones): part names as phone lists, with silences, digits and spaces."""
    extra = F.when(F.col("p_size") % 4 == 0, "sil").when(F.col("p_size") % 4 == 1, "sil1").when(F.col("p_size") % 4 == 2, F.concat(F.lit(" AH"), (F.col("p_size") % 3).cast("string"), F.lit(" "))).otherwise("spn")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws(",", F.regexp_replace("p_name", " ", ","), F.concat(F.lit("X"), F.col("p_size").cast("string")), F.lit(""), extra).alias("phones"))


DIRTY_PHONES = """dirty AS (SELECT p_partkey AS key, replace(p_name, ' ', ',') || ',X' || CAST(p_size AS VARCHAR) || ',,' ||
  CASE p_size % 4 WHEN 0 THEN 'sil' WHEN 1 THEN 'sil1' WHEN 2 THEN ' AH' || CAST(p_size % 3 AS VARCHAR) || ' ' ELSE 'spn' END AS phones FROM part)"""
