"""Same/different evaluation: seeded pair sampling, scoring and ROC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import draw_key, is_text, pair_type, speaker_of
from .ordered import dense_index, first_rows, running_sums
from .pairs import group_pairs

LEAST, MOST_WORDS, MOST_PAIRS, SEED = 5, 100, 200, 42


def segments(alignment: DataFrame) -> DataFrame:
    """Words of alignments with a text, lower-cased, one per (filename, word_id), with their speaker."""
    rows = alignment.withColumn("text", F.lower("text")).filter(is_text(F.col("text")))
    rows = first_rows(rows, ["filename", "word_id"], ["word_start", "word_end"])
    return rows.select(F.split_part("filename", F.lit("_"), F.lit(1)).alias("filename"), "word_id", speaker_of(F.col("filename")).alias("speaker"), "text", "word_start", "word_end", "phones")


def valid_words(rows: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """(text, count) of the words that occur often enough."""
    return rows.groupBy(text).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)


def same_pairs(rows: DataFrame, key: str, text: str = "text", most: int = MOST_WORDS, pairs: int = MOST_PAIRS, seed: int = SEED) -> DataFrame:
    """(text, key1, key2): up to `pairs` pairs of each word that occurs often enough, drawn from its first `most` rows in order of key."""
    often = rows.join(valid_words(rows, text).select(text), text, "left_semi")
    both = group_pairs(first_rows(often, [text], [key], most), text, key, [key])
    drawn = both.withColumn("_draw", draw_key(seed, F.concat_ws("-", F.col(f"{key}1").cast("string"), F.col(f"{key}2").cast("string"))))
    return first_rows(drawn, [text], ["_draw"], pairs).select(text, f"{key}1", f"{key}2")


def diff_pairs(rows: DataFrame, count: int, key: str, text: str = "text", seed: int = SEED) -> DataFrame:
    """(key1, key2): `count` pairs of different words: the rows in two drawn orders, rank to rank, where the words differ.

    Ranks are made without a global window. Each row is used at most once on either side; where that gives fewer than
    `count` pairs, more rounds with other seeds follow, ten at most.
    """
    base = rows.select(key, text)
    out, have, turn = None, 0, 0
    while have < count and turn < 10:
        sides = [dense_index(base.withColumn("_draw", draw_key(seed + 2 * turn + k, F.col(key))), ["_draw"], "_rank").select("_rank", F.col(key).alias(f"{key}{k + 1}"), F.col(text).alias(f"_t{k + 1}")) for k in (0, 1)]
        found = sides[0].join(sides[1], "_rank").filter("_t1 <> _t2").select(F.lit(turn).alias("_turn"), "_rank", f"{key}1", f"{key}2")
        out = found if out is None else out.unionByName(found)
        have, turn = out.count(), turn + 1
        if not have:
            break
    if out is None:
        return base.select(F.col(key).alias(f"{key}1"), F.col(key).alias(f"{key}2")).limit(0)
    return out.orderBy("_turn", "_rank").limit(count).select(f"{key}1", f"{key}2")


def labelled_pairs(rows: DataFrame, key: str, seed: int = SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """All pairs with the columns of both rows, label (1 same word) and pair_type C1 to C4. rows: key, text, speaker and `extra`."""
    often = rows.join(valid_words(rows).select("text"), "text", "left_semi")
    same = same_pairs(rows, key, seed=seed)
    diff = diff_pairs(often, same.count(), key, seed=seed)
    both = same.select(f"{key}1", f"{key}2", F.lit(1).alias("label")).unionByName(diff.select(f"{key}1", f"{key}2", F.lit(0).alias("label")))
    for k in (1, 2):
        both = both.join(rows.select(F.col(key).alias(f"{key}{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("text", "speaker", *extra))), f"{key}{k}")
    return both.withColumn("pair_type", pair_type(F.col("text1"), F.col("text2"), F.col("speaker1"), F.col("speaker2")))


def scored_pairs(pairs: DataFrame, encodings: DataFrame, key: str, seq: str = "seq", seen: Observation | None = None) -> DataFrame:
    """pairs with score = -(edit distance / longer length); pairs with a missing or empty encoding have a null score. seen: is told how many `pairs` went by, and how many were `skipped` so, by whatever action runs first."""
    for k in (1, 2):
        pairs = pairs.join(encodings.select(F.col(key).alias(f"{key}{k}"), F.col(seq).alias(f"_s{k}")), f"{key}{k}", "left")
    there = F.coalesce((F.length("_s1") > 0) & (F.length("_s2") > 0), F.lit(False))
    if seen is not None:
        pairs = pairs.observe(seen, F.count(F.lit(1)).alias("pairs"), F.count_if(~there).alias("skipped"))
    return pairs.withColumn("score", F.when(there, F.lit(0.0) - F.levenshtein("_s1", "_s2") / F.greatest(F.length("_s1"), F.length("_s2")))).drop("_s1", "_s2")


def _by_score(rows: DataFrame, label: str, score: str) -> DataFrame:
    """(score, p, n): positives and negatives of each distinct score. Windows then run over distinct scores, not rows."""
    return rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row, (positives, negatives, auc): the chance that a positive scores above a negative, ties one half; null unless there are both. Scores are ranked in sorted ranges."""
    placed, _ = running_sums(_by_score(rows, label, score), ["score"], ["n"])
    wins = placed.select("p", "n", (F.col("p") * (F.col("n_before") + F.col("n") / 2)).alias("_w"))
    sums = wins.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"), F.sum("_w").alias("_w"))
    return sums.select("positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("_w") / (F.col("positives") * F.col("negatives"))).alias("auc"))


def roc_points(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score: shares of negatives and positives that score at least so much; null where there are no such rows at all."""
    placed, total = running_sums(_by_score(rows, label, score), [F.desc("score")], ["p", "n"])
    share = lambda c: ((F.col(f"{c}_before") + F.col(c)) / F.lit(total[c])) if total[c] else F.lit(None).cast("double")
    return placed.select(F.col("score").alias("threshold"), share("n").alias("fpr"), share("p").alias("tpr"))
