"""Queries of the engine's own operators by name, with DuckDB SQL of equal results. Floating results are rounded where the order of a sum decides the last digit."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import community, graph, intervals, metrics, ordered, pairs, samediff, segment
from ..operators.scratch import Scratch
from ..sources import files
from . import bindings as b

QUERIES: dict = {}
ORACLE_SQL: dict = {}

THRESHOLD, SWEEP, COMPONENT_THRESHOLD, GAMMA = 0.4, [0.2, 0.4, 0.5, 0.7, 0.9], 0.3, 0.2
NED = "CAST(CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0::DOUBLE ELSE levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END AS FLOAT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _ned6(c: str = "ned"):
    return F.round(F.col(c).cast("double"), 6).alias("ned")


_PAIRS = f"WITH {b.NAMES} SELECT a.seq AS seq1, b.seq AS seq2, round({NED.format('a.seq', 'b.seq')}::DOUBLE, 6) AS ned FROM names a JOIN names b ON a.seq < b.seq WHERE {NED.format('a.seq', 'b.seq')} < {THRESHOLD}::FLOAT"


@query(_PAIRS)
def similar_pairs(spark, sf_dir):
    rows = b.names(spark, sf_dir)
    return pairs.all_pairs_ned(rows, "seq", "seq").filter(F.col("ned") < F.lit(THRESHOLD).cast("float")).select("seq1", "seq2", _ned6())


@query(_PAIRS)
def similar_pairs_pruned(spark, sf_dir):
    return pairs.all_pairs_ned(b.names(spark, sf_dir), "seq", "seq", THRESHOLD).select("seq1", "seq2", _ned6())


@query(_PAIRS)
def similar_pairs_segments(spark, sf_dir):
    return pairs.all_pairs_ned(b.names(spark, sf_dir), "seq", "seq", THRESHOLD, method="segments").select("seq1", "seq2", _ned6())


@query(f"WITH {b.USER_SEQUENCES} SELECT a.user_id AS user_id1, b.user_id AS user_id2, round({NED.format('a.seq', 'b.seq')}::DOUBLE, 6) AS ned FROM user_sequences a JOIN user_sequences b ON a.user_id < b.user_id WHERE {NED.format('a.seq', 'b.seq')} < 0.5::FLOAT")
def similar_user_sequences(spark, sf_dir):
    """Long strings of few letters: every segment is hot."""
    return pairs.all_pairs_ned(b.user_sequences(spark, sf_dir), "user_id", "seq", 0.5, method="segments", digits=6)


@query(f"WITH {b.USER_SEQUENCES} SELECT a.user_id AS user_id1, b.user_id AS user_id2, round({NED.format('a.seq', 'b.seq')}::DOUBLE, 6) AS ned FROM user_sequences a JOIN user_sequences b ON a.user_id < b.user_id")
def sequence_ned_all_pairs(spark, sf_dir):
    return pairs.all_pairs_ned(b.user_sequences(spark, sf_dir), "user_id", "seq", digits=6)


@query(f"WITH {b.CODES} SELECT vec_id, code FROM nearest")
def nearest_code(spark, sf_dir):
    return segment.nearest_code(b.frames(spark, sf_dir), b.codebook(spark, sf_dir), ["vec_id"])


_SEGMENTS = f"""{b.CODES},
marked AS (SELECT vec_id // 10 AS u, vec_id, code, CASE WHEN code IS DISTINCT FROM lag(code) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) THEN 1 ELSE 0 END AS new FROM nearest),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY vec_id) - 1 AS run FROM marked),
segments AS (SELECT u AS utterance, run, any_value(code) AS code, min(vec_id) AS first, count(*) AS size FROM numbered GROUP BY u, run)"""


def _segments(spark, sf_dir):
    codes = segment.nearest_code(b.frames(spark, sf_dir), b.codebook(spark, sf_dir), ["filename", "vec_id"])
    return segment.collapse(codes.select(F.col("filename").cast("long").alias("utterance"), "vec_id", "code"), "utterance", "vec_id")


@query(f"WITH {_SEGMENTS} SELECT utterance, CAST(run AS BIGINT) AS run, code, first, size FROM segments")
def segment_gamma0(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(f"WITH {_SEGMENTS}, s AS (SELECT utterance, string_agg(chr(97 + code), '' ORDER BY run) AS seq FROM segments GROUP BY utterance) SELECT a.utterance AS utterance1, b.utterance AS utterance2, round({NED.format('a.seq', 'b.seq')}::DOUBLE, 6) AS ned FROM s a JOIN s b ON a.utterance < b.utterance")
def code_ned_pairs(spark, sf_dir):
    s = _segments(spark, sf_dir).groupBy("utterance").agg(fn.code_string(F.transform(F.array_sort(F.collect_list(F.struct("run", "code"))), lambda x: x["code"])).alias("seq"))
    return pairs.all_pairs_ned(s, "utterance", "seq").select("utterance1", "utterance2", _ned6())


@query()
def segment_viterbi(spark, sf_dir):
    listed = F.array_sort(F.collect_list(F.struct("t", "vec")))
    utterances = b.frames(spark, sf_dir).groupBy("filename").agg(F.transform(listed, lambda x: x["vec"]).alias("frames"))
    return segment.segment(utterances, b.codebook(spark, sf_dir), GAMMA, ["filename"])


# The search as a recursion over frames: for each code the cost of the best way to end there with it and where its last segment began; then the way back from the last frame.
_VITERBI = f"""far AS (
  SELECT e.vec_id // 10 AS u, CAST(e.vec_id % 10 AS INT) AS t, list(list_distance(e.embedding::DOUBLE[], c.vec) ORDER BY c.code) AS d, list(c.code ORDER BY c.code) AS codes
  FROM embeddings e, (SELECT label AS code, arg_min(embedding, vec_id)::DOUBLE[] AS vec FROM embeddings GROUP BY label) c GROUP BY e.vec_id),
steps AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t) - 1 AS i FROM far),
search AS (
  SELECT u, i, d AS cost, list_transform(d, lambda x: 0::BIGINT) AS start, list_min(d) AS best FROM steps WHERE i = 0
  UNION ALL
  SELECT u, i, cost, start, list_min(cost) FROM (
    SELECT s.u, s.i,
           list_transform(s.d, lambda x, k: CASE WHEN r.cost[k] - {GAMMA}::DOUBLE <= r.best THEN r.cost[k] - {GAMMA}::DOUBLE ELSE r.best END + x) AS cost,
           list_transform(s.d, lambda x, k: CASE WHEN r.cost[k] - {GAMMA}::DOUBLE <= r.best THEN r.start[k] ELSE s.i END) AS start
    FROM search r JOIN steps s ON s.u = r.u AND s.i = r.i + 1)),
ends AS (
  SELECT u, i, arg_min(start[k], (cost[k], start[k], k)) AS start, arg_min(k, (cost[k], start[k], k)) AS k
  FROM (SELECT u, i, cost, start, unnest(range(1, len(cost) + 1)) AS k FROM search) GROUP BY u, i),
back AS (
  SELECT e.* FROM ends e JOIN (SELECT u, max(i) AS i FROM steps GROUP BY u) USING (u, i)
  UNION ALL SELECT e.* FROM back b JOIN ends e ON e.u = b.u AND e.i = b.start - 1 AND b.start > 0)"""


@query(f"WITH RECURSIVE {_VITERBI} SELECT CAST(back.u AS VARCHAR) AS filename, CAST(row_number() OVER (PARTITION BY back.u ORDER BY back.i) - 1 AS INT) AS place, steps.codes[back.k] AS code FROM back JOIN steps ON steps.u = back.u AND steps.i = back.i")
def viterbi_segments(spark, sf_dir):
    return segment_viterbi(spark, sf_dir).select("filename", F.posexplode("codes").alias("place", "code"))


_FRAME = "CAST(trunc({0} / 0.02::DOUBLE) AS INT)"


@query(f"WITH w AS (SELECT vec_id // 20 AS word_id, vec_id // 100 AS file FROM embeddings GROUP BY ALL) SELECT CAST(file AS VARCHAR) AS filename, CAST(word_id AS INT) AS word_id, count(e.vec_id) AS n_frames FROM w LEFT JOIN embeddings e ON e.vec_id // 100 = file AND e.vec_id % 100 >= {_FRAME.format('((word_id % 5) * 0.4::DOUBLE)')} AND e.vec_id % 100 < {_FRAME.format('((word_id % 5) * 0.4::DOUBLE + 0.3::DOUBLE)')} GROUP BY file, word_id")
def word_frame_counts(spark, sf_dir):
    e = b.table(spark, sf_dir, "embeddings")
    long = e.select(F.expr("vec_id div 100").cast("string").alias("filename"), (F.col("vec_id") % 100).cast("int").alias("t"), F.col("embedding").alias("vec"))
    words = e.select(F.expr("vec_id div 100").cast("string").alias("filename"), F.expr("vec_id div 20").cast("int").alias("word_id")).distinct()
    words = words.withColumn("word_start", (F.col("word_id") % 5) * F.lit(0.4)).withColumn("word_end", (F.col("word_id") % 5) * F.lit(0.4) + F.lit(0.3))
    return segment.word_frames(long, words).select("filename", "word_id", F.size("frames").cast("long").alias("n_frames"))


@query("WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM f WHERE n <= 60 OR t % 3 = 0")
def thinned_frames(spark, sf_dir):
    from pyspark.sql import Window

    e = b.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("user_id").alias("filename"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("t"))
    return segment.thin(e, most=60).select("user_id", "event_id")


@query(f"WITH {b.DIRTY_PHONES} SELECT key, array_to_string(list_transform(list_filter(string_split(phones, ','), lambda x: trim(x) NOT IN ('sil', 'sp', '', 'spn', 'nan')), lambda x: regexp_replace(x, '[012]', '', 'g')), ',') AS phones FROM dirty")
def clean_phones_eval(spark, sf_dir):
    return b.dirty_phones(spark, sf_dir).select("key", F.array_join(fn.clean_phones_eval(F.col("phones")), ",").alias("phones"))


@query(f"WITH {b.DIRTY_PHONES} SELECT key, array_to_string(list_filter(list_transform(string_split(phones, ','), lambda x: trim(regexp_replace(x, '[0-9]+', '', 'g'))), lambda x: x NOT IN ('sil', 'sp', '', 'spn', 'nan')), ',') AS phones FROM dirty")
def clean_phones_graph(spark, sf_dir):
    return b.dirty_phones(spark, sf_dir).select("key", F.array_join(fn.clean_phones_graph(F.col("phones")), ",").alias("phones"))


@query(f"WITH {b.WORDS}, {b.PHONE_TIER} SELECT w.filename, CAST(w.word_id AS INT) AS word_id, coalesce(string_agg(p.text, ',' ORDER BY p.idx), '') AS phones FROM words w LEFT JOIN phone_tier p ON p.filename = w.filename AND p.xmax > w.word_start AND p.xmin < w.word_end GROUP BY w.filename, w.word_id")
def phone_word_overlap(spark, sf_dir):
    w = b.words(spark, sf_dir).drop("phones", "event_id")
    return intervals.words_with_phones(w, b.phone_tier(spark, sf_dir)).select("filename", "word_id", "phones")


@query(f"WITH {b.WORDS}, {b.PHONE_TIER} SELECT w.filename, CAST(w.word_id AS INT) AS word_id, count(*) AS overlaps FROM words w JOIN phone_tier p ON p.filename = w.filename AND p.xmax > w.word_start AND p.xmin < w.word_end GROUP BY w.filename, w.word_id")
def bucketed_overlap_counts(spark, sf_dir):
    w = b.words(spark, sf_dir).select("filename", "word_id", "word_start", "word_end")
    p = b.phone_tier(spark, sf_dir).select("filename", "xmin", "xmax")
    return intervals.overlap_join(w, p, "filename", ("word_start", "word_end"), ("xmin", "xmax"), bucket=5.0).groupBy("filename", "word_id").agg(F.count(F.lit(1)).alias("overlaps"))


_TRANSCRIBE = f"""{b.WORDS}, {b.GOLD}, {b.FRAGMENTS},
o AS (
  SELECT f.*, g.word_start, g.word_end, g.phones, g.word,
         round_even(g.word_end - g.word_start, 2) AS dur,
         round_even(greatest(0, least(g.word_end, f."end") - greatest(g.word_start, f."begin")), 2) AS ov
  FROM fragments f LEFT JOIN gold g ON f.filename = g.filename AND g.word_start < g.word_end AND g.word_start < f."end" AND g.word_end > f."begin"),
t AS (
  SELECT *, word_start IS NOT NULL AS met,
         word_start IS NOT NULL AND ((word_start <= "begin" AND word_end >= "end") OR (dur >= 0.06::DOUBLE AND ov >= 0.03::DOUBLE) OR (dur < 0.06::DOUBLE AND CASE WHEN dur > 0 THEN ov / dur ELSE 0 END > 0.5)) AS ok
  FROM o),
transcription AS (
  SELECT frag_id, cluster_id, filename, CASE WHEN ok THEN 'matched' WHEN met THEN 'dropped' ELSE 'unmatched' END AS outcome,
         CASE WHEN ok THEN phones ELSE [] END AS phones, CASE WHEN ok THEN word ELSE '' END AS word
  FROM (SELECT *, row_number() OVER (PARTITION BY frag_id ORDER BY ok DESC, word_start, word_end, phones, word) AS rn FROM t) WHERE rn = 1)"""


def _transcription(spark, sf_dir, outcomes=False):
    return intervals.transcribe(b.fragments(spark, sf_dir), b.gold(spark, sf_dir), outcomes=outcomes)


@query(f"WITH {_TRANSCRIBE} SELECT frag_id, cluster_id, filename, outcome, array_to_string(phones, ' ') AS phones, word FROM transcription")
def transcribe_outcomes(spark, sf_dir):
    t = _transcription(spark, sf_dir, True)
    return t.select("frag_id", "cluster_id", "filename", "outcome", F.array_join("phones", " ").alias("phones"), "word")


_PAIR_SUMS = """k AS (SELECT cluster_id, coalesce({1}, '') AS s, row_number() OVER (PARTITION BY cluster_id ORDER BY {2}) AS rn FROM {0}),
d AS (SELECT a.cluster_id, CASE WHEN a.s = '' OR b.s = '' THEN 1.0::DOUBLE ELSE levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s))::DOUBLE END AS d FROM k a JOIN k b ON a.cluster_id = b.cluster_id AND a.rn < b.rn)"""


@query(f"WITH {_TRANSCRIBE}, kept AS (SELECT *, array_to_string(phones, '') AS seq FROM transcription WHERE outcome <> 'dropped'), {_PAIR_SUMS.format('kept', 'seq', 'frag_id')} SELECT cluster_id, count(*) AS pairs, round(avg(d), 6) AS avg_ned FROM d GROUP BY cluster_id")
def transcription_ned(spark, sf_dir):
    t = _transcription(spark, sf_dir).withColumn("seq", F.array_join("phones", ""))
    return metrics.cluster_scores(t).filter("pairs > 0").select("cluster_id", "pairs", F.round("avg_ned", 6).alias("avg_ned"))


@query(f"WITH {b.CLUSTERS}, {_PAIR_SUMS.format('clusters', 'seq', 'key')} SELECT cluster_id, count(*) AS pairs, round(avg(d), 6) AS avg_ned FROM d GROUP BY cluster_id")
def cluster_ned(spark, sf_dir):
    return metrics.cluster_scores(b.clusters(spark, sf_dir)).filter("pairs > 0").select("cluster_id", "pairs", F.round("avg_ned", 6).alias("avg_ned"))


@query(f"WITH {b.CLUSTERS}, {_PAIR_SUMS.format('clusters', 'seq', 'key')} SELECT count(*) AS pairs, round(coalesce(avg(d), 0), 6) AS avg_ned FROM d")
def overall_ned(spark, sf_dir):
    return metrics.overall_score(b.clusters(spark, sf_dir)).select("pairs", F.round("avg_ned", 6).alias("avg_ned"))


@query(f"WITH {b.CLUSTERS}, {_PAIR_SUMS.format('clusters', 'word', 'key')} SELECT cluster_id, count(*) AS pairs, round(avg(d), 6) AS avg_distance FROM d GROUP BY cluster_id")
def word_purity(spark, sf_dir):
    return metrics.cluster_scores(b.clusters(spark, sf_dir), seq="word").filter("pairs > 0").select("cluster_id", "pairs", F.round("avg_ned", 6).alias("avg_distance"))


@query(f"WITH {b.CLUSTERS} SELECT cluster_id, seq, count, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, seq) AS INT) AS place FROM (SELECT cluster_id, seq, count(*) AS count FROM clusters GROUP BY ALL)")
def cluster_token_freq(spark, sf_dir):
    return metrics.token_counts(b.clusters(spark, sf_dir))


@query(f"WITH {b.CLUSTERS} SELECT cluster_id, word, count, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, word) AS INT) AS place FROM (SELECT cluster_id, word, count(*) AS count FROM clusters GROUP BY ALL)")
def cluster_word_freq(spark, sf_dir):
    return metrics.token_counts(b.clusters(spark, sf_dir), token="word")


@query(f"WITH {_TRANSCRIBE}, kept AS (SELECT cluster_id, frag_id, array_to_string(phones, ' ') AS seq FROM transcription WHERE outcome <> 'dropped') SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, first_ord) AS INT) AS place FROM (SELECT cluster_id, seq, count(*) AS count, min(frag_id) AS first_ord FROM kept GROUP BY ALL)")
def tokens_first_seen(spark, sf_dir):
    return metrics.token_counts(_transcription(spark, sf_dir).withColumn("seq", F.array_join("phones", " ")), order="frag_id")


@query(f"WITH {_TRANSCRIBE} SELECT cluster_id, array_to_string(phones, ' ') AS seq, filename, count(*) AS count, min(frag_id) AS first_ord FROM transcription WHERE outcome <> 'dropped' GROUP BY ALL")
def token_speakers(spark, sf_dir):
    return metrics.token_speakers(_transcription(spark, sf_dir).withColumn("seq", F.array_join("phones", " ")))


_SPOKEN = f"""{b.WORDS}, said AS (
  SELECT filename || '_x' AS filename, CAST(word_id AS INT) AS word_id, word_start, word_end, phones,
         CASE WHEN event_id % 5 = 0 THEN '<unk>' WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE upper(text) END AS text, event_id FROM words),
twice AS (SELECT * FROM said UNION ALL SELECT * REPLACE (word_start - 0.5::DOUBLE AS word_start, 'early' AS text) FROM said WHERE event_id % 3 = 0)"""


@query(f"WITH {_SPOKEN} SELECT split_part(filename, '_', 1) AS filename, word_id, split_part(filename, '-', 1) AS speaker, lower(text) AS text, word_start, word_end, phones FROM twice WHERE text NOT IN ('', '<unk>', 'nan') QUALIFY row_number() OVER (PARTITION BY filename, word_id ORDER BY word_start, word_end) = 1")
def spoken_segments(spark, sf_dir):
    """Words with odd texts, a third of them there twice."""
    w = b.words(spark, sf_dir)
    odd = F.when(F.col("event_id") % 5 == 0, "<unk>").when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, "").otherwise(F.upper("text"))
    said = w.withColumn("text", odd).withColumn("filename", F.concat("filename", F.lit("_x")))
    again = said.filter("event_id % 3 = 0").withColumn("word_start", F.col("word_start") - F.lit(0.5)).withColumn("text", F.lit("early"))
    return samediff.segments(said.unionByName(again))


_REPORT = """{0}, {1}, scores AS (SELECT k.cluster_id, k.size, d.avg FROM (SELECT cluster_id, count(*) AS size FROM k GROUP BY 1) k LEFT JOIN (SELECT cluster_id, avg(d) AS avg FROM d GROUP BY 1) d USING (cluster_id)),
counts AS (SELECT cluster_id, shown, n, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, shown) AS place FROM (SELECT cluster_id, {2} AS shown, count(*) AS n FROM {3} GROUP BY ALL)),
lines AS (
  SELECT cluster_id AS cluster, 0 AS part, unnest([0, 1, 2, 3]) AS place, unnest(['', repeat('-', 60), '🧩 Cluster ' || cluster_id || ' | Size: ' || size, repeat('-', 60)]) AS line FROM scores
  UNION ALL SELECT cluster_id, 1, place, CASE WHEN length(shown) < {4} THEN rpad(shown, {4}, ' ') ELSE shown END || '  → ' || n || ' times' FROM counts
  UNION ALL SELECT cluster_id, 2, unnest([0, 1]), unnest(['→ Avg {5} for Cluster ' || cluster_id || ': ' || printf('%.4f', avg), repeat('=', 60)]) FROM scores WHERE avg IS NOT NULL
  UNION ALL SELECT NULL, 3, 0, '🔍 Overall {6} across all clusters: ' || printf('%.4f', avg(d)) FROM d)
SELECT cluster, part, CAST(place AS BIGINT) AS place, line FROM lines"""


@query("WITH " + _REPORT.format(b.CLUSTERS, _PAIR_SUMS.format("clusters", "seq", "key"), "array_to_string(string_split(seq, ''), ' ')", "clusters", 20, "NED", "NED"))
def ned_report_lines(spark, sf_dir):
    return metrics.ned_report(b.clusters(spark, sf_dir))


@query("WITH " + _REPORT.format(b.CLUSTERS, _PAIR_SUMS.format("clusters", "word", "key"), "word", "clusters", 30, "word purity", "WP"))
def word_report_lines(spark, sf_dir):
    return metrics.word_report(b.clusters(spark, sf_dir))


@query("SELECT p_type AS text, count(*) AS count FROM part GROUP BY 1 HAVING count(*) >= 5")
def valid_words(spark, sf_dir):
    return samediff.valid_words(b.segments_of(spark, sf_dir))


@query(f"WITH {b.WORDS} SELECT text, filename, CAST(word_id AS INT) AS word_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY filename, word_id) AS rn FROM words) WHERE rn <= 100")
def first_n_per_word(spark, sf_dir):
    return ordered.first_rows(b.words(spark, sf_dir), ["text"], ["filename", "word_id"], 100).select("text", "filename", "word_id")


@query(f"WITH {b.WORDS}, f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY filename, word_id) AS rn FROM words QUALIFY rn <= 6) SELECT text, event_id AS element, previous FROM (SELECT text, event_id, lag(event_id) OVER (PARTITION BY text ORDER BY filename, word_id) AS previous FROM f) WHERE previous IS NOT NULL")
def adjacent_pairs(spark, sf_dir):
    six = ordered.first_rows(b.words(spark, sf_dir), ["text"], ["filename", "word_id"], 6)
    return ordered.adjacent(six, ["text"], ["filename", "word_id"], "event_id")


_SAME = """seg AS (SELECT p_partkey AS key, p_type AS text, p_brand AS speaker, p_name AS seq FROM part),
often AS (SELECT * FROM seg WHERE text IN (SELECT text FROM seg GROUP BY text HAVING count(*) >= 5)),
few AS (SELECT * FROM often QUALIFY row_number() OVER (PARTITION BY text ORDER BY key) <= 100),
same AS (SELECT a.text, a.key AS key1, b.key AS key2 FROM few a JOIN few b ON a.text = b.text AND a.key < b.key
  QUALIFY row_number() OVER (PARTITION BY a.text ORDER BY md5('42|' || CAST(a.key AS VARCHAR) || '-' || CAST(b.key AS VARCHAR))) <= 200),
""" + ",\n".join(f"r{k} AS (SELECT key, text, row_number() OVER (ORDER BY md5('{42 + k}|' || CAST(key AS VARCHAR))) - 1 AS r FROM often)" for k in range(20)) + """,
diff AS (SELECT key1, key2 FROM (""" + " UNION ALL ".join(f"SELECT {k} AS turn, r, a.key AS key1, b.key AS key2 FROM r{2 * k} a JOIN r{2 * k + 1} b USING (r) WHERE a.text <> b.text" for k in range(10)) + """) ORDER BY turn, r LIMIT (SELECT count(*) FROM same)),
lab AS (SELECT key1, key2, 1 AS label FROM same UNION ALL SELECT key1, key2, 0 FROM diff)"""


@query(f"WITH {_SAME} SELECT text, key1, key2 FROM same")
def same_pairs(spark, sf_dir):
    return samediff.same_pairs(b.segments_of(spark, sf_dir), "key")


def _often(spark, sf_dir):
    s = b.segments_of(spark, sf_dir)
    return s.join(samediff.valid_words(s).select("text"), "text", "left_semi")


@query(f"WITH {_SAME} SELECT key1, key2 FROM diff")
def diff_pairs(spark, sf_dir):
    return samediff.diff_pairs(_often(spark, sf_dir), samediff.same_pairs(b.segments_of(spark, sf_dir), "key").count(), "key")


def _labelled(spark, sf_dir):
    return samediff.labelled_pairs(b.segments_of(spark, sf_dir), "key")


@query(f"WITH {_SAME} SELECT label, pair_type, count(*) AS pairs FROM (SELECT label, CASE WHEN a.text = b.text AND a.speaker = b.speaker THEN 'C1' WHEN a.text = b.text THEN 'C2' WHEN a.speaker = b.speaker THEN 'C3' ELSE 'C4' END AS pair_type FROM lab JOIN seg a ON a.key = key1 JOIN seg b ON b.key = key2) GROUP BY ALL")
def pair_types(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("label", "pair_type").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"WITH {_SAME} SELECT key1, key2, label, round(0 - levenshtein(a.seq, b.seq) / greatest(length(a.seq), length(b.seq))::DOUBLE, 6) AS score FROM lab JOIN seg a ON a.key = key1 JOIN seg b ON b.key = key2")
def samediff_scores(spark, sf_dir):
    scored = samediff.scored_pairs(_labelled(spark, sf_dir), b.segments_of(spark, sf_dir), "key")
    return scored.select("key1", "key2", "label", F.round("score", 6).alias("score"))


_AUC = """g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM {0} WHERE score IS NOT NULL GROUP BY score),
w AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE) AS w FROM g)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(sum(w) / (sum(p) * sum(n)), 9) AS auc FROM w"""


@query(f"WITH {_SAME}, sc AS (SELECT label, -(levenshtein(a.seq, b.seq) / greatest(length(a.seq), length(b.seq))::DOUBLE) AS score FROM lab JOIN seg a ON a.key = key1 JOIN seg b ON b.key = key2), " + _AUC.format("sc"))
def samediff_auc(spark, sf_dir):
    scored = samediff.scored_pairs(_labelled(spark, sf_dir), b.segments_of(spark, sf_dir), "key")
    return samediff.roc_auc(scored).withColumn("auc", F.round("auc", 9))


_GAPS = "sc0 AS (SELECT label, CASE WHEN a.key % 4 > 0 AND b.key % 4 > 0 THEN -(levenshtein(a.seq, b.seq) / greatest(length(a.seq), length(b.seq))::DOUBLE) END AS score FROM lab JOIN seg a ON a.key = key1 JOIN seg b ON b.key = key2)"


@query(f"WITH {_SAME}, {_GAPS}, r AS (SELECT * FROM (WITH {_AUC.format('sc0')})) SELECT r.*, (SELECT count(*) FROM sc0) AS pairs, (SELECT count(*) FROM sc0 WHERE score IS NULL) AS skipped FROM r")
def samediff_with_gaps(spark, sf_dir):
    """Every fourth part has no encoding. The pass that ranks the scores also counts the pairs that it can't score."""
    parts = b.segments_of(spark, sf_dir)
    seen = Observation()
    auc = samediff.roc_auc(samediff.scored_pairs(_labelled(spark, sf_dir), parts.filter("key % 4 > 0"), "key", seen=seen)).withColumn("auc", F.round("auc", 9))
    return auc.withColumn("pairs", F.lit(seen.get["pairs"]).cast("long")).withColumn("skipped", F.lit(seen.get["skipped"]).cast("long"))


@query(f"WITH {b.AUC_SAMPLE}, " + _AUC.format("auc_sample"))
def roc_auc(spark, sf_dir):
    return samediff.roc_auc(b.auc_sample(spark, sf_dir)).withColumn("auc", F.round("auc", 9))


@query(f"WITH {b.AUC_SAMPLE}, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM auc_sample GROUP BY score) SELECT score AS threshold, round(sum(n) OVER w / (sum(n) OVER ())::DOUBLE, 9) AS fpr, round(sum(p) OVER w / (sum(p) OVER ())::DOUBLE, 9) AS tpr FROM g WINDOW w AS (ORDER BY score DESC)")
def roc_points(spark, sf_dir):
    return samediff.roc_points(b.auc_sample(spark, sf_dir)).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


_EDGES = f"{b.NAME_NODES}, edges AS (SELECT a.node_id AS src, b.node_id AS dst, greatest({NED.format('a.seq', 'b.seq')}, 1e-10::FLOAT) AS weight FROM name_nodes a JOIN name_nodes b ON a.node_id < b.node_id WHERE {NED.format('a.seq', 'b.seq')} < {{0}}::FLOAT)"


@query(f"WITH {_EDGES.format(THRESHOLD)} SELECT src, dst, round(weight::DOUBLE, 6) AS weight FROM edges")
def threshold_graph_edges(spark, sf_dir):
    return graph.threshold_edges(b.name_nodes(spark, sf_dir), THRESHOLD).select("src", "dst", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@query(f"WITH {_EDGES.format(THRESHOLD)} SELECT node_id, count(src) AS degree FROM name_nodes LEFT JOIN edges ON node_id = src OR node_id = dst GROUP BY node_id")
def vertex_degree(spark, sf_dir):
    nodes = b.name_nodes(spark, sf_dir)
    return graph.degrees(graph.threshold_edges(nodes, THRESHOLD), nodes)


@query(f"WITH {_EDGES.format(max(SWEEP))} SELECT t AS threshold, CAST(count(*) FILTER (weight < t::FLOAT) AS BIGINT) AS edges FROM edges, (SELECT unnest({SWEEP}::DOUBLE[]) AS t) GROUP BY t")
def graph_sweep(spark, sf_dir):
    return graph.sweep(graph.threshold_edges(b.name_nodes(spark, sf_dir), max(SWEEP)), SWEEP)


@query(f"WITH RECURSIVE {_EDGES.format(COMPONENT_THRESHOLD)}, reach AS (SELECT node_id AS v, node_id AS c FROM name_nodes UNION SELECT CASE WHEN e.src = r.v THEN e.dst ELSE e.src END, r.c FROM reach r JOIN edges e ON e.src = r.v OR e.dst = r.v) SELECT v AS node_id, min(c) AS component FROM reach GROUP BY v")
def connected_components(spark, sf_dir):
    nodes = b.name_nodes(spark, sf_dir)
    return graph.components(graph.threshold_edges(nodes, COMPONENT_THRESHOLD), nodes)


@query()
def leiden_cpm(spark, sf_dir):
    nodes = b.name_nodes(spark, sf_dir)
    found, edges = community.with_components(graph.threshold_edges(nodes, THRESHOLD), nodes)
    return community.partition(found, edges, 0.1)


@query(f"WITH {b.NAME_NODES} SELECT node_id, node_id AS cluster FROM name_nodes")
def leiden_singletons(spark, sf_dir):
    """At a resolution above every weight each node is alone."""
    nodes = b.name_nodes(spark, sf_dir)
    found, edges = community.with_components(graph.threshold_edges(nodes, THRESHOLD), nodes)
    return community.partition(found, edges, 0.5)


@query()
def adaptive_resolution(spark, sf_dir):
    nodes = b.name_nodes(spark, sf_dir)
    _, part, _ = community.adaptive_resolution(graph.threshold_edges(nodes, THRESHOLD), nodes, target=30, rules=community.Rules(close=3))
    return part


def _community_checks(part, edges, nodes, resolution):
    """One row: whether each node has one community, each community is connected, and the quality is no less than that of the components and of single nodes."""
    ends = edges.join(part.select(F.col("node_id").alias("src"), F.col("cluster").alias("_a")), "src").join(part.select(F.col("node_id").alias("dst"), F.col("cluster").alias("_b")), "dst")
    inside = ends.filter("_a = _b")
    split = graph.components(inside.select("src", "dst"), nodes)

    def quality(by):
        own = edges.join(by.select(F.col("node_id").alias("src"), F.col("c").alias("_a")), "src").join(by.select(F.col("node_id").alias("dst"), F.col("c").alias("_b")), "dst")
        return (own.filter("_a = _b").agg(F.sum(F.col("weight").cast("double"))).first()[0] or 0.0) - resolution * (by.groupBy("c").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] or 0.0)

    whole = quality(graph.components(edges, nodes).withColumnRenamed("component", "c"))
    got = quality(part.withColumnRenamed("cluster", "c"))
    connected = split.join(part, "node_id").filter("component <> cluster").limit(1).count() == 0
    once = part.groupBy("node_id").count().filter("count > 1").limit(1).count() == 0 and part.count() == nodes.count()
    return nodes.sparkSession.createDataFrame([(once, connected, got >= whole - 1e-9, got >= -1e-9)], "once boolean, connected boolean, above_components boolean, above_nodes boolean")


_CHECKED = "SELECT true AS once, true AS connected, true AS above_components, true AS above_nodes"


@query(_CHECKED)
def leiden_checks(spark, sf_dir):
    with Scratch() as scratch:
        nodes = scratch.keep(b.name_nodes(spark, sf_dir), "nodes")
        edges = scratch.keep(graph.threshold_edges(nodes, THRESHOLD), "edges")
        found, kept = community.with_components(edges, nodes)
        part = scratch.keep(community.partition(found, kept, 0.1), "part")
        return _community_checks(part, edges, nodes, 0.1)


@query()
def kmeans_codebook(spark, sf_dir):
    frames = b.frames(spark, sf_dir)
    book = segment.kmeans_codebook(frames, 10)
    return segment.nearest_code(frames, book, ["vec_id"]).groupBy("code").agg(F.count(F.lit(1)).alias("frames"))


@query()
def minibatch_codebook(spark, sf_dir):
    """Each code's centre, how many frames are nearest to it, and the sum of their squared distances."""
    frames = b.frames(spark, sf_dir)
    book = segment.MiniBatchKMeans(10, batches=4, epochs=6).fit(frames)
    nearest = frames.select("vec_id", "vec").join(segment.nearest_code(frames, book, ["vec_id"]), "vec_id").join(book.select("code", F.col("vec").alias("centre")), "code")
    gap = fn.euclidean(F.col("vec"), F.col("centre"))
    return nearest.groupBy("code", "centre").agg(F.count(F.lit(1)).alias("frames"), F.sum(gap * gap).alias("inertia"))


_LINES = f"""{_TRANSCRIBE}, listed AS (SELECT f.cluster_id, row_number() OVER (PARTITION BY f.cluster_id ORDER BY frag_id) AS line_no, f.filename || ' ' || printf('%.2f', f."begin") || ' ' || printf('%.2f', f."end") AS line FROM fragments f)"""


@query(f"WITH {_LINES} SELECT cluster_id, line_no, line FROM listed UNION ALL SELECT cluster_id, 0, 'Class ' || cluster_id FROM listed GROUP BY cluster_id UNION ALL SELECT cluster_id, count(*) + 1, '' FROM listed GROUP BY cluster_id")
def partition_lines(spark, sf_dir):
    f = b.fragments(spark, sf_dir).select("cluster_id", "filename", F.col("begin").alias("onset"), F.col("end").alias("offset"), F.col("frag_id").alias("ord"))
    return files.partition_lines(f)


@query(f"""WITH {_TRANSCRIBE} SELECT cluster_id, filename, CAST(printf('%.2f', "begin") AS DOUBLE) AS onset, CAST(printf('%.2f', "end") AS DOUBLE) AS offset FROM fragments""")
def partition_round_trip(spark, sf_dir):
    lines = partition_lines(spark, sf_dir).select(F.lit("one").alias("file"), (F.col("cluster_id").cast("long") * 1_000_000_000 + F.col("line_no")).alias("n"), "line")
    return files.parse_partition(lines)


@query(f"WITH {b.WORDS} SELECT filename, CAST(word_id AS INT) AS word_id FROM words WHERE NOT EXISTS (SELECT 1 FROM words d WHERE d.event_id % 3 = 0 AND d.filename = words.filename AND d.word_id = words.word_id)")
def resume_anti(spark, sf_dir):
    w = b.words(spark, sf_dir)
    return files.missing_rows(w, w.filter("event_id % 3 = 0"), ["filename", "word_id"]).select("filename", "word_id")


@query(f"WITH {_SAME} SELECT key1 AS key FROM same UNION SELECT key2 FROM diff")
def union_keys(spark, sf_dir):
    same = same_pairs(spark, sf_dir).select(F.col("key1").alias("key"))
    return same.union(diff_pairs(spark, sf_dir).select(F.col("key2").alias("key"))).distinct()


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(l_discount / 0.02::DOUBLE) AS INT) AS frame, CAST(floor(l_discount * 16000 / 320) AS INT) AS number FROM lineitem")
def frame_index(spark, sf_dir):
    x = b.table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", fn.frame_index(F.col("l_discount")).alias("frame"), fn.frame_number(F.col("l_discount"), 16000, 20).alias("number"))


@query(f"WITH {b.WORDS} SELECT filename || '_' || word_id AS key, filename AS base, CAST(word_id AS INT) AS word_id, string_split(filename, '-')[1] AS speaker, replace(trim(filename || '_' || word_id), '''', '') AS vertex FROM words")
def keys_and_speakers(spark, sf_dir):
    w = b.words(spark, sf_dir).select(fn.compose_key(F.col("filename"), F.col("word_id")).alias("key"))
    return w.select("key", fn.base_of(F.col("key")).alias("base"), fn.word_id_of(F.col("key")).alias("word_id"), fn.speaker_of(F.col("key")).alias("speaker"), fn.vertex_name(F.col("key")).alias("vertex"))


@query(f"WITH {b.WORDS} SELECT filename, CAST(max(word_id) AS INT) AS last_word, CAST(count(*) FILTER (text <> 'error') AS BIGINT) AS spoken, count(*) AS words FROM words GROUP BY filename")
def utterance_counts(spark, sf_dir):
    w = b.words(spark, sf_dir)
    return w.groupBy("filename").agg(F.max("word_id").alias("last_word"), F.count_if(fn.is_spoken(F.col("phones"))).alias("spoken"), F.count(F.lit(1)).alias("words"))


@query(f"WITH {b.WORDS} SELECT filename, CAST(word_id AS INT) AS word_id FROM words WHERE text <> 'error'")
def spoken_nodes(spark, sf_dir):
    w = b.words(spark, sf_dir)
    return graph.spoken_nodes(w.select("filename", "word_id"), w)


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS filename FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def files_without_gold(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("filename"))
    return intervals.without_gold(c, b.table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_custkey").cast("string").alias("filename")))


@query("SELECT p_partkey FROM part ORDER BY md5('42|' || CAST(p_partkey AS VARCHAR)) LIMIT 100")
def seeded_files(spark, sf_dir):
    return files.seeded_files(b.table(spark, sf_dir, "part").select("p_partkey"), 100, key="p_partkey")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS node_id, o_orderkey FROM orders")
def dense_nodes(spark, sf_dir):
    return ordered.dense_index(b.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT count(*) AS pairs, CAST(floor((1 + sqrt(1 + 8 * count(*))) / 2) AS BIGINT) AS sequences, CAST(ceil(count(*) / 5000000.0) AS BIGINT) AS chunks FROM (SELECT DISTINCT p_name AS s FROM part) a JOIN (SELECT DISTINCT p_name AS s FROM part) b ON a.s < b.s")
def pair_sizes(spark, sf_dir):
    n = b.names(spark, sf_dir).count()
    m = fn.pairs_of(n)
    return spark.createDataFrame([(m, fn.sequences_of(m), fn.chunks_of(m))], "pairs long, sequences long, chunks long")
