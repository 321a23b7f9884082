"""The whole workflow over a workspace folder: alignments, frames, codebook, codes, distances, graph, partition, scores.

Tables are Parquet under names that carry the run's coordinates; a stage whose result is there does nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_phones_eval, code_string, compose_key
from ..operators import community, graph, intervals, metrics, samediff, segment
from ..operators.ordered import dense_index, first_rows
from ..operators.pairs import all_pairs_ned, blocks_of, tokens_to_string
from ..sources import files

#: A vocabulary of more phones is not folded into an expression.
MOST_PHONES = 20_000


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *(str(p).strip("/") for p in parts)))

    def exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def table(self, path: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table at path, made and written first if it is not there (a run that broke off leaves no _SUCCESS)."""
        if not self.exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def coordinates(self, kind: str, model: str, layer: int, gamma: float, k: int) -> str:
        return self.path(kind, f"model={model}", f"layer={layer}", f"gamma={gamma}", f"k={k}")

    def extract_alignment(self, align_dir: str) -> DataFrame:
        """(word_id, filename, word_start, word_end, text, phones) of all TextGrid files below align_dir, written as alignments.csv there. Files that can't be read or lack a tier are left out."""
        out = f"{align_dir.rstrip('/')}/alignments.csv"
        if not self.exists(out):
            intervals_, _ = files.read_textgrids(self.spark, align_dir)
            words, phones = files.words_of(intervals_)
            files.write_csv(intervals.words_with_phones(words, phones), out)
        return files.read_alignments(self.spark, out)

    def extract_features(self, audio_dir: str, extension: str, model: str, layer: int, encode: Callable[[bytes], object] | None = None) -> DataFrame:
        """Frames of the audio below audio_dir by the caller's encoder; without one, frames that are there as .npy files are read. One pass over the files gives both the frames and what damaged() lists."""
        self.table(self.path("frames", f"model={model}", f"layer={layer}"), lambda: files.read_media(self.spark, audio_dir, extension, encode) if encode else files.read_npy(self.spark, audio_dir))
        return self.frames(model, layer)

    def frames(self, model: str, layer: int) -> DataFrame:
        return files.split_damaged(self.spark.read.parquet(self.path("frames", f"model={model}", f"layer={layer}")))[0]

    def damaged(self, model: str, layer: int) -> DataFrame:
        """(filename, error) of the files whose frames could not be read."""
        return files.split_damaged(self.spark.read.parquet(self.path("frames", f"model={model}", f"layer={layer}")))[1]

    def kmeans(self, model: str, layer: int, k: int, seed: int = 0) -> DataFrame:
        frames = self.frames(model, layer)
        return self.table(self.path("codebooks", f"model={model}", f"layer={layer}", f"k={k}"), lambda: segment.kmeans_codebook(segment.thin(frames), k, seed))

    def encode_features(self, align_dir: str, model: str, layer: int, gamma: float, k: int) -> DataFrame:
        """(filename, word_id, codes) of each aligned word; words without frames have no codes."""
        frames = self.frames(model, layer)
        book = self.spark.read.parquet(self.path("codebooks", f"model={model}", f"layer={layer}", f"k={k}"))
        known = self.extract_alignment(align_dir).join(frames.select("filename").distinct(), "filename", "left_semi")
        return self.table(self.coordinates("codes", model, layer, gamma, k), lambda: segment.segment(segment.word_frames(frames, known), book, gamma, ["filename", "word_id"]))

    def _codes(self, model: str, layer: int, gamma: float, k: int) -> DataFrame:
        return self.spark.read.parquet(self.coordinates("codes", model, layer, gamma, k))

    def nodes(self, model: str, layer: int, gamma: float, k: int) -> DataFrame:
        """(node_id, filename, word_id, seq): the one numbering that all later tables use."""
        rows = self._codes(model, layer, gamma, k).select("filename", "word_id", code_string(F.col("codes")).alias("seq"))
        return self.table(self.coordinates("nodes", model, layer, gamma, k), lambda: dense_index(rows, ["filename", "word_id"]))

    def distance(self, model: str, layer: int, gamma: float, k: int, parts: int = 16) -> DataFrame:
        """(i, j, ned) of all pairs, in parts of the pairs of blocks, each written by a job of its own: a run that was stopped goes on with the parts that are missing. graph() doesn't need it: below a threshold most pairs are never compared."""
        nodes = self.nodes(model, layer, gamma, k)
        path = self.coordinates("distances", model, layer, gamma, k)
        # What the parts are is written first, so that a rerun in another session cuts the same ones.
        plan = self.table(f"{path}/plan", lambda: self.spark.createDataFrame([(parts, blocks_of(self.spark))], "parts int, blocks int")).first()
        for n in range(plan["parts"]):
            self.table(f"{path}/pairs/part={n}", lambda n=n: all_pairs_ned(nodes, "node_id", "seq", blocks=plan["blocks"], part=(n, plan["parts"])).toDF("i", "j", "ned"))
        return self.spark.read.parquet(f"{path}/pairs").select("i", "j", "ned")

    def graph(self, model: str, layer: int, gamma: float, k: int, align_dir: str, threshold: float = 0.4) -> tuple[DataFrame, DataFrame]:
        """(vertices, edges) of words with phones other than silence; edges are strictly below the threshold."""
        nodes = graph.spoken_nodes(self.nodes(model, layer, gamma, k), self.extract_alignment(align_dir))
        keyed = nodes.withColumn("key", compose_key(F.col("filename"), F.col("word_id")))
        edges = self.table(f"{self.coordinates('graphs', model, layer, gamma, k)}/threshold={threshold}", lambda: graph.threshold_edges(nodes, threshold))
        return graph.vertices(keyed, "key"), edges

    def cluster(self, model: str, layer: int, gamma: float, k: int, align_dir: str, threshold: float = 0.4, resolution: float = 0.02, target: int = 13_967, rules: community.Rules | None = None) -> str:
        """Writes the partition whose number of clusters comes closest to the target as text and returns its path; nothing is written if the best resolution is 0."""
        out = f"{self.coordinates('partitions', model, layer, gamma, k)}/threshold={threshold}.txt"
        if self.exists(f"{out}/_SUCCESS"):
            return out
        alignment = self.extract_alignment(align_dir)
        _, edges = self.graph(model, layer, gamma, k, align_dir, threshold)
        nodes = graph.spoken_nodes(self.nodes(model, layer, gamma, k), alignment)
        best, part, _ = community.adaptive_resolution(edges, nodes.select("node_id"), target, rules=replace(rules or community.Rules(), start=resolution))
        if best == 0 or part is None:
            return out
        spans = first_rows(alignment, ["filename", "word_id"], ["word_start", "word_end"]).select("filename", "word_id", "word_start", "word_end")
        rows = part.join(nodes.select("node_id", "filename", "word_id"), "node_id").join(spans, ["filename", "word_id"])
        lines = files.partition_lines(rows.select(F.col("cluster").alias("cluster_id"), "filename", F.col("word_start").alias("onset"), F.col("word_end").alias("offset"), F.col("node_id").alias("ord")))
        files.write_lines(lines, out, ["cluster_id", "line_no"])
        return out

    def transcription(self, partition_path: str, align_dir: str) -> DataFrame:
        found = files.read_partition(self.spark, partition_path).select("cluster_id", "filename", F.col("onset").alias("begin"), F.col("offset").alias("end")).withColumn("frag_id", F.monotonically_increasing_id())
        gold = self.extract_alignment(align_dir).select("filename", "word_start", "word_end", clean_phones_eval(F.col("phones")).alias("phones"), F.col("text").alias("word"))
        rows = intervals.transcribe(found, gold)
        vocabulary = sorted(r[0] for r in gold.select(F.explode("phones")).distinct().limit(MOST_PHONES).collect())
        if len(vocabulary) == MOST_PHONES:
            raise ValueError("too many kinds of phones")
        return rows.withColumn("seq", tokens_to_string(F.col("phones"), vocabulary) if vocabulary else F.lit(""))

    def evaluate(self, model: str, layer: int, gamma: float, k: int, threshold: float, align_dir: str) -> tuple[float, float]:
        """(mean phone distance, mean character distance) within clusters; writes both reports."""
        base = self.coordinates("partitions", model, layer, gamma, k)
        rows = self.table(f"{base}/transcription-{threshold}", lambda: self.transcription(f"{base}/threshold={threshold}.txt", align_dir))
        for name, lines in (("ned", metrics.ned_report(rows, order="frag_id")), ("wp", metrics.word_report(rows, order="frag_id"))):
            files.write_lines(lines, f"{base}/{name}-{threshold}.txt", [F.col("part") == 3, "cluster", "part", "place"], whole=2)
        words = rows.withColumn("seq", F.coalesce("word", F.lit("")))
        return metrics.overall_score(rows).first()["avg_ned"], metrics.overall_score(words).first()["avg_ned"]

    def samediff(self, model: str, layer: int, gamma: float, k: int, align_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pairs, AUC, ROC points) of the words' codes as same/different evidence; the pairs are written as CSV."""
        codes = self._codes(model, layer, gamma, k).select(compose_key(F.col("filename"), F.col("word_id")).alias("key"), code_string(F.col("codes")).alias("seq"))
        rows = samediff.segments(self.extract_alignment(align_dir)).withColumn("key", compose_key(F.col("filename"), F.col("word_id")))
        pairs = self.table(f"{self.coordinates('samediff', model, layer, gamma, k)}/pairs", lambda: samediff.labelled_pairs(rows, "key", extra=("filename", "word_start", "word_end", "phones")))
        files.write_csv(pairs, f"{self.coordinates('samediff', model, layer, gamma, k)}/same_diff_pairs_labeled.csv")
        scored = samediff.scored_pairs(pairs, codes, "key")
        return pairs, samediff.roc_auc(scored), samediff.roc_points(scored)
