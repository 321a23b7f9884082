"""Lexical retrieval packing: a sharded BM25 inverted index returns unused neighbours of a seed document, which greedily fill its window.

Document frequencies and the mean length are those of the whole input. Documents are dealt into shards by content, so
that related ones meet wherever they lie in the input: a tree of bisections of projected BM25 vectors, fitted on a
sample, gives a leaf; within it the heaviest terms give the order; a key with many rows is dealt over several ranges.
Each shard then has its own postings, and a seed looks up all of its terms. Windows are filled to the last token: the
document that overflows is cut and its rest seeds the next window. The few tokens that are left at a shard's end go to
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, materialise, partitions, released, table

TOKENIZER, END, WINDOW = "word_bpe_49k.json", 2, 4096
#: Rows and tokens of a shard at most (a longer document is a shard of its own); BM25's constants; words of one kind that the token cache holds, but for those of one slice.
SHARD_ROWS, SHARD_TOKENS, K1, B, CACHE = 8192, 1 << 24, 1.2, 0.75, 300_000
#: Documents at most that the tree is fitted on, and of a leaf at least; dimensions of the projection; documents ranked at first for a seed; cells of a shard's matrix of common terms.
SAMPLE, LEAF, DIMENSIONS, FIRST, CELLS = 1 << 14, 32, 64, 64, 1 << 23


#: The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, the rest in order from 256.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


#: What may end a word after its last letter or digit as one part. (The apostrophe starts parts of its own.)
_STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text that are cut into words at once.
SLICE = 1 << 22


_END = np.array([END], "<u4").tobytes()
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[[9, 10, 13]] = 32


class Known:
    """Ids of strings of one kind, as Arrow arrays, which take a tenth of the memory of dictionaries; those met lately stay."""

    def __init__(self, of):
        self.of = of
        self.names, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.odd, self.used, self.turn = np.zeros(0, bool), np.zeros(0, np.int64), 0

    def ids(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(ids, whether the last character is no letter or digit) of each of some distinct strings."""
        if len(self.names) > CACHE:
            lately = np.sort(np.argsort(-self.used, kind="stable")[: CACHE // 2])
            self.names, self.values = self.names.take(pa.array(lately)), self.values.take(pa.array(lately))
            self.odd, self.used = self.odd[lately], self.used[lately]
        found = pc.index_in(parts, value_set=self.names)
        at = np.asarray(found.fill_null(-1)).astype(np.int64)
        if found.null_count:
            new = parts.filter(found.is_null())
            texts = new.to_pylist()
            at[at < 0] = len(self.names) + np.arange(len(new))
            self.names = pa.concat_arrays([self.names, new])
            self.values = pa.concat_arrays([self.values, pa.array(self.of(texts), pa.large_binary())])
            self.odd = np.concatenate([self.odd, np.array([bool(x) and not x[-1].isalnum() for x in texts], bool)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.turn += 1
        self.used[at] = self.turn
        return self.values.take(pa.array(at)), self.odd[at]


class Tokens:
    """Token ids of texts, by a public tokenizer, with bounded caches.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words, end to end. A
    word that ends in stops after a letter or digit is likewise two parts. The words of many texts are cut, lower-cased
    and made distinct at once; a part of letters alone goes straight to the tokenizer's model, in the form that its
    first steps would give it, any other through the whole tokenizer.
    """

    @staticmethod
    @lru_cache(1)
    def shared(path: str = "") -> Tokens:
        """That of the process: a worker's later tasks find the words of its earlier ones."""
        return Tokens(path)

    def __init__(self, path: str = ""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.model = self.tokenizer.model.tokenize
        self.lower, self.word = Known(lambda parts: list(map(self._lower, parts))), Known(self._words)
        self.stops = pa.array([*(self._whole(chr(b)) if chr(b) in _STOPS else b"" for b in range(256)), _END], pa.large_binary())

    def _whole(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _lower(self, part: str) -> bytes:
        """Ids of a part in lower case."""
        if part.isalpha():
            if part.isascii():
                return array("I", [t.id for t in self.model(part)]).tobytes()
            if unicodedata.is_normalized("NFC", part):
                return array("I", [t.id for t in self.model(part.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        return self._whole(part)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words with any number of final stops."""
        cut = []
        for word in words:
            core = word.rstrip(_STOPS)
            form = core.lower()
            whole = not core or len(core) == len(word) or "Σ" in core or not form.isalpha() or len(form) != len(core)
            cut.append((None, word) if whole else (form, word[len(core) :]))
        forms = list(dict.fromkeys(form for form, _ in cut if form))
        known = dict(zip(forms, self.lower.ids(pa.array(forms, pa.large_string()))[0].to_pylist(), strict=True))
        ends = {end: self._whole(end) for end in {end for form, end in cut if form}}
        return [known[form] + ends[end] if form else self._whole(end) for form, end in cut]

    def of(self, column: pa.Array):
        """The ids of each text, END included, as little-endian arrays; null is empty."""
        raw, offsets = bytes_of(column)
        first = 0
        while first < len(offsets) - 1:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
            yield from self._slice(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last

    def _slice(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_SPACES[raw]))
        lists = pc.split_pattern(texts, " ")
        words, of_doc = lists.flatten(), np.asarray(lists.offsets)
        core = pc.utf8_rtrim(words, characters=_STOPS)
        size = np.asarray(pc.binary_length(core))
        tail = np.asarray(pc.binary_length(words)) - size
        parts = pc.dictionary_encode(pc.utf8_lower(core))
        at = np.asarray(parts.indices)
        ids, odd = self.lower.ids(parts.dictionary)
        # The one capital whose lower case is two characters.
        wide_capital = np.asarray(pc.match_substring(words, "\u0130")) if b"\xc4\xb0" in raw.tobytes() else False
        slow = np.flatnonzero((tail > 1) | ((tail == 1) & (size == 0)) | (odd[at] if len(odd) else False) | wide_capital)
        if len(slow):
            # The final stops are not a part of their own, or more than one character: the whole word is tokenized.
            whole = pc.dictionary_encode(words.take(pa.array(slow)))
            at = at.astype(np.int64)
            at[slow] = len(ids) + np.asarray(whole.indices)
            tail = tail.copy()
            tail[slow] = 0
            ids = pa.concat_arrays([ids, self.word.ids(whole.dictionary)[0]])
        # The parts of all words in order, a word's stop behind it.
        stopped = np.flatnonzero(tail)
        to = np.arange(len(at)) + np.cumsum(tail) - tail
        order = np.empty(len(at) + len(stopped), np.int64)
        order[to] = at
        if len(stopped):
            data = np.frombuffer(words.buffers()[2], np.uint8)
            ends = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset + 1 :][stopped]
            order[to[stopped] + 1] = len(ids) + data[ends - 1].astype(np.int64)
        # Each text's parts, then the final token. Their ids are moved as bytes.
        order = np.insert(order, edges := np.concatenate([to, [len(order)]])[of_doc[1:] - of_doc[0]], len(ids) + len(self.stops) - 1)
        joined = pa.concat_arrays([ids, self.stops]).take(pa.array(order))
        upto = np.frombuffer(joined.buffers()[1], np.int64, len(order) + 1)[1:] // 4
        every = np.frombuffer(joined.buffers()[2], "<u4", int(upto[-1]) if len(upto) else 0)
        ends = upto[edges + np.arange(n)].tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            yield every[a:b]


class Statistics:
    """Of all documents: their number, mean length and BM25's weight of each term."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.n, self.df = n, df
        self.mean = max(1.0, tokens / n if n else 1.0)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Statistics:
        terms = [np.unique(d) for d in docs]
        return cls(len(docs), sum(map(len, docs)), np.bincount(np.concatenate(terms).astype(np.int64) if terms else np.zeros(0, np.int64)))

    def weights(self, term: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


class Index:
    """BM25 postings of a shard, by term; stats: of all documents, else of the shard.

    Terms of many documents are rows of a matrix (of CELLS cells at most), the others lists. Documents that have been used
    leave the index from time to time, so what a look-up reads shrinks as the shard is packed.
    """

    def __init__(self, docs: list[np.ndarray], stats: Statistics | None = None):
        pairs = [np.unique(d, return_counts=True) for d in docs]
        self.sizes = np.array([len(t) for t, _ in pairs], np.int64)
        self.terms = [t.astype(np.int32) for t, _ in pairs]
        term = np.concatenate(self.terms) if pairs else np.zeros(0, np.int32)
        tf = np.concatenate([c for _, c in pairs]).astype(np.float32) if pairs else np.zeros(0, np.float32)
        del pairs
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), self.sizes)
        length = np.array([len(d) for d in docs], float)
        order = np.argsort(term, kind="stable")
        weight = (stats or Statistics.of(docs)).weights(term, tf, length[doc]).astype(np.float32)
        self.width = int(term.max()) + 1 if len(term) else 0
        self._take(np.arange(len(docs)), term[order], doc[order], weight[order])

    def _take(self, names: np.ndarray, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        """names: the documents that are left; postings by term, doc is a place in names."""
        self.names, self.term, self.doc, self.weight = names, term, doc, weight
        self.df = np.bincount(term, minlength=self.width)
        self.first = np.concatenate([[0], np.cumsum(self.df)])
        many = np.flatnonzero(self.df > max(8, len(names) // 16))
        many = many[np.argsort(-self.df[many], kind="stable")][: CELLS // max(1, len(names))]
        self.row = np.full(self.width, -1, np.int64)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), len(names)), np.float32)
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], doc[dense]] = weight[dense]

    def _shrink(self, used: np.ndarray) -> None:
        left = ~used[self.names]
        to = (np.cumsum(left) - 1).astype(np.int32)
        stay = left[self.doc]
        self._take(self.names[left], self.term[stay], to[self.doc[stay]], self.weight[stay])

    def ranked(self, seed: int, used: np.ndarray):
        """The unused documents that share terms with the seed, best first, ties by position; the first few, then all others."""
        if 4 * np.count_nonzero(used[self.names]) > len(self.names):
            self._shrink(used)
        t = self.terms[seed]
        row = self.row[t]
        score = np.zeros(len(self.names), np.float32)
        for k in row[row >= 0].tolist():
            np.add(score, self.rows[k], out=score)
        t = t[(row < 0) & (self.df[t] > 0)]
        if len(t):
            parts = [slice(a, b) for a, b in zip(self.first[t].tolist(), self.first[t + 1].tolist(), strict=True)]
            score = score + np.bincount(np.concatenate([self.doc[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), len(score))
        score[used[self.names]] = 0
        found = np.flatnonzero(score)
        least = np.partition(score[found], -FIRST)[-FIRST] if len(found) > FIRST else 0.0
        names = self.names
        for some in (found[score[found] >= least], found[score[found] < least]):
            yield from names[some[np.argsort(-score[some], kind="stable")]].tolist()

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        return np.array(list(self.ranked(seed, used)), np.int64)


class Places:
    """Where a document's content puts it in an order in which related documents are near each other."""

    def __init__(self, stats: Statistics):
        self.stats = stats
        self.planes: dict[int, tuple[np.ndarray, float]] = {}
        self.mean = np.zeros(DIMENSIONS, np.float32)
        self.basis = None

    def look(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(projected BM25 vectors, the two heaviest terms of each document that others have, but not most; 0 stands for none)."""
        if self.basis is None:
            self.basis = np.random.default_rng(7).standard_normal((len(self.stats.df), DIMENSIONS), np.float32)
        telling = (self.stats.df > 1) & (2 * self.stats.df < self.stats.n)
        vectors, heavy = np.zeros((len(docs), DIMENSIONS), np.float32), np.zeros((len(docs), 2), np.int64)
        for k, d in enumerate(docs):
            term, tf = np.unique(d, return_counts=True)
            weight = self.stats.weights(term, tf, len(d)).astype(np.float32)
            vectors[k] = weight @ self.basis[term]
            weight[~telling[term]] = 0
            for j in range(2):
                if weight[top := weight.argmax()] > 0:
                    heavy[k, j], weight[top] = int(term[top]) + 1, 0
        return vectors, heavy

    def _even(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors - self.mean
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def fit(self, vectors: np.ndarray) -> None:
        """Halves the sample along its main axis, again and again."""
        if not len(vectors):
            return
        self.mean = vectors.mean(0)
        x, at, todo = self._even(vectors), np.ones(len(vectors), np.int64), [1]
        while todo:
            rows = np.flatnonzero(at == (node := todo.pop()))
            if len(rows) < 2 * LEAF or node >= 1 << 14:
                continue
            axis = np.linalg.eigh(np.cov(x[rows].T))[1][:, -1].astype(np.float32)
            along = x[rows] @ axis
            middle = float(np.median(along))
            if not (along < middle).any():
                continue
            self.planes[node] = axis, middle
            at[rows] = 2 * node + (along >= middle)
            todo += [2 * node, 2 * node + 1]

    def keys(self, vectors: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """15 bits of the leaf, 24 of each heavy term."""
        at, x = np.ones(len(vectors), np.int64), self._even(vectors)
        todo = [1] if len(vectors) else []
        while todo:
            node = todo.pop()
            if node in self.planes and len(rows := np.flatnonzero(at == node)):
                axis, middle = self.planes[node]
                at[rows] = 2 * node + (x[rows] @ axis >= middle)
                todo += [2 * node, 2 * node + 1]
        depth = np.floor(np.log2(at)).astype(np.int64)
        leaf = (at << (14 - depth)) - (1 << 14)
        return leaf << 48 | (heavy[:, 0] & 0xFFFFFF) << 24 | heavy[:, 1] & 0xFFFFFF


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, stats: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length): windows filled to the last token, then powers of two."""
    index, n = Index(docs, stats), len(docs)
    used = np.zeros(n, bool)
    out: list[list[tuple[int, int, int]]] = []
    current: list[tuple[int, int, int]] = []
    room, following = window, 0

    def place(doc: int, start: int) -> int:
        """Puts what fits of a document into the window; returns where its rest starts."""
        nonlocal room
        take = min(room, len(docs[doc]) - start)
        current.append((doc, start, take))
        room -= take
        return start + take

    carry = None
    while True:
        if carry is None:
            while following < n and used[following]:
                following += 1
            if following == n:
                break
            used[following] = True
            carry = (following, 0)
        seed, at = carry
        rest = place(seed, at)
        carry = (seed, rest) if rest < len(docs[seed]) else None
        if room and carry is None:
            for doc in index.ranked(seed, used):
                used[doc] = True
                rest = place(doc, 0)
                if rest < len(docs[doc]):
                    carry = (doc, rest)
                if not room:
                    break
        if not room:
            out.append(current)
            current, room = [], window
    left = window - room
    while left:
        size = 1 << left.bit_length() - 1
        part, need = [], size
        while need:
            doc, start, length = current.pop(0)
            take = min(need, length)
            part.append((doc, start, take))
            need -= take
            if take < length:
                current.insert(0, (doc, start + take, length - take))
        out.append(part)
        left -= size
    return out


def _arrays(tokens: pa.Array, sizes: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t, f"<u{len(t) // n}") for t, n in zip(tokens.to_pylist(), sizes.to_pylist(), strict=True)]


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = "") -> tuple[DataFrame, Statistics]:
    """(_id, _tokens, _n, _crc) of each document, kept on disk, and the statistics of all."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tokens = Tokens.shared(tokenizer)
        size = tokens.tokenizer.get_vocab_size()
        df, place, form = np.zeros(size, "<i8"), np.zeros(size, np.int32), "<u2" if size <= 1 << 16 else "<u4"
        id_type = None
        for batch in batches:
            id_type, found = batch.schema.field(0).type, []
            for i, one in zip(batch.column(0).to_pylist(), tokens.of(batch.column(1)), strict=True):
                # Of a term's places in the text one is left.
                place[one] = every = np.arange(len(one), dtype=np.int32)
                df[one[place[one] == every]] += 1
                found.append((raw := one.astype(form).tobytes(), len(one), zlib.crc32(raw, zlib.crc32(str(i).encode())), None))
            cols = list(zip(*found, strict=True)) or [[] for _ in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.int64(), pa.int64(), pa.binary()], strict=True))], names)
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *(pa.array([c], t) for c, t in zip([None, None, None, df.tobytes()], [pa.binary(), pa.int64(), pa.int64(), pa.binary()], strict=True))], names)

    def counts(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                one = np.frombuffer(x, "<i8")
                total = one + total if len(total) else one
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(total[term], pa.int64()), pa.array(np.full(len(term), len(total)), pa.int64())], ["term", "n", "size"])

    names = ["_id", "_tokens", "_n", "_crc", "_df"]
    kept = materialise(docs.select(id_col, text_col).mapInArrow(released(run), f"_id {kind}, _tokens binary, _n long, _crc long, _df binary"), "pack-tokens")
    # A row per term of the vocabulary at most.
    found = kept.filter("_df is not null").select("_df").mapInArrow(counts, "term long, n long, size long").groupBy("term").agg(F.sum("n").alias("n"), F.max("size").alias("size")).collect()
    n, total = kept.filter("_n is not null").agg(F.count("_n"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    df = np.zeros(max((r["size"] for r in found), default=0), np.int64)
    df[[r["term"] for r in found]] = [r["n"] for r in found]
    return kept.filter("_n is not null").drop("_df"), Statistics(n, total, df)


def placed(tokens: DataFrame, stats: Statistics) -> DataFrame:
    """Documents in ranges by content, one to a task, each sorted."""
    spark, every = tokens.sparkSession, max(1, -(-stats.n // SAMPLE))
    share = lambda n: 1 / SHARD_ROWS + n / SHARD_TOKENS
    places = Places(stats)

    def sample(batches):
        for rows in batches:
            vectors, heavy = places.look(_arrays(rows.column(0), rows.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([h.tobytes() for h in heavy], pa.binary()), rows.column(1)], ["v", "h", "n"])

    # A row's place in its part of the stored table.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + F.spark_partition_id() * 7919
    got = tokens.withColumn("_place", place).filter(F.col("_place") % every == 0).select("_tokens", "_n").mapInArrow(released(sample), "v binary, h binary, n long").collect()
    got.sort()
    vectors = np.frombuffer(b"".join(r["v"] for r in got), np.float32).reshape(-1, DIMENSIONS)
    heavy = np.frombuffer(b"".join(r["h"] for r in got), np.int64).reshape(-1, 2)
    places.fit(vectors)
    places.basis = None
    keys = places.keys(vectors, heavy)
    order = np.argsort(keys, kind="stable")
    filled = np.cumsum(share(np.array([r["n"] for r in got], float))[order])
    ranges = max(1, min(partitions(spark), int(np.ceil(filled[-1] * every / 0.8)))) if len(got) else 1
    edges = keys[order][np.searchsorted(filled, filled[-1] * np.arange(1, ranges) / ranges)] if len(got) else keys

    def put(batches):
        at = 0
        for batch in batches:
            key = places.keys(*places.look(_arrays(batch.column(1), batch.column(2))))
            low, high = np.searchsorted(edges, key, "left"), np.searchsorted(edges, key, "right")
            # A key that is several edges is dealt over the ranges between them.
            to = low + (at + np.arange(len(key))) % (high - low + 1)
            at += len(key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64()), pa.array(to, pa.int32())], [*batch.schema.names, "_key", "_to"])

    kind = tokens.schema["_id"].dataType.simpleString()
    dealt = tokens.select("_id", "_tokens", "_n", "_crc").mapInArrow(released(put), f"_id {kind}, _tokens binary, _n long, _crc long, _key long, _to int")
    return dealt.repartitionById(ranges, F.col("_to")).sortWithinPartitions("_key", "_crc", "_n").select("_id", "_tokens", "_n")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "", with_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Every token of every row lies in exactly one piece; repeated rows are packed as often as they occur. A null or
    empty text is its final token alone. The offsets of a sequence have no gaps, and each sequence has WINDOW tokens
    or a power of two of them, so nothing is padded. An empty table gives no sequences.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    types = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
    kept, stats = tokenized(docs, id_col, text_col, tokenizer)

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        ids, arrays, held = [], [], 0

        def flush():
            nonlocal number
            rows = []
            for sequence in pack_shard(arrays, stats=stats):
                offset = 0
                for doc, start, length in sequence:
                    piece = arrays[doc][start : start + length].astype("<u4")
                    rows.append((ids[doc], start, length, zlib.crc32(piece), len(arrays[doc]), number, offset) + ((piece.astype(np.int32),) if with_ids else ()))
                    offset += length
                number += 1
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [id_type, *types], strict=True)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, one in zip(batch.column(0).to_pylist(), _arrays(batch.column(1), batch.column(2)), strict=True):
                if arrays and (len(arrays) >= SHARD_ROWS or held + len(one) > SHARD_TOKENS):
                    yield flush()
                    ids, arrays, held = [], [], 0
                ids.append(i)
                arrays.append(one)
                held += len(one)
        if arrays:
            yield flush()

    columns = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return placed(kept, stats).mapInArrow(released(run), columns)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, packed with its neighbours."""
    return pack(table(spark, sf_dir, "documents"))
