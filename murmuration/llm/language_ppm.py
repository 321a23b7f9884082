"""Language ID by prediction by partial matching: per-language byte context trees of variable order, with escape probabilities, score exact code lengths under frozen statistics.

A byte's code length depends only on the ORDER bytes before it. The trees of all languages are laid over each other:
a node is a context that some language has seen, and each pair of a node and a byte that some language has seen there
has its code length in every language. A byte that no language has seen at a node costs each of them its escape and
is looked for at the next shorter context. So a text is scored by a few lookups in whole Arrow batches, and tables
grow with the pairs seen, not with all that could be. code_length() is the same model walked byte by byte, for tests and single texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, id_hash, table
from .training import drawn, window_of

ORDER = 3
#: The training sample: about so many documents a language (1.25 times that and 16 at most), and of a longer document a window of so many characters, drawn by hash of the id.
SAMPLE_DOCS, SAMPLE_CHARS = 160, 8000
#: Symbols: 0 starts a text, 1 + b is byte b.
START, SYMBOLS = 0, 257
#: Code lengths that are held at once, over all languages.
SLICE = 1 << 22
#: Bits of a byte below order 0, where all 256 are alike.
FLAT = 8.0


class Trees:
    """Frozen statistics: counts of (context, symbol) by language and order. A context's last symbol counts least."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        self.counts = []
        for lang in self.langs:
            s = np.concatenate([np.zeros(0, np.int64), *(x for t in samples[lang] for x in (np.full(ORDER, START, np.int64), np.frombuffer(t, np.uint8).astype(np.int64) + 1))])
            at = np.flatnonzero(s != START)
            orders, code = [], np.zeros(len(at), np.int64)
            for k in range(ORDER + 1):
                if k:
                    code = code + s[at - k] * SYMBOLS ** (k - 1)
                orders.append(np.unique(code * SYMBOLS + s[at], return_counts=True))
            self.counts.append(orders)
        self.key = hashlib.sha256(b"".join(a.tobytes() + b.tobytes() for orders in self.counts for a, b in orders)).hexdigest()

    def code_length(self, text: bytes, lang: str) -> float:
        """Bits of a text in one language, symbol by symbol: the longest context that the language has seen, escapes to shorter ones."""
        trees = defaultdict(dict)
        for k, (pairs, count) in enumerate(self.counts[self.langs.index(lang)]):
            for p, c in zip(pairs.tolist(), count.tolist(), strict=True):
                trees[k, p // SYMBOLS][p % SYMBOLS] = c
        s = [START] * ORDER + [1 + b for b in text]
        bits = 0.0
        for i in range(ORDER, len(s)):
            for k in range(ORDER, -2, -1):
                if k < 0:
                    bits += FLAT
                    break
                here = trees.get((k, sum(s[i - j] * SYMBOLS ** (j - 1) for j in range(1, k + 1))))
                if not here:
                    continue
                total = sum(here.values()) + len(here)
                if s[i] in here:
                    bits -= np.log2(here[s[i]] / total)
                    break
                bits -= np.log2(len(here) / total)
        return float(bits)


class Tables:
    """Trees laid over each other. symbol: of each byte, numbered by what was seen (the last stands for bytes never seen); node: of the last ORDER symbols; parent and escape by node; slots and cost by pair."""

    def __init__(self, trees: Trees):
        n = len(trees.langs)
        seen = np.unique(np.concatenate([c[0][0] for c in trees.counts] + [np.zeros(0, np.int64)]) % SYMBOLS)
        self.width = len(seen) + 2
        of = np.full(SYMBOLS, len(seen) + 1, np.int64)
        of[START], of[seen] = 0, 1 + np.arange(len(seen))
        self.symbol = of[1:].astype(np.int32)
        contexts, self.parent = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        first, escape, keys, costs = [0], [], [], []
        for k in range(ORDER + 1):
            if k:
                contexts.append(np.unique(np.concatenate([c[k][0] // SYMBOLS for c in trees.counts] + [np.zeros(0, np.int64)])))
                first.append(first[-1] + len(contexts[k - 1]))
                self.parent.append(first[k - 1] + np.searchsorted(contexts[k - 1], contexts[k] % SYMBOLS ** (k - 1)))
            pairs = np.unique(np.concatenate([c[k][0] for c in trees.counts] + [np.zeros(0, np.int64)]))
            at, symbol = np.searchsorted(contexts[k], pairs // SYMBOLS), pairs % SYMBOLS
            low = np.zeros((len(contexts[k]), n), np.float32)
            # What a language that has not seen a pair pays: its escape, then what the pair costs one context shorter.
            below = np.full((len(pairs), n), FLAT, np.float32) if not k else costs[k - 1][np.searchsorted(keys[k - 1], self.parent[k][at] * SYMBOLS + symbol)]
            for j, (own, count) in enumerate(c[k] for c in trees.counts):
                node = np.searchsorted(contexts[k], own // SYMBOLS)
                total, kinds = np.bincount(node, count, len(contexts[k])), np.bincount(node, minlength=len(contexts[k]))
                have = total > 0
                low[have, j] = -np.log2(kinds[have] / (total[have] + kinds[have]))
                cost = below[:, j] + low[at, j]
                cost[np.searchsorted(pairs, own)] = -np.log2(count / (total[node] + kinds[node]))
                below[:, j] = cost
            escape.append(low)
            keys.append((first[k] + at) * SYMBOLS + symbol)
            costs.append(below)
        self.escape, self.cost = np.concatenate(escape), np.concatenate(costs)
        self.node = np.zeros(1, np.int32)
        for k in range(1, ORDER + 1):
            self.node = np.tile(self.node, self.width)
            code = sum(of[contexts[k] // SYMBOLS ** j % SYMBOLS] * self.width**j for j in range(k))
            self.node[code] = first[k] + np.arange(len(contexts[k]))
        self.parent = np.concatenate(self.parent).astype(np.int32)
        self._hash(np.concatenate([k // SYMBOLS * self.width + of[k % SYMBOLS] for k in keys]))

    def _hash(self, keys: np.ndarray) -> None:
        """An open-addressed table of the pairs, at most half full."""
        bits = max(4, (2 * len(keys) - 1).bit_length()) if len(keys) else 4
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_pair = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slot_key[slot] < 0
            taken, one = np.unique(slot[free], return_index=True)
            put = todo[free][one]
            self.slot_key[taken], self.slot_pair[taken] = keys[put], put
            rest = self.slot_key[slot] != keys[todo]
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The pair of each node and symbol, -1 where no language has seen it."""
        keys = node.astype(np.int64) * self.width + symbol
        slot = self._slot(keys)
        have = self.slot_key[slot]
        out = np.where(have == keys, self.slot_pair[slot], -1)
        todo = np.flatnonzero((have != keys) & (have >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            have = self.slot_key[slot]
            hit = have == keys[todo]
            out[todo[hit]] = self.slot_pair[slot[hit]]
            more = ~hit & (have >= 0)
            todo, slot = todo[more], slot[more]
        return out

    def bits(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Code lengths of symbols after contexts, by language."""
        pair = self.find(node, symbol)
        out = self.cost.take(np.maximum(pair, 0), axis=0)
        todo = np.flatnonzero(pair < 0)
        out[todo] = 0
        node = node[todo]
        while len(todo):
            out[todo] += self.escape[node]
            root = node == 0
            out[todo[root]] += FLAT
            todo, node = todo[~root], self.parent[node[~root]]
            pair = self.find(node, symbol[todo])
            hit = pair >= 0
            out[todo[hit]] += self.cost[pair[hit]]
            todo, node = todo[~hit], node[~hit]
        return out


_TABLES: dict[str, Tables] = {}


def _tables(trees: Trees) -> Tables:
    if trees.key not in _TABLES:
        _TABLES.clear()
        _TABLES[trees.key] = Tables(trees)
    return _TABLES[trees.key]


def code_lengths(trees: Trees, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language, from the texts' bytes end to end."""
    tables = _tables(trees)
    n = len(offsets) - 1
    starts = offsets[:-1] + ORDER * np.arange(n)
    s = np.full(len(raw) + ORDER * n, START, np.int32)
    symbols = tables.symbol[raw]
    for a, b, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (starts + ORDER).tolist(), strict=True):
        s[to : to + b - a] = symbols[a:b]
    out = np.zeros((n, len(trees.langs)))
    step = max(1, SLICE // max(1, len(trees.langs)))
    for p in range(0, len(s), step):
        q = min(p + step, len(s))
        x = np.concatenate([np.zeros(max(0, ORDER - p), np.int32), s[max(0, p - ORDER) : q]])
        code = np.zeros(q - p, np.int32)
        for k in range(ORDER):
            code += x[k : k + q - p] * np.int32(tables.width ** (ORDER - 1 - k))
        own = np.flatnonzero(x[ORDER:] != START)
        bits = np.zeros((q - p, len(trees.langs)), np.float32)
        bits[own] = tables.bits(tables.node.take(code[own]), x[ORDER:][own])
        first = int(np.searchsorted(starts, p, "right")) - 1
        last = int(np.searchsorted(starts, q))
        bounds = np.concatenate([[p], starts[first + 1 : last]]) - p
        out[first:last] += np.add.reduceat(bits, bounds, axis=0, dtype=np.float64)
    return out


_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    return bool(_LETTER.search(raw)) or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predict(trees: Trees, column: pa.Array) -> tuple[list[str], list[float]]:
    """(language, posterior under equal priors) of each text; `und` with score 0 if it is null, has no letter, or no language was learned. Ties go to the first language by name."""
    raw, offsets = bytes_of(column)
    n, langs = len(offsets) - 1, trees.langs
    if not n or not langs:
        return ["und"] * n, [0.0] * n
    bits = code_lengths(trees, raw, offsets)
    best = bits.argmin(axis=1)
    score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
    ok = [has_letter(raw[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return [langs[k] if y else "und" for k, y in zip(best.tolist(), ok, strict=True)], np.where(ok, score, 0.0).tolist()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Trees:
    """Trees from a bounded sample of docs with a language and a text, drawn at a rate by language, by hash of the id; of a long text a window.

    The number of languages must be small; it and the sample's limits bound what the driver gathers, however often an id
    repeats. Without such rows no language is learned.
    """
    text = F.col(text_col)
    usable = docs.filter(F.col(lang_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("_id"), window_of(text, F.col(id_col), SAMPLE_CHARS).alias("_text"), F.col(lang_col).alias("_lang"))
    samples: dict[str, list[bytes]] = defaultdict(list)
    for r in drawn(usable, "_lang", defaultdict(lambda: SAMPLE_DOCS)).select("_lang", "_text").collect():
        samples[r["_lang"]].append(r["_text"].encode())
    return Trees({lang: sorted(texts) for lang, texts in samples.items()})


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: id, the columns in keep, lang_pred, score. Only the whole text decides, so repeated rows are judged alike.

    A null text and one without a letter are `und` with score 0; of languages with equal code lengths the first by name
    counts. Other columns are dropped. An empty table gives an empty result. Memory holds a batch and SLICE code lengths, however long a text is.
    """
    names = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for batch in batches:
            lang, score = predict(trees, batch.column(len(names)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*names, text_col).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op4_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by trees of the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_hash() % 3 == 1)
    return identify(docs, fit(docs.filter(~F.col("held_out"))), keep=("held_out",))
