"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence, which accumulates overlap counts and discards pairs below bounds that follow from the sets' sizes.

The steps, each exact for a threshold of 3/4:

1. Column blocks. A linked document shares at least 3/4 of its set with one other, so of its shingles in the lower half
   of the hash space all but a quarter of its whole set occur elsewhere. Columns are counted by block; documents below that bound link with nothing. Most leave here.
2. Equal sets are one class with one representative, whose text is read again; a Bloom filter of their ids keeps the other texts where they are.
3. Stars. Classes with the same smallest hash (under several orders) are compared with a few of their number, one pass
   over sorted rows; classes that link are known to be together, so most groups of near copies collapse without their pairs.
4. Product. Prefix shingles (any linked pair shares one) are the columns. The order that defines prefixes goes from
   rare shingles to common ones, as told by a sketch that grows with the input; any order is exact, this one keeps
   shared passages out. A cell of the sketch with one entry has a shingle of one class, which makes no pair. In columns
   of the others that are not common, pairs of different known groups are made, their overlaps in the prefixes
   accumulate, and pairs whose count cannot reach the threshold at their sizes are dropped; the rest are compared in full.
5. Documents with common shingles in their prefix are laid out in blocks of similar rows. Blocks that share such a
   column are multiplied: overlaps of all their pairs accumulate in one task's memory, and only links that join groups leave it.
6. Components of all links give each document its group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import dense_index
from ..operators.scratch import sweep
from .common import Scratch, bytes_of, materialise, partitions, released, split_by_bloom, table
from .components import components
from .shingles import class_id, overlap, shingle_sets

#: Shingles and documents of a flush (documents are numbered in 16 bits), leaders of a star (and of those that go to other tasks), rows of a block of a column and of a block of rows.
FLUSH, FLUSH_DOCS, LEADERS, SENT, BLOCK_ROWS, ROWS = 1 << 19, 60_000, 64, 16, 2048, 512
#: Bytes of text of a block of columns; bits of the sketch's cell numbers at least and at most (2 bits a cell, so 32 MB is the most that is sent to tasks), its cells per entry.
BLOCK_BYTES, SKETCH, CELLS = 1 << 26, (16, 27), 1
#: Entries of a cell from which its shingles are in the third and the last part of the order, and times the mean of a cell from which they are.
MIDDLE, COMMON, MIDDLE_MEAN, COMMON_MEAN = 8, 64, 4, 8
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
HALF = np.uint64(1 << 63)


def linked(a: int, b: int, common: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def prefix(n: int) -> int:
    """Length of the prefix that a set shares with any linked one: n - ceil(3 n / 4) + 1."""
    return n - (3 * n + 3) // 4 + 1 if n else 0


def _columns(docs: DataFrame, blocks: int) -> DataFrame:
    """(kind, block, flush, data): kind 0, the hashes of a flush that fall in a block; kind 1, what is known of the flush's documents."""
    kind = docs.schema.fields[0].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("document ids must be integers")

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, classes, lows, held = [], [], [], [], 0

        def flush():
            nonlocal number
            name = part << 24 | number
            number += 1
            low = np.concatenate(lows) if lows else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(lows), dtype=np.uint16), [len(x) for x in lows])
            order = np.argsort(low, kind="stable")
            s, d = low[order], doc[order]
            new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
            lone = new & np.r_[new[1:], True] if len(s) else new
            # Shared within the flush: counted here, and one witness goes to the block.
            base = np.bincount(d[~lone], minlength=len(lows)).astype(np.uint32)
            s, d, lone = s[new], d[new], lone[new]
            block = ((s & np.uint64(0x7FFFFF)) % np.uint64(blocks)).astype(np.int32)
            value = (s >> np.uint64(31)).astype(np.uint32)
            order = np.lexsort((d, ~lone, block))
            block, value, d, lone = block[order], value[order], d[order], lone[order]
            edges = np.searchsorted(block, np.arange(blocks + 1))
            rows = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[k], edges[k + 1]
                singles = int(lone[a:b].sum())
                data = np.uint32(singles).tobytes() + d[a : a + singles].tobytes() + value[a:b].tobytes()
                rows.append((0, k, name, data))
            of = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array([len(x) for x in lows], pa.int64()), pa.array(base.astype(np.int64))], ["id", "n", "cls", "low", "shared"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, of.schema) as w:
                w.write_batch(of)
            rows.append((1, zlib.crc32(b"%d" % name) % blocks, name, sink.getvalue().to_pybytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["kind", "block", "flush", "data"])

        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(*bytes_of(batch.column(1))), strict=True):
                low = s[: int(np.searchsorted(s, HALF))]
                ids.append(i)
                sizes.append(len(s))
                classes.append(class_id(s))
                lows.append(low)
                held += len(low)
                if held >= FLUSH or len(ids) >= FLUSH_DOCS:
                    yield flush()
                    ids, sizes, classes, lows, held = [], [], [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(released(run), "kind int, block int, flush long, data binary")


def _count_block(t: pa.Table) -> pa.Table:
    """One block of columns: (flush, kind, data) with the documents of each flush that share a hash, and how many; what is known of documents passes through."""
    kinds, flushes = t.column("kind").to_pylist(), t.column("flush").to_pylist()
    out, parts, wit = [], [], []
    for kind, flush, data in zip(kinds, flushes, t.column("data").to_pylist(), strict=True):
        if kind:
            out.append((flush, 1, data))
            continue
        singles = int(np.frombuffer(data, np.uint32, 1)[0])
        d = np.frombuffer(data, np.uint16, singles, 4)
        value = np.frombuffer(data[4 + 2 * singles :], np.uint32)
        parts.append((flush, d, value[:singles]))
        wit.append(value[singles:])
    if parts:
        single = np.concatenate([v for _, _, v in parts])
        every = np.concatenate([single, *wit])
        s = np.sort(every)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        at = np.searchsorted(twice, single)
        at[at == len(twice)] = 0
        hit = twice[at] == single if len(twice) else np.zeros(len(single), bool)
        k = 0
        for flush, d, v in parts:
            found = d[hit[k : k + len(v)]]
            k += len(v)
            if len(found):
                docs, count = np.unique(found, return_counts=True)
                out.append((flush, 0, docs.astype(np.uint16).tobytes() + count.astype(np.uint32).tobytes()))
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table({"flush": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()), "data": pa.array(cols[2], pa.binary())})


def _judge_flush(t: pa.Table) -> pa.Table:
    """The documents of a flush: (id, n, cls, candidate)."""
    known, shared = None, []
    for kind, data in zip(t.column("kind").to_pylist(), t.column("data").to_pylist(), strict=True):
        if kind:
            known = pa.ipc.open_stream(data).read_all()
        else:
            k = len(data) // 6
            shared.append((np.frombuffer(data, np.uint16, k), np.frombuffer(data, np.uint32, k, 2 * k)))
    total = known.column("shared").to_numpy().copy()
    for docs, count in shared:
        total[docs] += count  # the documents of one entry are distinct
    n, low = known.column("n").to_numpy(), known.column("low").to_numpy()
    return pa.table({"id": known.column("id"), "n": known.column("n"), "cls": known.column("cls"), "candidate": pa.array((n > 0) & (total >= low - n // 4))})


def _sets(batches):
    """(id, cls, n, keys, set) of rows (id, text)."""
    for batch in batches:
        every = shingle_sets(*bytes_of(batch.column(1)))
        ids = batch.column(0).filter(pa.array([len(s) > 0 for s in every], pa.bool_()))
        sets = [s for s in every if len(s)]
        keys = [[int(np.min(s * np.uint64(m)) ^ np.uint64(k)) - (1 << 63) for k, m in enumerate(ORDERS)] for s in sets]
        yield pa.RecordBatch.from_arrays([ids, pa.array([class_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "cls", "n", "keys", "data"])


def _stars(batches):
    """Rows (key, cls, data) sorted by key: (a, b, key, data); a link of a class with a leader, or (b null) a leader of the task's first or last key, whose rows other tasks may hold too.

    The leaders of a key are its first classes, those with most links in front: they soon are the middle of a group.
    """
    key, leaders, first = None, [], True

    def kept():
        return [(c, None, key, s.tobytes()) for _, c, s in leaders[:SENT]]

    def batch_of(rows):
        cols = list(zip(*rows, strict=True)) or [[] for _ in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["a", "b", "key", "data"])

    for batch in batches:
        out = []
        for k, c, data in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            s = np.frombuffer(data, np.uint64)
            if k != key:
                if first and key is not None:
                    out += kept()
                    first = False
                key, leaders = k, []
            for q, leader in enumerate(leaders):
                if c == leader[1]:
                    break
                t = leader[2]
                if linked(len(s), len(t), min(len(s), len(t))) and linked(len(s), len(t), overlap(s, t)):
                    out.append((c, leader[1], k, None))
                    leader[0] += 1
                    while q and leaders[q - 1][0] < leader[0]:
                        leaders[q - 1], leaders[q] = leaders[q], leaders[q - 1]
                        q -= 1
                    break
            if len(leaders) < LEADERS:
                leaders.append([0, c, s])
        yield batch_of(out)
    if key is not None:
        yield batch_of(kept())


def sketch_bits(entries: int) -> int:
    """Bits of a cell's number: CELLS cells an entry, within bounds."""
    return min(max((CELLS * entries - 1).bit_length() if entries else 0, SKETCH[0]), SKETCH[1])


def _cells(bits: int):
    """Cells of rows (data) by parts of 2 ** 16 cells: (part, data), the place in the part of each entry in 16 bits."""

    def flush(held):
        cell = np.sort(np.concatenate(held))
        parts, first = np.unique(cell >> np.uint32(16), return_index=True)
        edges = [*first.tolist(), len(cell)]
        low = cell.astype(np.uint16)
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["part", "data"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for d in batch.column(0).to_pylist():
                held.append((np.frombuffer(d, np.uint64) >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(held[-1])
                if size >= 4 * FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _levels(mean: float):
    """A part of the sketch: (part, levels), each cell's place in the order in 2 bits: one entry, few, some, common."""
    steps = (2, max(MIDDLE, MIDDLE_MEAN * mean) + 1, max(COMMON, COMMON_MEAN * mean) + 1)

    def run(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << 16, np.int64)
        for d in t.column("data").to_pylist():
            total += np.bincount(np.frombuffer(d, np.uint16), minlength=1 << 16)
        level = np.searchsorted(steps, total, "right").astype(np.uint8).reshape(-1, 4)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "levels": pa.array([(level[:, 0] | level[:, 1] << 2 | level[:, 2] << 4 | level[:, 3] << 6).tobytes()], pa.binary())})

    return run


def sketch(sets: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, levels of all cells, 4 in a byte) of the shingles of sets (n, data). The sketch grows with the input up to a fixed size; beyond that its levels follow the mean of a cell."""
    entries = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = sketch_bits(entries)
    out = np.zeros(1 << bits - 2, np.uint8)
    for r in sets.select("data").mapInArrow(released(_cells(bits)), "part int, data binary").groupBy("part").applyInArrow(_levels(entries / (1 << bits)), "part int, levels binary").collect():
        out[r["part"] << 14 : (r["part"] + 1) << 14] = np.frombuffer(r["levels"], np.uint8)
    return bits, out


def _entries(bits: int, levels: np.ndarray):
    """Prefix entries (shingle, cls, n, comp, common) of rows (cls, n, comp, data), without those that no other class has."""

    def run(batches):
        for batch in batches:
            cls, n, comp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            sets, flags = [], []
            for d, m in zip(batch.column(3).to_pylist(), n.tolist(), strict=True):
                s = np.frombuffer(d, np.uint64)
                cell = s >> np.uint64(64 - bits)
                level = levels[cell >> np.uint64(2)] >> ((cell & np.uint64(3)) << np.uint64(1)).astype(np.uint8) & np.uint8(3)
                order = np.argsort(level, kind="stable")[: prefix(m)]
                order = order[level[order] > 0]
                sets.append(s[order])
                flags.append(level[order] == 3)
            size = [len(s) for s in sets]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            flag = np.concatenate(flags) if flags else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *(pa.array(np.repeat(x, size)) for x in (cls, n, comp)), pa.array(flag)], ["shingle", "cls", "n", "comp", "common"])

    return run


def _multiply(t: pa.Table) -> pa.Table:
    """Two blocks of rows (side, cls, comp, data): (a, b), links that join groups. A block with itself has side 0 alone."""
    side = t.column("side").to_numpy()
    sets = [np.frombuffer(d, np.uint64) for d in t.column("data").to_pylist()]
    cls, comp = t.column("cls").to_pylist(), t.column("comp").to_pylist()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right if len(right) else left
    size = np.array([len(sets[k]) for k in right])
    x = np.concatenate([sets[k] for k in right])
    row = np.repeat(np.arange(len(right)), size)
    order = np.argsort(x, kind="stable")
    x, row = x[order], row[order]
    of = np.array([comp[k] for k in right])
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    out = []
    for k in left.tolist():
        s = sets[k]
        a, b = np.searchsorted(x, s, "left"), np.searchsorted(x, s, "right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(row[at], minlength=len(right))
        for j in np.flatnonzero((100 * common >= 75 * (len(s) + size - common)) & (of != comp[k])).tolist():
            u, v = find(comp[k]), find(int(of[j]))
            if u != v:
                root[u] = v
                out.append((cls[k], cls[right[j]]))
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


def _product(batches):
    """Rows (shingle, bi, bj, side, cls, n, comp) sorted by the first three: (a, b, na, nb) of pairs of different groups whose sizes allow a link. Side 0 lies in block bi, 1 in bj; in a block with itself all sides are 0."""
    held: list[np.ndarray] = []

    def pairs(rows: np.ndarray):
        """All pairs of one cell (shingle, bi, bj), a slice of rows at a time."""
        left = rows[rows[:, 3] == 0]
        right = rows[rows[:, 3] == 1] if rows[0, 1] != rows[0, 2] else left
        own = right is left
        step = max(1, (1 << 20) // max(1, len(right)))
        for k in range(0, len(left), step):
            x = left[k : k + step]
            ok = (x[:, None, 6] != right[None, :, 6]) & (4 * np.minimum(x[:, None, 5], right[None, :, 5]) >= 3 * np.maximum(x[:, None, 5], right[None, :, 5]))
            if own:
                ok &= np.arange(k, k + len(x))[:, None] < np.arange(len(right))[None, :]
            i, j = np.nonzero(ok)
            if len(i):
                p, q = x[i], right[j]
                swap = p[:, 4] > q[:, 4]
                p, q = np.where(swap[:, None], q, p), np.where(swap[:, None], p, q)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p[:, 4], q[:, 4], p[:, 5], q[:, 5])], ["a", "b", "na", "nb"])

    def cells(rows: np.ndarray):
        cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        for part in np.split(rows, cut):
            if len(part) > 1 and part[:, 6].min() != part[:, 6].max():
                yield from pairs(part)

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)], axis=1)
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut or held and (held[-1][-1, :3] != rows[0, :3]).any():
            yield from cells(np.concatenate([*held, rows[:cut]]))
            held = []
        held.append(rows[cut:])
    if held:
        yield from cells(np.concatenate(held))


def _verify(batches):
    """(a, b) of rows (a, b, one, two) whose sets link."""
    for batch in batches:
        ok = []
        for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            s, t = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            ok.append(linked(len(s), len(t), overlap(s, t)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_shingles (size of its set of 5-word shingles), component_id (smallest id reachable by links, its own included).

    A-Z are lower-cased; words are runs of other than [\\x20\\x09-\\x0D]. Two sets link when 100 times their
    intersection is at least 75 times their union. A text without words, or null, has no set and links with
    nothing. Rows with equal sets link, repeated rows too. A null id is never a component's id unless nothing else is
    reachable. Other columns are ignored. An empty table gives an empty result.
    """
    with Scratch() as scratch:
        return _near_duplicates(docs, id_col, text_col, scratch)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    n = partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(2 * n, size // BLOCK_BYTES)
    counted = _columns(base, blocks).repartition(n, "block").groupBy("block").applyInArrow(_count_block, "flush long, kind int, data binary")
    known = scratch.keep(counted.groupBy("flush").applyInArrow(_judge_flush, "id long, n long, cls long, candidate boolean"), "jaccard-known")
    classes = scratch.keep(known.filter("candidate").groupBy("cls").agg(F.min("id").alias("rep")), "jaccard-classes")
    texts, _ = split_by_bloom(base, "id", classes.select("rep"))
    found = texts.mapInArrow(released(_sets), "id long, cls long, n long, keys array<long>, data binary").join(classes.withColumnRenamed("cls", "_cls"), (F.col("cls") == F.col("_cls")) & F.col("id").eqNullSafe(F.col("rep"))).select("cls", "n", "keys", "data")
    sets = scratch.keep(found.dropDuplicates(["cls"]), "jaccard-sets")
    sweep(docs.sparkSession)
    groups = _star_groups(sets, n, scratch)
    sweep(docs.sparkSession)
    more = scratch.keep(_rare_links(sets, groups, n, scratch).unionByName(_common_links(sets, groups, scratch)), "jaccard-more")
    # The known groups are stars already; new links join them.
    final = components(groups.select(F.col("v").alias("a"), F.col("c").alias("b")).unionByName(more), scratch=scratch)
    of_class = classes.join(final, classes["cls"] == final["v"], "left").select("cls", "rep", F.coalesce("c", "cls").alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = of_class.join(least, "comp").select("cls", "component_id")
    out = known.filter("candidate").join(named, "cls").select("id", "n", "component_id").unionByName(known.filter("not candidate").select("id", "n", F.col("id").alias("component_id")))
    return materialise(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"), "jaccard-groups")


def _star_groups(sets: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(v, c): classes that stars link, and their group."""
    keyed = sets.select(F.explode("keys").alias("key"), "cls", "data").repartitionByRange(n, "key", "cls").sortWithinPartitions("key", "cls")
    schema = "a long, b long, key long, data binary"
    stars = scratch.keep(keyed.mapInArrow(released(_stars), schema), "jaccard-stars")
    again = stars.filter("b is null").select("key", F.col("a").alias("cls"), "data").repartition(n, "key").sortWithinPartitions("key", "cls").mapInArrow(released(_stars), schema)
    links = scratch.keep(stars.filter("b is not null").select("a", "b").unionByName(again.filter("b is not null").select("a", "b")).distinct(), "jaccard-links")
    scratch.drop(stars)
    groups = components(links, scratch=scratch)
    scratch.drop(links)
    return groups


def _grouped(sets: DataFrame, groups: DataFrame) -> DataFrame:
    return sets.join(groups, sets["cls"] == groups["v"], "left").select("cls", "n", F.coalesce("c", "cls").alias("comp"), "data")


def _rare_links(sets: DataFrame, groups: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(a, b): links of different groups whose prefixes share a shingle that is not common. Also keeps the entries with common shingles, for _common_links()."""
    entries = scratch.entries = scratch.keep(_grouped(sets, groups).mapInArrow(released(_entries(*sketch(sets))), "shingle long, cls long, n long, comp long, common boolean"), "jaccard-entries")
    of = Window.partitionBy("shingle")
    few = entries.filter("not common").drop("common").select("*", F.min("comp").over(of).alias("_lo"), F.max("comp").over(of).alias("_hi"), F.ceil(F.count(F.lit(1)).over(of) / BLOCK_ROWS).alias("_g")).filter("_lo <> _hi")
    cells = few.withColumn("_b", F.pmod(F.xxhash64("cls"), F.col("_g"))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)))
    cells = cells.select("shingle", F.least("_b", "_j").alias("bi"), F.greatest("_b", "_j").alias("bj"), F.when(F.col("_b") > F.col("_j"), 1).otherwise(0).cast("long").alias("side"), "cls", "n", "comp")
    made = cells.repartition(n, "shingle", "bi", "bj").sortWithinPartitions("shingle", "bi", "bj").mapInArrow(released(_product), "a long, b long, na long, nb long")
    left = lambda c: F.expr(f"(3 * {c} + 3) div 4 - 1")  # noqa: E731  what a set has beyond its prefix
    counts = made.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("_common"))
    # The overlap is at most what the prefixes share and what one of the sets has beyond its prefix.
    maybe = scratch.keep(counts.filter(7 * (F.col("_common") + F.greatest(left("na"), left("nb"))) >= 3 * (F.col("na") + F.col("nb"))).select("a", "b"), "jaccard-maybe")
    one = maybe.join(sets.select(F.col("cls").alias("a"), F.col("data").alias("one")), "a")
    return one.join(sets.select(F.col("cls").alias("b"), F.col("data").alias("two")), "b").select("a", "b", "one", "two").mapInArrow(released(_verify), "a long, b long")


def _common_links(sets: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links of different groups whose prefixes share a common shingle: products of blocks of rows."""
    many = scratch.entries.filter("common").select("shingle", "cls", "comp")
    rows = many.select("cls", "comp").distinct().join(sets.select("cls", F.col("keys")[0].alias("key")), "cls")
    placed = scratch.keep(dense_index(rows, ["key", "cls"], "_rank", scratch).select("cls", "comp", F.expr(f"_rank div {ROWS}").alias("block")), "jaccard-rows")
    touched = many.select("shingle", "cls").join(placed.select("cls", "block"), "cls").select("shingle", "block").distinct()
    meet = touched.select("shingle", F.col("block").alias("bi")).join(touched.select("shingle", F.col("block").alias("bj")), "shingle").filter("bi <= bj").select("bi", "bj").distinct()
    span = placed.groupBy("block").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
    for side in ("bi", "bj"):
        meet = meet.join(span.select(F.col("block").alias(side), F.col("_lo").alias(f"_lo{side}"), F.col("_hi").alias(f"_hi{side}")), side)
    meet = scratch.keep(meet.filter("least(_lobi, _lobj) <> greatest(_hibi, _hibj)").select("bi", "bj"), "jaccard-meet")
    full = placed.join(sets.select("cls", "data"), "cls")
    sides = meet.join(full, F.col("bi") == F.col("block")).select("bi", "bj", F.lit(0).alias("side"), "cls", "comp", "data").unionByName(meet.filter("bi < bj").join(full, F.col("bj") == F.col("block")).select("bi", "bj", F.lit(1).alias("side"), "cls", "comp", "data"))
    return sides.groupBy("bi", "bj").applyInArrow(_multiply, "a long, b long")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the smallest id that its links reach."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                             WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT l.b AS v, reach.c FROM reach JOIN l ON l.a = reach.v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.c) AS component_id
FROM w JOIN reach ON reach.v = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
GROUP BY w.doc_id, n.n
"""
