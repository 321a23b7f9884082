"""Communities that maximise the constant Potts model: w(c) - resolution * n_c (n_c - 1) / 2, summed over communities c.

For a positive resolution no best community spans two connected components, so components are partitioned side by side
by the Leiden scheme: nodes move, communities are refined, and what has joined becomes a node of a smaller graph.
Components that fit a task are its work, with a fixed order of nodes; the moves of larger ones are made in distributed
rounds, many at once, of which none can disturb another's gain.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .ordered import first_rows
from .scratch import Scratch, drop, keep

#: Edges of a component that one task takes at most; of larger ones, graphs and rounds of a phase at most, and moves to and from a community in a round.
TASK_EDGES, LEVELS, ROUNDS, AT_ONCE = 500_000, 20, 24, 64


def _move(adjacent: list[dict[int, float]], size: list[int], part: list[int], resolution: float, rng: random.Random, fixed: list[int] | None = None) -> bool:
    """Moves single nodes to the neighbouring (or a new) community of highest gain until none gains. fixed: nodes stay within their part of it, and only lone nodes move."""
    weight: dict[int, int] = {}
    for v, c in enumerate(part):
        weight[c] = weight.get(c, 0) + size[v]
    members: dict[int, int] = {}
    for c in part:
        members[c] = members.get(c, 0) + 1
    free = max(part, default=-1) + 1
    queue = list(range(len(part)))
    rng.shuffle(queue)
    waiting = set(queue)
    moved, at = False, 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting.discard(v)
        own = part[v]
        if fixed is not None and members[own] > 1:
            continue
        pull: dict[int, float] = {}
        for u, w in adjacent[v].items():
            if fixed is None or fixed[u] == fixed[v]:
                pull[part[u]] = pull.get(part[u], 0.0) + w
        stay = pull.get(own, 0.0) - resolution * size[v] * (weight[own] - size[v])
        best, target = stay, own
        for c, w in sorted(pull.items()):
            if c != own and (gain := w - resolution * size[v] * weight[c]) > best + 1e-12:
                best, target = gain, c
        if fixed is None and members[own] > 1 and best < -1e-12:
            target, free = free, free + 1
        if target != own:
            weight[own] -= size[v]
            members[own] -= 1
            weight[target] = weight.get(target, 0) + size[v]
            members[target] = members.get(target, 0) + 1
            part[v] = target
            moved = True
            for u in adjacent[v]:
                if part[u] != target and u not in waiting:
                    waiting.add(u)
                    queue.append(u)
    return moved


def _dense(part: list[int]) -> list[int]:
    names: dict[int, int] = {}
    return [names.setdefault(c, len(names)) for c in part]


def leiden(n: int, edges: list[tuple[int, int, float]], resolution: float, seed: int = 42) -> list[int]:
    """Communities of nodes 0 to n - 1, numbered by first node. Each is connected."""
    rng = random.Random(seed)
    adjacent: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            adjacent[a][b] = adjacent[a].get(b, 0.0) + w
            adjacent[b][a] = adjacent[b].get(a, 0.0) + w
    size, of, part = [1] * n, list(range(n)), list(range(n))
    while _move(adjacent, size, part, resolution, rng) or len(set(part)) < len(part):
        refined = list(range(len(part)))
        _move(adjacent, size, refined, resolution, rng, fixed=part)
        refined = _dense(refined)
        m = max(refined) + 1
        if m == len(part):
            break
        merged: list[dict[int, float]] = [{} for _ in range(m)]
        for v, near in enumerate(adjacent):
            for u, w in near.items():
                a, b = refined[v], refined[u]
                if a != b:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        sizes, parts = [0] * m, [0] * m
        for v, c in enumerate(refined):
            sizes[c] += size[v]
            parts[c] = part[v]
        of = [refined[c] for c in of]
        adjacent, size, part = merged, sizes, _dense(parts)
    return _connected(n, edges, _dense([part[c] for c in of]))


def _connected(n: int, edges: list[tuple[int, int, float]], part: list[int]) -> list[int]:
    """Splits communities that are not connected: splitting never lowers the model's quality."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b, _ in edges:
        if part[a] == part[b]:
            root[find(a)] = find(b)
    return _dense([find(v) for v in range(n)])


def quality(n: int, edges: list[tuple[int, int, float]], part: list[int], resolution: float) -> float:
    sizes: dict[int, int] = {}
    for c in part:
        sizes[c] = sizes.get(c, 0) + 1
    return sum(w for a, b, w in edges if part[a] == part[b]) - resolution * sum(s * (s - 1) / 2 for s in sizes.values())


def with_components(edges: DataFrame, nodes: DataFrame, key: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), each with its component, kept for repeated partitioning."""
    found = keep(components(edges, nodes, key), "components")
    return found, keep(edges.join(found.select(F.col(key).alias("src"), "component"), "src").select("component", "src", "dst", "weight"), "component-edges")


def partition(found: DataFrame, edges: DataFrame, resolution: float, key: str = "node_id", seed: int = 42, weight: str = "distance", most: int | None = None) -> DataFrame:
    """(key, cluster): the cluster is named by its smallest node. weight: `distance` takes weights as they are, `similarity` takes 1 less the weight.

    Components of TASK_EDGES edges and fewer are a task's work each, larger ones are partitioned together by distributed
    rounds, for which nodes are numbers from 0; `most` sets another limit, and 0 sends all to the rounds.
    """
    rows = edges.select("component", "src", "dst", F.col("weight").cast("double").alias("w"))
    if weight == "similarity":
        rows = rows.withColumn("w", 1 - F.col("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        names = sorted(set(pdf["src"]) | set(pdf["dst"]))
        at = {v: k for k, v in enumerate(names)}
        part = leiden(len(names), [(at[a], at[b], w) for a, b, w in zip(pdf["src"], pdf["dst"], pdf["w"], strict=True)], resolution, seed)
        least: dict = {}
        for v, c in zip(names, part, strict=True):
            least[c] = min(v, least.get(c, v))
        return pd.DataFrame({key: names, "cluster": [least[c] for c in part]})

    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > (TASK_EDGES if most is None else most)).select("component")
    kind = found.schema[key].dataType.simpleString()
    if large.limit(1).count():
        # At most one in TASK_EDGES edges is a row of the list.
        large = keep(large, "large-components")
        linked = rows.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, f"`{key}` {kind}, cluster {kind}")
        linked = linked.unionByName(moved_apart(rows.join(large, "component", "left_semi"), resolution).toDF(key, "cluster"))
    else:
        linked = rows.groupBy("component").applyInPandas(run, f"`{key}` {kind}, cluster {kind}")
    alone = found.join(linked.select(key), key, "left_anti").select(key, F.col(key).alias("cluster"))
    return linked.unionByName(alone)


def _proposals(both: DataFrame, labels: DataFrame, resolution: float, lone: bool) -> DataFrame:
    """(v, s, c, to, gain): the move of each node that gains most, to a community next to it or to one of its own, named -1 - v; nodes that gain nothing have none. lone: only nodes that are alone in their community move, and to others only."""
    mass = labels.groupBy("c").agg(F.sum("s").alias("_mass"))
    near = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("to")), "u").groupBy("v", "to").agg(F.sum("w").alias("_w"))
    zero = F.lit(0.0).alias("_w")
    ways = near.unionByName(labels.select("v", F.col("c").alias("to"), zero))
    if not lone:
        ways = ways.unionByName(labels.select("v", (-1 - F.col("v")).alias("to"), zero))
    ways = ways.groupBy("v", "to").agg(F.sum("_w").alias("_w")).join(labels, "v").join(mass.withColumnRenamed("c", "to"), "to", "left")
    stay = F.col("to") == F.col("c")
    worth = F.col("_w") - resolution * F.col("s") * (F.coalesce("_mass", F.lit(0)) - F.when(stay, F.col("s")).otherwise(0))
    ways = ways.select("v", "s", "c", "to", worth.alias("_worth"), stay.alias("_stay"), (stay & (F.col("_mass") > F.col("s"))).alias("_held"))
    best = ways.groupBy("v", "s", "c").agg(F.max(F.when(F.col("_stay"), F.col("_worth"))).alias("_now"), F.max("_held").alias("_held"), F.max(F.struct("_worth", (-F.col("to")).alias("_minus"))).alias("_best"))
    found = best.select("v", "s", "c", (-F.col("_best._minus")).alias("to"), (F.col("_best._worth") - F.col("_now")).alias("gain"), "_held").filter("gain > 1e-9 and to <> c")
    return (found.filter("not _held") if lone else found).drop("_held")


def _harmless(found: DataFrame, resolution: float) -> DataFrame:
    """(v, to) of the moves that can be made at once.

    Communities take two colours: one whose best leaver gains more than its best comer is left, the others are come to,
    and only moves from the first to the second colour go. What they disturb then is sizes alone: a comer finds those
    before it there, and a leaver leaves less behind. In order of gain, moves go as long as they gain after that, so
    each round raises the quality, and the best move of all is always among them.
    """
    rank = F.struct("gain", F.xxhash64("v").alias("_h"), F.col("v").alias("_v"))
    ends = found.select(F.col("c").alias("_k"), rank.alias("_out"), F.lit(None).cast("struct<gain:double,_h:bigint,_v:bigint>").alias("_in"))
    ends = ends.unionByName(found.select(F.col("to").alias("_k"), F.lit(None).cast("struct<gain:double,_h:bigint,_v:bigint>").alias("_out"), rank.alias("_in")))
    left = ends.groupBy("_k").agg(F.max("_out").alias("_out"), F.max("_in").alias("_in")).select("_k", (F.col("_out").isNotNull() & (F.col("_in").isNull() | (F.col("_out") > F.col("_in")))).alias("_left"))
    go = found.join(left.filter("_left").select(F.col("_k").alias("c")), "c", "left_semi").join(left.filter("not _left").select(F.col("_k").alias("to")), "to", "left_semi")
    for side in ("to", "c"):
        # A community gets and gives a few dozen a round; the limit cuts the others before they are shuffled.
        go = first_rows(go, [side], [F.desc("gain"), "v"], AT_ONCE)
        earlier = Window.partitionBy(side).orderBy(F.desc("gain"), "v").rowsBetween(Window.unboundedPreceding, -1)
        go = go.withColumn("gain", F.col("gain") - resolution * F.col("s") * F.coalesce(F.sum("s").over(earlier), F.lit(0))).filter("gain > 1e-9")
    return go.select("v", "to")


def _settled(both: DataFrame, labels: DataFrame, resolution: float, lone: bool, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(labels (v, s, c) after rounds of moves until none gains, or ROUNDS of them; whether any moved)."""
    for turn in range(ROUNDS):
        found = scratch.keep(_proposals(both, labels, resolution, lone), "proposals")
        if not found.limit(1).count():
            scratch.drop(found)
            return labels, turn > 0
        goes = _harmless(found, resolution)
        before, labels = labels, scratch.keep(labels.join(goes.withColumnRenamed("to", "_to"), "v", "left").select("v", "s", F.coalesce("_to", "c").alias("c")), "moved")
        scratch.drop(before, found)
    return labels, True


def moved_apart(edges: DataFrame, resolution: float) -> DataFrame:
    """(v, c): communities of the nodes of edges (src, dst, w), of components of any size.

    The Leiden scheme in rounds of joins and aggregations whose labels go to the shared folder: nodes move; within each
    community lone nodes join others (refinement); what has joined is a node of the next, smaller graph, whose edges and
    sizes are sums and whose nodes begin in the communities that were moved to. It ends when nothing joins, after
    LEVELS graphs at most of ROUNDS rounds at most for either phase. Communities that are not connected are split,
    which never lowers the quality.
    """
    with Scratch() as scratch:
        both = edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w").filter("v <> u")
        first = both = scratch.keep(both.unionByName(both.select(F.col("u").alias("v"), F.col("v").alias("u"), "w")).groupBy("v", "u").agg(F.sum("w").alias("w")), "both")
        labels = scratch.keep(both.select("v").distinct().select("v", F.lit(1).cast("long").alias("s"), F.col("v").alias("c")), "labels")
        of = scratch.keep(labels.select("v", F.col("v").alias("at")), "places")
        for _ in range(LEVELS):
            labels, _ = _settled(both, labels, resolution, False, scratch)
            ends = both.join(labels.select("v", F.col("c").alias("_a")), "v").join(labels.select(F.col("v").alias("u"), F.col("c").alias("_b")), "u")
            inside = scratch.keep(ends.filter("_a = _b").select("v", "u", "w"), "inside")
            refined, joined = _settled(inside, scratch.keep(labels.select("v", "s", F.col("v").alias("c")), "refined"), resolution, True, scratch)
            if not joined:
                break
            over = both.join(refined.select("v", F.col("c").alias("_a")), "v").join(refined.select(F.col("v").alias("u"), F.col("c").alias("_b")), "u").filter("_a <> _b")
            over = scratch.keep(over.groupBy(F.col("_a").alias("v"), F.col("_b").alias("u")).agg(F.sum("w").alias("w")), "over")
            # A joined node is named by a node in it, and so is a community after the joined node that is named least.
            named = labels.select("v", F.col("c").alias("_part")).join(refined, "v").groupBy(F.col("c").alias("v")).agg(F.sum("s").alias("s"), F.min("_part").alias("_part"))
            named = scratch.keep(named, "named")
            least = named.groupBy("_part").agg(F.min("v").alias("c"))
            after = scratch.keep(named.join(least, "_part").select("v", "s", "c"), "labels")
            places = scratch.keep(of.join(refined.select(F.col("v").alias("at"), F.col("c").alias("_to")), "at").select("v", F.col("_to").alias("at")), "places")
            scratch.drop(labels, refined, inside, named, of, *([both] if both is not first else []))
            both, labels, of = over, after, places
        part = scratch.keep(of.join(labels.select(F.col("v").alias("at"), "c"), "at").select("v", "c"), "found")
        ends = first.join(part.select("v", F.col("c").alias("_a")), "v").join(part.select(F.col("v").alias("u"), F.col("c").alias("_b")), "u")
        return components(ends.filter("_a = _b").select(F.col("v").alias("src"), F.col("u").alias("dst")), part.select(F.col("v").alias("node_id"))).select(F.col("node_id").alias("v"), F.col("component").alias("c"))


@dataclass(frozen=True)
class Rules:
    """How a search for a number of clusters goes: where it starts, its first step, when it ends and how steps change."""

    start: float = 0.02
    step: float = 0.01
    most_steps: int = 50
    close: int = 5  # a gap below this is good enough
    still: float = 1e-6  # a shorter move ends it
    patience: int = 3
    shortest: float = 1e-5
    boost: float = 1.1
    shrink: float = 0.95
    lowest: float = 0.0
    highest: float = 5.0


class Step(NamedTuple):
    """Where a search stands: the resolution to try, the length of the next move, the gap of the step before (None at first), steps in a row that did not narrow it."""

    resolution: float
    length: float
    gap: int | None = None
    stalls: int = 0


def advance(at: Step, clusters: int, target: int, rules: Rules) -> Step:
    """The step after one that gave so many clusters: up if there are too few, else down; after `patience` stalls once the other way, by a longer move."""
    gap = abs(clusters - target)
    stalls = at.stalls + 1 if at.gap is not None and gap >= at.gap else 0
    turn = stalls >= rules.patience
    length = at.length * (rules.boost if turn else 1.0)
    up = (clusters < target) != turn
    resolution = at.resolution + (length if up else -length)
    return Step(min(max(resolution, rules.lowest), rules.highest), max(length * rules.shrink, rules.shortest), gap, 0 if turn else stalls)


def adaptive_resolution(edges: DataFrame, nodes: DataFrame, target: int, key: str = "node_id", rules: Rules | None = None, seed: int = 42, weight: str = "distance", most: int | None = None) -> tuple[float, DataFrame, list[tuple[float, int]]]:
    """(best resolution, its partition, [(resolution, clusters) of each step]). The first of the steps nearest to the target counts; other partitions are removed as the search goes on."""
    rules = rules or Rules()
    found, kept = with_components(edges, nodes, key)

    def tried(resolution: float) -> tuple[DataFrame, int]:
        part = keep(partition(found, kept, resolution, key, seed, weight, most), "partition")
        return part, part.select("cluster").distinct().count()

    at, best, trail = Step(rules.start, rules.step), None, []
    while len(trail) < rules.most_steps:
        part, clusters = tried(at.resolution)
        trail.append((at.resolution, clusters))
        after = advance(at, clusters, target, rules)
        if best is None or after.gap < best[0]:
            best, part = (after.gap, at.resolution, part), best and best[2]
        if part is not None:
            drop(part)
        if after.gap < rules.close or abs(after.resolution - at.resolution) < rules.still:
            break
        at = after
    return best[1], best[2], trail
