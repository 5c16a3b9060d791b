"""Multi-objective selection (maximising): Pareto fronts, hypervolume, UCB, tree search.

Points with a null objective are left out. Equal points are all on the front. Two objectives are
worked out by one ordered pass over range partitions; more need the reference-free blocked test below.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import cut_lineage

#: Local fronts that may be gathered for the last comparison.
FRONT_BOUND = 50_000
#: Objectives and areas closer than this are equal.
TIE = 1e-9
#: Rules by which values go back to the root.
MODES = ("mean", "max", "max_hv")


def front_2d(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The non-dominated points of two objectives: sorted by x falling, y must exceed all before it.

    Each range partition keeps its own running maximum; the maxima of the partitions before it, one
    number each, decide the rest. No pair of points is ever compared.
    """
    p = points.select(key, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    parts = cut_lineage(p.repartitionByRange(F.desc(x)).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    tops = parts.groupBy("part").agg(F.max(y).alias("m")).select("part", F.max("m").over(before).alias("earlier"))
    parts = parts.join(F.broadcast(tops), "part")
    same = Window.partitionBy("part", x)
    top = parts.withColumn("peak", F.max(y).over(same)).filter(F.col(y) == F.col("peak"))
    lowest = F.lit(float("-inf"))
    seen = F.greatest(F.coalesce(F.max(y).over(_rows_above(x)), lowest), F.coalesce("earlier", lowest))
    one = top.groupBy("part", x).agg(F.max(y).alias(y), F.first("earlier").alias("earlier")).withColumn("seen", seen)
    good = one.filter(F.col(y) > F.col("seen")).select(F.col(x).alias("__x"), F.col(y).alias("__y"))
    return p.join(good, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y"))).select(key, x, y)


def _rows_above(x: str):
    return Window.partitionBy("part").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)


def hypervolume_2d(front: DataFrame, x: str, y: str, ref: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One row: the area that the points dominate above the reference point.

    The points are a front: x falls as y rises, so the next smaller x bounds each point's strip.
    """
    p = front.filter((F.col(x) > ref[0]) & (F.col(y) > ref[1])).groupBy(x).agg(F.max(y).alias(y))
    n = p.count()
    if n > FRONT_BOUND:
        raise ValueError(f"a front of {n} points; thin it out before its area is taken")
    w = Window.orderBy(F.desc(x))  # at most FRONT_BOUND rows, checked above
    s = p.withColumn("before", F.max(y).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gain = F.greatest(F.col(y) - F.coalesce(F.col("before"), F.lit(ref[1])), F.lit(0.0))
    return s.agg(F.round(F.coalesce(F.sum((F.col(x) - ref[0]) * gain), F.lit(0.0)), 6).alias("hypervolume"))


def front_of(points) -> list[int]:
    """Positions of the non-dominated points; equal points stay."""
    m = np.asarray(points, dtype=float)
    kept: list[int] = []
    for i in np.argsort(-m.sum(axis=1), kind="stable") if len(m) else []:  # what dominates a point has a larger sum
        k = m[kept]
        if not len(kept) or not ((k >= m[i]).all(axis=1) & (k > m[i]).any(axis=1)).any():
            kept.append(int(i))
    return sorted(kept)


def hypervolume(points: list[list[float]], ref: list[float], samples: int = 20_000, seed: int = 42) -> float:
    """Exact for up to two objectives, by seeded sampling for more; points not above the reference add nothing."""
    m = np.asarray([p for p in points if all(a > r for a, r in zip(p, ref, strict=True))], dtype=float)
    if not len(m):
        return 0.0
    r = np.asarray(ref, dtype=float)
    if len(m) == 1:
        return float(np.prod(m[0] - r))
    if m.shape[1] == 2:
        area, top = 0.0, r[1]
        for x, y in sorted(m.tolist(), key=lambda p: (-p[0], -p[1])):
            if y > top:
                area, top = area + (x - r[0]) * (y - top), y
        return float(area)
    hi = m.max(axis=0)
    u = np.random.default_rng(seed).uniform(r, hi, size=(samples, len(r)))
    hit = (u[:, None, :] <= m[None, :, :]).all(axis=2).any(axis=1)
    return float(np.prod(hi - r) * hit.mean())


def front_nd(points: DataFrame, key: str, objectives: list[str], bound: int = FRONT_BOUND) -> DataFrame:
    """The non-dominated points of any number of objectives: each task keeps its own front, and these are compared.

    More than ``bound`` points on the tasks' fronts are refused with ValueError, not thinned out.
    """
    p = points.select(key, *(F.col(c).cast("double").alias(c) for c in objectives)).dropna()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema)

    def own(batches):
        kept = None
        for pdf in batches:
            both = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            kept = both.iloc[front_of(both[objectives].to_numpy())]
        if kept is not None:
            yield kept

    local = cut_lineage(p.mapInPandas(own, schema))
    if local.count() > bound:
        raise ValueError(f"more than {bound} points on the fronts of the tasks")
    return local.coalesce(1).mapInPandas(own, schema)


def point_volume(v, ref) -> float:
    return float(np.prod([max(a - r, 0.0) for a, r in zip(v, ref, strict=True)]))


def contributions(points: list[list[float]], ref: list[float], seed: int = 42) -> list[float]:
    """What the whole loses without each point; points within TIE of each other count as one and share its loss.

    Exact for up to two objectives; for more by one seeded sample, 20,000 points for three and 10,000 for others.
    """
    m = np.asarray(points, dtype=float)
    if not len(m):
        return []
    group = np.empty(len(m), dtype=int)
    own: list[np.ndarray] = []
    for i in np.lexsort(m.T[::-1]):
        if not own or np.abs(own[-1] - m[i]).max() > TIE:
            own.append(m[i])
        group[i] = len(own) - 1
    d, r = np.array(own), np.asarray(ref, dtype=float)
    if d.shape[1] < 3:
        each = [x.tolist() for x in d]
        whole = hypervolume(each, list(ref))
        gain = np.array([max(0.0, whole - hypervolume(each[:i] + each[i + 1 :], list(ref))) for i in range(len(each))])
    else:
        gain = np.zeros(len(d))
        above = np.flatnonzero((d > r).all(axis=1))
        if len(above):
            n = 20_000 if d.shape[1] == 3 else 10_000
            hi = d[above].max(axis=0)
            hits = (np.random.default_rng(seed).uniform(r, hi, size=(n, len(r)))[:, None, :] <= d[above][None, :, :]).all(axis=2)
            gain[above] = np.prod(hi - r) * hits[hits.sum(axis=1) == 1].sum(axis=0) / n
    return gain[group].tolist()


def ucb(mean: list[float], visits: int, parent_visits: int, c: float) -> list[float]:
    if visits == 0:
        return [math.inf] * len(mean)
    return [m + c * math.sqrt(math.log(max(parent_visits, 1)) / visits) for m in mean]


def branching(visits: int, least: int = 2, most: int = 8) -> int:
    return max(least, min(most, int(math.log2(max(visits, 1)) + 2)))


# ---- trees as tables ------------------------------------------------------------------------------


def node_values(nodes: DataFrame, evaluations: DataFrame, objectives: list[str], mode: str = "mean", ref: tuple[float, ...] = ()) -> DataFrame:
    """(node_id, visits, objectives...): what back-propagation leaves at each node of a tree, from all evaluations at once.

    nodes (node_id, path): the ids from the root to the node, both included; evaluations (node_id, seq, objectives...).
    An evaluation counts for its node and all above it: their mean, the largest of each objective ("max"), or the one
    vector of the largest volume above ``ref``, then the largest first objective, then the earliest ("max_hv").
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    each = evaluations.join(nodes.select("node_id", "path"), "node_id").select(F.explode("path").alias("node_id"), "seq", *objectives)
    n = F.count(F.lit(1)).alias("visits")
    if mode != "max_hv":
        f = F.avg if mode == "mean" else F.max
        return each.groupBy("node_id").agg(n, *(f(c).alias(c) for c in objectives))
    best = each.groupBy("node_id").agg(n, F.max_by(F.struct(*objectives), _quality(objectives, ref)).alias("v"))
    return best.select("node_id", "visits", *(F.col(f"v.{c}").alias(c) for c in objectives))


def _quality(objectives: list[str], ref: tuple[float, ...]) -> Column:
    volume = F.lit(1.0)
    for c, r in zip(objectives, ref or (0.0,) * len(objectives), strict=True):
        volume = volume * F.greatest(F.col(c) - F.lit(r), F.lit(0.0))
    return F.struct(volume.alias("hv"), F.col(objectives[0]).alias("first"), (-F.col("seq")).alias("seq"))


def own_objectives(nodes: DataFrame, evaluations: DataFrame, objectives: list[str], ref: tuple[float, ...] = ()) -> DataFrame:
    """(node_id, objectives...): each node's best own evaluation of the features that it has now; others do not count.

    nodes (node_id, features), evaluations (node_id, seq, features, objectives...); null features of an evaluation
    count as unchanged; vectors with a null, NaN or infinite objective are left out.
    """
    now = nodes.select("node_id", F.col("features").alias("now"))
    good = F.lit(True)
    for c in objectives:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    same = evaluations.join(now, "node_id").filter(good & (F.col("features").isNull() | (F.col("features") == F.col("now"))))
    best = same.groupBy("node_id").agg(F.max_by(F.struct(*objectives), _quality(objectives, ref)).alias("v"))
    return best.select("node_id", *(F.col(f"v.{c}").alias(c) for c in objectives))


def best_node(candidates: DataFrame, x: str, y: str, ref: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One row (node_id, x, y, contribution): of the front the node whose point alone dominates the largest area.

    candidates (node_id, n_features, created, x, y). Points within TIE of each other are one; areas within TIE of
    the largest tie, and ties go to fewer features, then to the earlier node.
    """
    c = candidates.select("node_id", "n_features", "created", x, y)
    front = cut_lineage(front_2d(c, "node_id", x, y))
    if front.count() > FRONT_BOUND:
        raise ValueError(f"a front of more than {FRONT_BOUND} points")
    w = Window.orderBy(F.desc(x), F.desc(y))  # at most FRONT_BOUND rows, checked above
    apart = (F.lag(x).over(w) - F.col(x) > TIE) | (F.col(y) - F.lag(y).over(w) > TIE)
    numbered = front.withColumn("point", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(w))
    points = numbered.groupBy("point").agg(F.max(x).alias("px"), F.max(y).alias("py"))
    o = Window.orderBy("point")
    left = F.greatest(F.coalesce(F.lead("px").over(o), F.lit(ref[0])), F.lit(ref[0]))
    below = F.greatest(F.coalesce(F.lag("py").over(o), F.lit(ref[1])), F.lit(ref[1]))
    gain = F.greatest(F.col("px") - left, F.lit(0.0)) * F.greatest(F.col("py") - below, F.lit(0.0))
    judged = numbered.join(points.select("point", gain.alias("contribution")), "point").join(c.select("node_id", "n_features", "created"), "node_id")
    top = judged.agg(F.max("contribution")).first()[0]
    tied = judged.filter(F.col("contribution") >= F.lit(top) - TIE) if top is not None else judged
    return tied.orderBy("n_features", "created").limit(1).select("node_id", x, y, "contribution")


def children_of(nodes: DataFrame, key: str, suggestions: str, most: int = 5) -> DataFrame:
    """(key, child, label): one child per suggestion, at most ``most``; labels show the first 80 characters."""
    s = nodes.select(key, F.posexplode(F.slice(suggestions, 1, most)).alias("child", "s"))
    return s.select(key, "child", F.concat(F.lit("suggestion_"), F.col("child").cast("string"), F.lit(": "), F.left("s", F.lit(80))).alias("label"))


def is_exhausted(index: Column, suggestions: Column) -> Column:
    """Whether a suggestion index points past the end of a list; an empty or missing list is never used up."""
    return (F.coalesce(F.size(suggestions), F.lit(0)) > 0) & (index >= F.size(suggestions))


def node_key(rollout: int, lineage: list[int], parent: str, features: list[str]) -> str:
    """A node's key from where it stands, what its parent was and what it holds; the order of features does not matter."""
    text = "|".join([str(rollout), ",".join(map(str, lineage)), parent, ",".join(sorted(features))])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def node_keys(rollout: Column, lineage: Column, parent: Column, features: Column) -> Column:
    """``node_key`` of columns."""
    text = F.concat_ws("|", rollout.cast("string"), F.array_join(F.transform(lineage, lambda x: x.cast("string")), ","), parent, F.array_join(F.array_sort(features), ","))
    return F.substring(F.sha2(text, 256), 1, 16)


# ---- the search itself ----------------------------------------------------------------------------


@dataclass
class Node:
    features: tuple[str, ...]
    parent: Node | None = None
    index: int = 0
    label: str = ""
    children: list[Node] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)
    history: list[tuple[tuple[str, ...], list[float]]] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    visits: int = 0
    key: str = ""

    @property
    def own(self) -> list[float]:
        return self.history[-1][1] if self.history else []

    def lineage(self) -> list[int]:
        out, n = [], self
        while n.parent:
            out.append(next(i for i, x in enumerate(n.parent.children) if x is n))
            n = n.parent
        return out[::-1]


#: evaluate(features of the parent, suggestion or None) -> (objectives, suggestions, features now).
Evaluate = Callable[[tuple[str, ...], "str | None"], tuple[list[float], list[str], tuple[str, ...]]]


class TreeSearch:
    """A search over feature sets that grows a tree by evaluated suggestions, and can go on from its saved state.

    Each rollout selects a leaf (unvisited children first, at random, then the child of the UCB front whose point
    alone dominates most), expands it and evaluates one child, or, if ``deep``, a path down to ``max_depth``. A child
    whose suggestion is no longer in its parent's list is passed over. Values go back to the root by ``mode``, see
    ``node_values``; the answer is judged by each node's own evaluations. An evaluation is known by its node's key
    and not repeated, neither in a run nor after a resume; rollouts draw from a generator seeded by their number.
    """

    def __init__(self, evaluate: Evaluate, start: tuple[str, ...] = (), objectives: int = 2, ref: tuple[float, ...] = (0.5, 0.0), c: float = 0.5,
                 mode: str = "mean", deep: bool = False, max_depth: int = 5, branch: int | None = None, seed: int = 42):
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        self.evaluate, self.n, self.ref, self.c, self.mode = evaluate, objectives, ref[:objectives], c, mode
        self.deep, self.max_depth, self.branch, self.seed = deep, max_depth, branch, seed
        self.root = Node(tuple(start))
        self.nodes = [self.root]
        self.known: dict[str, tuple[list[float], list[str], list[str]]] = {}
        self.rollouts = 0

    def _quality(self, v: list[float]) -> tuple[float, float]:
        return point_volume(v, self.ref), v[0]

    def exhausted(self, node: Node) -> bool:
        s = node.parent.suggestions if node.parent else []
        return bool(s) and node.index >= len(s)

    def _visit(self, node: Node, rollout: int) -> list[float] | None:
        if self.exhausted(node):
            return None
        up = node.parent
        suggestion = up.suggestions[node.index] if up and up.suggestions else None
        before = up.features if up else node.features
        node.key = node_key(rollout, node.lineage(), up.key if up else "no-parent", list(before))
        if node.key not in self.known:
            got, more, now = self.evaluate(before, suggestion)
            self.known[node.key] = (list(got), list(more), list(now))
        got, more, now = self.known[node.key]
        vector = [float(x) for x in (*got, *[0.0] * self.n)][: self.n]
        node.features, node.suggestions = tuple(now), list(more)
        node.history.append((node.features, vector))
        at: Node | None = node
        while at:
            if not at.visits:
                at.value = list(vector)
            elif self.mode == "mean":
                at.value = [(a * at.visits + b) / (at.visits + 1) for a, b in zip(at.value, vector, strict=True)]
            elif self.mode == "max":
                at.value = [max(a, b) for a, b in zip(at.value, vector, strict=True)]
            elif self._quality(vector) > self._quality(at.value):
                at.value = list(vector)
            at.visits += 1
            at = at.parent
        return vector

    def _choose(self, node: Node, rng: random.Random) -> Node:
        fresh = [x for x in node.children if not x.visits]
        if fresh:
            return rng.choice(fresh)
        scores = [ucb(x.value, x.visits, node.visits, self.c) for x in node.children]
        front = front_of(scores)
        gain = contributions([scores[i] for i in front], [0.0] * self.n)
        best = max(range(len(front)), key=lambda i: gain[i])
        return node.children[front[best]] if gain[best] > 0 else rng.choice(node.children)

    def _expand(self, node: Node) -> None:
        most = self.branch or branching(node.visits)
        for i, s in enumerate(node.suggestions[:most]):
            child = Node(node.features, node, i, f"suggestion_{i}: {s[:80]}")
            node.children.append(child)
            self.nodes.append(child)

    def _depth(self, node: Node) -> int:
        return len(node.lineage())

    def _rollout(self, number: int) -> None:
        rng = random.Random(f"{self.seed}-{number}")
        node, depth = self.root, 0
        while node.children and depth < self.max_depth:
            node, depth = self._choose(node, rng), depth + 1
        if node.visits and not node.children and depth < self.max_depth:
            self._expand(node)
            open_ = [x for x in node.children if not self.exhausted(x)]
            node = rng.choice(open_) if open_ else node
        vector = self._visit(node, number)
        depth = self._depth(node)
        while self.deep and depth < self.max_depth and (vector is not None or node.visits):
            if not node.children:
                self._expand(node)
            open_ = [x for x in node.children if not self.exhausted(x)]
            if not open_:
                return
            node = rng.choice([x for x in open_ if not x.visits] or open_)
            vector, depth = self._visit(node, number), depth + 1

    def run(self, rollouts: int, save: Callable[[str], None] | None = None) -> Node:
        """Goes on until so many rollouts are done in all; ``save`` gets the state after each."""
        if not self.root.visits:
            self._visit(self.root, 0)
        while self.rollouts < rollouts:
            self._rollout(self.rollouts)
            self.rollouts += 1
            if save:
                save(self.state())
        return self.best()

    def best_own(self, node: Node) -> list[float] | None:
        """The node's best evaluation of the features that it has now."""
        good = [v for f, v in node.history if f == node.features and np.isfinite(v).all()]
        return max(good, key=self._quality) if good else None

    def best(self) -> Node:
        scored = [(n, v) for n in self.nodes if (v := self.best_own(n)) is not None]
        if not scored:
            return self.root
        front = front_of([v for _, v in scored]) if self.n > 1 else range(len(scored))
        gain = contributions([scored[i][1] for i in front], list(self.ref)) if self.n > 1 else [v[0] for _, v in scored]
        top = max(gain)
        tied = [i for i, g in zip(front, gain, strict=True) if g >= top - TIE]
        return scored[min(tied, key=lambda i: (len(scored[i][0].features), i))][0]

    def state(self) -> str:
        """All that a resume needs, as JSON."""
        at = {id(n): i for i, n in enumerate(self.nodes)}
        nodes = [
            [list(n.features), at[id(n.parent)] if n.parent else None, n.index, n.label, n.suggestions, [[list(f), v] for f, v in n.history], n.value, n.visits, n.key]
            for n in self.nodes
        ]
        return json.dumps({"rollouts": self.rollouts, "known": self.known, "nodes": nodes})

    def resume(self, state: str) -> TreeSearch:
        got = json.loads(state)
        self.rollouts = got["rollouts"]
        self.known = {k: tuple(v) for k, v in got["known"].items()}
        self.nodes = []
        for f, up, index, label, more, history, value, visits, key in got["nodes"]:
            parent = self.nodes[up] if up is not None else None
            n = Node(tuple(f), parent, index, label, [], more, [(tuple(a), b) for a, b in history], value, visits, key)
            self.nodes.append(n)
            if parent:
                parent.children.append(n)
        self.root = self.nodes[0]
        return self


def tree_search(start: tuple[str, ...], evaluate: Callable[[tuple[str, ...]], tuple[list[float], list[str]]], rollouts: int, **options) -> Node:
    """The best node of a search in which each suggestion names a feature to add; each distinct set is evaluated once."""
    sets: dict[tuple[str, ...], tuple[list[float], list[str]]] = {}

    def step(features: tuple[str, ...], suggestion: str | None):
        now = tuple(sorted({*features, suggestion})) if suggestion else tuple(features)
        if now not in sets:
            sets[now] = evaluate(now)
        return (*sets[now], now)

    return TreeSearch(step, tuple(start), **options).run(rollouts)
