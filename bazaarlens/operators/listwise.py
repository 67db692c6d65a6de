"""Grouped learning to rank: boosted trees on the pairs inside each user's list.

Every round asks, for each pair of a user's rows with unequal labels, how much NDCG@k would change if
they swapped, and pushes the two apart by that much (lambda gradients). A weighted regression tree is
fitted to the Newton target gradient / weight; its leaf values come from one aggregation by leaf.

The training table is written once, bucketed by user, so no round shuffles rows to form lists. Lists are
whole: a swap behind place k changes nothing, so each row only meets the k best of its list, and rows go
by in the order of their scores while those k are held. Users whose labels are all equal have no pairs
and leave the table before training. Trees are column expressions: scoring stays in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import as_col
from bazaarlens.operators.core import top_n
from bazaarlens.operators.rank import clean_features
from bazaarlens.session import bucketed, durable
from bazaarlens.sources.star import hash_split


class Node(NamedTuple):
    """A split (feature <= threshold goes left) or, without a feature, a leaf."""

    feature: int | None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1


class Tree(NamedTuple):
    root: Node
    values: Mapping[int, float]
    gains: Sequence[float]


class ListwiseModel(NamedTuple):
    """Trees in the order of their rounds; ``history`` holds (rounds, NDCG of the held-out users)."""

    trees: Sequence[Tree]
    step: float
    features: Sequence[str]
    history: Sequence[tuple[int, float]]

    def importance(self) -> dict[str, float]:
        sums = [sum(t.gains[i] for t in self.trees) for i in range(len(self.features))]
        return {f: s / (sum(sums) or 1.0) for f, s in zip(self.features, sums)}


def _read_tree(model) -> Node:
    """The splits of a fitted regression tree, leaves numbered from the left."""
    leaves = 0

    def walk(node) -> Node:
        nonlocal leaves
        if node.getClass().getSimpleName() == "LeafNode":
            leaves += 1
            return Node(None, leaf=leaves - 1)
        split = node.split()
        return Node(split.featureIndex(), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild()))

    return walk(model._call_java("rootNode"))


def leaf_of(x: str, node: Node, values: Mapping[int, float] | None = None) -> Column:
    """The leaf that the array column ``x`` of features falls into, or the leaf's value."""
    if node.feature is None:
        return F.lit(node.leaf) if values is None else F.lit(float(values.get(node.leaf, 0.0)))
    return F.when(F.get(x, node.feature) <= node.threshold, leaf_of(x, node.left, values)).otherwise(leaf_of(x, node.right, values))


def _sum_of(trees: Sequence[Tree], step: float) -> Column:
    return sum((leaf_of("x", t.root, t.values) * step for t in trees), F.lit(0.0))


def _moved(nth, labels, scores, ideal, k: int, done: int = 0):
    """(g, h): sums of pair gradients and of their weights, for rows in the order of their list and of ``nth``, their place in it.

    A swap of two rows changes NDCG@k by the difference of their gains times that of their discounts, and
    places behind k have discount 0. So a row forms its pairs with the first k of the rows before it, and those
    are all pairs that count. The first ``done`` rows have formed theirs already; ``ideal`` is the DCG of the list's best order.
    """
    import numpy as np

    n, heads = len(nth), nth == 1
    first = np.flatnonzero(heads)[np.cumsum(heads) - 1]
    discount = np.where(nth <= k, 1.0 / np.log2(nth + 1.0), 0.0)
    gain = np.exp2(labels) - 1.0
    g, h = np.zeros(n), np.zeros(n)
    for place in range(1, min(k, int(nth.max(initial=0)) - 1) + 1):
        row = np.flatnonzero((nth > place) & (ideal > 0) & (np.arange(n) >= done))
        top = first[row] + place - 1
        row, top = (x[labels[row] != labels[top]] for x in (row, top))
        rises = np.where(labels[row] > labels[top], 1.0, -1.0)
        change = np.abs((gain[row] - gain[top]) * (discount[row] - discount[top])) / ideal[row]
        miss = 1.0 / (1.0 + np.exp(np.clip(rises * (scores[row] - scores[top]), -60, 60)))
        push, weight = rises * miss * change, miss * (1.0 - miss) * change
        g[row] += push  # a row meets one other at each place
        h[row] += weight
        g -= np.bincount(top, push, n)
        h += np.bincount(top, weight, n)
    return g, h


def gradients_of_lists(heads, labels, scores, k: int):
    """(g, h) of the rows of many lists. A list starts where ``heads`` is true; its rows stand in the order that breaks ties of the score."""
    import numpy as np

    of = np.cumsum(heads) - 1
    rank = np.arange(len(of)) - np.flatnonzero(heads)[of]
    gain = np.exp2(labels) - 1.0
    ideal = np.bincount(of, np.where(rank < k, gain[np.lexsort((-gain, of))] / np.log2(rank + 2.0), 0.0))
    order = np.lexsort((-scores, of))  # lists are contiguous, so the i-th row of a sorted list has the rank of its i-th row
    g, h = np.zeros(len(of)), np.zeros(len(of))
    g[order], h[order] = _moved(rank + 1, labels[order], scores[order], ideal[of], k)
    return g, h


def pair_gradients(labels, scores, k: int):
    """``gradients_of_lists`` for one list."""
    import numpy as np

    return gradients_of_lists(np.arange(len(labels)) == 0, labels, scores, k)


def _gradients(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(table, g, h, rows):
            rows = rows[h[rows] > 0]
            return pa.RecordBatch.from_arrays([table.column("x").take(pa.array(rows)).combine_chunks(), pa.array(g[rows]), pa.array(h[rows])], ["x", "g", "h"])

        best = sums = None  # the first k rows of the last list, which may go on in the next batch, and their sums so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table, done = pa.Table.from_batches([batch]), 0
            if best is not None:
                table, done = pa.concat_tables([best, table]), best.num_rows
            nth, label, score, ideal = (table.column(c).to_numpy() for c in ("nth", "label", "score", "ideal"))
            g, h = _moved(nth, label, score, ideal, k, done)
            if done:
                g[:done] += sums[0]
                h[:done] += sums[1]
            last = int(np.flatnonzero(nth == 1)[-1])
            kept = np.arange(last, min(last + k, len(nth)))
            best, sums = table.take(pa.array(kept)), (g[kept], h[kept])
            yield out(table, g, h, np.setdiff1d(np.arange(len(nth)), kept, assume_unique=True))
        if best is not None:
            yield out(best, *sums, np.arange(best.num_rows))

    return run


def list_gradients(rows: DataFrame, k: int) -> DataFrame:
    """(x, g, h): the rows of (user_id, place, label, score, x) that some pair moves.

    Windows number each user's rows where they lie, so lists come to Python in the order of their scores, many in one
    call; a long one spans many, and no more than a batch and its best k rows are held.
    """
    from pyspark.sql import Window as W

    user = W.partitionBy("user_id")
    worth = F.when(F.col("best") <= k, (F.pow(F.lit(2.0), F.col("label")) - 1.0) / F.log2(F.col("best") + 1.0)).otherwise(0.0)
    ideal = rows.select("user_id", "place", "label", "score", "x", F.row_number().over(user.orderBy(F.desc("label"), "place")).alias("best")).withColumn("ideal", F.sum(worth).over(user))
    nth = F.row_number().over(user.orderBy(F.desc("score"), "place")).alias("nth")
    return ideal.select("label", "score", "x", "ideal", nth).mapInArrow(_gradients(k), "x array<double>, g double, h double")


def fit_tree(gradients: DataFrame, depth: int, least_rows: int, l2: float, seed: int) -> Tree:
    """A regression tree on g / h weighted by h, with leaf values sum(g) / (sum(h) + l2)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = gradients.select(array_to_vector("x").alias("features"), (F.col("g") / F.col("h")).alias("target"), "h")
    fitted = DecisionTreeRegressor(labelCol="target", weightCol="h", maxDepth=depth, minInstancesPerNode=least_rows, maxBins=64, seed=seed).fit(rows)
    root = _read_tree(fitted)
    sums = gradients.groupBy(leaf_of("x", root).alias("leaf")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))  # at most 2 ** depth rows
    return Tree(root, {r.leaf: r.g / (r.h + l2) for r in sums.collect()}, fitted.featureImportances.toArray().tolist())


def list_ndcg(rows: DataFrame, k: int) -> float:
    """Mean NDCG@k of the lists (user_id, place, label, score), in Spark SQL."""
    from pyspark.sql import Window as W

    gain = F.pow(F.lit(2.0), F.col("label")) - 1.0
    at = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), F.asc("place")))
    best = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("label"), F.asc("place")))
    part = lambda place: F.when(F.col(place) <= k, gain * F.lit(math.log(2.0)) / F.ln(F.col(place) + 1.0)).otherwise(0.0)
    users = rows.select("user_id", "place", "label", "score").withColumns({"at": at, "best": best}).groupBy("user_id").agg(F.sum(part("at")).alias("dcg"), F.sum(part("best")).alias("ideal"))
    return users.agg(F.avg(F.col("dcg") / F.col("ideal"))).first()[0] or 0.0


def training_lists(rows: DataFrame, features: Sequence[str], label: str = "label", cap: int | None = None, order: Sequence[Column] | None = None) -> DataFrame:
    """(user_id, place, label, x, score): all rows of each user whose labels differ, or the first ``cap`` where a caller asks for them.

    ``order`` breaks ties of scores; the item's id by default.
    """
    from pyspark.sql import Window as W

    ties, clean = [*(order or []), F.asc("item_id")], clean_features(rows, features)
    lists = clean.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(*ties))) if cap is None else top_n(clean, ["user_id"], ties, cap, "place")
    values = F.array(*[as_col(f) for f in features])
    table = lists.select("user_id", "place", F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("label"), values.alias("x"), F.lit(0.0).alias("score"))
    mixed = table.groupBy("user_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("hi > lo").select("user_id")
    return table.join(mixed, "user_id", "left_semi")


def boost(
    table: DataFrame, features: Sequence[str], k: int = 10, rounds: int = 50, depth: int = 4, step: float = 0.1, l2: float = 1.0, least_rows: int = 1,
    patience: int | None = 3, every: int = 5, seed: int = 42, start: ListwiseModel | None = None,
) -> ListwiseModel:
    """Boosting on lists (``training_lists`` with ``is_train``, in buckets of users), up to ``rounds`` trees in all.

    Scores enter the written table every ``every`` rounds, so no plan carries more than that many
    trees, and the held-out users' NDCG@k is measured then. With ``patience`` training stops after so
    many measurements without a new best, and the rounds up to the best stay. ``start`` is continued from its trees.
    """
    trees: list[Tree] = list(start.trees) if start else []
    history: list[tuple[int, float]] = list(start.history) if start else []
    fresh: list[Tree] = list(trees)
    best, top = list(trees), max((x for _, x in history), default=-1.0)
    while len(trees) < rounds:
        if len(fresh) >= every:  # also the trees of the start
            table, fresh = _with_trees(table, fresh, step, every), []
        scored = table.withColumn("score", F.col("score") + _sum_of(fresh, step)) if fresh else table
        gradients = durable(list_gradients(scored.filter("is_train = 1"), k), "gradients")
        if gradients.isEmpty():
            break
        fresh.append(fit_tree(gradients, depth, least_rows, l2, seed))
        trees.append(fresh[-1])
        if len(trees) % every and len(trees) < rounds:
            continue
        table, fresh = _with_trees(table, fresh, step, every), []
        history.append((len(trees), list_ndcg(table.filter("is_train = 0"), k)))
        if patience is None or history[-1][1] >= top:
            best, top = list(trees), max(top, history[-1][1])
        elif sum(1 for n, _ in history if n > len(best)) >= patience:
            break
    return ListwiseModel(best, step, tuple(features), tuple(history))


def _with_trees(table: DataFrame, trees: Sequence[Tree], step: float, group: int) -> DataFrame:
    """The lists with the trees in their scores, written again in the same buckets."""
    for i in range(0, len(trees), group):
        table = bucketed(table.withColumn("score", F.col("score") + _sum_of(trees[i : i + group], step)), "lists", "user_id", dealt=True)
    return table


def train_listwise(
    rows: DataFrame, features: Sequence[str], label: str = "label", order: Sequence[Column] | None = None, **options
) -> ListwiseModel:
    """Listwise boosting on an 80/20 user split; see ``training_lists`` and ``boost`` for the options."""
    return boost(bucketed(hash_split(training_lists(rows, features, label, order=order), "user_id"), "lists", "user_id"), features, **options)


class Trial(NamedTuple):
    """A parameter set of a search: its model so far and the NDCG@k of the held-out users."""

    number: int
    params: Mapping
    model: ListwiseModel
    ndcg: float


def search_listwise(
    rows: DataFrame, features: Sequence[str], grid: Sequence[Mapping], rungs: Sequence[int] = (5, 15, 45), keep: int = 3, label: str = "label", k: int = 10,
) -> list[Trial]:
    """Successive halving: all parameter sets get the first few rounds, the best ``1 / keep`` of them go on from their trees.

    Returns one trial per set, the winner first: those that came furthest, then the better. Ties go to the earlier set.
    """
    table = bucketed(hash_split(training_lists(rows, features, label), "user_id"), "lists", "user_id")
    alive = [Trial(i, p, ListwiseModel([], p.get("step", 0.1), tuple(features), ()), 0.0) for i, p in enumerate(grid)]
    done: list[Trial] = []
    for number, rung in enumerate(rungs):
        models = [boost(table, features, k=k, rounds=rung, patience=None, start=t.model, **t.params) for t in alive]
        alive = sorted((Trial(t.number, t.params, m, m.history[-1][1] if m.history else 0.0) for t, m in zip(alive, models)), key=lambda t: (-t.ndcg, t.number))
        going = math.ceil(len(alive) / keep) if number + 1 < len(rungs) else len(alive)
        done = alive[going:] + done
        alive = alive[:going]
    return alive + done


def score_listwise(rows: DataFrame, model: ListwiseModel, out: str = "score", group: int = 10) -> DataFrame:
    """Rows with the model's score; trees are added up in groups, so no expression holds them all."""
    scored = clean_features(rows, model.features).withColumns({"x": F.array(*[as_col(f) for f in model.features]), out: F.lit(0.0)})
    for i in range(0, len(model.trees), group):
        scored = scored.withColumn(out, F.col(out) + _sum_of(model.trees[i : i + group], model.step))
    return scored.drop("x")


def listwise_top_k(rows: DataFrame, model: ListwiseModel, k: int = 30, tiebreak: str | None = None) -> DataFrame:
    order = [F.desc("score")] + ([F.desc(tiebreak)] if tiebreak else []) + [F.asc("item_id")]
    return top_n(score_listwise(rows, model), ["user_id"], order, k)
