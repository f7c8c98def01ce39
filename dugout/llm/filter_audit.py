"""How filters interact: decision diagrams over the sets of filters that documents fail.

Every document becomes a mask of the filters it fails. Masks are counted per part, so whatever
the size of the corpus a part has at most one row per mask and label. A part's counts make a
decision diagram: level k tests the k-th filter, a document goes on along its pass or its fail
branch, and a node weighs the documents below it. Two neighbouring levels can be swapped in place;
swaps lead from one order of the filters to the next, through all orders. In each order the path
that passes every filter shows the steps: the fail branch at level k weighs what step k removes.

Defined results: a null text counts as empty, a null part as the empty string. A row with a null
id is never a later copy and makes no other row one; rows that repeat id and text are not copies
of each other. A document is good (toxic) if any row of the labels with its id says so; ids without a label
are neither. Texts are read whole. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.common import quoted
from dugout.sources.shared import materialize

_WEIGHTS = ("n", "good", "toxic")
_STEP = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)
_SPACES = "[\\x20\\x09-\\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D on a text that is not null."""
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 100,
        "B": 100 * distinct.cast("long") < 80 * n.cast("long"),
        "C": 100 * upper.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    failures: Callable[[Column], dict[str, Column]] = text_failures, copies: bool = True,
) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail exactly the filters of ``mask``.

    Bit k of the mask is the k-th filter of ``failures``; with ``copies`` one bit more is set where a
    smaller id has the same text. Only ids, digests and masks are shuffled, never a text. Copies
    meet after map-side sums per text, part and label, so a group that holds a third of the table
    is a few rows there.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    source = docs.select(
        quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("text"))
    tests = list(failures(F.col("text")).values())
    mask = sum((F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)), F.lit(0))
    rows = source.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    is_one = lambda c: F.coalesce(F.max((quoted(c) == 1).cast("int")), F.lit(0)).cast("long")
    marks = labels.groupBy(quoted(id_col).cast("long").alias("id")).agg(
        is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    # Rows without an id match no label; numbered, so that the join does not gather them under one key.
    spread = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.col("id") % 1)
    rows = rows.withColumn("spread", spread).join(marks.withColumn("spread", F.col("id") % 1), ["id", "spread"], "left")
    zero = F.lit(0).cast("long")
    rows = rows.select(
        "id", "part", "mask", "digest", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    if copies:
        rows = _mark_copies(rows, 1 << len(tests))
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"),
        F.sum(F.col("toxic") * F.col("n")).alias("toxic"))


def _mark_copies(rows: DataFrame, bit: int) -> DataFrame:
    """The rows counted, with ``bit`` added to the mask of those whose text a smaller id has too."""
    alike = ["digest", "part", "mask", "good", "toxic"]
    # Rows of one id and text first, so that the smallest id of a group carries the number of its rows.
    same = rows.groupBy(*alike, "id").agg(F.count("*").alias("n"))
    groups = materialize(same.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("unnamed"),
    ), "text_groups")
    least = groups.groupBy("digest").agg(F.min("first.id").alias("least"))
    joined = groups.join(least, "digest")
    stays = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = joined.select("part", "mask", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("extra"), stays.alias("n")),
        F.struct(F.lit(bit).alias("extra"), (F.col("n") - stays).alias("n")),
    )).alias("x"))
    return split.where("x.n > 0").select(
        "part", (F.col("mask") + F.col("x.extra")).cast("int").alias("mask"), "good", "toxic", F.col("x.n").alias("n"))


class Diagram:
    """Reduced decision diagram of weighted failure masks, in an order of variables that can change.

    A node is (level, pass child, fail child); equal nodes exist once. The leaves are weight vectors.
    A path that skips no level leads from the root to a leaf, so that a node's weight is the sum
    of its children's.
    """

    def __init__(self, weights: dict[int, tuple], n: int):
        self.n, self.order = n, list(range(n))
        self.zero = (0,) * len(next(iter(weights.values()), _WEIGHTS))
        self.unique: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        self.root = self._build(weights)

    def _node(self, *key) -> int:
        if key not in self.unique:
            self.unique[key] = len(self.nodes)
            self.nodes.append(key)
        return self.unique[key]

    def _build(self, weights: dict[int, tuple]) -> int:
        nodes = {m: self._node("leaf", tuple(weights.get(m, self.zero))) for m in range(1 << self.n)}
        for level in range(self.n - 1, -1, -1):  # a mask of the filters above this level leads to each node
            bit = 1 << level
            nodes = {m: self._node(level, nodes[m], nodes[m | bit]) for m in range(bit)}
        return nodes[0]

    def weight(self, node: int, memo: dict[int, tuple]) -> tuple:
        if node not in memo:
            kind, *rest = self.nodes[node]
            memo[node] = rest[0] if kind == "leaf" else tuple(
                a + b for a, b in zip(self.weight(rest[0], memo), self.weight(rest[1], memo)))
        return memo[node]

    def swap(self, level: int) -> None:
        """Exchange the filters at ``level`` and the next one; nodes below are shared as they are."""
        memo: dict[int, int] = {}

        def change(node: int) -> int:
            if node not in memo:
                kind, low, high = self.nodes[node]
                if kind < level:
                    memo[node] = self._node(kind, change(low), change(high))
                else:
                    (_, a, b), (_, c, d) = self.nodes[low], self.nodes[high]
                    memo[node] = self._node(level, self._node(level + 1, a, c), self._node(level + 1, b, d))
            return memo[node]

        self.root = change(self.root)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self, memo: dict[int, tuple]) -> Iterator[tuple[int, tuple, tuple]]:
        """(filter, weights kept after it, weights removed by it) along the path that passes everything."""
        node = self.root
        for variable in self.order:
            _, low, high = self.nodes[node]
            yield variable, self.weight(low, memo), self.weight(high, memo)
            node = low


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next one, so that all n! orders appear once, the first one unswapped.

    The last item sweeps through each order of the others, by turns upwards and downwards.
    """
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


def part_steps(weights: dict[int, tuple], names: Sequence[str]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    n = len(names)
    diagram, memo = Diagram(weights, n), {}
    total = [sum(w[0] for m, w in weights.items() if m >> k & 1) for k in range(n)]
    unique = [weights.get(1 << k, (0,))[0] for k in range(n)]
    shapley, out = [0] * n, []
    for level in chain([None], adjacent_swaps(n)):
        if level is not None:
            diagram.swap(level)
        order = "".join(names[k] for k in diagram.order)
        for step, (k, kept, gone) in enumerate(diagram.steps(memo), 1):
            shapley[k] += gone[0]
            out.append((order, step, kept[0], gone[0], total[k] - gone[0], unique[k], gone[1], gone[2], k))
    return [(*row, shapley[k]) for *row, k in out]


def interaction_audit(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of :func:`failure_counts`.

    A part has at most 2^filters rows here, so one small group per part, however many documents it has.
    """
    names = [str(x) for x in names]
    if not 1 <= len(names) <= 7:
        raise ValueError(f"{factorial(len(names))} orders are too many to list")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        weights = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()}
        found = [(rows["part"].iloc[0], *row) for row in part_steps(weights, names)]
        return pd.DataFrame(found, columns=[c.split()[0] for c in _STEP.split(", ")])

    return counts.groupBy("part").applyInPandas(run, _STEP)
