"""Mixing sources to target weights by hierarchical budgets.

The leaves of the tree are (domain, language, source); their weights are the target share of
the source, spread over the source's domains and languages as its tokens lie. Budgets flow from
the root: a node's budget is split over its children by weight; a child that can give at most
its capacity (tokens times permitted repeats) takes that, and what it cannot take goes to its
siblings before it goes back to the parent and so to the parent's siblings.

From each leaf the budget is taken as whole epochs (every document once more) plus a prefix of
one seeded epoch: documents in the order of a seeded hash until the tokens are reached. The
prefix is found through hash buckets, so no leaf is ever gathered or sorted in one task.

Without a given total, the mixture is as large as it can be with every present source at its
share: the least of capacity / share (or ``times`` that). With a given total, shortages are redistributed and the
shares reached are reported.

Sources are compared without case and surrounding space; a document with a null or blank source,
or one of no target, takes no part; a target without documents reaches nothing and its share
goes to the others. Null languages and domains are leaves of their own. Repeated rows of one
doc_id count once; documents without tokens take no part.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.encode import count_tokens
from paperloom.session import cut, shuffle_width

BUCKETS = 4096
#: Leaves and targets are handled on the driver; more of them than this is an error.
LEAVES_AT_MOST = 100_000

_EPS = 1e-9


def split_budget(budget: float, weights: list[float], capacities: list[float]) -> list[float]:
    """Split a budget by weight under capacities; a shortage goes to the others by weight."""
    got = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and capacities[i] > 0]
    left = min(budget, sum(capacities[i] for i in open_))
    while open_ and left > _EPS:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if got[i] + left * weights[i] / total >= capacities[i] - _EPS]
        if not full:
            for i in open_:
                got[i] += left * weights[i] / total
            return got
        for i in full:
            left -= capacities[i] - got[i]
            got[i] = capacities[i]
        open_ = [i for i in open_ if i not in set(full)]
    return got


def tree_budgets(leaves: dict[tuple, tuple[float, float]], total: float) -> dict[tuple, float]:
    """``leaves[path] = (weight, capacity)`` to the budget of each leaf.

    Going down, a node takes its share by weight up to what its whole subtree can give; so a
    shortage stays inside the smallest subtree whose other members can take it."""
    children: dict[tuple, list[tuple]] = defaultdict(list)
    weight: dict[tuple, float] = defaultdict(float)
    capacity: dict[tuple, float] = defaultdict(float)
    for path, (w, c) in leaves.items():
        for k in range(len(path) + 1):
            node = path[:k]
            weight[node] += w
            # A leaf without weight gives nothing.
            capacity[node] += c if w > 0 else 0.0
            if k and node not in children[path[: k - 1]]:
                children[path[: k - 1]].append(node)
    budgets = {(): min(total, capacity[()])}
    for depth in range(len(next(iter(leaves), ()))):
        for node in [n for n in list(budgets) if len(n) == depth]:
            kids = children[node]
            for kid, b in zip(kids, split_budget(budgets[node], [weight[k] for k in kids], [capacity[k] for k in kids])):
                budgets[kid] = b
    return {p: budgets.get(p, 0.0) for p in leaves}


def _clean(c):
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


class Mixture:
    """A planned mixture: ``rows`` (doc_id, source, tokens, copies) and ``shares``."""

    def __init__(self, docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, times: float = 1.0, seed: int = 0, domain: str = "section_type", path: str | None = None):
        spark = docs.sparkSession
        want = (
            targets.select(_clean(targets["source"]).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0")
            .groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
        )
        wanted_rows = want.limit(LEAVES_AT_MOST + 1).collect()
        if len(wanted_rows) > LEAVES_AT_MOST:
            raise ValueError("too many targets")
        self.targets = {r["source"]: (r["share"], max(1, r["repeats"] or 1)) for r in wanted_rows}
        named = docs.select("doc_id", "text", _clean(docs["source"]).alias("source"), _clean(docs["lang"]).alias("lang"), _clean(docs[domain]).alias("domain"))
        wanted = named.where(F.col("source").isin(list(self.targets) or [""]) & F.col("text").isNotNull() & (F.length("text") > 0)).repartition(shuffle_width(spark), "doc_id").dropDuplicates(["doc_id"])
        sizes = count_tokens(wanted.withColumn("key", F.struct("doc_id", "source", "lang", "domain")), "key", "text", path)
        # The sizes are read twice (leaf totals, selection): kept, so that nothing is encoded again.
        self.sizes = cut(
            sizes.select("key.doc_id", "key.source", F.coalesce("key.domain", F.lit("")).alias("domain"), F.coalesce("key.lang", F.lit("")).alias("lang"), "tokens")
            .where("tokens > 0")
            .withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
            .withColumn("b", F.pmod(F.shiftrightunsigned("h", 32), F.lit(BUCKETS)).cast("int"))
        )
        totals = self.sizes.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).limit(LEAVES_AT_MOST + 1).collect()
        if len(totals) > LEAVES_AT_MOST:
            raise ValueError("too many leaves")
        by_source: dict[str, float] = defaultdict(float)
        for r in totals:
            by_source[r["source"]] += r["tokens"]
        self.available = dict(by_source)
        present = sum(self.targets[s][0] for s in by_source)
        leaves = {}
        for r in totals:
            share, repeats = self.targets[r["source"]]
            leaves[(r["domain"], r["lang"], r["source"])] = (share * r["tokens"] / by_source[r["source"]], float(r["tokens"] * repeats))
        if total_tokens is None:
            total_tokens = min((by_source[s] * self.targets[s][1] * present / self.targets[s][0] for s in by_source), default=0.0)
            total_tokens *= times
        self.total = float(total_tokens)
        self.budgets = tree_budgets(leaves, self.total) if leaves else {}
        self._capacity = {k: c for k, (_, c) in leaves.items()}
        self._plan = self._planned(self.budgets)
        if leaves:
            self._settle()

    def _planned(self, budgets: dict[tuple, float]) -> DataFrame:
        rows = []
        for k, b in budgets.items():
            t = self._capacity[k] / self.targets[k[2]][1]
            rows.append((*k, int(b // t), float(b - (b // t) * t)))
        return self.sizes.sparkSession.createDataFrame(rows, "domain string, lang string, source string, epochs int, rest double")

    def _settle(self) -> None:
        """Documents are whole, so leaves miss their budgets a little; each source's sum of
        misses goes into its largest leaf."""
        got = {(r["domain"], r["lang"], r["source"]): r["t"] for r in self.rows().groupBy("domain", "lang", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
        budgets = dict(self.budgets)
        for source in {k[2] for k in budgets}:
            own = [k for k in budgets if k[2] == source]
            largest = max(own, key=lambda k: (self._capacity[k], k))
            miss = sum(budgets[k] - got.get(k, 0) for k in own if k != largest)
            budgets[largest] = min(max(0.0, budgets[largest] + miss), self._capacity[largest])
        self._plan = self._planned(budgets)

    def rows(self) -> DataFrame:
        leaf = ["domain", "lang", "source"]
        before = Window.partitionBy(*leaf).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        steps = (
            self.sizes.groupBy(*leaf, "b").agg(F.sum("tokens").alias("n"))
            .select(*leaf, "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
            .join(self._plan, leaf)
        )
        inside = Window.partitionBy(*leaf, "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        placed = self.sizes.join(steps, [*leaf, "b"]).withColumn("start", F.col("below") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        # A document belongs to the prefix if at least half of it lies inside the budget.
        extra = (F.col("start") + F.col("tokens") / 2 <= F.col("rest")).cast("int")
        return placed.select("doc_id", "source", "lang", "domain", "tokens", (F.col("epochs") + extra).alias("copies")).where("copies > 0")

    def shares(self) -> DataFrame:
        spark = self.sizes.sparkSession
        facts = [(s, float(w), int(r), int(self.available.get(s, 0))) for s, (w, r) in self.targets.items()]
        want = spark.createDataFrame(facts or [], "source string, target_share double, max_repeats int, available_tokens bigint")
        got = self.rows().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.count(F.lit(1)).alias("docs"), F.max("copies").alias("most"))
        joined = want.join(got, "source", "left").withColumn("all", F.sum("t").over(Window.partitionBy()))
        return joined.select(
            "source", "target_share", "max_repeats", "available_tokens", F.coalesce("t", F.lit(0)).alias("tokens"),
            F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most", F.lit(0)).alias("repeats"),
            F.coalesce(F.col("t") / F.col("all"), F.lit(0.0)).alias("actual_share"),
        )
