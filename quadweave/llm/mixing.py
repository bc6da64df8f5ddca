"""Mixing sources to target weights by fitting each source's remaining budget as a bounded subset sum."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.common import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one rank group.
GROUP_ROWS = 512


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many documents of each exact length to take so that their words come as near to the budget as they can.

    From the longest on every length gives its share, and what a length can't give in whole documents goes to the
    next, down to a reserve of twice the longest document; a bounded knapsack over the exact lengths then spends
    that. Its table has one entry for each word of the reserve, so it is bounded by the longest document.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    take = dict.fromkeys(lengths, 0)
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return dict(zip(lengths, counts, strict=True))
    hist = sorted(((n, c) for n, c in zip(lengths, counts, strict=True) if n > 0), reverse=True)
    spread = max(0, budget - 2 * hist[0][0])
    owed = given = 0
    for n, c in hist:
        owed += n * c * spread
        take[n] = min(c, (owed - given * total) // (n * total))
        given += n * take[n]
    rest = budget - given
    room = rest + hist[-1][0]  # one past the budget by the shortest may be nearer
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    step_of = np.zeros(room + 1, np.int32)  # which step made a sum reachable; the step leads to a sum that was before
    steps: list[tuple[int, int]] = []
    for n, c in hist:
        left, k = min(c - take[n], room // n), 1
        while left > 0:
            k = min(k, left)
            new = reach[: room + 1 - n * k] & ~reach[n * k :]
            if new.any():
                at = np.flatnonzero(new) + n * k
                reach[at] = True
                step_of[at] = len(steps)
                steps.append((n, k))
            left -= k
            k *= 2
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])  # the lower of two equally near
    while at:
        n, k = steps[step_of[at]]
        take[n] += k
        at -= n * k
    return take


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, s) -> (source, s, t): weights in turn by code point, null last; no target above cap x its size.

    Places come from an ordered exchange and the level of the targets from sums, so the driver holds sums only.
    """
    ordered = sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    placed = durable(ordered.withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before, offsets = 0, {}
    for part, n in sorted(placed.groupBy("part").count().collect()):
        offsets[part], before = before, before + n
    if not offsets:
        return placed.select("source", "s", F.lit(0.0).alias("t"))
    shift = F.element_at(F.create_map(*[F.lit(x) for p in offsets.items() for x in p]), F.col("part"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("i") + shift, F.lit(len(weights))).cast("int") + 1)
    weighed = durable(placed.select("source", "s", weight.alias("w")))
    whole = int(weighed.agg(F.sum("s")).first()[0] or 0)
    most = F.col("s") * F.lit(float(cap))
    left, total, seen = share * whole, float(weighed.agg(F.sum("w")).first()[0]), -1
    while True:
        over = F.lit(left) * F.col("w") / F.lit(total) > most if total else F.lit(True)
        n, capped, free = weighed.agg(F.count_if(over), F.sum(F.when(over, F.col("s"))), F.sum(F.when(~over, F.col("w")))).first()
        if n == seen:  # sources only ever join those at their bound
            return weighed.select("source", "s", F.when(over, most).otherwise(F.lit(left) * F.col("w") / F.lit(total or 1.0)).alias("t"))
        seen, left, total = n, share * whole - cap * int(capped or 0), float(free or 0.0)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every document, and the columns named by keep.

    Size is the number of words (null text: 0). Sources in code-point order, null last, get the weights in turn;
    their targets share `share` of all words and stop at `cap` times their size, the excess going to the others
    by weight. A source is taken whole as often as its target allows; what remains is fitted by a bounded
    knapsack over its histogram of exact lengths, and the documents of a length are chosen by seeded hash.
    taken = words that the mix takes from the document, repeats counted: 0 to cap x size. Empty texts take 0.
    The histogram of one source is one row per distinct length, at most as many as the longest document has words.
    Null and repeated ids are allowed: the hash covers the text too, and equal rows are documents of their own, of
    which any may be taken, so reruns agree. Extra columns are ignored; an empty table gives no rows.
    """
    text = F.col(f"`{text_col}`")
    # null sources join by a flag and an empty string, which keeps joins plain equi-joins that skew handling can split
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), text).alias("u"),
        *[F.col(f"`{c}`") for c in keep],
    ).withColumns({"k": F.coalesce("source", F.lit("")), "z": F.col("source").isNull()})
    slim = durable(slim)
    lengths = durable(slim.groupBy("source", "k", "z", "size").agg(F.count("*").alias("n")))
    goals = _targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")), weights, share, cap)
    goals = goals.select(F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("z"), F.col("s").alias("source_size"), F.col("t").alias("target"))

    def plan(pdf):
        import pandas as pd

        s, t = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        times = 0 if s == 0 else min(int(t // s), cap)
        spare = 0 if s == 0 or times >= cap else round(t - times * s)
        got = fit_budget([int(x) for x in pdf["size"]], [int(x) for x in pdf["n"]], int(spare))
        return pd.DataFrame({"k": pdf["k"], "z": pdf["z"], "size": pdf["size"], "n": pdf["n"], "times": times, "more": [got[int(x)] for x in pdf["size"]], "source_size": s, "target": t})

    planned = lengths.join(goals, ["k", "z"]).select("k", "z", "size", "n", "source_size", "target")
    plans = durable(planned.groupBy("k", "z").applyInPandas(plan, "k string, z boolean, size long, n long, times long, more long, source_size long, target double"))
    rows = slim.join(plans, ["k", "z", "size"])
    # rank by hash only where a length is taken in part: in groups of about GROUP_ROWS of neighbouring hashes
    part = F.col("more").between(1, F.col("n") - 1)
    rows = durable(rows.withColumn("cell", F.when(part, F.pmod(F.shiftright("u", 1), F.ceil(F.col("n") / F.lit(GROUP_ROWS))))).withColumn("salt", F.spark_partition_id()))
    key = ["k", "z", "size", "cell", "u"]
    # equal rows share a hash; they are counted first, so that however many there are, a cell ranks hashes only
    hashes = durable(rows.where("cell is not null").groupBy(*key, "more").agg(F.count("*").alias("m")))
    cells = hashes.groupBy("k", "z", "size", "cell").agg(F.sum("m").alias("m"))
    before = cells.withColumn("before", F.sum("m").over(Window.partitionBy("k", "z", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("k", "z", "size", "cell", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("m").over(Window.partitionBy("k", "z", "size", "cell").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = hashes.withColumn("inside", inside).join(before, ["k", "z", "size", "cell"])
    quota = F.greatest(F.lit(0), F.least(F.col("m"), F.col("more") - F.col("before") - F.col("inside")))
    ranked = durable(ranked.select(*key, "m", quota.alias("quota")))
    out = ["doc_id", "size", "source_size", "target", "taken", "source", *keep]
    add = lambda d: d.withColumn("taken", F.col("size") * (F.col("times") + F.col("extra"))).select(*out)
    whole = add(rows.where("cell is null").withColumn("extra", (F.col("more") > 0).cast("long")))
    chosen = rows.where("cell is not null").join(ranked, key)
    all_alike = add(chosen.where("quota = 0 or quota = m").withColumn("extra", (F.col("quota") > 0).cast("long")))
    # equal rows that are taken in part, at most one hash of a length: ranked where they lie, by the counts of the parts before
    mixed = chosen.where("quota > 0 and quota < m")
    parts = mixed.groupBy(*key, "salt").agg(F.count("*").alias("here"))
    earlier = F.coalesce(F.sum("here").over(Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("earlier", earlier).drop("here")
    place = F.row_number().over(Window.partitionBy(*key, "salt").orderBy(F.lit(1)))
    some = add(mixed.join(parts, [*key, "salt"]).withColumn("extra", (F.col("earlier") + place <= F.col("quota")).cast("long")))
    return whole.unionByName(all_alike).unionByName(some)
