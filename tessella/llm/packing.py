"""Problem 7: items into containers of fixed capacity, by bin completion."""

from bisect import bisect_right, insort
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

CHUNK_ITEMS = 4000
ROUNDS = 3
MOST_SPECS = 1000
COPIES_AT_ONCE = 10_000


class Budget(NamedTuple):
    """What the search of a chunk may spend; it ends with the best solution found, never with items left over.

    ``steps``: fillings tried in all. ``nodes``: partial fillings looked at for one container, not counting the way to
    the first filling. ``fillings``: fillings kept for one container. ``depth``: items of a filling, besides its largest, with
    alternatives; behind them the largest item that fits is taken.
    """

    steps: int = 20_000
    nodes: int = 400
    fillings: int = 6
    depth: int = 3


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of the items of each container. ``sizes`` fall."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for k, s in enumerate(sizes):
        at = bisect_right(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        insort(room, (left - s, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Martello and Toth's bound L2 over all of its values: the volume bound, sharpened by the items too large to share a container."""
    x = np.sort(np.asarray(sizes, np.int64))
    x = x[x > 0]
    if not len(x):
        return 0
    big, rest = x[2 * x > capacity], x[2 * x <= capacity]
    a = np.concatenate([[0], np.unique(rest)])
    upto = lambda v: np.concatenate([[0], np.cumsum(v)])
    alone = np.searchsorted(big, capacity - a, "right")  # from here on a large item leaves no room for an item of size a
    free = alone * capacity - upto(big)[alone]
    small = rest.sum() - upto(rest)[np.searchsorted(rest, a)]
    return int((len(big) + np.maximum(0, -(-(small - free) // capacity))).max())


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` can be put, whole, into spaces of the sizes of ``a``: then ``a`` is never the worse filling."""
    if sum(b) > sum(a):
        return False

    def go(k: int, room: tuple[int, ...]) -> bool:
        if k == len(b):
            return True
        return any(r >= b[k] and go(k + 1, (*room[:j], r - b[k], *room[j + 1 :])) for j, r in enumerate(room) if r not in room[:j])

    return go(0, a)


def completions(count: dict[int, int], order: list[int], room: int, budget: Budget) -> list[tuple[int, ...]]:
    """Undominated maximal fillings of ``room`` from the multiset ``count``, the fullest first; those found within the budget.

    ``order`` holds the sizes, rising. Larger items come first, so that of two fillings of equal waste the one that leaves
    the smaller and handier items is met first. An exact filling that is a single item dominates all others, and ends
    the search; a filling that another one dominates is left out.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    stack: list[int] = []
    nodes = budget.nodes

    def go(left: int, top: int) -> bool:
        nonlocal nodes
        nodes -= bool(found)
        k = min(top, bisect_right(order, left)) - 1
        fits = False
        while k >= 0:
            s = order[k]
            if count[s]:
                fits = True
                count[s] -= 1
                stack.append(s)
                done = go(left - s, k + 1)
                stack.pop()
                count[s] += 1
                if done or nodes <= 0:
                    return True
                if len(stack) >= budget.depth:
                    break
            k -= 1
        if not fits:
            found.append((left, tuple(stack)))
            return left == 0
        return False

    go(room, len(order))
    found.sort(key=lambda f: f[0])
    out: list[tuple[int, ...]] = []
    for _, f in found:
        if len(out) < budget.fillings and f not in out and not any(len(f) + len(a) <= 12 and dominates(a, f) for a in out):
            out.append(f)
    return out or [()]


def bin_completion(sizes: list[int], capacity: int, budget: Budget = Budget()) -> list[list[int]]:
    """Positions of the items of each container; ``sizes`` fall, none exceeds ``capacity``, none is 0.

    Branch and bound over containers: the largest item left opens the next one, and its completions are tried,
    the fullest first. The incumbent is the best-fit-decreasing solution; a branch is cut when the waste so far leaves no
    way to need fewer containers than the incumbent does, and the search ends at the lower bound or when the node
    budget is used up, always with the best solution found.
    """
    incumbent = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(incumbent) <= bound:
        return incumbent
    total = sum(sizes)
    where: dict[int, list[int]] = {}
    for k, s in enumerate(sizes):
        where.setdefault(s, []).append(k)
    order = sorted(where)
    count = {s: len(k) for s, k in where.items()}
    allowed = (len(incumbent) - 1) * capacity - total  # waste with which there is one container less
    chosen: list[tuple[int, ...]] = []
    options: list[list[tuple[int, ...]]] = []
    waste, left = 0, len(sizes)
    steps = budget.steps

    def place(fill: tuple[int, ...], sign: int) -> None:
        nonlocal waste, left
        for s in fill:
            count[s] -= sign
        waste += sign * (capacity - sum(fill))
        left -= sign * len(fill)

    def top() -> int:
        return next(s for s in reversed(order) if count[s])

    def expand() -> list[tuple[int, ...]]:
        s = top()
        count[s] -= 1
        got = completions(count, order, capacity - s, budget)
        count[s] += 1
        return [(s, *f) for f in reversed(got)]

    def keep(fills: list[tuple[int, ...]]) -> None:
        nonlocal incumbent, allowed
        pool = {s: list(k) for s, k in where.items()}
        incumbent = [[pool[s].pop() for s in f] for f in fills]
        allowed = (len(fills) - 1) * capacity - total

    # a first descent along the fullest completions, to its end: often a better incumbent than best fit
    while left:
        chosen.append(expand()[-1])
        place(chosen[-1], 1)
    if len(chosen) < len(incumbent):
        keep(chosen)
    while chosen:
        place(chosen.pop(), -1)
    if len(incumbent) <= bound:
        return incumbent
    options.append(expand())
    while options and steps > 0:
        steps -= 1
        if len(chosen) == len(options):
            place(chosen.pop(), -1)
        if not options[-1]:
            options.pop()
            continue
        chosen.append(options[-1].pop())
        place(chosen[-1], 1)
        if waste > allowed:
            continue
        if left:
            options.append(expand())
        else:
            keep(chosen)
            if len(incumbent) <= bound:
                break
    return incumbent


def pack_chunk(capacity: int, sizes: list[int], budget: Budget = Budget()) -> list[int]:
    """Container number of each item of a chunk, in the order given; items of size 0 go to the first container."""
    order = sorted((k for k, s in enumerate(sizes) if s > 0), key=lambda k: -sizes[k])
    out = [0] * len(sizes)
    for b, items in enumerate(bin_completion([sizes[k] for k in order], capacity, budget)):
        for k in items:
            out[order[k]] = b
    return out


def _pack(items: DataFrame, rnd: int, chunks: int, budget: Budget) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["uid", "piece"], kind="stable").reset_index(drop=True)
        capacity = int(rows["capacity_tokens"].iloc[0])
        into = pack_chunk(capacity, rows["n_tokens"].tolist(), budget)
        rows["container"] = [f"{rnd}.{key[1]}.{b}" for b in into]
        rows["filled"] = rows.groupby("container")["n_tokens"].transform("sum")
        return rows.drop(columns="chunk")

    schema = "spec_name string, capacity_tokens int, uid string, doc_id bigint, piece int, first_token bigint, n_tokens bigint, container string, filled bigint"
    return items.withColumn("chunk", F.pmod(F.xxhash64("uid", "piece", F.lit(rnd)), F.lit(chunks))).groupBy("spec_name", "chunk").applyInPandas(run, schema)


def fill_containers(items: DataFrame, specs: DataFrame, record: str = "doc_id", size: str = "n_tokens", chunk_items: int = CHUNK_ITEMS, rounds: int = ROUNDS, budget: Budget = Budget()) -> DataFrame:
    """(spec_name, capacity_tokens, container, doc_id, piece, first_token, n_tokens) of every item for every container size.

    An item larger than the capacity, and no other, is split: into pieces of exactly the capacity, each a full container
    of its own, and a remainder. Remainders and items are spread by hash over chunks of about ``chunk_items``, each
    solved by bin completion within ``budget``; the items of containers with more than 1/64 of their room unused are gathered and packed
    again, in fewer chunks, so that the poor last containers of all chunks are filled from one another.

    Defined cases: a null size counts as 0, items of size 0 (empty texts) use no room but are put in a container; a null record
    keeps its place; repeated rows are items of their own; specs of null or non-positive capacity are left out, repeated
    ones count once; no items give no rows.
    """
    # items alike in record and size are told apart by a number: a name that no partitioning changes; very many of them are numbered in runs
    alike = items.groupBy(F.col(record).cast("bigint").alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size")).agg(F.count("*").alias("n"))
    runs = alike.select("doc_id", "size", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES_AT_ONCE))).alias("run"))
    runs = runs.repartition("doc_id", "size", "run").select("doc_id", "size", F.explode(F.sequence(F.col("run") * COPIES_AT_ONCE, F.least(F.col("n"), (F.col("run") + 1) * COPIES_AT_ONCE) - 1)).alias("nth"))
    sized = materialize(runs.select(F.concat_ws(".", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "nth").alias("uid"), "doc_id", "size"), "sizes")
    n = sized.count()
    kinds = specs.where("capacity_tokens > 0").select("spec_name", F.col("capacity_tokens").cast("int").alias("capacity_tokens")).distinct().limit(MOST_SPECS + 1).collect()
    if len(kinds) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container sizes")
    each = sized.withColumn("spec", F.explode(F.array([F.struct(F.lit(k.spec_name).cast("string").alias("spec_name"), F.lit(k.capacity_tokens).cast("int").alias("capacity_tokens")) for k in kinds]).cast("array<struct<spec_name:string,capacity_tokens:int>>"))).select("uid", "doc_id", "size", "spec.*")
    full = F.floor(F.col("size") / F.col("capacity_tokens")).cast("int")
    pieces = each.withColumn("full", full).withColumn("rest", F.col("size") - F.col("full") * F.col("capacity_tokens"))
    whole = pieces.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).select("spec_name", "capacity_tokens", "uid", "doc_id", "piece", (F.col("piece").cast("bigint") * F.col("capacity_tokens")).alias("first_token"), F.col("capacity_tokens").cast("bigint").alias("n_tokens"), F.concat(F.lit("full."), "uid", F.lit("."), "piece").alias("container"))
    todo = pieces.where("rest > 0 OR full = 0").select("spec_name", "capacity_tokens", "uid", "doc_id", F.col("full").alias("piece"), (F.col("full").cast("bigint") * F.col("capacity_tokens")).alias("first_token"), F.col("rest").alias("n_tokens"))
    done, cols = [whole], whole.columns
    for rnd in range(rounds):
        chunks = max(1, -(-n // chunk_items))
        packed = materialize(_pack(todo, rnd, chunks, budget), "packed")
        poor = F.col("filled") < F.col("capacity_tokens") - F.floor(F.col("capacity_tokens") / 64)
        if chunks == 1 or rnd == rounds - 1:
            done.append(packed.select(cols))
            break
        done.append(packed.where(~poor).select(cols))
        todo = packed.where(poor).drop("container", "filled")
        n = packed.where(poor).groupBy("spec_name").count().agg(F.max("count")).first()[0] or 0
        if not n:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("uid")
