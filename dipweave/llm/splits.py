"""Splits that keep related records together.

Strings of a column that name one star are found as connected components, by parallel hooking and shortcutting over a parent table that is
joined with the edges. Components are assigned whole: an even part of the sizes by proportion, the rest by subset sums over the
multiplicities of sizes, so that the splits' totals come as close to their targets as sizes allow.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stars import catalog_links, designation, star_keys
from ..operators.lookup import lookup
from ..sources.shared import kept, scratch

#: Components of one size that are put in order in one task.
PER_TASK = 50_000
#: Most labels; the driver looks at a few components of each label.
MOST_LABELS = 500


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the component of each node that an edge (a, b) names. Edges with a NULL end count for nothing."""
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    with scratch(edges.sparkSession) as keep:
        links = keep(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        parents = keep(links.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("parent")))
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            both = parents.join(above, "parent")
            # the smallest grandparent among a node's neighbours
            near = links.join(both.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("least"))
            seen = both.join(near, "node")
            # hooking: the node's parent and the node itself move under it; shortcutting: the node moves under its grandparent
            moves = seen.select(F.explode(F.array(F.struct(F.col("parent").alias("node"), F.col("least").alias("parent")), F.struct("node", F.least("least", "grand", "parent").alias("parent")))).alias("m")).select("m.*")
            new = moves.groupBy("node").agg(F.min("parent").alias("new"))
            changed = keep(parents.join(new, "node").select("node", F.least("parent", "new").alias("parent"), (F.col("new") < F.col("parent")).alias("moved")))
            parents = changed.select("node", "parent")
            if not changed.where("moved").head(1):
                return kept(parents.select("node", F.col("parent").alias("component")))


def named_stars(names: DataFrame, catalog: DataFrame, column: str) -> DataFrame:
    """names (distinct strings in column) with node, their designation, and star, the component of what they name; strings that name none go."""
    named = names.select(column, designation(F.col(column)).alias("node")).where("node IS NOT NULL")
    found = components(catalog_links(catalog).select(F.col("tic").alias("a"), F.col("kic").alias("b")))
    return named.join(found, "node", "left").select(column, "node", F.coalesce("component", "node").alias("star"))


def same_names(rows: DataFrame, catalog: DataFrame, column: str = "host_star") -> DataFrame:
    """(host_a, host_b): each pair of different strings of a column that name the same star, the smaller in code-point order first.

    Strings of one component are candidates. A component also joins what is linked by way of others (KIC 10 and KIC 20, if one TIC has both numbers); two strings
    name the same star only if they share a designation of it, see star_keys, and that is checked for each pair.
    """
    stars = kept(named_stars(rows.select(column).distinct(), catalog, column))
    keys = star_keys(stars.select("node").distinct(), catalog_links(catalog).distinct(), "node").groupBy("node").agg(F.collect_set("star").alias("keys"))
    each = stars.join(keys, "node")
    a, b = (each.select("star", F.col(column).alias(f"host_{k}"), F.col("keys").alias(f"keys_{k}")) for k in "ab")
    return a.join(b, "star").where((F.col("host_a") < F.col("host_b")) & F.arrays_overlap("keys_a", "keys_b")).select("host_a", "host_b")


def _blocks(sizes: dict[int, int]) -> list[tuple[int, int]]:
    """Multiplicities as powers of two and what is left, largest sizes first: (size, how many of it at once)."""
    out = []
    for s, m in sorted(sizes.items(), reverse=True):
        k = 1
        while m > 0:
            out.append((s, min(k, m)))
            m -= min(k, m)
            k *= 2
    return out


def _pick(items: list[tuple[int, int]], goal: int) -> list[tuple[int, int]]:
    """Items whose sizes add up to a goal that is known to be reachable. Sums that both halves of the items can meet in split the work, so a few bitsets are held at a time."""
    if goal == 0:
        return []
    if len(items) == 1:
        return items
    half, there, back = len(items) // 2, 1, 1 << goal
    mask = (1 << (goal + 1)) - 1
    for s, k in items[:half]:
        there |= (there << (s * k)) & mask
    for s, k in items[half:]:
        back |= back >> (s * k)
    both = there & back
    at = (both & -both).bit_length() - 1
    return _pick(items[:half], at) + _pick(items[half:], goal - at)


def _nearest_sum(sizes: dict[int, int], goal: int) -> list[tuple[int, int]]:
    """Items whose sum is as near to goal as can be, the lower of two equally near. A bitset holds the sums that are reachable; it ends as soon as the goal is among them."""
    mask, reached, items = (1 << (2 * goal + 1)) - 1, 1, []
    for s, k in _blocks({s: min(m, 2 * goal // s) for s, m in sizes.items()}):
        if s * k <= 2 * goal:
            items.append((s, k))
            reached |= (reached << (s * k)) & mask
            if reached >> goal & 1:
                return _pick(items, goal)
    low = (reached & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reached >> (goal + 1)
    high = goal + (above & -above).bit_length() if above else None
    return _pick(items, low if high is None or goal - low <= high - goal else high)


def choose(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many of each size to take, of so many that there are, for a sum as near to target as can be; of two equally near, either.

    All sizes give the same part, rounded along the sizes so that the sum is less than the largest size short of the target; subset sums of the others
    fill what is lacking. If no sum is as near as the sizes' common divisor allows, part of what was taken is released, twice as much each time, until one is or all sizes
    are open: the sum found then is the nearest there is, at any number of rows and sizes.
    """
    total = sum(s * m for s, m in sizes.items())
    if target <= 0 or not total:
        return {}
    if target >= total:
        return dict(sizes)
    taken, upto = {}, 0
    for s, m in sorted(sizes.items(), reverse=True):
        taken[s] = (upto + m) * target // total - upto * target // total
        upto += m
    divisor = math.gcd(*sizes)
    least = min(target % divisor, divisor - target % divisor)
    while True:
        room = target - sum(s * n for s, n in taken.items())
        more = _nearest_sum({s: m - taken[s] for s, m in sizes.items() if m > taken[s]}, room)
        if abs(room - sum(s * k for s, k in more)) == least or not any(taken.values()):
            break
        wanted = 2 * room + max(sizes)
        while room < wanted and any(taken.values()):
            for s in sorted(sizes, reverse=True):
                if taken[s] and room < wanted:
                    taken[s] -= 1
                    room += s
    for s, k in more:
        taken[s] += k
    return {s: n for s, n in taken.items() if n}


def quotas(sizes: dict[int, int], targets: dict[str, int]) -> dict[int, dict[str, int]]:
    """How many components of each size go to each split of targets (rows wanted), one split after the other; the others go to the split that isn't named."""
    free, out = dict(sizes), {s: dict.fromkeys(targets, 0) for s in sizes}
    for k, t in targets.items():
        for s, n in choose({s: m for s, m in free.items() if m}, t).items():
            out[s][k] = n
            free[s] -= n
    return out


def _needed(held: dict[str, str], labels: dict[str, list[str]]) -> dict[str, str]:
    """held without the components whose labels others bring to the same split, those that come last in the labels' order of preference first."""
    place = {u: max(c.index(u) for c in labels.values() if u in c) for u in held}
    count: dict[tuple[str, str], int] = {}
    of = {u: [x for x, c in labels.items() if u in c] for u in held}
    for u, k in held.items():
        for x in of[u]:
            count[x, k] = count.get((x, k), 0) + 1
    for u in sorted(held, key=lambda u: (-place[u], u)):
        if all(count[x, held[u]] > 1 for x in of[u]):
            for x in of[u]:
                count[x, held[u]] -= 1
            held = {v: k for v, k in held.items() if v != u}
    return held


def reserve(labels: dict[str, list[str]], splits: list[str]) -> dict[str, str]:
    """Components that make sure of each label in each split: component and split.

    labels: of each label the components that have it, in the order of preference, all of them or as many as splits times labels. A label with at least as many as there are splits reaches all of them if any assignment does that for
    all such labels; one with fewer reaches as many splits as it has components, if those of the others leave them. First each label and split is matched with a component of its own,
    labels with few components first, moving what was matched before where that helps. If that leaves a label out, a search also lets one component serve several labels.
    """
    n = len(splits)
    full = sorted((x for x, c in labels.items() if len(c) >= n), key=lambda x: (len(labels[x]), x))
    few = sorted((x for x, c in labels.items() if len(c) < n), key=lambda x: (len(labels[x]), x))
    holder: dict[str, tuple[str, str]] = {}

    def place(want: tuple[str, str], tried: set[str]) -> bool:
        for u in labels[want[0]]:
            if u not in tried:
                tried.add(u)
                if u not in holder or place(holder[u], tried):
                    holder[u] = want
                    return True
        return False

    met = [place((x, k), set()) for x in full for k in splits[::-1]]
    if all(met):
        for x in few:
            for k in splits[::-1]:
                place((x, k), set())
        return _needed({u: k for u, (_, k) in holder.items()}, labels)
    # components with the same labels stand for one another
    kinds: dict[frozenset, list[str]] = {}
    for u in dict.fromkeys(u for c in labels.values() for u in c):
        kinds.setdefault(frozenset(x for x in labels if u in labels[x]), []).append(u)
    names = list(kinds)

    @cache
    def search(open_: frozenset, left: tuple[int, ...]) -> tuple | None:
        """(kind, split) of the components to take, so that none of the open (label, split) is left."""
        if not open_:
            return ()
        offers = {x: [k for k, kind in enumerate(names) if left[k] and x[0] in kind] for x in open_}
        want = min(sorted(open_), key=lambda x: sum(left[k] for k in offers[x]))
        for k in offers[want]:
            rest = search(frozenset(x for x in open_ if not (x[1] == want[1] and x[0] in names[k])), left[:k] + (left[k] - 1,) + left[k + 1 :])
            if rest is not None:
                return ((k, want[1]), *rest)
        return None

    found = search(frozenset((x, k) for x in full for k in splits), tuple(len(kinds[k]) for k in names))
    if found is None:  # no assignment does it
        return _needed({u: k for u, (_, k) in holder.items()}, labels)
    left = {k: list(kinds[kind]) for k, kind in enumerate(names)}
    return _needed({left[k].pop(0): split for k, split in found}, labels)


def _ranked(units: DataFrame) -> DataFrame:
    """units (unit, size, parts) with a rank from 1 within their size, in the order of a hash; a size is counted in as many parts as it says, so that none is sorted in one task."""
    placed = units.withColumn("_hash", F.xxhash64("unit")).withColumn("_part", F.pmod("_hash", "parts"))
    before = placed.groupBy("size", "_part").count().withColumn("_before", F.sum("count").over(Window.partitionBy("size").orderBy("_part")) - F.col("count")).drop("count")
    local = placed.withColumn("_n", F.row_number().over(Window.partitionBy("size", "_part").orderBy("_hash", "unit")))
    return local.join(before, ["size", "_part"]).withColumn("rank", F.col("_before") + F.col("_n")).drop("_hash", "_part", "_before", "_n")


def grouped_splits(rows: DataFrame, catalog: DataFrame, proportions: dict[str, float] | None = None, key: str = "label_id", host: str = "host_star", label: str = "label") -> DataFrame:
    """(key, label, star, split) for each row: rows whose host names the same star share a split, also by way of other names (see components).

    proportions: split and share, by default train 0.8, validation 0.1, test 0.1; the first takes what the others leave. Rows with a host that names no star (NULL, empty or anything else)
    go each by itself; rows that also share their key go together. Each label that at least as many components have as there are splits gets at least one component in every split, if there is an assignment that does so for all such labels
    (with fewer, it goes to as many splits as it has components); a NULL label asks for nothing. Labels are a small vocabulary, ValueError for more than MOST_LABELS: the smallest few components of each are looked at by the driver, as is the
    number of components of each size. The assignment is the same for the same rows. Rows keep their number; further columns are left out; an empty table gives an empty result.
    """
    proportions = proportions or {"train": 0.8, "validation": 0.1, "test": 0.1}
    splits = list(proportions)
    spark = rows.sparkSession
    base = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(host).alias("host"))
    base = base.withColumn("named", designation(F.col("host")).isNotNull()).withColumn("at", F.when(F.col("named"), F.col("host")).otherwise(F.concat(F.lit("\x01row "), F.coalesce(F.col("key").cast("string"), F.lit("NULL")))))
    with scratch(spark) as keep:
        counted = keep(base.groupBy("at", "named", "label").count())
        stars = named_stars(counted.where("named").select(F.col("at")).distinct(), catalog, "at").drop("node")
        units = keep(counted.join(stars, "at", "left").select("at", F.coalesce("star", "at").alias("unit"), "star", "label", "count"))
        sized = keep(units.groupBy("unit").agg(F.sum("count").alias("size")))

        labelled = units.where("label IS NOT NULL").select("unit", "label").distinct().join(sized, "unit")
        n_labels = labelled.select("label").distinct().limit(MOST_LABELS + 1).count()
        if n_labels > MOST_LABELS:
            raise ValueError(f"{label} has more than {MOST_LABELS} values")
        # the smallest components of each label, as many as all labels together can take away from it and one for each split
        few = Window.partitionBy("label").orderBy("size", F.xxhash64("unit"), "unit")
        small = labelled.withColumn("n", F.row_number().over(few)).where(F.col("n") <= len(splits) * max(1, n_labels)).orderBy("label", "n").collect()
        having: dict[str, list[str]] = {}
        for r in small:
            having.setdefault(r["label"], []).append(r["unit"])
        sizes = {r["unit"]: r["size"] for r in small}
        reserved = reserve(having, splits)
        held = F.broadcast(spark.createDataFrame(list(reserved.items()), "unit string, split string"))  # at most one for each label and split

        rest = sized.join(held.select("unit"), "unit", "left_anti")
        histogram = {r["size"]: r["n"] for r in rest.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most the square root of twice the rows
        total = sum(s * m for s, m in histogram.items()) + sum(sizes[u] for u in reserved)
        wanted = {k: max(0, round(total * proportions[k]) - sum(sizes[u] for u, s in reserved.items() if s == k)) for k in splits[1:]}
        bounds = []
        for s, taken in quotas(histogram, wanted).items():
            cuts, upto = [], 0
            for k in splits[1:]:
                cuts.append((k, upto, upto + taken[k]))
                upto += taken[k]
            bounds.append((s, -(-histogram[s] // PER_TASK), cuts))
        ranges = F.broadcast(spark.createDataFrame(bounds, "size bigint, parts bigint, cuts array<struct<split: string, low: bigint, high: bigint>>"))  # a row per size
        mine = F.get(F.filter("cuts", lambda c: (F.col("rank") > c["low"]) & (F.col("rank") <= c["high"])), F.lit(0))["split"]
        placed = _ranked(rest.join(ranges, "size")).select("unit", F.coalesce(mine, F.lit(splits[0])).alias("split"))
        by_name = kept(units.select("at", "unit", "star").distinct().join(placed.unionByName(held), "unit").select("at", "star", "split"))
    return lookup(base, by_name, "at", "key").select(F.col("key").alias(key), F.col("label").alias(label), "star", "split")
