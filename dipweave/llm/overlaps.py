"""Records of evaluation splits that reappear, exactly or almost, in the training split.

A record is normalised to a stream of tokens, one for each measured feature that is there: its name and the coarse cell of its value on a logarithmic grid. A rolling hash over the
tokens cuts the stream into chunks where their content says so, whatever comes before; digests of the chunks of one star are joined across splits and the lengths of shared chunks are
summed to an overlap fraction. Each stream is cut on two grids half a cell apart, so that values a little apart are in one cell on at least one of them. Pairs with a fraction above a
threshold go to an exact comparison of all features.

A record that lacks features its copy has, or has values near borders of cells in each chunk, shares no chunk with it. For these there is an index of pairs of cells: the measured features are
dealt into groups, fewer than measured features of an agreeing pair, so at least two are of one group; an evaluation record looks up both values in the one or two cells that a
partner's can be in. Pairs that match wherever both have the two features are compared too. So no agreeing pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import known
from ..functions.stars import catalog_links, designation, star_keys
from ..operators.lookup import lookup
from ..operators.training import FEATURES
from ..sources.shared import kept, scratch

#: Features that are no measurements on a scale.
FLAGS = ("signs_agree", "periodic")
#: Widths of cells in tolerances: of tokens in chunks, of the index.
CHUNK_CELL, INDEX_CELL = 24, 6
#: Tokens of a chunk.
SHORTEST, LONGEST = 2, 6


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cells(x: np.ndarray, width: float, shift: float) -> np.ndarray:
    """The cell of each value, moved by shift, on a logarithmic grid; values of opposite signs, zero and infinity have cells apart."""
    size = np.abs(x)
    with np.errstate(all="ignore"):
        at = np.floor((np.log(np.where((size > 0) & (size < np.inf), size, 1.0)) + shift) / width).astype(np.int64) * 2 + (x > 0)
    return np.where(x == 0, 1 << 40, np.where(size == np.inf, (1 << 41) + (x > 0), at)).astype(np.uint64)


def chunks(tokens: np.ndarray, present: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, digests, lengths) of the chunks of each row's stream of present tokens.

    A cyclic-polynomial hash rolls over the last two tokens; a chunk of at least SHORTEST tokens ends where its low two bits are zero, one of LONGEST in any case.
    """
    n = len(tokens)
    before, digest, length = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(tokens.shape[1]):
        here, token = present[:, k], tokens[:, k]
        rolling = ((before << np.uint64(1)) | (before >> np.uint64(63))) ^ token
        digest = np.where(here, _mix(digest ^ token), digest)
        length += here
        before = np.where(here, token, before)
        end = np.flatnonzero(here & ((length >= LONGEST) | ((length >= SHORTEST) & (rolling & np.uint64(3) == 0))))
        yield end, digest[end], length[end]
        digest[end], length[end] = 0, 0
    end = np.flatnonzero(length > 0)
    yield end, digest[end], length[end]


def index_groups(n: int, groups: int) -> list[tuple[int, int]]:
    """Pairs of places of n features dealt into so many groups: of more than that many features two are always a pair."""
    return [(i, j) for i in range(n) for j in range(i + groups, n, groups)]


def _digests(records: DataFrame, names: tuple[str, ...], groups: int, tolerance: float, probing: bool) -> DataFrame:
    """(key, class, what, weight, present) of each record (star, class, measures): its chunks on both grids (what -1 and -2, weight their length), and its pairs of cells (what their number); probing: in each cell a partner's value can be in."""
    delta = -math.log(1 - tolerance) * (1 + 1e-9)
    pairs = index_groups(len(names), groups)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _mix(np.arange(1, len(names) + len(pairs) + 3, dtype=np.uint64))
        for batch in batches:
            star = batch.column(0).to_numpy().view(np.uint64)
            of_class = batch.column(1).to_numpy()
            x = np.array([np.array(batch.column(k + 2).to_numpy(zero_copy_only=False), np.float64) for k in range(len(names))]).T.reshape(-1, len(names))
            there = ~np.isnan(x)
            present = (there * (1 << np.arange(len(names)))).sum(axis=1)
            rows, keys, what, weight = [], [], [], []

            def add(r, k, w, n):
                rows.append(r), keys.append(k), what.append(np.full(len(r), w)), weight.append(np.broadcast_to(n, len(r)))

            for grid in range(2):
                token = _mix(cells(x, CHUNK_CELL * delta, grid * CHUNK_CELL * delta / 2) ^ salt[: len(names)])
                for r, digest, n in chunks(token, there):
                    add(r, _mix(digest ^ star[r] ^ salt[len(names) + len(pairs) + grid]), -1 - grid, n)
            sides = [cells(x, INDEX_CELL * delta, s) for s in ((-delta, delta) if probing else (0.0,))]
            for k, (i, j) in enumerate(pairs):
                for u in sides:
                    for v in sides:
                        fresh = there[:, i] & there[:, j]
                        if u is not sides[0]:
                            fresh &= u[:, i] != sides[0][:, i]
                        if v is not sides[0]:
                            fresh &= v[:, j] != sides[0][:, j]
                        r = np.flatnonzero(fresh)
                        add(r, _mix(_mix(_mix(star[r] ^ salt[len(names) + k]) ^ u[r, i]) ^ v[r, j]), k, 0)
            r = np.concatenate(rows)
            out = [np.concatenate(keys).view(np.int64), of_class[r], np.concatenate(what).astype(np.int8), np.concatenate(weight).astype(np.int8), present[r].astype(np.int32)]
            yield from pa.Table.from_arrays([pa.array(c) for c in out], names=["key", "class", "what", "weight", "present"]).to_batches(max_chunksize=20_000)

    plain = records.select(F.xxhash64("star").alias("star"), "class", *names)
    return plain.mapInArrow(make, "key bigint, class bigint, what tinyint, weight tinyint, present int")


def agree(a: str, b: str, features: tuple[str, ...], tolerance: float, least: int) -> Column:
    """For features in columns that begin with a and b: at least `least` are present in both, and each of these differs by at most the tolerance times the larger absolute value; an infinite one must be equal."""
    n = " + ".join(f"int({a}{f} IS NOT NULL AND {b}{f} IS NOT NULL)" for f in features)
    big = "double('Infinity')"
    close = " AND ".join(f"coalesce({a}{f} = {b}{f} OR (abs({a}{f} - {b}{f}) <= greatest(abs({a}{f}), abs({b}{f})) * {tolerance!r}D AND abs({a}{f}) < {big} AND abs({b}{f}) < {big}), true)" for f in features)
    return F.expr(f"{n} >= {least} AND {close}")


def with_star(rows: DataFrame, host: str, links: DataFrame, spread: str) -> DataFrame:
    """rows with star for each star that their host names (as a rule one); rows that name none go."""
    named = rows.withColumn("_at", designation(F.col(host))).where("_at IS NOT NULL")
    stars = star_keys(named.select(F.col("_at").alias("designation")).distinct(), links).groupBy(F.col("designation").alias("_at")).agg(F.collect_set("star").alias("_stars"))
    return lookup(named, stars, "_at", spread).withColumn("star", F.explode("_stars")).drop("_at", "_stars")


def overlapping(rows: DataFrame, catalog: DataFrame, features: tuple[str, ...] = FEATURES, flags: tuple[str, ...] = FLAGS, tolerance: float = 0.01, least: int = 8, likely: float = 0.5, hot: int = 1000) -> DataFrame:
    """(eval_id, train_id, split, author, shared): rows of validation or test and rows of train of one star whose features agree.

    shared is the overlap fraction: the part of the evaluation row's tokens in chunks that both have on one grid, the larger of the two. It doesn't decide: pairs from a fraction of `likely` on, and pairs that the index finds,
    are compared exactly. Missing features (NULL or NaN) are passed over. Rows that name no star, or have
    another split or none (in any letter case), or no label_id, overlap with nothing. Rows with exactly the same features are one class, compared once and
    expanded at the end, so heaps of copies cost no more than their pairs. Keys that more than 1/hot of the training rows have are joined in parts of no more. Further columns are left out; an empty table gives an empty result.
    """
    measures = tuple(f for f in features if f not in flags)
    groups = least - sum(f in flags for f in features) - 1
    if groups < 1:
        raise ValueError(f"{least} features in common are too few for an index of measured ones")
    links = catalog_links(catalog)
    side = F.lower(F.trim("split"))
    base = rows.where("label_id IS NOT NULL").select("label_id", "author", side.alias("split"), "host_star", *(known(F.col(f).cast("double")).alias(f) for f in features)).where(F.col("split").isin("train", "validation", "test")).withColumn("train", F.col("split") == "train")
    starred = with_star(base, "host_star", links, "label_id")
    # 128 bits stand for a star and its features; 0.0 and -0.0 are the same
    text = " + ".join(f"shiftleft(int({f} IS NOT NULL), {k})" for k, f in enumerate(features)) + "".join(f", {f} + 0.0D" for f in features)
    with scratch(rows.sparkSession) as keep:
        members = keep(starred.select("label_id", "author", "split", "train", "star", F.expr(f"xxhash64(1, star, {text})").alias("class"), F.expr(f"xxhash64(2, star, {text})").alias("more"), *features))
        classes = keep(members.groupBy("star", "train", "class", "more").agg(*(F.first(f).alias(f) for f in features)))
        ours, theirs = (_digests(classes.where(f"train = {t}"), measures, groups, tolerance, not t) for t in (False, True))
        # keys that more than a given part of the training rows has, which only keys of stars with as many of them can be
        per_star = classes.where("train").groupBy("star").agg(F.count("*").alias("n"))
        most = per_star.select((F.greatest(F.sum("n"), F.lit(1_000_000)) / hot).alias("most"))
        large = F.broadcast(per_star.join(F.broadcast(most)).where("n > most").select("star"))  # fewer than `hot`
        inner = _digests(classes.where("train").join(large, "star", "left_semi"), measures, groups, tolerance, False)
        common = F.broadcast(inner.groupBy("key").count().join(F.broadcast(most)).where("count > most").select("key", F.expr("ceil(count / most)").alias("parts")))  # a few for each of those stars' share
        part = lambda df, of: df.join(common, "key", "left").withColumn("part", F.expr(of))
        left = part(ours, "explode(sequence(0L, coalesce(parts, 1L) - 1))")
        right = part(theirs, "pmod(class, coalesce(parts, 1L))").select("key", "part", F.col("class").alias("train_class"), F.col("present").alias("train_present"))
        met = left.join(right, ["key", "part"])
        met = met.groupBy("class", "train_class", F.expr("present & train_present").alias("both"), "present").agg(F.expr("bit_or(CASE WHEN what >= 0 THEN shiftleft(1L, int(what)) ELSE 0L END)").alias("found"), *(F.sum(F.expr(f"CASE WHEN what = {-1 - g} THEN int(weight) ELSE 0 END")).alias(f"grid{g}") for g in range(2)))
        due = " + ".join(f"int(both & {(1 << i) | (1 << j)} = {(1 << i) | (1 << j)})" for i, j in index_groups(len(measures), groups))
        shared = F.greatest("grid0", "grid1") / F.bit_count("present")
        close = met.withColumn("shared", shared).where((F.col("shared") >= likely) | ((F.col("found") != 0) & (F.bit_count("found") == F.expr(due)))).select("class", "train_class", "shared")
        of = lambda t, p, x: classes.where(f"train = {t}").select(*(F.col(c).alias(p + c) for c in ("star", "class", "more")), *(F.col(f).alias(x + f) for f in features))
        pairs = close.join(of(False, "", "x_"), "class").join(of(True, "train_", "y_"), "train_class").where("star = train_star").where(agree("x_", "y_", features, tolerance, least)).select("class", "more", "train_class", "train_more", "shared")
        found = members.where("NOT train").select(F.col("label_id").alias("eval_id"), "split", "author", "class", "more").join(pairs, ["class", "more"])
        train = members.where("train").select(F.col("label_id").alias("train_id"), F.col("class").alias("train_class"), F.col("more").alias("train_more"))
        return kept(found.join(train, ["train_class", "train_more"]).groupBy("eval_id", "train_id").agg(F.first("split").alias("split"), F.first("author").alias("author"), F.max("shared").alias("shared")))


def targets_in_train(rows: DataFrame, targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """(target_no, label_id, author): each target and each row of train whose host names the same star. NULL numbers and strings that name no star give nothing."""
    links = catalog_links(catalog)
    train = rows.where((F.lower(F.trim("split")) == "train") & F.col("label_id").isNotNull()).select("label_id", "author", designation(F.col("host_star")).alias("designation"))
    sought = targets.where("target_no IS NOT NULL").select("target_no", designation(F.col("target_id")).alias("target"))
    a = star_keys(sought.select("target").distinct(), links, "target")
    b = star_keys(train.select("designation").distinct(), links)
    hosts = sought.join(a.join(b, "star").select("target", "designation").distinct(), "target").select("target_no", "designation").distinct()
    return hosts.join(train, "designation").select("target_no", "label_id", "author").dropDuplicates(["target_no", "label_id"])
