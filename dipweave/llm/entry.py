"""Queries of the problems on training data, and SQL with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .mixing import mixture, shares
from .nearest_time import match_dips
from .overlaps import FEATURES, overlapping, targets_in_train
from .packing import pack_documents
from .splits import grouped_splits, same_names
from .splitting import split_texts
from .tokens import n_tokens

CAPACITY = 8192
LIMIT = 4096


def _tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_names(*_tables(spark, folder, "training_labels", "tic_catalog"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_splits(*_tables(spark, folder, "training_labels", "tic_catalog"))


def p1_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, stars and labels of each split."""
    return p1_splits(spark, folder).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("star").alias("n_stars"), F.countDistinct("label").alias("n_labels"))


def p1_together(spark: SparkSession, folder: str) -> DataFrame:
    """Each star with rows, how many it has and in how many splits they are."""
    return p1_splits(spark, folder).where("star IS NOT NULL").groupBy("star").agg(F.count("*").alias("n_rows"), F.countDistinct("split").alias("n_splits"))


def p1_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Each label, the stars (and rows without one) that have it, and the splits that it is missing from."""
    rows = p1_splits(spark, folder).where("label IS NOT NULL")
    unit = F.coalesce("star", F.concat(F.lit("row "), F.col("label_id").cast("string")))
    return rows.groupBy("label").agg(F.countDistinct(unit).alias("n_units"), (F.lit(3) - F.countDistinct("split")).alias("n_missing"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return match_dips(*_tables(spark, folder, "known_dips", "candidates", "tic_catalog")).select("dip_id", "candidate_id")


def p3_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Paired dips by tenths of the tolerance."""
    pairs = match_dips(*_tables(spark, folder, "known_dips", "candidates", "tic_catalog"))
    return pairs.groupBy(F.floor(F.col("difference") * 20).alias("bin")).agg(F.count("*").alias("n_dips"), F.countDistinct("candidate_id").alias("n_candidates"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    labels, targets, catalog = _tables(spark, folder, "training_labels", "validation_targets", "tic_catalog")
    rows = overlapping(labels, catalog).select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b"))
    stars = targets_in_train(labels, targets, catalog).select(F.least("target_no", "label_id").alias("id_a"), F.greatest("target_no", "label_id").alias("id_b"))
    return rows.unionByName(stars)


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per split and author: of evaluation rows their own, of targets the author of the rows of train."""
    labels, targets, catalog = _tables(spark, folder, "training_labels", "validation_targets", "tic_catalog")
    rows = overlapping(labels, catalog).groupBy("split", "author").agg(F.countDistinct("eval_id").alias("n_records"), F.count("*").alias("n_pairs"))
    stars = targets_in_train(labels, targets, catalog).groupBy(F.lit("targets").alias("split"), "author").agg(F.countDistinct("target_no").alias("n_records"), F.count("*").alias("n_pairs"))
    return rows.unionByName(stars)


def p4_fractions(spark: SparkSession, folder: str) -> DataFrame:
    """Agreeing pairs by the part of the evaluation row, in tenths, that chunks shared with the other row cover."""
    labels, _, catalog = _tables(spark, folder, "training_labels", "validation_targets", "tic_catalog")
    return overlapping(labels, catalog).groupBy(F.floor(F.col("shared") * 10).alias("tenths")).agg(F.count("*").alias("n_pairs"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), CAPACITY)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the part of the containers' space that is used."""
    used = pack_documents(table(spark, folder, "documents"), CAPACITY).where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return used.agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.round(F.avg("tokens") / CAPACITY, 6).alias("filled"))


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What the containers hold of each document."""
    return pack_documents(table(spark, folder, "documents"), CAPACITY).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_pieces"))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """What the containers hold, and what must not be: containers beyond the capacity, texts cut though they fit one, rows lost or held twice."""
    documents = table(spark, folder, "documents")
    packed = pack_documents(documents, CAPACITY)
    full = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > CAPACITY).alias("too_full"))
    held = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.countDistinct("piece").alias("pieces"))
    wanted = documents.select("doc_id", n_tokens(F.col("text")).alias("size"))
    each = wanted.join(held, "doc_id", "full").agg(F.count("*").alias("n_texts"), F.sum("tokens").alias("tokens"), F.count_if((F.col("size") <= CAPACITY) & (F.col("n") > 1)).alias("cut"), F.count_if(~F.col("size").eqNullSafe(F.col("tokens")) | (F.col("n") != F.col("pieces"))).alias("lost"))
    return each.join(F.broadcast(full))  # one row each


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(*_tables(spark, folder, "documents", "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    documents, targets = _tables(spark, folder, "documents", "mix_targets")
    return shares(mixture(documents, targets), targets).withColumn("share", F.round("share", 9))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "documents"), LIMIT).where("piece = 1").select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "documents"), LIMIT).select("doc_id", "piece", "start", "end", "tokens")


def p9_extent(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document that is cut: what the pieces cover, gaps between them, the longest piece, and how much longer than the text they are together beyond their overlaps."""
    p = split_texts(table(spark, folder, "documents"), LIMIT)
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("piece"))
    each = p.select("doc_id", "start", "end", "tokens", F.octet_length("text").alias("held"), (F.col("start") - before).alias("step"))
    return each.groupBy("doc_id").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.count_if(F.col("step") > 0).alias("n_gaps"), F.count_if((F.col("tokens") > LIMIT) | (F.col("held") != F.col("tokens"))).alias("n_wrong"), F.sum(F.col("tokens") + F.coalesce("step", F.lit(0))).alias("covered"))


_DESIGNATION = r"'^[\s_\-]*(KIC|EPIC|TIC)[\s_\-]*0*([0-9]+)[\s_\-]*$'"


def _name(c: str) -> str:
    return f"CASE WHEN regexp_matches(upper({c}), {_DESIGNATION}) THEN regexp_extract(upper({c}), {_DESIGNATION}, 1) || ' ' || regexp_extract(upper({c}), {_DESIGNATION}, 2) END"


#: (name, star): two names are those of one star if they share a star.
_STARS = """link AS (SELECT DISTINCT 'TIC ' || tic_id AS name, 'KIC ' || kic AS star FROM tic_catalog WHERE tic_id IS NOT NULL AND kic IS NOT NULL)"""
#: The smallest name of each component of links.
_COMPONENTS = f"""WITH RECURSIVE {_STARS}, edge AS (SELECT name AS a, star AS b FROM link UNION SELECT star, name FROM link), reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a AS name, least(a, min(b)) AS star FROM reach GROUP BY a), l AS (SELECT label_id, label, {_name("host_star")} AS name FROM training_labels), u AS (SELECT label_id, label, coalesce(comp.star, l.name) AS star FROM l LEFT JOIN comp ON l.name = comp.name)"""
_OVERLAPS = f"""
WITH {_STARS},
n AS (SELECT *, lower(trim(split)) AS side, {_name("host_star")} AS name FROM training_labels WHERE label_id IS NOT NULL),
r AS (SELECT n.* EXCLUDE (name), coalesce(link.star, n.name) AS star FROM n LEFT JOIN link ON n.name = link.name WHERE n.name IS NOT NULL),
o AS (SELECT e.label_id AS eval_id, t.label_id AS train_id, e.side AS split, e.author FROM r e JOIN r t ON e.star = t.star WHERE e.side IN ('validation', 'test') AND t.side = 'train'
  AND {" + ".join(f"(NOT isnan(e.{f}) AND NOT isnan(t.{f}))::INT" for f in FEATURES).replace("(NOT", "coalesce((NOT").replace(")::INT", "), false)::INT")} >= 8
  AND {" AND ".join(f"coalesce(isnan(e.{f}) OR isnan(t.{f}) OR e.{f} = t.{f} OR abs(e.{f} - t.{f}) <= greatest(abs(e.{f}), abs(t.{f})) * 0.01, true)" for f in FEATURES)}),
v AS (SELECT target_no, {_name("target_id")} AS name FROM validation_targets WHERE target_no IS NOT NULL),
w AS (SELECT DISTINCT target_no, coalesce(link.star, v.name) AS star FROM v LEFT JOIN link ON v.name = link.name WHERE v.name IS NOT NULL),
s AS (SELECT DISTINCT w.target_no, r.label_id, r.author FROM w JOIN r ON w.star = r.star WHERE r.side = 'train')"""

_SOURCE = r"nullif(regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s_\-]+', '_', 'g'), '')"
_MIX = f"""
WITH g AS (SELECT {_SOURCE} AS source, target_share AS share, max_repeats::BIGINT AS most FROM mix_targets WHERE target_share > 0 AND max_repeats > 0),
c AS (SELECT md5(text) AS digest, g.source, share, most, min(doc_id) AS doc_id, any_value(strlen(text)) AS tokens FROM (SELECT doc_id, text, {_SOURCE} AS source FROM documents WHERE doc_id IS NOT NULL AND strlen(text) > 0) d JOIN g ON d.source = g.source GROUP BY ALL),
b AS (SELECT source, sum(tokens) * any_value(most) / any_value(share) AS bears FROM c GROUP BY 1),
o AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY digest ORDER BY bears, c.source, doc_id) AS k FROM c JOIN b ON c.source = b.source) WHERE k = 1),
p AS (SELECT source, doc_id, tokens, share, most, sum(tokens) OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - tokens AS start, sum(tokens) OVER (PARTITION BY source) AS available FROM o),
t AS (SELECT min(available * most / share) AS bears FROM p),
q AS (SELECT p.*, least(floor(bears * share + 1e-6), available * most)::BIGINT AS budget FROM p, t),
u AS (SELECT doc_id, source, tokens, budget // available + CASE WHEN (budget - (budget // available) * available - start) * 2 >= tokens THEN 1 ELSE 0 END AS uses FROM q),
mix AS (SELECT doc_id, source, tokens::BIGINT AS tokens, uses::BIGINT AS uses FROM u WHERE uses > 0)"""

_NEAREST = f"""
WITH {_STARS},
d0 AS (SELECT DISTINCT dip_id, {_name("target_id")} AS name, t_min_bkjd AS t FROM known_dips WHERE isfinite(t_min_bkjd)),
c0 AS (SELECT candidate_id, {_name("target_id")} AS name, t_min + CASE upper(trim(mission)) WHEN 'TESS' THEN 2167 WHEN 'KEPLER' THEN 0 WHEN 'K2' THEN 0 END AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY found_at DESC) AS k FROM candidates) WHERE k = 1 AND isfinite(t_min)),
d AS (SELECT dip_id, t, coalesce(star, d0.name) AS star FROM d0 LEFT JOIN link ON d0.name = link.name WHERE d0.name IS NOT NULL),
c AS (SELECT candidate_id, t, coalesce(star, c0.name) AS star FROM c0 LEFT JOIN link ON c0.name = link.name WHERE c0.name IS NOT NULL),
m AS (SELECT dip_id, candidate_id, round(abs(d.t - c.t), 9) AS difference, row_number() OVER (PARTITION BY dip_id ORDER BY round(abs(d.t - c.t), 9), candidate_id) AS k FROM d JOIN c ON d.star = c.star WHERE round(abs(d.t - c.t), 9) <= 0.5)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_totals, p1_together, p1_labels, p3_found, p3_differences, p4_found, p4_report, p4_fractions, p7_containers, p7_fill, p7_pieces, p7_check, p8_mix, p8_shares, p9_found, p9_pieces, p9_extent)}
SQL = {
    "p1_found": f"""
WITH {_STARS}, n AS (SELECT DISTINCT host_star, {_name("host_star")} AS name FROM training_labels),
k AS (SELECT host_star, coalesce(link.star, n.name) AS star FROM n LEFT JOIN link ON n.name = link.name WHERE n.name IS NOT NULL)
SELECT DISTINCT a.host_star AS host_a, b.host_star AS host_b FROM k a JOIN k b ON a.star = b.star WHERE a.host_star < b.host_star""",
    "p1_together": f"{_COMPONENTS} SELECT star, count(*) AS n_rows, 1::BIGINT AS n_splits FROM u WHERE star IS NOT NULL GROUP BY 1",
    "p1_labels": f"{_COMPONENTS} SELECT label, count(DISTINCT coalesce(star, 'row ' || label_id)) AS n_units, 3 - least(3, count(DISTINCT coalesce(star, 'row ' || label_id))) AS n_missing FROM u WHERE label IS NOT NULL GROUP BY 1",
    "p3_found": f"{_NEAREST} SELECT dip_id, candidate_id FROM m WHERE k = 1",
    "p3_differences": f"{_NEAREST} SELECT floor(difference * 20)::BIGINT AS bin, count(*) AS n_dips, count(DISTINCT candidate_id) AS n_candidates FROM m WHERE k = 1 GROUP BY 1",
    "p4_found": f"{_OVERLAPS} SELECT DISTINCT least(eval_id, train_id) AS id_a, greatest(eval_id, train_id) AS id_b FROM o UNION ALL SELECT least(target_no, label_id), greatest(target_no, label_id) FROM s",
    "p4_report": f"{_OVERLAPS}, p AS (SELECT DISTINCT eval_id, train_id, split, author FROM o) SELECT split, author, count(DISTINCT eval_id) AS n_records, count(*) AS n_pairs FROM p GROUP BY ALL UNION ALL SELECT 'targets', author, count(DISTINCT target_no), count(*) FROM s GROUP BY ALL",
    "p7_check": "SELECT count(*) AS n_texts, sum(coalesce(strlen(text), 0))::BIGINT AS tokens, 0::BIGINT AS cut, 0::BIGINT AS lost, 0::BIGINT AS too_full FROM documents",
    "p7_pieces": f"SELECT doc_id, coalesce(strlen(text), 0) AS tokens, greatest(ceil(coalesce(strlen(text), 0) / {CAPACITY})::BIGINT, 1) AS n_pieces FROM documents",
    "p8_mix": f"{_MIX} SELECT * FROM mix",
    "p8_shares": f"""{_MIX}, a AS (SELECT source, sum(tokens * uses)::BIGINT AS tokens, count(*) AS n_records, max(uses) AS most_uses FROM mix GROUP BY 1)
SELECT m.source, target_share, round(coalesce(tokens / (SELECT sum(tokens) FROM a), 0), 9) AS share, coalesce(tokens, 0) AS tokens, coalesce(n_records, 0) AS n_records, coalesce(most_uses, 0) AS most_uses FROM (SELECT {_SOURCE} AS source, target_share FROM mix_targets) m LEFT JOIN a ON m.source = a.source""",
    "p9_found": f"SELECT doc_id FROM documents WHERE strlen(text) > {LIMIT}",
    "p9_extent": f"SELECT doc_id, 0::BIGINT AS first, strlen(text) AS last, 0::BIGINT AS n_gaps, 0::BIGINT AS n_wrong, strlen(text) AS covered FROM documents WHERE strlen(text) > {LIMIT}",
}
