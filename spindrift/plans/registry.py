"""Queries of the core library and their DuckDB equivalents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import fingerprints, hierarchy, projection, snapshots, terms, vectors
from spindrift.sources import files
from spindrift.streaming import windows

LEAST = 0.15
APART = 15
GROUPED = 18
GAMMA = 0.5
LARGEST = 50
SHEET = 1000.0, 600.0


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def group_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of each component of the vectors of a label."""
    out = vectors.group_centroids(_table(spark, folder, "embeddings"), "label", "embedding")
    return out.select("label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    items = _table(spark, folder, "embeddings")
    return vectors.similarities(items, "vec_id", "embedding", vectors.centroid_vectors(items, "label", "embedding"), "label")


def centroid_zscores(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of every vector with every label's centroid, standardised within the label."""
    return vectors.standardised(_scores(spark, folder), "label").select("vec_id", "label", F.round("sim", 6).alias("sim"), F.round("z", 5).alias("z"))


def nearest_centroid_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many vectors are nearest to each label's centroid, and how many near none (label null)."""
    items = _table(spark, folder, "embeddings")
    best = vectors.nearest_groups(items, "vec_id", "embedding", vectors.centroid_vectors(items, "label", "embedding"), "label", LEAST)
    return best.groupBy("label").agg(F.count("*").alias("n"))


def _prints(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "embeddings").select("vec_id", fingerprints.sign_fingerprint("embedding").alias("h"))


def hamming_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors whose sign fingerprints are at most 15 bits apart; of equal fingerprints the smallest vec_id stands for all and is paired with each."""
    return fingerprints.hamming_pairs(_prints(spark, folder), "vec_id", "h", APART)


def near_copy_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of vectors that chains of fingerprints at most 18 bits apart link, named by their smallest vec_id."""
    return fingerprints.near_copy_groups(_prints(spark, folder), "vec_id", "h", GROUPED)


def mmd_with_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Discrepancy of all pairs between the vectors with a positive first component and the others, and between two halves of the first."""
    out = vectors.feature_mmd(_table(spark, folder, "embeddings"), "vec_id", "embedding", F.get("embedding", F.lit(0)) > 0, GAMMA)
    return out.select("n_first", "n_second", F.round("mmd2", 6).alias("mmd2"), F.round("baseline", 6).alias("baseline"))


def embedding_components(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest variances of the vectors along principal components."""
    _, _, variance = vectors.principal_components(_table(spark, folder, "embeddings"), "embedding", 10)
    return spark.createDataFrame([(k + 1, round(float(v), 9)) for k, v in enumerate(variance)], "component int, variance double")


def linear_mmd(spark: SparkSession, folder: str) -> DataFrame:
    """Linear-time discrepancy between the vectors with a positive first component and the others."""
    out = vectors.linear_mmd(_table(spark, folder, "embeddings"), "vec_id", "embedding", F.get("embedding", F.lit(0)) > 0, GAMMA)
    return out.select("n_pairs", F.round("mmd2", 6).alias("mmd2"))


def language_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The ten words that tell each language's documents from the others'."""
    return terms.group_terms(_table(spark, folder, "documents"), "lang", "text", 10, 2).select("lang", "rank", "term", "n_texts", F.round("weight", 6).alias("weight"))


def snapshot_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's last event in the lower half of the event_ids' range against that in the upper half."""
    events = _table(spark, folder, "events")
    ends = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    middle = F.lit(ends["low"] + (ends["high"] - ends["low"]) // 2 if ends["low"] is not None else None).cast("long")

    def last(part: DataFrame) -> DataFrame:
        return part.groupBy("user_id").agg(F.max("event_id").alias("version"))

    return snapshots.reconcile(last(events.where(F.col("event_id") <= middle)), last(events.where(F.col("event_id") > middle)), "user_id", "version")


def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events and their values by hour and kind."""
    return windows.event_windows(_table(spark, folder, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def _label_means(spark: SparkSession, folder: str) -> tuple[list, list, list]:
    """Labels, a bounded set, with their means and sizes."""
    items = _table(spark, folder, "embeddings").where("label is not null")
    means = vectors.group_centroids(items, "label", "embedding").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))
    rows = means.join(items.groupBy("label").agg(F.count("*").alias("n")), "label").orderBy("label").limit(hierarchy.MOST_POINTS + 1).collect()
    return [r["label"] for r in rows], [[x["value"] for x in r["s"]] for r in rows], [r["n"] for r in rows]


def label_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Ward merges of the labels' centroids, weighted by their sizes."""
    _, means, sizes = _label_means(spark, folder)
    merges = hierarchy.linkage(means, sizes)
    return spark.createDataFrame([(i, a, b, round(h, 6), int(w)) for i, (a, b, h, w) in enumerate(merges)], "step int, low int, high int, height double, n long")


def label_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of each label when Ward's and the average linkage tree are cut to every number of clusters."""
    labels, means, sizes = _label_means(spark, folder)
    rows = []
    for method in ("ward", "average"):
        merges = hierarchy.linkage(means, sizes, method)
        rows += [(method, k, label, c) for k in range(1, len(labels) + 1) for label, c in zip(labels, hierarchy.cut(merges, len(labels), k))]
    kind = dict(_table(spark, folder, "embeddings").dtypes)["label"]
    return spark.createDataFrame(rows, f"method string, k int, label {kind}, cluster int")


def label_order(spark: SparkSession, folder: str) -> DataFrame:
    """The labels in the order of least distances between neighbours that the average linkage tree of their centroids allows, and their places on a map."""
    labels, means, sizes = _label_means(spark, folder)
    kind = dict(_table(spark, folder, "embeddings").dtypes)["label"]
    shape = f"place int, label {kind}, x double, y double"
    if not labels:
        return spark.createDataFrame([], shape)
    points = np.array(means)
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    spots = projection.tsne(points, perplexity=max(2.0, len(labels) / 4)).tolist()
    order = hierarchy.leaf_order(hierarchy.linkage(means, sizes, "average"), apart)
    return spark.createDataFrame([(place, labels[k], *[round(v, 4) for v in spots[k]]) for place, k in enumerate(order)], shape)


def source_treemap(spark: SparkSession, folder: str) -> DataFrame:
    """Rectangles of the largest sources of documents and one of all the others (rest) on a sheet."""
    sizes = _table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"))
    rows = [(r["source"], False, 1, r["n"]) for r in sizes.orderBy(F.desc("n"), "source").limit(LARGEST).collect()]
    whole = sizes.agg(F.count("*").alias("sources"), F.sum("n").alias("n")).first()
    if whole["sources"] > len(rows):
        rows.append((None, True, whole["sources"] - len(rows), whole["n"] - sum(r[3] for r in rows)))
    boxes = hierarchy.treemap([r[3] for r in rows], *SHEET)
    return spark.createDataFrame([(*r, *[round(v, 4) for v in b]) for r, b in zip(rows, boxes)], "source string, rest boolean, n_sources long, n long, x double, y double, w double, h double")


def table_files(spark: SparkSession, folder: str) -> DataFrame:
    """Name and size of the Parquet files of the folder."""
    return files.files(spark, folder, ("parquet",)).select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), "n_bytes")


_ALL = (group_centroids, centroid_zscores, nearest_centroid_counts, hamming_pairs, near_copy_groups, linear_mmd, mmd_with_baseline, embedding_components, language_terms, snapshot_changes, hourly_events, label_tree, label_cuts, label_order, source_treemap, table_files)
QUERIES = {f.__name__: f for f in _ALL}

_MEANS = """
each AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
means AS (SELECT label, pos, avg(x) AS value FROM each GROUP BY label, pos)"""
_SCORES = f"""{_MEANS},
norms AS (SELECT label, sqrt(sum(value * value)) AS norm FROM means GROUP BY label),
units AS (SELECT label, pos, value / norm AS value FROM means JOIN norms USING (label)),
size AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM each GROUP BY vec_id),
scores AS (SELECT e.vec_id, u.label, sum(e.x * u.value) / any_value(s.norm) AS sim FROM each e JOIN units u ON e.pos = u.pos JOIN size s ON s.vec_id = e.vec_id GROUP BY e.vec_id, u.label)"""
_PRINTS = "SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings"
_KERNEL = "exp(-0.5 * list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
ORACLES = {
    "group_centroids": f"WITH {_MEANS} SELECT label, pos, round(value, 6) AS value FROM means",
    "centroid_zscores": f"""WITH {_SCORES}, stats AS (SELECT label, avg(sim) AS m, stddev_pop(sim) AS sd FROM scores GROUP BY label)
SELECT vec_id, label, round(sim, 6) AS sim, round(CASE WHEN sd > 0 THEN (sim - m) / sd ELSE 0 END, 5) AS z FROM scores JOIN stats USING (label)""",
    "nearest_centroid_counts": f"""WITH {_SCORES}, best AS (SELECT vec_id, label, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM scores)
SELECT CASE WHEN sim >= {LEAST} THEN label END AS label, count(*) AS n FROM best WHERE r = 1 GROUP BY 1""",
    "hamming_pairs": f"""WITH p AS ({_PRINTS}), r AS (SELECT *, min(vec_id) OVER (PARTITION BY s) AS first FROM p),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, len(list_filter(list_zip(a.s, b.s), lambda x: x[1] <> x[2])) AS distance FROM r a JOIN r b ON a.vec_id < b.vec_id WHERE a.vec_id = a.first AND (b.vec_id = b.first OR b.first = a.vec_id))
SELECT a, b, CAST(distance AS INTEGER) AS distance FROM d WHERE distance <= {APART}""",
    "near_copy_groups": f"""WITH RECURSIVE p AS ({_PRINTS}), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE len(list_filter(list_zip(a.s, b.s), lambda x: x[1] <> x[2])) <= {GROUPED}),
r AS (SELECT DISTINCT a AS id, a AS seen FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a)
SELECT id AS vec_id, min(seen) AS component FROM r GROUP BY id""",
    "linear_mmd": f"""WITH s AS (SELECT embedding[1] > 0 AS first, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY embedding[1] > 0 ORDER BY vec_id) - 1 AS r FROM embeddings),
q AS (SELECT first, r // 2 AS q, max(CASE WHEN r % 2 = 0 THEN v END) AS v1, max(CASE WHEN r % 2 = 1 THEN v END) AS v2 FROM s GROUP BY first, r // 2 HAVING count(*) = 2)
SELECT count(*) AS n_pairs, round(avg({_KERNEL.format('x.v1', 'x.v2')} + {_KERNEL.format('y.v1', 'y.v2')} - {_KERNEL.format('x.v1', 'y.v2')} - {_KERNEL.format('x.v2', 'y.v1')}), 6) AS mmd2
FROM q x JOIN q y ON x.q = y.q AND x.first AND NOT y.first""",
    "language_terms": """WITH w AS (SELECT DISTINCT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS term FROM documents),
c AS (SELECT lang, term, count(*) AS n_texts FROM w WHERE length(term) > 1 AND lang IS NOT NULL GROUP BY lang, term),
z AS (SELECT lang, count(*) AS size FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang), g AS (SELECT term, count(*) AS n_groups FROM c GROUP BY term),
t AS (SELECT lang, term, n_texts, round(n_texts / size * ln((SELECT count(*) FROM z) / n_groups), 9) AS weight FROM c JOIN z USING (lang) JOIN g USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM t)
SELECT lang, CAST(rank AS INTEGER) AS rank, term, n_texts, round(weight, 6) AS weight FROM r WHERE rank <= 10""",
    "snapshot_changes": """WITH m AS (SELECT min(event_id) + (max(event_id) - min(event_id)) // 2 AS middle FROM events),
a AS (SELECT user_id, max(event_id) AS v FROM events, m WHERE event_id <= middle GROUP BY user_id), b AS (SELECT user_id, max(event_id) AS v FROM events, m WHERE event_id > middle GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'modified' ELSE 'kept' END AS status
FROM a FULL JOIN b ON a.user_id IS NOT DISTINCT FROM b.user_id""",
    "hourly_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
