"""Core queries against DuckDB on the tables of the environment, and small cases."""
import os
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from spindrift.functions import shared
from spindrift.operators import fingerprints, graph, hierarchy, images, projection, snapshots, terms, vectors
from spindrift.plans import registry
from spindrift.sources import files
from spindrift.streaming import windows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _rows(frame):
    return sorted((tuple(None if v is None else str(v) if not isinstance(v, float) else round(v, 4) + 0.0 for v in r) for r in frame), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for table in ("embeddings", "documents", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert _rows(got.select(*columns).collect()) == _rows(want)
    assert want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_constant_scores_have_z_zero(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.5), (1, "b", 0.0), (2, "b", 1.0)], "k int, g string, sim double")
    assert {(r.k, r.g): r.z for r in vectors.standardised(rows, "g").collect()} == {(1, "a"): 0, (2, "a"): 0, (1, "b"): -1, (2, "b"): 1}


def test_hamming_edges(spark):
    top = -(1 << 63)
    rows = spark.createDataFrame([(1, 0), (2, top), (3, 7), (4, 15)], "k long, h long")
    assert {tuple(r) for r in fingerprints.hamming_pairs(rows, "k", "h", 3).collect()} == {(1, 2, 1), (1, 3, 3), (3, 4, 1)}


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), ("z", None), ("w", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 5), ("n", 1)], "k string, v int")
    want = {"x": "kept", "y": "modified", "z": "kept", "w": "removed", "n": "added"}
    assert {r.k: r.status for r in snapshots.reconcile(a, b, "k", "v", trust_null=True).collect()} == want
    assert {r.k: r.status for r in snapshots.reconcile(a, b, "k", "v").collect()} == want | {"z": "modified"}
    one, none = spark.createDataFrame([(None, 1), ("x", None)], "k string, v int"), a.limit(0)
    assert {r.k: r.status for r in snapshots.reconcile(one, one, "k", "v").collect()} == {None: "kept", "x": "kept"}
    assert {r.status for r in snapshots.reconcile(one, none, "k", "v").collect()} == {"removed"} and snapshots.reconcile(none, none, "k", "v").collect() == []


def test_ward_is_the_least_increase():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 3))
    groups = {i: [i] for i in range(9)}
    cost = lambda g: ((x[g] - x[g].mean(0)) ** 2).sum()
    for step, (a, b, height, weight) in enumerate(hierarchy.ward(x)):
        least = min(cost(g + h) - cost(g) - cost(h) for i, g in groups.items() for j, h in groups.items() if i < j)
        mine = cost(groups[a] + groups[b]) - cost(groups[a]) - cost(groups[b])
        assert abs(mine - least) < 1e-9 and abs(height - np.sqrt(2 * mine)) < 1e-9
        groups[9 + step] = groups.pop(a) + groups.pop(b)
        assert weight == len(groups[9 + step])
    coarse, fine = hierarchy.cut(hierarchy.ward(x), 9, 3), hierarchy.cut(hierarchy.ward(x), 9, 4)
    assert len(set(coarse)) == 3 and len(set(zip(coarse, fine))) == 4


def test_treemap_areas():
    boxes = hierarchy.treemap([6, 6, 4, 3, 2, 2, 1], 6, 4)
    assert [round(w * h, 6) for _, _, w, h in boxes] == [6, 6, 4, 3, 2, 2, 1]
    assert all(-1e-9 <= x and x + w <= 6 + 1e-9 and -1e-9 <= y and y + h <= 4 + 1e-9 for x, y, w, h in boxes)


def test_stream_equals_table(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = windows.event_windows(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hours").start()
    query.processAllAvailable()
    query.stop()
    assert _rows(spark.table("hours").collect()) == _rows(windows.event_windows(source.withColumn("ts", source.ts.cast("timestamp"))).collect())


def test_ranks_are_places(spark):
    n = 200_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")).repartition(7)
    ranked = vectors._ranked(rows, "k")
    found = ranked.agg(F.countDistinct("r").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), F.sum((F.col("r") != F.col("k")).cast("int")).alias("wrong")).first()
    assert tuple(found) == (n, 0, n - 1, 0)
    runs = {tuple(vectors.linear_mmd(rows.repartition(k), "k", "v", F.col("k") % 2 == 0, 0.1).first()) for k in (3, 7, 11)}
    assert len({r[0] for r in runs}) == 1 and {r[0] for r in runs} == {n // 4} and len({round(r[1], 9) for r in runs}) == 1
    twice = spark.createDataFrame([(5, [1.0]), (5, [2.0]), (1, [3.0]), (5, [1.0])], "k long, v array<double>")
    assert sorted((r.r, r.k) for r in vectors._ranked(twice, "k").collect()) == [(0, 1), (1, 5), (2, 5), (3, 5)]


def _points(spark, n=400, dim=6, shift=0.4, seed=3):
    rng = np.random.default_rng(seed)
    first = rng.random(n) < 0.4
    x = rng.normal(size=(n, dim)) + shift * first[:, None]
    rows = [(i, bool(f), v.tolist()) for i, (f, v) in enumerate(zip(first, x))]
    return spark.createDataFrame(rows, "k long, f boolean, v array<double>"), x, first


def _mmd(x, y, gamma):
    k = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2))
    n, m = len(x), len(y)
    return (k(x, x).sum() - n) / (n * (n - 1)) + (k(y, y).sum() - m) / (m * (m - 1)) - 2 * k(x, y).mean()


def test_discrepancies_of_all_pairs(spark):
    frame, x, first = _points(spark)
    want = _mmd(x[first], x[~first], 0.05)
    exact = vectors.pairwise_mmd(frame, "k", "v", F.col("f"), 0.05).first()
    assert (exact.n_first, exact.n_second) == (first.sum(), (~first).sum()) and abs(exact.mmd2 - want) < 1e-12
    near = vectors.feature_mmd(frame, "k", "v", F.col("f"), 0.05, 4096).first()
    assert (near.n_first, near.n_second) == (first.sum(), (~first).sum())
    assert abs(near.mmd2 - want) < 0.15 * want and abs(near.baseline) < 0.15 * want  # far above two halves of one set
    odd = frame.union(spark.createDataFrame([(None, True, [1.0] * 6), (900, None, [1.0] * 6), (901, True, None), (902, True, [float("nan")] * 6), (903, True, [1.0])], frame.schema))
    again = vectors.feature_mmd(odd, "k", "v", F.col("f"), 0.05, 4096).first()
    assert abs(again.mmd2 - near.mmd2) < 1e-9
    none = vectors.feature_mmd(frame.limit(0), "k", "v", F.col("f"), 0.05).first()
    assert tuple(none) == (0, 0, None, None) and vectors.pairwise_mmd(frame.limit(1), "k", "v", F.col("f"), 0.05).first().mmd2 is None


def test_random_features_estimate_the_kernel():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 5))
    w, b = vectors.random_features(5, 200_000, 0.3)
    assert abs(2 * (np.cos(w @ x + b) * np.cos(w @ y + b)).mean() - np.exp(-0.3 * ((x - y) ** 2).sum())) < 0.01


def test_principal_components(spark):
    frame, x, _ = _points(spark, dim=5)
    x = x * [3, 1, 2, 0.5, 1]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    mean, axes, variance = vectors.principal_components(frame, "v", 3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(variance, s[:3] ** 2 / (len(x) - 1)) and np.allclose(np.abs(axes), np.abs(vt[:3]))
    odd = frame.union(spark.createDataFrame([(-1, None), (-2, [1.0]), (-3, [float("inf")] * 5)], frame.schema))
    got = {r.k: r.projection for r in vectors.projected(odd, "k", "v", 3).collect()}
    assert np.allclose([got[i] for i in range(len(x))], (x - x.mean(0)) @ axes.T) and [got[i] for i in (-1, -2, -3)] == [None] * 3
    assert len(vectors.principal_components(frame.limit(0), "v", 3)[1]) == 0


def test_nearest_groups(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2)
    centroids = spark.createDataFrame([(3, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (4, [0.0, -1.0]), (None, [1.0, 1.0])], "g int, centroid array<double>")
    items = spark.createDataFrame([(1, [0.0, 5.0]), (2, [3.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, -2.0]), (None, [2.0, 0.0]), (7, [None, 1.0])], "k long, v array<double>")
    got = {r.k: (r.g, round(r.sim, 3)) for r in vectors.nearest_groups(items, "k", "v", centroids, "g", 0.5).collect()}
    assert got == {1: (1, 1.0), 2: (3, 0.999), 3: (None, 0.0), 5: (None, 0.0), 6: (4, 1.0), None: (3, 1.0), 7: (None, 0.0)}
    scores = {(r.k, r.g): round(r.sim, 3) for r in vectors.similarities(items, "k", "v", centroids, "g").collect()}
    assert len(scores) == 7 * 4 and scores[2, 3] == 0.999 and scores[6, 4] == 1.0
    assert {r.g for r in vectors.nearest_groups(items, "k", "v", centroids.limit(0), "g", 0.5).collect()} == {None}
    with pytest.raises(ValueError):
        monkeypatch.setattr(vectors, "MOST_CENTROIDS", 2)
        vectors.similarities(items, "k", "v", centroids, "g")


@pytest.mark.parametrize(("n", "most"), [(50, 0), (50, 3), (400, 15), (10**6, 15), (10**7, 6)])
def test_bands_find_all_pairs(n, most):
    own = fingerprints.bands(n, most)
    assert sum(w for _, w, _ in own) <= 64
    rng = np.random.default_rng(n + most)
    for _ in range(300):
        flips = rng.choice(64, most, replace=False)
        assert any(sum(a <= f < a + w for f in flips) <= r for a, w, r in own)


def test_hamming_pairs_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**63), 2**63 - 1, 20)
    prints = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 9), replace=False)) for b in rng.choice(base, 150)]
    rows = [(i, h) for i, h in enumerate(prints)] + [(500 + i, prints[0]) for i in range(60)] + [(None, prints[0]), (800, None), (3, prints[3])]
    frame = spark.createDataFrame(rows, "k long, h long")
    first: dict = {}
    for k, h in sorted((r for r in rows if None not in r)):
        first.setdefault(h, k)
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(min(a, b), max(a, b), apart(g, h)) for g, a in first.items() for h, b in first.items() if a != b and apart(g, h) <= 7}
    want |= {(first[h], k, 0) for k, h in rows if k is not None and h is not None and first[h] != k}
    for bands in (None, [(0, 32, 3), (32, 32, 3)]):
        if bands:
            monkeypatch.setattr(fingerprints, "bands", lambda *a: bands)
        got = fingerprints.hamming_pairs(frame, "k", "h", 7).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        monkeypatch.undo()
    groups = {r.k: r.component for r in fingerprints.near_copy_groups(frame, "k", "h", 7).collect()}
    assert set(groups) == {x for a, b, _ in want for x in (a, b)} and all(groups[a] == groups[b] for a, b, _ in want) and all(groups[g] == g for g in groups.values())
    assert fingerprints.near_copy_groups(frame.limit(0), "k", "h", 7).collect() == []


def _groups_by_brute_force(rows, most):
    """The smallest key that links reach, for linked keys: of rows (key, fingerprint)."""
    k, h = np.array([r for r in rows if None not in r], dtype=np.int64).T
    a, b = np.nonzero((np.bitwise_count((h[:, None] ^ h).view(np.uint64)) <= most) & (k[:, None] != k))
    group = {int(x): int(x) for x in k[a]}
    links = [(int(x), int(y)) for x, y in zip(k[a], k[b])]
    while True:
        before = dict(group)
        for x, y in links:
            group[x] = group[y] = min(group[x], group[y])
        if group == before:
            return group


@pytest.mark.parametrize("many", [False, True])
def test_near_copy_groups_by_brute_force(spark, monkeypatch, many):
    """Sparse links, families that aren't linked, copies, keys with several fingerprints; of few fingerprints and of many, in blocks."""
    rng = np.random.default_rng(23)
    base = [0, -1, 0x00000000FFFFFFFF, -(1 << 63) | 0x7FFF0000FFFF]
    near = [int(np.uint64(b & (2**64 - 1)) ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False)))) for b in base for _ in range(150)]
    prints = [x - (1 << 64) if x >> 63 else x for x in near] + [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 500)]
    rows = [(5000 - i, h) for i, h in enumerate(prints)] + [(9000 + i, prints[0]) for i in range(40)] + [(None, 3), (8000, None), (4000, prints[900]), (4000, prints[901]), (8001, 1 << 40), (8001, 1 << 41)]
    if many:
        for name, value in {"AT_ONCE": 0, "BLOCK": 400, "CHUNK": 300, "WINDOW": 16, "_LINKS": 50, "_TILES": 2, "_FEW": 1 << 14, "_MANY": 1 << 18}.items():
            monkeypatch.setattr(fingerprints, name, value)
    for most in (18, 7):
        got = fingerprints.near_copy_groups(spark.createDataFrame(rows, "k long, h long"), "k", "h", most).collect()
        assert {r.k: r.component for r in got} == (want := _groups_by_brute_force(rows, most)) and len(got) == len(want)
    assert len(set(want.values())) > 3


def test_near_copy_groups_list_no_links(spark, monkeypatch):
    """700 fingerprints have 244,650 links; no table has more than a few rows for each."""
    sizes, table = [], shared.table
    monkeypatch.setattr(shared, "table", lambda *a, **b: (sizes.append((found := table(*a, **b)).count()), found)[1])
    rng = np.random.default_rng(3)
    prints = {sum(1 << int(x) for x in rng.choice(62, 4, replace=False)) for _ in range(720)}
    rows = list(enumerate(sorted(prints)))[:700]
    got = fingerprints.near_copy_groups(spark.createDataFrame(rows, "k long, h long"), "k", "h", 18).collect()
    assert {tuple(r) for r in got} == {(k, 0) for k, _ in rows} and max(sizes) <= 4 * len(rows)


def test_components_of_hubs_and_paths(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5060)] + [(7, 7), (None, 3), (4000, 4001), (4001, 4000)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(3000)} | {k: 5000 for k in range(5000, 5061)} | {4000: 4000, 4001: 4000}


def test_spread_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 900).alias("k"), F.col("id").alias("x"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("top"), F.lit(None).cast("int").alias("nothing")).where("k != 5")
    got = shared.spread_join(rows, table, ["k"], "n", 4, 5000)
    assert got.columns == ["k", "x", "top", "nothing"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = shared.spread_join(rows, table, ["k"], "n", 4, 5000)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"hashpartitioning\(k#\d+L?, _salt#\d+", plan)) == 2  # rows of heavy keys are dealt by the salt
    want = rows.join(table.drop("n"), "k")
    assert sorted(map(tuple, got.select("k", "x", "top").collect())) == sorted(map(tuple, want.select("k", "x", "top").collect()))


def test_average_linkage():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(8, 3)), rng.integers(1, 5, 8).astype(float)
    groups = {i: [i] for i in range(8)}
    mean = lambda g, h: sum(w[i] * w[j] * np.sqrt(((x[i] - x[j]) ** 2).sum()) for i in g for j in h) / (w[g].sum() * w[h].sum())
    for step, (a, b, height, weight) in enumerate(hierarchy.linkage(x, w, "average")):
        least = min(mean(g, h) for i, g in groups.items() for j, h in groups.items() if i < j)
        assert abs(height - least) < 1e-9 and abs(mean(groups[a], groups[b]) - least) < 1e-9
        groups[8 + step] = groups.pop(a) + groups.pop(b)
        assert weight == w[groups[8 + step]].sum()
    assert hierarchy.linkage([]) == [] and hierarchy.linkage([[1.0]]) == []
    with pytest.raises(ValueError):
        hierarchy.linkage(x, w, "other")


def test_label_cuts_are_nested(spark):
    rows = registry.label_cuts(spark, SF).collect()
    for method in ("ward", "average"):
        by = {k: {r.label: r.cluster for r in rows if r.method == method and r.k == k} for k in {r.k for r in rows}}
        for k, own in by.items():
            assert len(set(own.values())) == k
            if k + 1 in by:
                assert len({(by[k + 1][x], own[x]) for x in own}) == k + 1


def test_terms_of_odd_groups(spark):
    rows = [("a", "x yy yy"), ("a", None), ("b", "x Zz"), (None, "yy"), ("c", "")]
    frame = spark.createDataFrame(rows, "g string, t string")
    got = {(r.g, r.rank, r.term, r.n_texts) for r in terms.group_terms(frame, "g", "t", 1, 2).collect()}
    assert got == {("a", 1, "yy", 1), ("b", 1, "zz", 1)}
    assert terms.group_terms(frame.limit(0), "g", "t", 1).collect() == []


def test_treemap_has_all_documents(spark, monkeypatch):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for most in (50, 1):
        monkeypatch.setattr(registry, "LARGEST", most)
        rows = registry.source_treemap(spark, SF).collect()
        assert sum(r.n for r in rows) == n and abs(sum(r.w * r.h for r in rows) - 600_000) < 1


def _png(pixels):
    """An RGB image as a PNG file."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[i].astype(np.uint8).tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    pictures = {"a.PNG": rng.integers(0, 256, (40, 50, 3)), "deep/b.png": np.tile(np.arange(64)[:, None, None] * 4, (1, 64, 3))}
    (tmp_path / "deep").mkdir()
    for name, x in pictures.items():
        (tmp_path / name).write_bytes(_png(x))
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    names = lambda frame: sorted(r.path.rsplit("/", 1)[1] for r in frame.collect())
    assert names(files.image_files(spark, str(tmp_path))) == ["a.PNG", "b.png", "broken.jpg"]
    assert names(files.image_files(spark, str(tmp_path), recursive=False)) == ["a.PNG", "broken.jpg"]
    assert names(files.files(spark, str(tmp_path))) == ["a.PNG", "b.png", "broken.jpg", "notes.txt"]
    with pytest.raises(Exception):
        files.files(spark, str(tmp_path / "missing")).collect()
    decoded = files.decoded_images(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in decoded.collect()}
    assert {n: r.ok for n, r in got.items() if n != "notes.txt"} == {"a.PNG": True, "b.png": True, "broken.jpg": False}
    assert (got["a.PNG"].height, got["a.PNG"].width, got["a.PNG"].channels) == (40, 50, 3) and got["broken.jpg"].height is None
    found = {r.path.rsplit("/", 1)[1]: r for r in images.image_features(decoded, "path").collect()}
    for name, x in pictures.items():
        grey = x @ np.array([0.299, 0.587, 0.114])
        row = found[name.rsplit("/", 1)[-1]]
        assert row.hash == images.dct_hash(grey) and np.allclose(row.wavelet, images.wavelet_features(grey))
    assert found["broken.jpg"].hash is None and found["broken.jpg"].wavelet is None


def test_dct_hash_by_brute_force():
    rng = np.random.default_rng(5)
    x = rng.random((32, 32))
    low = np.array([[sum(x[i, j] * np.cos(np.pi * (2 * i + 1) * u / 64) * np.cos(np.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) for v in range(8)] for u in range(8)]).reshape(-1)
    assert images.dct_hash(x) & (2**64 - 1) == sum(1 << k for k in range(64) if low[k] > np.median(low))
    assert np.allclose(images.cosine_transform(16) @ images.cosine_transform(16).T, np.eye(16))
    near = images.dct_hash(np.kron(x, np.ones((2, 2))) + 0.001)
    assert ((near ^ images.dct_hash(x)) & (2**64 - 1)).bit_count() <= 2  # larger and brighter, the same picture


def test_wavelets():
    rng = np.random.default_rng(6)
    low, high = images.DB4, images.DB4[::-1] * (-1) ** np.arange(8)
    assert abs(low.sum() - 2**0.5) < 1e-9 and abs((low * low).sum() - 1) < 1e-9 and abs((low[2:] * low[:-2]).sum()) < 1e-9
    assert all(abs((high * np.arange(8.0) ** k).sum()) < 1e-6 for k in range(4))  # four vanishing moments
    x = rng.normal(size=(3, 16))
    a, d = images.wavelet_step(x)
    for r in range(3):
        for k in range(8):
            assert abs(a[r, k] - sum(low[i] * x[r, (2 * k + i) % 16] for i in range(8))) < 1e-12 and abs(d[r, k] - sum(high[i] * x[r, (2 * k + i) % 16] for i in range(8))) < 1e-12
    assert np.isclose((a * a).sum() + (d * d).sum(), (x * x).sum())  # orthonormal
    flat = images.wavelet_features(np.full((50, 70), 100.0))
    assert len(flat) == 20 and np.allclose(flat[2:], 0, atol=1e-6) and np.isclose(flat[0], 100 / 255 * 8)
    up_and_down, across = np.sin(np.arange(128) * 2.5)[:, None] * np.ones(128), np.sin(np.arange(128) * 2.5)[None, :] * np.ones((128, 1))
    f, g = images.wavelet_features(up_and_down), images.wavelet_features(across)
    assert np.isclose(g[14], f[16]) and g[14] > 10 * g[16]


def test_table_files(spark):
    assert {r.name for r in registry.table_files(spark, SF).collect()} == {f for f in os.listdir(SF) if f.endswith(".parquet")}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7])
def test_leaf_order_is_the_best_of_all(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    merges = hierarchy.linkage(x, method="average")
    orders = [[[i]] for i in range(n)]  # all that turning branches allows
    for a, b, *_ in merges:
        orders.append([p + q for u, v in ((a, b), (b, a)) for p in orders[u] for q in orders[v]])
    length = lambda o: sum(d[i, j] for i, j in zip(o, o[1:]))
    got = hierarchy.leaf_order(merges, d)
    assert got in orders[-1] and abs(length(got) - min(map(length, orders[-1]))) < 1e-12
    with pytest.raises(ValueError):
        hierarchy.leaf_order([(0, 1, 0.0, 2.0)] * 700, d)


def test_tsne():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(25, 6)), rng.normal(size=(25, 6)) + 9, rng.normal(size=(25, 6)) - 9])
    p = projection.affinities(x, 8)
    assert np.allclose(p, p.T) and np.isclose(p.sum(), 1)
    y = rng.normal(size=(75, 2))
    value, gradient = projection.divergence(p, y)
    near = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
    np.fill_diagonal(near, 0)
    q = near / near.sum()
    assert np.isclose(value, sum(p[i, j] * np.log(p[i, j] / q[i, j]) for i in range(75) for j in range(75) if i != j and p[i, j] > 0))
    for i, k in ((0, 0), (30, 1)):
        step = np.zeros_like(y)
        step[i, k] = 1e-6
        assert np.isclose((projection.divergence(p, y + step)[0] - projection.divergence(p, y - step)[0]) / 2e-6, gradient[i, k], atol=1e-6)
    found = projection.tsne(x, 8, 300)
    assert np.array_equal(found, projection.tsne(x, 8, 300)) and projection.divergence(p, found)[0] < 0.5 * value
    group = np.repeat([0, 1, 2], 25)
    apart = ((found[:, None] - found[None]) ** 2).sum(2)
    np.fill_diagonal(apart, np.inf)
    assert (group[apart.argmin(1)] == group).all()
    assert projection.tsne(np.zeros((0, 3))).shape == (0, 2) and projection.tsne([[1.0, 2.0]]).shape == (1, 2) and np.isfinite(projection.tsne(np.ones((5, 3)))).all()
