"""Values that no SQL states: numeric helpers, files, errors."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeloom.functions import keys
from probeloom.jobs import tile_queries
from probeloom.operators import audit, coords, geo, knn, leaderboard, metrics, probes, ranges, results, stacked, tiles
from probeloom.sources import shards, store


def test_floor_ties_and_macro(spark):
    rows = spark.createDataFrame(
        [("alpha", "s", "r2", -3.0), ("alpha", "s", "r2", 0.6), ("beta", "s", "r2", 0.3), ("alpha", "e", "r2", 0.5), ("beta", "e", "r2", 0.5), ("alpha", "l", "accuracy", 0.9), ("beta", "l", "accuracy", 0.8), ("beta", "l", "accuracy", float("nan"))],
        "model_name string, dataset string, metric_name string, metric_value double",
    )
    families = spark.createDataFrame([("s", "socio"), ("e", "env"), ("l", "land")], "dataset string, family string")
    got = {(r.model_name, r.family): (r.mean_rank, round(r.mean_score, 9)) for r in leaderboard.family_board(leaderboard.bench_scores(rows, families)).collect()}
    assert got["alpha", "socio"] == (2.0, -0.2) and got["beta", "socio"] == (1.0, 0.3)
    assert got["alpha", "env"][0] == got["beta", "env"][0] == 1.5 and got["alpha", "macro"][0] == got["beta", "macro"][0] == 1.5


def test_dedup_prefers_hashed_then_last(spark):
    row = lambda value, config, seed, seq, size: ("d", "knn5", "m", "z", size, "rgb", config, "accuracy", value, seed, seq)
    df = spark.createDataFrame([row(0.6, "abc", 0, 1, "224"), row(0.5, "", 0, 2, "224.0"), row(0.7, "def", 0, 0, " 224"), row(0.1, None, 1, 5, "224")], "dataset string, method string, name string, normalization string, image_size string, bands string, config_hash string, metric_name string, metric_value double, seed int, append_seq long")
    assert sorted(r.metric_value for r in results.dedup(df).collect()) == [0.1, 0.6]
    assert results.dedup(df.drop("metric_name")).count() == 4


def test_canonical_cells(spark):
    cells = ["224.0", "1e3", " x ", None, "", "-0", "1.5", "nan", "00"]
    got = spark.createDataFrame([(c,) for c in cells], "v string").select(keys.canonical_cell("v").alias("k")).collect()
    assert [r.k for r in got] == ["224", "1000", "x", "", "", "0", "1.5", "nan", "0"]


def test_errors_are_loud(spark):
    blank = spark.createDataFrame([("m", "d", "accuracy", "0.5", " ")], "name string, dataset string, metric_name string, metric_value string, normalization string")
    with pytest.raises(ValueError):
        leaderboard.harmonise(blank, [], {"accuracy": "acc"}, {})
    costs = spark.createDataFrame([("a", "1"), ("a", "2")], "name string, gflops string")
    with pytest.raises(ValueError):
        leaderboard.extract_costs(costs, ("name",), "gflops")
    catalog = spark.createDataFrame([("a", "f", 0)], "name string, family string, pos int")
    with pytest.raises(ValueError):
        coords.select_benchmarks(catalog, "a, nothing")
    with pytest.raises(ValueError):
        geo.tolerate(spark.range(50).withColumn("failed", F.col("id") < 2), "failed")
    with pytest.raises(ValueError):
        tiles.band_places(("red",), ("nir",))
    with pytest.raises(ValueError):
        coords.lonlat_columns(("a", "b"))
    assert coords.lonlat_columns(("Longitude", "LAT")) == ("Longitude", "LAT")


def test_ratings_order():
    got = leaderboard.ratings([("a", "b", 8.0), ("b", "a", 2.0), ("b", "c", 8.0), ("c", "b", 2.0)])
    assert got["a"] > got["b"] > got["c"] and abs(np.mean(list(got.values())) - 1000) < 1e-6


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(int(i), int(x), 1, float(s), int(p)) for i, (x, s, p) in enumerate(zip(rng.random(2000) < 0.7, rng.random(2000), rng.random(2000) < 0.3))], "sample_id long, label int, pred int, score double, positive int")
    r = metrics.bootstrap_accuracy(rows).first()
    assert abs(r.mean - r.accuracy) < 0.01 and 0.015 < (r.high - r.low) / 2 < 0.025
    ap = metrics.average_precision(rows).first().ap
    b = metrics.bootstrap_ap(rows, "sample_id", 40).first()
    assert b.low < ap < b.high and b.high - b.low < 0.15


def test_micro_precision_is_direct(spark):
    rng = np.random.default_rng(1)
    data = [(float(s), int(p)) for s, p in zip(rng.integers(0, 40, 500) / 40, rng.random(500) < 0.2)]
    got = metrics.average_precision(spark.createDataFrame(data, "score double, positive int")).first().ap
    want = sum(p * sum(q for t, q in data if t >= s) / sum(1 for t, _ in data if t >= s) for s, p in data) / sum(p for _, p in data)
    assert abs(got - want) < 1e-12


def test_temperature(spark):
    rng = np.random.default_rng(2)
    logits = rng.standard_normal((3000, 4)) * 2
    p = np.exp(logits / 3)
    labels = [int(rng.choice(4, p=q / q.sum())) for q in p]
    df = spark.createDataFrame([(x.tolist(), y) for x, y in zip(logits, labels)], "logits array<double>, label int")
    assert abs(metrics.temperature(df) - 3) < 0.5


def test_ridge_is_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 5))
    x[:, 3], x[:, 4] = 1.0, x[:, 0]
    y = x[:, 0] - 2 * x[:, 1] + 0.1 * rng.standard_normal(90)
    fold = np.arange(90) % 3
    df = spark.createDataFrame([(int(f), a.tolist(), float(b)) for f, a, b in zip(fold, x, y)], "fold int, features array<double>, y double")
    got = {(r.fold, r.alpha): r.r2 for r in coords.ridge_r2(df, (0.1, 10.0)).collect()}
    for f in range(3):
        a, b, c, d = x[fold != f], y[fold != f], x[fold == f], y[fold == f]
        s = np.maximum(a.std(axis=0, ddof=1), 1e-6)
        for alpha in (0.1, 10.0):
            z = (a - a.mean(0)) / s
            w = np.linalg.solve(z.T @ z + alpha * np.eye(5), z.T @ (b - b.mean()))
            e = d - (b.mean() + (c - a.mean(0)) / s @ w)
            assert abs(got[f, alpha] - (1 - (e @ e) / ((d - d.mean()) ** 2).sum())) < 1e-7
    best = coords.best_alpha(spark.createDataFrame([(0, 1.0, 0.5), (0, 2.0, 0.5), (0, 3.0, 0.1)], "fold int, alpha double, r2 double"), "r2").first()
    assert best.alpha == 1.0 and best.at_edge


def test_knn_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((120, 6))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(data)], "sample_id long, features array<double>, label int")
    monkeypatch.setattr(knn, "BLOCK", 25)
    got = {(r.sample_id, r["rank"]): r.train_id for r in knn.neighbours(df, df, 4, exclude_self=True).collect()}
    d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert all(got[i, k + 1] == near[i, k] for i in range(120) for k in range(4))
    assert knn.neighbours(df.limit(5), df.limit(3), 10).count() == 15


def test_spectrum_and_dimensions(spark):
    rng = np.random.default_rng(5)
    make = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, features array<double>")
    one = probes.spectrum(make(np.outer(rng.standard_normal(50), np.ones(6)))).first()
    assert abs(one.anisotropy - 1) < 1e-9 and abs(one.pc1 - 1) < 1e-9 and abs(one.effective_rank - 1) < 1e-6
    flat = probes.spectrum(make(rng.standard_normal((4000, 5)))).first()
    assert flat.anisotropy < 0.02 and abs(flat.effective_rank - 5) < 0.05
    with pytest.raises(ValueError):
        probes.spectrum(make(np.ones((10, 3))))
    plane = rng.random((600, 2)) @ rng.standard_normal((2, 8))
    assert abs(probes.two_nn(make(plane)).first().two_nn - 2) < 0.4
    assert abs(probes.mle_dimension(make(plane), 10).first().mle - 2) < 0.4
    assert probes.pca_dimension(make(plane)).first().lpca == 2


def test_spectrum_queries_take_all_rows(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.xxhash64("id", i) % 1000 / 1000).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    x = np.stack([r.embedding for r in rows.where("vec_id % 5 < 3").orderBy("vec_id").collect()]).astype(float)
    values = np.linalg.eigvalsh(np.cov(x.T))
    want = values.sum() ** 2 / (values**2).sum()
    for query in (tile_queries.feature_spectrum, tile_queries.spectrum_ratio):
        assert abs(query(spark, str(tmp_path)).where("split = 'train'").first().participation_ratio - want) < 2e-6


def test_base_variant_has_no_delta_to_itself(spark):
    noise = F.udf(lambda: float(np.random.default_rng().random()), "double").asNondeterministic()  # as sums of doubles are, in their last digits
    rows = spark.range(40).select((F.col("id") % 20).alias("dataset"), F.when(F.col("id") < 20, "all").otherwise("rgb").alias("bands")).withColumn("score", noise())
    deltas = leaderboard.delta_to(rows, ("dataset",), "bands", "all")
    got = {r.bands: r for r in leaderboard.variant_summary(deltas, "bands").collect()}
    assert (got["all"].n, got["all"].improved, got["all"].regressed, got["all"].least, got["all"].most) == (20, 0, 0, 0, 0)
    assert got["rgb"].n == got["rgb"].improved + got["rgb"].regressed == 20


def test_logistic_gradient_is_zero(spark):
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((150, 3)), rng.integers(0, 3, 150)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "sample_id long, features array<double>, label int")
    model = probes.fit_logistic(df, 0.5, 500)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    p = np.exp(x @ w.T + b)
    p /= p.sum(1, keepdims=True)
    g = (p - np.eye(3)[y]).T @ x / 150 + w / (0.5 * 150)
    assert np.abs(g - g.mean(0)).max() < 1e-4
    out = probes.evaluate_multilabel(df.withColumn("labels", F.array((F.col("label") > 0).cast("int"), F.lit(1) - (F.col("label") > 1).cast("int"))), df.withColumn("labels", F.array(F.lit(0), F.lit(1))), 2, 1.0)
    assert out.count() == 300


def test_confident_learning_finds_planted_flips(spark):
    rng = np.random.default_rng(7)
    rows, flipped = [], set()
    for i in range(600):
        true = int(rng.integers(0, 3))
        p = rng.dirichlet(np.ones(3)) * 0.05
        p[true] += 0.95
        label = true
        if i % 20 == 0:
            label, _ = (true + 1) % 3, flipped.add(i)
        rows.append((i, label, p.tolist()))
    found = {r.sample_id for r in audit.label_issues(spark.createDataFrame(rows, "sample_id long, label int, probs array<double>")).where("is_issue").collect()}
    assert len(found & flipped) >= 27 and len(found - flipped) <= 5


def test_handmade_features_and_resize():
    flat, ramp = np.full((8, 8), 3.0), np.tile(np.arange(8.0), (8, 1))
    assert tiles._statistics(flat)[:4] == [3, 0, 3, 3] and tiles._texture(flat) == [0.0] * 12
    t = tiles._texture(ramp)
    assert t[0] == 1 and t[1] == 0 and abs(t[2] - 1) < 1e-12 and t[3] == 0
    assert tiles._structure(flat)[1] == 1.0
    assert [len(f(ramp)) for f in (tiles._statistics, tiles._texture, tiles._structure)] == [9, 12, 16]
    assert [len(tiles.feature_manifest(["a", "b"], k)) for k in (1, 2, 3)] == [18, 42, 74]
    for how in ("nearest", "area", "bilinear", "bicubic"):
        assert np.allclose(tiles._weights(8, 8, how), np.eye(8)) and np.allclose(tiles._weights(7, 3, how).sum(1), 1)
    assert np.allclose(tiles._weights(4, 2, "area") @ np.arange(4.0), [0.5, 2.5])


def test_utm():
    lon, lat = geo._utm_inverse(np.array([32]), np.array([True]), np.array([500000.0]), np.array([4649776.22]))
    assert abs(lon[0] - 9) < 1e-9 and abs(lat[0] - 42.0) < 1e-5


def test_files(spark, tmp_path):
    a, b = tmp_path / "res", tmp_path / "t"
    a.mkdir()
    (a / "m1.csv").write_text("name,x\nm1,1\n")
    (a / "m2.csv").write_text("name,y\nm2,2\nm2,3\n")
    (a / "m3.csv").write_text("")
    got = store.load_results(spark, str(a))
    assert got.count() == 3 and set(got.columns) == {"name", "x", "y", "source_file"}
    assert store.load_results(spark, str(a), ["m2"]).count() == 2
    path = str(b / "rows")
    store.append_rows(spark.createDataFrame([(1, "a")], "i int, s string"), path)
    store.append_rows(spark.createDataFrame([(2, "b")], "i int, s string"), path)
    store.append_rows(spark.createDataFrame([(3.5, 3)], "z double, i int"), path)
    store.append_rows(spark.createDataFrame([], "i int"), path)
    assert spark.read.parquet(path).count() == 3 and spark.read.parquet(path).columns == ["z", "i", "s"]
    snap = str(b / "snap")
    store.write_snapshot(spark.createDataFrame([(1,)], "i int"), snap, "2024-01-02")
    store.write_snapshot(spark.createDataFrame([(2,), (3,)], "i int"), snap, "main")
    assert {(r.snapshot, r.i) for r in store.read_snapshots(spark, snap).selectExpr("string(snapshot) snapshot", "i").collect()} == {("2024-01-02", 1), ("main", 2), ("main", 3)}
    (a / "default_partition.json").write_text(json.dumps({"train": ["a", "b"], "test": ["c"]}))
    assert store.read_partitions(spark, str(a)).count() == 3
    store.write_record(spark, str(b / "geo"), "x", {"n": 3})
    assert store.read_records(spark, str(b / "geo"), "name string, n long").first().n == 3
    rows = spark.createDataFrame([("a/b", "knn5"), ("c", "profile")], "name string, method string")
    store.route_rows(rows, str(b / "routed"))
    assert {(r.kind, r.name_safe) for r in spark.read.parquet(str(b / "routed")).collect()} == {("models", "a_b"), ("profiles", "c")}


def test_shards(spark, tmp_path):
    with tarfile.open(tmp_path / "s0.tar", "w") as tar:
        for i in range(3):
            data = io.BytesIO()
            np.savez(data, red=np.full((2, 2), i), nir_a=np.eye(2))
            for name, body in ((f"x.{i}.bands.npz", data.getvalue()), (f"x.{i}.meta.json", b'{"label": 1}')):
                info = tarfile.TarInfo(name)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
    got = shards.read_samples(spark, str(tmp_path)).orderBy("sample_id").collect()
    assert [r.sample_id for r in got] == ["x.0", "x.1", "x.2"] and got[2].bands[0] == [2.0] * 4 and got[0].height == 2
    place = shards.read_samples(spark, str(tmp_path)).select(shards.find_band("names", "nir").alias("a"), shards.find_band("names", "zz").alias("b")).first()
    assert place.a == 1 and place.b is None
    index = shards.index_members(spark, str(tmp_path)).collect()
    assert len(index) == 3 and all(r.meta_size == 12 and r.bands_offset > 0 for r in index)


def test_handmade_features_are_direct(spark):
    """Texture and structure against loops over pixels."""
    rng = np.random.default_rng(8)
    eps = 1e-6

    def direct(m):
        h, w = m.shape
        low, high = m.min(), m.max()
        unit = (m - low) / max(high - low, eps)

        def slope(z, y, x, dy, dx):
            n = (h, w)[dx]
            if n == 1:
                return 0.0
            a, b = (min(max((y, x)[dx] + s, 0), n - 1) for s in (-1, 1))
            at = lambda k: z[y, k] if dx else z[k, x]
            return (at(b) - at(a)) / (b - a)

        codes = []
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                ring = [m[y - 1, x - 1], m[y - 1, x], m[y - 1, x + 1], m[y, x + 1], m[y + 1, x + 1], m[y + 1, x], m[y + 1, x - 1], m[y, x - 1]]
                codes.append([bool(v > m[y, x]) for v in ring])
        if codes:
            names = [tuple(c) for c in codes]
            share = np.array([names.count(c) for c in set(names)]) / len(names)
            out = [-(share * np.log(share)).sum() / np.log(256), np.mean([sum(c[i] != c[i - 1] for i in range(8)) <= 2 for c in codes])]
        else:
            out = [0.0, 0.0]
        g = np.array([[(slope(unit, y, x, 0, 1), slope(unit, y, x, 1, 0)) for x in range(w)] for y in range(h)])
        near = lambda y, x: [(i, j) for i in range(max(y - 1, 0), min(y + 2, h)) for j in range(max(x - 1, 0), min(x + 2, w))]
        r = np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                v = np.array([g[i, j] for i, j in near(y, x)])
                a, b, c = (v[:, 0] ** 2).mean(), (v[:, 1] ** 2).mean(), (v[:, 0] * v[:, 1]).mean()
                r[y, x] = max(a * b - c * c - 0.04 * (a + b) ** 2, 0)
        peak = [[r[y, x] > 0.01 * r.max() and r[y, x] >= max(r[i, j] for i, j in near(y, x)) for x in range(w)] for y in range(h)]
        out += [np.mean(peak), r.mean()]
        i, j = (h + 1) // 2, (w + 1) // 2
        for q in (m[:i, :j], m[:i, j:], m[i:, :j], m[i:, j:]):
            out += [q.mean(), q.std()] if q.size else [0.0, 0.0]
        ys, xs = np.linspace(-1, 1, h) if h > 1 else [0], np.linspace(-1, 1, w) if w > 1 else [0]
        for weight in (np.maximum(np.percentile(m, 25) - m, 0), np.maximum(m - np.percentile(m, 75), 0)):
            p = weight / max(weight.sum(), eps * max(high - low, eps)) if weight.sum() else weight
            pts = np.array([(x, y) for y in ys for x in xs])
            mean = (p.ravel()[:, None] * pts).sum(0)
            cov = (p.ravel()[:, None, None] * (pts[:, :, None] * pts[:, None, :])).sum(0) - np.outer(mean, mean) if weight.sum() else np.zeros((2, 2))
            lo, hi = np.linalg.eigvalsh(cov)
            out += [(hi - lo) / max(hi + lo, eps), np.sqrt(max(hi + lo, 0))]
        return out

    for shape in ((4, 4), (5, 3), (7, 8), (1, 6), (2, 2)):
        x = rng.random((3, 2, *shape))
        got = tiles.structure_of(x)
        for a in range(3):
            for b in range(2):
                assert np.allclose(got[a, b], direct(x[a, b]), atol=1e-9), (shape, got[a, b], direct(x[a, b]))
    ramp = np.tile(np.arange(5.0), (5, 1))
    assert np.allclose(tiles._cells(ramp, 2), [[0.5, 2.5, 4]] * 3) and np.allclose(tiles._texture(ramp)[4:6], [1.75, np.sqrt(1 / 24)])
    mixed = spark.createDataFrame([(1, 2, 2, [[1.0, 2.0, 3.0, 4.0]]), (2, 1, 3, [[1.0, 5.0, 2.0]]), (3, 2, 2, [[0.0, 0.0, 0.0, 1.0]])], "sample_id long, height int, width int, px array<array<double>>")
    made = tiles.handmade(mixed.select("sample_id", "height", "width", F.transform("px", lambda p: F.struct(F.lit("a").alias("name"), p.alias("px"))).alias("maps"))).collect()
    assert {r.sample_id: len(r.features) for r in made} == {1: 37, 2: 37, 3: 37} and made[0].features[0] == 2.5


def test_policies_and_filters():
    bands = [{"name": "a", "unit": "dn", "mean": 1.0, "std": 2.0, "lower": 0.0, "upper": 4.0}]
    assert tiles._policy_band(bands[0], "model", {"unit": "reflectance", "mean": None}) == (1e-4, 0.0, 1.0)
    for bad in ({"policy": "x"}, {"policy": "dataset", "clip": True}, {"policy": "model"}, {"policy": "none", "model": bands}, {"policy": "model", "model": [{"name": "b", "unit": "dn"}]}):
        with pytest.raises(ValueError):
            tiles.normalise_policy(None, bands, **bad)
    for numbers, policy in (({"mean": None, "std": 1.0}, "dataset"), ({"lower": 1.0, "upper": 1.0}, "minmax"), ({"lower": 0.0, "upper": float("inf")}, "minmax")):
        with pytest.raises(ValueError):
            tiles._policy_band({"name": "a"} | numbers, policy, None)
    patches = np.random.default_rng(9).standard_normal((50, 6))
    white = tiles.whiten(patches, ridge=1e-9)
    p = patches - patches.mean(1, keepdims=True)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(p.T @ p / 50)
    assert np.allclose(white @ axes[:, 1:], p @ axes[:, 1:] / (values[1:] + 1e-9))


def test_multilabel_flips_are_found(spark):
    rng = np.random.default_rng(10)
    rows, flipped = [], set()
    for i in range(500):
        y = rng.random(3) < (0.5, 0.2, 0.8)
        p = np.clip(np.where(y, 0.93, 0.07) + 0.05 * rng.standard_normal(3), 0.01, 0.99)
        labels = y.astype(int).tolist()
        if i % 25 == 0:
            k = int(rng.integers(3))
            labels[k] = 1 - labels[k]
            flipped.add((i, k))
        rows.append((i, labels, p.tolist()))
    df = spark.createDataFrame(rows, "sample_id long, labels array<int>, probs array<double>")
    issues = audit.multilabel_issues(df)
    found = {(r.sample_id, r.place) for r in issues.where("is_issue").collect()}
    assert found <= flipped and len(found) >= 0.7 * len(flipped)  # the quota follows the confident rows alone
    samples = {r.sample_id: r for r in audit.multilabel_samples(df, issues).collect()}
    assert {i for i, r in samples.items() if r.is_issue} == {i for i, _ in found}
    own = sorted((p if y else 1 - p for y, p in zip(rows[0][1], rows[0][2])), reverse=True)
    assert abs(samples[0].issue_score - (1 - (0.8 * own[2] + 0.2 * (0.8 * own[1] + 0.2 * own[0])))) < 1e-12


def test_polygons_shipped_or_joined(spark):
    rng = np.random.default_rng(11)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-30, 30, (300, 2)))] + [(300, None, 1.0), (301, float("nan"), 1.0)], "row_id long, lon double, lat double")
    polygons = spark.createDataFrame([("b", [[-20.0, -20.0], [5.0, -20.0], [5.0, 10.0]]), ("a", [[0.0, -5.0], [25.0, -5.0], [12.0, 25.0]]), ("c", [[-29.0, 0.0], [-10.0, 0.0], [-10.0, 29.0], [-29.0, 29.0]])], "name string, ring array<array<double>>")
    one, two = ({r.row_id: r.continent for r in geo.attribute_polygons(points, polygons, 5.0, limit).collect()} for limit in (1000, 0))
    assert one == two and set(one.values()) == {"a", "b", "c", geo.OCEAN}


def test_binomial_draws():
    x = metrics.binomial_draws(1000, 300, 4000)
    assert abs(x.mean() - 300) < 1 and abs(x.std() - np.sqrt(210)) < 0.6
    assert (metrics.binomial_draws(10, 0, 5) == 0).all() and (metrics.binomial_draws(10, 10, 5) == 10).all()
    big = metrics.binomial_draws(10**9, 4 * 10**8, 500)
    assert abs(big.mean() / 10**9 - 0.4) < 1e-5


def test_columns_and_logs(spark):
    schema = spark.createDataFrame([], "id long, Lat double, LON double, name string, MeanT double, Price int").schema
    assert coords.task_columns(schema, ("id",)) == ["MeanT", "Price"]
    assert coords.label_column(schema, "income", ("id",)) == "MeanT" and coords.label_column(schema, "price", ("id",)) == "Price" and coords.label_column(schema, "x", ("id", "MeanT", "Price")) is None
    jobs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "job_id long")
    events = spark.createDataFrame([(1, 1, "completed", "old"), (2, 1, "completed", "new"), (3, 2, "failed", "x")], "seq long, job_id long, event string, log string")
    attempts = spark.createDataFrame([(1, "a1", "done"), (2, "a2", "all done"), (2, "b2", "no"), (3, "a3", "done"), (3, "b3", "done")], "job_id long, log string, text string")
    assert {r.job_id: r.log for r in results.job_logs(jobs, events, attempts, "done").collect()} == {1: "new", 2: "a2", 3: None, 4: None}


def test_knn_cells_prune_and_lose_nothing(spark, monkeypatch):
    """Clusters far apart, copies beyond a block, ties and folds: equal to brute force, and far from all blocks met."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((12, 5)) * 100
    data = np.concatenate([c + rng.standard_normal((30, 5)) for c in centres] + [np.repeat(centres[:1], 90, axis=0)])
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(data)], "sample_id long, features array<double>, fold int")
    monkeypatch.setattr(knn, "BLOCK", 20)
    d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(2))
    for by, own in ((None, True), ("fold", False), ("fold", True)):
        stats = {}
        got = {(r.sample_id, r["rank"]): r.train_id for r in knn.neighbours(df, df, 6, by, own, stats).collect()}
        e = d.copy()
        if own:
            np.fill_diagonal(e, np.inf)
        if by:
            e[(np.arange(len(data))[:, None] - np.arange(len(data))) % 2 == 1] = np.inf
        near = np.argsort(e, axis=1, kind="stable")[:, :6]
        assert got == {(i, k + 1): near[i, k] for i in range(len(data)) for k in range(6)}
        assert stats["met"] < 0.6 * stats["all"], stats


@pytest.mark.parametrize("room", [1 << 25, 1])
def test_knn_writes_no_pairs(spark, monkeypatch, room):
    """Rows that reach into every cell, copies beyond a round, folds: equal to brute force, and no table holds queries once for each cell."""
    rng = np.random.default_rng(12)
    data = np.concatenate([rng.standard_normal((300, 16)), np.zeros((60, 16))])
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(data)], "sample_id long, features array<double>, fold int")
    monkeypatch.setattr(knn, "BLOCK", 40)
    monkeypatch.setattr(knn, "ROUND_BYTES", room, raising=False)
    sizes, write = [], knn.written

    def spied(table, name):
        out = write(table, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(knn, "written", spied)
    got = {(r.sample_id, r["rank"]): r.train_id for r in knn.neighbours(df, df, 3, "fold", True).collect()}
    d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    d[(np.arange(360)[:, None] - np.arange(360)) % 2 == 1] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert got == {(i, k + 1): near[i, k] for i in range(360) for k in range(3)}
    assert max(n for name, n in sizes if name != "near") <= 360, sizes


def test_large_tiles(spark):
    """A tile of 224 x 224: statistics in one fold over its pixels, and features of a corner, an edge and a plane."""
    import time

    rng = np.random.default_rng(12)
    x = rng.standard_normal((224, 224)) + 1e6
    df = spark.createDataFrame([(k, 224, 224, [x.ravel().tolist()]) for k in range(4)], "sample_id long, height int, width int, bands array<array<double>>")
    began = time.time()
    got = tiles.image_stats(df).collect()
    assert time.time() - began < 30
    assert np.allclose(got[0].features, [x.mean(), x.std(), x.max(), x.min()], rtol=1e-12, atol=1e-9)
    plane = np.add.outer(np.arange(224.0), 3 * np.arange(224.0))
    assert np.allclose(tiles.texture_of(plane)[[0, 1, 2, 3]], [np.sqrt(10), 0, 1, 0])
    square = np.zeros((224, 224))
    square[60:120, 60:120] = 1
    assert 4 <= tiles.structure_of(square)[2] * 224 * 224 <= 16  # few peaks, at the four corners


def test_polygons_cut_into_cells(spark, monkeypatch):
    """Rings with corners and edges on grid lines, thin and star-shaped ones, split cells: as the even-odd rule says for whole rings."""
    rng = np.random.default_rng(14)
    angle = np.sort(rng.random(400)) * 2 * np.pi
    star = np.column_stack([np.cos(angle), np.sin(angle)]) * (20 + 15 * rng.random((400, 1))) + [33, -7]
    bow = [[-60.0, 10.0], [-10.0, 60.0], [-10.0, 10.0], [-60.0, 60.0]]
    rings = [("star", star.tolist()), ("box", [[-20.0, -30.0], [20.0, -30.0], [20.0, 30.0], [-20.0, 30.0]]), ("bow", bow), ("sliver", [[0.0, 0.0], [170.0, 1.0], [170.0, 1.001]]), ("triangle", [[-170.0, -80.0], [-100.0, -80.0], [-135.0, -5.0]])]
    lonlat = np.concatenate([rng.uniform((-180, -90), (180, 90), (3000, 2)), rng.uniform((0, -40), (70, 30), (3000, 2)), np.array([[x, y] for x in range(-180, 181, 5) for y in range(-90, 91, 5)], float) + 0.25])
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(lonlat)] + [(10**6, None, 1.0), (10**6 + 1, float("nan"), 1.0)]
    points, polygons = spark.createDataFrame(rows, "row_id long, lon double, lat double"), spark.createDataFrame(rings, "name string, ring array<array<double>>")
    want = dict.fromkeys((r[0] for r in rows), geo.OCEAN)
    for name, ring in sorted(rings, reverse=True):
        want |= dict.fromkeys(np.flatnonzero(geo.inside(lonlat[:, 0], lonlat[:, 1], np.array(ring))).tolist(), name)
    for most in (10**6, 60):
        monkeypatch.setattr(geo, "MET_POINTS", most)
        monkeypatch.setattr(geo, "MET_EDGES", most)
        got = {r.row_id: r.continent for r in geo.attribute_polygons(points, polygons, shipped=0).collect()}
        assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert set(want.values()) == {"star", "box", "bow", "sliver", "triangle", geo.OCEAN} - ({"sliver"} - set(want.values()))


def test_versions_appear_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        store.read_version(spark, path)
    assert store.append_version(spark.createDataFrame([(1, "a")], "i int, s string"), path) == 1
    before = store.read_version(spark, path)
    publish = store._publish
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("the writer ends between the steps")))
    with pytest.raises(OSError):
        store.append_version(spark.createDataFrame([(2, 2.5)], "i int, z double"), path)
    assert store.read_version(spark, path).columns == ["i", "s"] and store.read_version(spark, path).count() == 1
    other = []

    def late(*a):  # another writer is quicker, once
        if not other:
            other.append(1)
            monkeypatch.setattr(store, "_publish", publish)
            store.append_version(spark.createDataFrame([("c", 3)], "s string, i long"), path)
            monkeypatch.setattr(store, "_publish", late)
        return publish(*a)

    monkeypatch.setattr(store, "_publish", late)
    assert store.append_version(spark.createDataFrame([(4, 4.5)], "i int, z double"), path) == 3
    got = store.read_version(spark, path)
    assert got.columns == ["i", "z", "s"] and dict(got.dtypes)["i"] == "int"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, None, "a"), (3, None, "c"), (4, 4.5, None)], key=repr)
    assert before.count() == 1
    assert store.append_version(spark.createDataFrame([], "i int"), path) == 3


def test_running_sums_of_a_hot_group(spark):
    """A group of most rows lies in many ranges; sums over 2^31; nulls and equal groups."""
    rows = [("hot", k) for k in range(2000)] + [("a", 1), ("a", 2), (None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(3)
    got = ranges.running(df, ("g",), ("k",), parts=8, s=F.lit(2**31), n=F.lit(1)).collect()
    assert {(r.g, r.k): (r.s, r.n) for r in got} == {(g, k): (2**31 * n, n) for g, k in rows for n in [sum(1 for h, j in rows if h == g and j <= k)]}
    down = ranges.placed(df, ("g",), (("k", True),), "n", parts=8).where("g = 'hot'").collect()
    assert {r.k: r.n for r in down} == {k: 2000 - k for k in range(2000)}
    dealt = df.repartitionByRange(8, "g", "k").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 600  # no task has the group
    assert [r.place for r in ranges.placed(df.limit(0), ("g",), ("k",)).collect()] == []


def test_official_split_is_one_direction(spark):
    rng = np.random.default_rng(15)
    n = 200
    x = rng.standard_normal((n, 4))
    test = np.arange(n) % 3 == 0
    y = x @ [1.0, -2.0, 0.5, 0.0] + np.where(test, 3.0, 0.3) * rng.standard_normal(n)
    rows = spark.createDataFrame([(k, x[k].tolist(), float(y[k]), bool(test[k])) for k in range(n)], "row_id long, features array<double>, y double, is_test boolean")
    alphas = (0.01, 1.0, 100.0)
    got = coords.official_score(coords.ridge_r2(coords.nested_folds(rows, 5), alphas), "r2").first()

    def r2(train, held, alpha):
        m, s = x[train].mean(0), x[train].std(0, ddof=1)
        z = (x[train] - m) / s
        w = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y[train] - y[train].mean()))
        e = y[held] - y[train].mean() - (x[held] - m) / s @ w
        return 1 - (e @ e) / ((y[held] - y[held].mean()) ** 2).sum()

    pool = np.flatnonzero(~test)
    means = [np.mean([r2(np.setdiff1d(pool, pool[f::5]), pool[f::5], a) for f in range(5)]) for a in alphas]
    best = alphas[int(np.argmax(means))]
    assert got.alpha == best and abs(got.score - r2(pool, np.flatnonzero(test), best)) < 1e-9


def test_stacked_probes_by_either_way(spark):
    """Shipped rows and passes over them give the same weights, for classes and labels, and the slope there is zero."""
    rng = np.random.default_rng(16)
    x = rng.standard_normal((240, 3)) * [1, 5, 0.2] + [0, 10, 0]
    label, labels = rng.integers(0, 3, 240), rng.integers(0, 2, (240, 2))
    rows = spark.createDataFrame([(k, ("train", "val", "test")[k % 3], x[k].tolist(), int(label[k]), labels[k].tolist()) for k in range(240)], "sample_id long, split string, features array<double>, label int, labels array<int>").repartition(3)
    grid = (0.01, 1.0, 50.0)
    for target, classes in (("label", True), ("labels", False)):
        blocks = stacked.pack(rows, target)
        one, two = (stacked.fit(blocks, grid, ("train", "val"), classes, shipped=most) for most in (1 << 20, 0))
        assert np.allclose(one, two, atol=1e-5)
        some = np.arange(240) % 3 < 2
        y = label[:, None].astype(float) if classes else labels.astype(float)
        _, slope = stacked.loss_and_slope(x[some], y[some], one, classes)
        slope = slope / some.sum()
        slope[:, 1:] += one[:, 1:] / (np.array(grid)[:, None, None] * some.sum())
        assert np.abs(slope).max() < 1e-6
        found = {(round(r.c, 6), r.split): r.score for r in stacked.scores(blocks, one, grid, classes).collect()}
        z = stacked.outputs(x, one)
        if classes:
            for i, c in enumerate(grid):
                for k, s in enumerate(("train", "val", "test")):
                    own = np.arange(240) % 3 == k
                    assert abs(found[c, s] - (z[own, i].argmax(1) == label[own]).mean()) < 1e-12
    with pytest.raises(ValueError):
        stacked.fit(blocks, grid, ("none",), False)
    out = probes.evaluate_logistic(rows, grid, resamples=20).first()
    assert out.low <= out.metric <= out.high and out.n == 80
    cooled = probes.evaluate_logistic(rows.drop("label"), grid, merge_val=False, resamples=20).first()
    assert cooled.temperature > 0 and 0 <= cooled.ece_ts <= 1


def test_report_of_classes(spark):
    """Shares are parts of the class, not of its errors; the class most often guessed for flagged rows; precision against all others."""
    rows = spark.createDataFrame([(0, 0, 0, False, 0.9, [0.9, 0.1, 0.0]), (1, 0, 1, True, 0.2, [0.2, 0.7, 0.1]), (2, 0, 2, True, 0.1, [0.1, 0.1, 0.8]), (3, 0, 1, False, 0.4, [0.4, 0.6, 0.0]), (4, 1, 1, False, 0.8, [0.1, 0.8, 0.1])], "sample_id long, label int, guess int, is_issue boolean, quality double, probs array<double>")
    got = {r.label: r for r in audit.class_report(rows).collect()}
    assert set(got) == {0, 1} and (got[0].top_confused, got[0].confused_share) == (1, 0.5) and (got[1].top_confused, got[1].confused_share) == (0, 0.0)
    assert (got[0].top_flagged, got[0].top_flagged_n) == (1, 1) and (got[1].top_flagged, got[1].top_flagged_n) == (-1, 0)
    assert abs(got[0].ap - (1 + 1 + 1 + 4 / 5) / 4) < 1e-12 and abs(got[1].ap - 1) < 1e-12


def test_temperature_of_labels(spark):
    rng = np.random.default_rng(17)
    z = rng.standard_normal((2000, 3)) * 2
    y = (rng.random((2000, 3)) < 1 / (1 + np.exp(-z / 2.5))).astype(int)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(z, y)], "logits array<double>, labels array<int>")
    t = metrics.temperature_labels(df)
    loss = lambda v: (np.logaddexp(0, z / v) - y * z / v).mean()
    assert abs(t - 2.5) < 0.4 and loss(t) <= min(loss(t * 1.01), loss(t / 1.01))
