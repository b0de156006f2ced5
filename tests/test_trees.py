"""Tree ensembles and isotonic fits: any dealing of rows gives the same model, and plain versions agree."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwise.operators import boosting, forest, isotonic, trees
from keepwise.operators import models as H
from keepwise.operators.trees import Binning, Block, Positions

COLUMNS = "customer_id long, label int, fold int, a double, b double, c string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    out = []
    for i in range(700):
        a, b, c = float(rng.integers(0, 40)), float(rng.random()), str(rng.choice(["x", "y", "z"]))
        label = int((a > 20) != (c == "x")) if rng.random() < 0.9 else int(rng.integers(0, 2))
        out.append((i, label, i % 3, None if i % 50 == 0 else a, b, None if i % 70 == 0 else c))
    return spark.createDataFrame(out, COLUMNS)


@pytest.fixture(scope="module")
def binning(rows):
    return trees.fit_binning(rows, ["a", "b"], ["c"])


def dealt(rows, binning, monkeypatch, block_rows):
    monkeypatch.setattr(trees, "BLOCK_ROWS", block_rows)
    n = rows.count()
    return trees.blocks_of(rows, binning, n, 4).persist(), trees.parts_of(n)


def same(x, y):
    return all((getattr(x.trees, f) == getattr(y.trees, f)).all() for f in trees.FIELDS) and np.allclose(x.importances, y.importances)


def test_binning(binning):
    assert binning.names == ["a", "b", "c_x", "c_y", "c_z"] and binning.widths == [42, 256, 4]
    import pandas as pd
    got = binning.bins({"a": pd.Series([None, 0.0, 0.5, 99.0]), "b": pd.Series([0.0] * 4), "c": pd.Series([None, "x", "new", "z"])})
    assert got[:, 0].tolist() == [0, 1, 2, 41] and got[:, 2].tolist() == [0, 1, 0, 3]


def test_blocks_leave_out_their_fold(rows, binning, monkeypatch):
    blocks, parts = dealt(rows, binning, monkeypatch, 200)
    sizes: dict = {}
    for f, n in blocks.map(lambda b: (b.fit, len(b.y))).collect():
        sizes.setdefault(f, []).append(n)
    assert parts == 4 and {f: sum(n) for f, n in sizes.items()} == {0: 466, 1: 467, 2: 467, 3: 700}
    assert all(len(n) == 4 for n in sizes.values())


def test_boosting_is_the_same_in_place_and_across_blocks(rows, binning, monkeypatch):
    settings = boosting.BoostSettings(rounds=22, depth=3)  # past one cut of the lineage
    one, _ = dealt(rows, binning, monkeypatch, 10_000)
    many, parts = dealt(rows, binning, monkeypatch, 200)
    a, b = boosting.boost(one, 4, 1, binning, settings), boosting.boost(many, 4, parts, binning, settings)
    assert len(a) == 4 and all(map(same, a, b))
    assert all((m.trees.column >= 0).any() for m in a)


def test_first_boosted_split_is_the_best_of_all(rows, binning, monkeypatch):
    settings = boosting.BoostSettings(rounds=1, depth=1, rows=1.1, columns=1.0)
    blocks, _ = dealt(rows, binning, monkeypatch, 10_000)
    model = boosting.boost(blocks, 4, 1, binning, settings)[-1]
    block = blocks.filter(lambda b: b.fit == 3).first()
    p = block.y.mean()
    g, h = p - block.y, np.full(len(block.y), p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(
        ((score(m) + score(~m), c, cut) for c in range(3) for cut in range(binning.widths[c])
         if (c < 2 or cut > 0) and (m := (block.bins[:, c] == cut) if c == 2 else (block.bins[:, c] <= cut)).any()
         and h[m].sum() >= 1 and h[~m].sum() >= 1), key=lambda x: x[0])
    assert (model.trees.column[0], model.trees.cut[0]) == best[1:]
    left = (block.bins[:, best[1]] == best[2]) if best[1] == 2 else (block.bins[:, best[1]] <= best[2])
    assert model.trees.value[model.trees.left[0]] == pytest.approx(-0.05 * g[left].sum() / (h[left].sum() + 1), rel=1e-4)


def test_forest_is_the_same_whole_and_by_shared_levels(rows, binning, monkeypatch):
    settings = forest.ForestSettings(trees=7)
    one, _ = dealt(rows, binning, monkeypatch, 10_000)
    many, _ = dealt(rows, binning, monkeypatch, 200)
    a = forest.grow_forests(one, 4, binning, settings)
    b = forest.grow_forests(many, 4, binning, settings, block_rows=40)
    bins = one.filter(lambda x: x.fit == 3).first().bins
    for x, y in zip(a, b):
        assert len(x.trees) == len(y.trees) and (x.probabilities(bins) == y.probabilities(bins)).all()
        assert np.allclose(x.importances, y.importances)


def test_forest_grows_until_nothing_parts_the_rows():
    rng = np.random.default_rng(2)
    binning = Binning(("a", "b"), (), (tuple(range(200)), (0.5,)), ())
    bins = np.stack([rng.permutation(200) + 1, rng.integers(1, 3, 200)], axis=1).astype(np.uint16)
    block = Block(0, np.arange(200, dtype=np.uint64), rng.integers(0, 2, 200).astype(np.int8), bins)
    tree = forest.grow_here(block, np.ones(200, np.int64), 5, Positions.of(binning), np.array([1.0, 1.0]))
    nodes = tree.nodes()
    assert (nodes.value[trees.places(nodes, bins)] == block.y).all()  # random labels of distinct rows are learned by heart
    same_rows = Block(0, block.key, block.y, np.ones_like(bins))
    lump = forest.grow_here(same_rows, np.ones(200, np.int64), 5, Positions.of(binning), np.array([1.0, 1.0]))
    assert len(lump.column) == 1 and lump.value[0] == block.y.mean()


def test_a_forest_stays_on_the_executors(spark, rows, binning, monkeypatch, tmp_path):
    """Fitting, scoring and storing send no tree to the driver; a forest is scored like its trees in memory."""
    def refused(self):
        raise AssertionError("the driver holds a forest")

    blocks, _ = dealt(rows, binning, monkeypatch, 200)
    held = forest.Forest.held
    monkeypatch.setattr(forest.Forest, "held", property(refused))
    monkeypatch.setattr(trees.TreeEnsemble, "of", classmethod(lambda cls, *a: refused(cls)))
    monkeypatch.setattr(forest, "SCORED_TREES", 3)
    monkeypatch.setattr(forest, "SCORED_ROWS", 250)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 200)
    models = forest.grow_forests(blocks, 4, binning, forest.ForestSettings(trees=7), block_rows=40)
    models[0].save(spark, str(tmp_path))
    models[3] = loaded = forest.load_trees(spark, str(tmp_path))
    twice = rows.unionByName(rows.withColumn("customer_id", F.lit(None).cast("long"))).repartition(5)  # keys that repeat or are missing
    got = forest.score_forests(twice, {"p": models[0], "q": models[1], "r": loaded}, twice.columns).toPandas()
    empty = H.predict(models[0], rows.where("label > 1"), keep=["customer_id"])
    assert empty.columns == ["customer_id", "p"] and empty.count() == 0
    monkeypatch.setattr(forest.Forest, "held", held)
    held.__set_name__(forest.Forest, "held")
    assert len(got) == 1400 and got["customer_id"].isna().sum() == 700 and list(got.columns) == [*rows.columns, "p", "q", "r"]
    for c, m in (("p", models[0]), ("q", models[1]), ("r", models[0])):
        want = m.probabilities(binning.bins({x: got[x] for x in ("a", "b", "c")}))
        assert np.allclose(got[c], want, rtol=0, atol=1e-12) and want.std() > 0.05


def test_boosting_needs_no_job_a_level_at_common_sizes():
    assert trees.parts_of(72_000, boosting.BLOCK_ROWS) == 1 and trees.parts_of(2_000_000, boosting.BLOCK_ROWS) == 8


def test_levels_of_a_block_have_the_sums_of_the_shared_ones(rows, binning, monkeypatch):
    block = dealt(rows, binning, monkeypatch, 10_000)[0].filter(lambda b: b.fit == 3).first()
    block.margin = np.linspace(-1, 1, len(block.y))
    positions, settings = Positions.of(binning), boosting.BoostSettings(depth=4)
    tree, here = boosting.Growing(positions.slots), boosting._Round(block, 5, positions, settings)
    levels = 0
    for _ in range(settings.depth):
        sums = boosting.level_sums(block, tree, 5, positions, settings)
        assert (here.sums(tree) == sums).all()
        levels += 1
        if not tree.grow(boosting.best_splits(sums, 5, positions, settings), settings):
            break
    assert levels > 2


def test_draws_follow_the_expected_distribution():
    times = forest.times_drawn(np.arange(200_000, dtype=np.uint64), 3, forest.ForestSettings())
    assert abs(times.mean() - 1) < 0.01 and abs((times == 0).mean() - np.exp(-1)) < 0.005


def test_ensembles_are_stored_whole(spark, rows, binning, monkeypatch, tmp_path):
    blocks, _ = dealt(rows, binning, monkeypatch, 10_000)
    model = boosting.boost(blocks, 4, 1, binning, boosting.BoostSettings(rounds=5))[0]
    model.save(spark, str(tmp_path))
    loaded = trees.TreeEnsemble.load(spark, str(tmp_path))
    assert same(model, loaded) and loaded.binning == binning and loaded.kind == "boosting"
    p, q = (rows.select("customer_id", m.probability(spark).alias("p")).orderBy("customer_id").collect() for m in (model, loaded))
    assert p == q and all(0 < r["p"] < 1 for r in p)


def pooled(xs, ys):
    """Boundaries of the monotone fit by pooling adjacent violators."""
    sums: dict = {}
    for x, y in zip(xs, ys):
        n, s = sums.get(x, (0, 0.0))
        sums[x] = n + 1, s + y
    blocks: list = []
    for x in sorted(sums):
        blocks.append([*sums[x], x, x])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            n, s, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + s, blocks[-1][2], hi]
    return blocks


@pytest.mark.parametrize("kind", ["noise", "trend", "monotone", "falling", "ties"])
def test_isotonic_over_ranges(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 15, 300) / 15 if kind == "ties" else rng.random(300)
    y = {"noise": rng.random(300) < 0.5, "trend": rng.random(300) < x, "monotone": x ** 2, "falling": 1 - x, "ties": rng.random(300) < 0.5}[kind]
    data = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (0.5, None), (float("nan"), 0.0)]
    iso = isotonic.fit_isotonic(spark.createDataFrame(data, "p double, label double"), range_rows=50)
    want = pooled(x.tolist(), np.asarray(y, float).tolist())
    assert iso.count == len(want) and (kind != "monotone" or iso.count == 300)  # nothing is pooled: a row per score
    asked = [*x.tolist(), *rng.random(20).tolist(), -1.0, 2.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*asked, None])], "i long, p double")
    px = np.array([v for b in want for v in b[2:]])
    py = np.array([b[1] / b[0] for b in want for _ in range(2)])
    for bound in (isotonic.SENT_BLOCKS, 0):  # sent to the tasks, or joined
        monkeypatch.setattr(isotonic, "SENT_BLOCKS", bound)
        got = {r["i"]: r["v"] for r in iso.transform(df, "p", "v").collect()}
        assert got.pop(len(asked)) is None
        assert [got[i] for i in range(len(asked))] == pytest.approx(np.interp(asked, px, py).tolist(), abs=1e-9)


def test_isotonic_of_nothing(spark):
    empty = spark.createDataFrame([], "p double, label double")
    iso = isotonic.fit_isotonic(empty)
    assert iso.transform(spark.createDataFrame([(0.3,)], "p double"), "p", "v").first()["v"] is None


def test_a_task_grows_the_same_tree_from_few_nodes_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    binning = Binning(("a", "b"), ("c", "d", "e"), (tuple(range(30)), (0.5,)), (tuple(f"{i:03}" for i in range(300)), ("x", "y"), ()))
    bins = np.stack([rng.integers(0, w, 900) for w in binning.widths], axis=1).astype(np.uint16)  # one column has more than 256 bins
    block = Block(0, np.arange(900, dtype=np.uint64), (rng.random(900) < 0.2 + 0.5 * (bins[:, 0] > 15)).astype(np.int8), bins)
    times, positions, weight = forest.times_drawn(block.key, 1, forest.ForestSettings()), Positions.of(binning), np.array([0.7, 1.6])
    whole = forest.grow_here(block, times, 5, positions, weight)
    monkeypatch.setattr(forest, "CELLS", 1)
    parts = forest.grow_here(block, times, 5, positions, weight)
    assert all((getattr(whole.nodes(), f) == getattr(parts.nodes(), f)).all() for f in trees.FIELDS) and (whole.gain == parts.gain).all()
    nodes = whole.nodes()
    at, own = trees.places(nodes, bins), times > 0
    counts = np.array([np.bincount(at[own & (block.y == y)], times[own & (block.y == y)], len(nodes)) for y in (0, 1)])
    leaves = (nodes.column < 0) & (counts.sum(axis=0) > 0)
    share = counts[1] * weight[1] / np.maximum(counts[0] * weight[0] + counts[1] * weight[1], 1e-9)
    assert len(nodes) > 100 and np.allclose(nodes.value[leaves], share[leaves])
    # a node stays whole where its rows are of one class or of the same bins
    left = [i for i in np.flatnonzero(leaves) if (counts[:, i] > 0).all()]
    assert all(len(np.unique(bins[own & (at == i)], axis=0)) == 1 or (np.ptp(bins[own & (at == i)][:, :2], axis=0) == 0).all() for i in left)


def test_cells_of_few_and_of_many_places():
    rng = np.random.default_rng(6)
    key, y, drawn = rng.integers(0, 90, 400), rng.integers(0, 2, 400).astype(np.uint8), rng.integers(1, 10, 400).astype(np.float64)
    at, counts = forest._cells(key, y, drawn, 90)  # a cell for each place
    for places in (10_000, 1 << 27):               # sorted rows
        other, sums = forest._cells(key, y, drawn, places)
        assert (at == other).all() and (counts == sums).all()
    assert (counts == [np.bincount(key, drawn * (y == c), 90)[at] for c in (0, 1)]).all()


def test_trees_of_a_fit_are_dealt_evenly(rows, binning, monkeypatch):
    blocks, _ = dealt(rows, binning, monkeypatch, 200)
    monkeypatch.setattr(forest, "TREES_A_TASK", 2)
    parts, write = [], forest.staged
    monkeypatch.setattr(forest, "staged", lambda df, *a, **b: parts.append(df.rdd.glom().map(lambda p: sorted((r["fit"], r["tree"]) for r in p)).collect()) or write(df, *a, **b))
    forest.grow_forests(blocks, 4, binning, forest.ForestSettings(trees=7))
    assert sorted(len(p) for p in parts[0]) == [1] * 4 + [2] * 12 and sorted(t for p in parts[0] for t in p) == [(f, t) for f in range(4) for t in range(7)]


def test_a_block_is_binned_in_parts(rows, binning, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    blocks = trees.blocks_of(rows, binning, 700, 4, block_rows=1000)
    assert sorted((b.fit, len(b.y), len(set(b.key.tolist()))) for b in blocks.collect()) == [(0, 466, 466), (1, 467, 467), (2, 467, 467), (3, 700, 700)]
    assert "(7) " in blocks.toDebugString().decode()  # tasks that bin


def test_a_fit_of_many_blocks_is_boosted_in_one_task(rows, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 150)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    monkeypatch.setattr(H, "WHOLE_ROWS", 100)
    across = H.fit_folds(rows, "Gradient Boosting", ["a", "b"], ["c"], k=3, sizes=H.Sizes(rounds=3))
    monkeypatch.setattr(H, "WHOLE_ROWS", 700)
    monkeypatch.setattr(boosting, "_across", None)  # a job a level
    here = H.fit_folds(rows, "Gradient Boosting", ["a", "b"], ["c"], k=3, sizes=H.Sizes(rounds=3))
    assert all(map(same, [*across.folds, across.model], [*here.folds, here.model])) and (here.model.trees.column >= 0).any()


def test_codes_of_columns_have_the_sums_of_each():
    rng = np.random.default_rng(8)
    binning = Binning(("a", "b"), ("c", "d", "e"), (tuple(range(1500)), (0.5,)), (("x",) * 40, ("y", "z"), ()))
    bins = np.stack([rng.integers(0, w, 500) for w in binning.widths], axis=1).astype(np.uint16)
    block = Block(0, np.arange(500, dtype=np.uint64), np.zeros(500, np.int8), bins)
    positions = Positions.of(binning)
    codes, weights = boosting._Codes(block, positions, boosting.BoostSettings()), [rng.integers(-9, 9, 500).astype(float), rng.integers(0, 5, 500).astype(float)]
    assert sorted(c for g in codes.together for c in g) == [0, 1, 2, 3, 4] and len(codes.together) == 2
    for own in (None, np.flatnonzero(rng.random(500) < 0.3), np.zeros(0, np.int64)):
        at = np.arange(500) if own is None else own
        want = positions.histogram(bins[at], np.zeros(len(at), np.int64), 1, [w[at] for w in weights])[:, 0]
        assert (codes.sums(weights, own) == want).all()


def test_leaves_are_where_each_row_walks():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 6, (200, 3)).astype(np.uint16)
    bins[:20, 1] = 65535
    grown, roots = [], []
    for t in range(9):
        tree = trees.NodeList()
        tree.add()
        for _ in range(30 * (t % 3)):  # every third one is a leaf
            node = int(rng.choice([i for i, c in enumerate(tree.column) if c < 0][-3:]))  # some rows go far down
            tree.split(node, int(rng.integers(0, 3)), int(rng.choice([0, 1, 2, 3, 65535])), bool(rng.random() < 0.5))
        grown.append(tree.nodes())
    model = trees.TreeEnsemble.of("forest", None, grown, 0.0, np.zeros(1))

    def walked(tree, row):
        node = 0
        while tree.column[node] >= 0:
            b, cut = row[tree.column[node]], tree.cut[node]
            node = tree.left[node] + int(b != cut if tree.equal[node] else b > cut)
        return node

    want = np.array([[walked(tree, row) for tree in grown] for row in bins])
    assert (trees.leaves(model.trees, model.roots, bins) == want + model.roots).all()
    assert all((trees.places(tree, bins.astype(np.uint16)) == want[:, t]).all() for t, tree in enumerate(grown))
    assert trees.leaves(model.trees, model.roots, bins[:0]).shape == (0, 9)
    assert (trees.leaves(grown[0], np.zeros(1, np.int64), np.zeros((4, 0), np.uint16)) == 0).all()
