import numpy as np

from arborlake.llm import hnsw as hw


def clouds(n, seed, dim=24, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 6), dim))
    return (centres[rng.integers(len(centres), size=n)] + spread * rng.normal(size=(n, dim)) * rng.random((n, 1))).astype(np.float32)


def plain_groups(rows, least=0.98):
    """Brute force over (id, vector, label)."""
    usable = [(i, np.array(v, float), k) for i, v, k in rows if v is not None and k is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    pairs = []
    for k in {k for _, _, k in usable}:
        ids = [i for i, _, x in usable if x == k]
        unit = np.stack([v / np.linalg.norm(v) for _, v, x in usable if x == k])
        near = unit @ unit.T >= least
        pairs += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: (links[i], find(i)) for i in links}


def test_beams_find_nearly_all_neighbours():
    unit = hw._unit(clouds(3000, 1))
    graph = hw.Graph.build(unit.astype(np.float32), np.arange(3000))
    assert len(graph.layers) > 1
    ids, cosines = graph.search(unit[:200].astype(np.float32), 48)
    exact = np.sort(unit[:200] @ unit.T, axis=1)[:, ::-1][:, :10]
    assert np.mean(cosines[:, :10] >= exact - 1e-5) > 0.95
    assert (ids[:, 0] == np.arange(200)).all()


def graph_of(unit):
    return hw.Graph.build(unit.astype(np.float32), np.arange(len(unit)))


def test_links_are_complete_where_beams_overflow():
    rng = np.random.default_rng(2)
    tight = np.ones((700, 24)) + 0.01 * rng.normal(size=(700, 24))
    unit = hw._unit(np.concatenate([tight, clouds(900, 3)]))
    hits, beam, recall = hw.joint_links((graph_of(unit), unit), None)
    assert beam < len(unit) and recall >= hw.RECALL
    assert (hits == (unit @ unit.T >= 0.98)).all()


def few_links(n, links, seed, dim=64):
    """Vectors without structure, and a few more that are each linked with one of them."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dim))
    near = vectors[:links] + 0.12 * rng.normal(size=(links, dim))
    return np.concatenate([vectors, near])


def test_beams_widen_until_the_audits_pass(monkeypatch):
    """Three shards without structure: the first beam meets too few nearest nodes, wider ones do, none is the whole shard."""
    unit = hw._unit(few_links(12_000, 90, 5))
    shards = [unit[k::3] for k in range(3)]
    graphs = [graph_of(x) for x in shards]
    beams = []
    for a in range(3):
        for b in range(a, 3):
            got, beam, recall = hw.joint_links((graphs[a], shards[a]), None if a == b else (graphs[b], shards[b]))
            assert (got == (shards[a] @ shards[b].T >= 0.98)).all()
            assert recall >= hw.RECALL and beam < len(shards[b])
            beams.append(beam)
    assert max(beams) > hw.BEAM


def test_graphs_without_ways_are_searched_by_whole_beams():
    unit = hw._unit(few_links(900, 60, 5))
    graph = graph_of(unit)
    graph.layers[0][1][:, 2:] = -1
    hits, beam, recall = hw.joint_links((graph, unit), None)
    assert beam == len(unit) and recall == 1
    assert (hits == (unit @ unit.T >= 0.98)).all()


def test_long_vectors_make_smaller_shards(spark, monkeypatch):
    monkeypatch.setattr(hw, "SHARD_BYTES", 8 * 24 * 50)
    vectors = clouds(300, 7)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hw.embedding_groups(table).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_groups(rows)


def test_groups_match_brute_force(spark):
    vectors = clouds(700, 4)
    rows = [(3 * i + 5, v.tolist(), i % 3 if i % 50 else None) for i, v in enumerate(vectors)]
    rows += [(9000 + i, rows[10][1], rows[10][2]) for i in range(4)]
    rows += [(9100, None, 1), (9101, [0.0] * 24, 1), (9102, [float("nan")] * 24, 1), (9103, [None] * 24, 1), (9104, [float("inf")] + [1.0] * 23, 2), (9105, [1e-30] * 24, 2), (9106, [1e-30] * 24, 2)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rid string").repartition(4)
    want = plain_groups(rows)
    for shard in (8192, 60):
        got = hw.embedding_groups(table, shard).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
        assert all((r.recall is None) == (r.vec_id in (9100, 9101, 9102, 9103, 9104) or r.vec_id < 9000 and (r.vec_id - 5) // 3 % 50 == 0) for r in got)
        assert min(r.recall for r in got if r.recall is not None) >= hw.RECALL


def test_odd_tables(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 0), (4, [-0.0, 1.0], 0), (5, [0.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in hw.embedding_groups(table).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("3", 0, 3), ("4", 1, 4), ("5", 1, 4), ("None", 0, None)]
    assert hw.embedding_groups(table.limit(0)).count() == 0
