"""Near duplicates of vectors and texts, and connected components."""

import random
import re
from math import comb
from pathlib import Path

import numpy as np
import pytest

from motorlot.llm import components, minhash, vectors
from plain import groups, near_duplicates


def test_components_of_paths_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = groups({x for p in links for x in p}, links)
    assert got == {k: expected[k] for p in links for k in p if p[0] != p[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def edited(rng, words, share):
    return [rng.choice(["xa", "xb", "xc", "xd"]) + str(rng.random()) if rng.random() < share else w for w in words]


def test_text_groups_against_all_pairs(spark, make_docs):
    rng = random.Random(5)
    rows, common = [], [f"c{k}" for k in range(60)]
    for family in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(25):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04]))))
    rows += [" ".join(common + [f"z{rng.random()}" for _ in range(20)]) for _ in range(40)]
    rows += ["", None, " \t\n", "one", "ONE", "one two three four", "one two three four", "a b c d e", "Ünï ünï ÜNÏ a b", "x y z"]
    rng.shuffle(rows)
    docs = list(enumerate(rows))
    got = {r[0]: (r[1], r[2]) for r in minhash.near_duplicates(make_docs(docs)).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == near_duplicates(docs)


def test_blocks_and_late_rounds_lose_no_link(spark, make_docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "HUBS", 1)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    docs = [(k, " ".join(edited(rng, base, 0.025))) for k in range(60)]
    got = {r[0]: (r[1], r[2]) for r in minhash.near_duplicates(make_docs(docs)).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == near_duplicates(docs)


def test_repeated_and_null_ids(spark, make_docs):
    text, other = "a b c d e f g h", "k l m n o p q r"
    rows = [(3, text), (3, text), (3, other), (None, text), (None, "u v w x y z"), (9, other)]
    got = sorted(map(tuple, minhash.near_duplicates(make_docs(rows)).collect()), key=str)
    assert got == sorted([(3, 4, 3, True), (3, 4, 3, True), (3, 4, 3, True), (None, 4, 3, False), (None, 2, None, True), (9, 4, 3, False)], key=str)
    docs = make_docs(rows)
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"]) == [(3, text), (3, other)]


def test_one_row_of_each_group_stays_whatever_the_ids(spark, make_docs):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:-1], "other"])
    text, far = " ".join(words), "one two three four five six"
    rows = [(None, text), (None, text), (None, near), (None, "k l m n o p"), (4, "k l m n o p")]
    rows += [(7, far), (7, far.upper()), (7, far + " seven"), (None, None), (None, " "), (None, " "), (7, "")]
    got = [(r["doc_id"], r["text"]) for r in minhash.representatives(make_docs(rows)).collect()]
    assert len(got) == len(set(got)) == 7
    assert len({(None, text), (None, near)} & set(got)) == 1 and len({(7, far), (7, far.upper())} & set(got)) == 1
    assert {(4, "k l m n o p"), (7, far + " seven"), (None, None), (None, " "), (7, "")} <= set(got)


def test_a_set_fetches_its_own_text_alone(spark, make_docs, monkeypatch):
    joined, fetch = [], minhash.texts_of

    def watched(*given):
        out = fetch(*given)
        joined.append(out._jdf.queryExecution().optimizedPlan().toString())
        joined.append({r["node"]: r["text"] for r in out.collect()})
        return out

    monkeypatch.setattr(minhash, "texts_of", watched)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(k % 2 or None, " ".join(edited(rng, base, 0.02))) for k in range(40)]
    minhash.near_duplicates(make_docs(rows))
    plan, texts = joined
    assert sorted(texts.values()) == sorted({t for _, t in rows})
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "text_key" in join and "doc_id" in join


def test_stated_recall_is_the_binomial_tail():
    pairs = 1 / sum(comb(64, k) * 0.75**k * 0.25**(64 - k) for k in range(minhash.MATCHES))
    for place in (Path(minhash.__file__), Path(minhash.__file__).parents[2] / "README.md"):
        stated = re.search(r"once in (?:about )?([\d,]+)\s+pairs", place.read_text()).group(1)
        assert abs(int(stated.replace(",", "")) / pairs - 1) < 0.01


def test_sketch_never_overstates_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 500))) for _ in range(2))
        differ = np.bitwise_count((minhash.sketch(a) ^ minhash.sketch(b)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_long_sets_have_the_same_signature_in_pieces():
    s = np.random.default_rng(1).integers(0, 2**63, 9000, dtype=np.uint64)
    whole = ((s[:, None] * minhash.FACTORS + minhash.SHIFTS) >> np.uint64(32)).min(0).astype(np.uint32).view(np.int32)
    assert (minhash.signature(s) == whole).all()


def all_pairs(rows):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    root = groups([i for i, _ in rows], links)
    return {i: (sum(i in p for p in links), root[i], root[i] == i) for i, _ in rows}


@pytest.mark.parametrize("chunk_rows", [20, 4096])
def test_vectors_against_all_pairs(spark, chunk_rows):
    rng = np.random.default_rng(2)
    rows = []
    for spread in (0.0, 0.02, 0.05, 0.08, 0.12):
        centre = rng.normal(size=16)
        rows += [list(map(float, centre + spread * rng.normal(size=16) * np.linalg.norm(centre) / 4)) for _ in range(30)]
    rows += [list(map(float, rng.normal(size=16))) for _ in range(40)]
    rows += [[2 * x for x in rows[0]], [1e-30 * x for x in rows[0]], None, [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0], [1.0, 0.01], []]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, cell string")
    got = {r[0]: tuple(r[1:]) for r in vectors.near_vectors(df, chunk_rows=chunk_rows).collect()}
    assert got == all_pairs(rows)


def test_vectors_without_id_and_repeated(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)], key=str)


def test_near_copies_on_the_threshold_are_judged_by_their_rows():
    # Rows 0 and 1 are 1e-8 apart, which a cosine cannot show; row 2 is 0.95 from between them.
    angles = np.array([0, 1e-8, np.arccos(0.95) + 5e-9])
    x = vectors.unit(np.stack([np.cos(angles), np.sin(angles)], axis=1))
    order, starts, centres, radii = vectors.Tree.built(x)
    n, _ = vectors.traversed(vectors.Tree(x[order], starts, centres, radii), None, 0.95)
    near = x[order] @ x[order].T >= 0.95
    assert (n == near.sum(1) - 1).all() and sorted(n) == [1, 1, 2]


def test_large_nodes_are_compared_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=24)
    x = vectors.unit(base + 0.25 * rng.normal(size=(300, 24)))
    monkeypatch.setattr(vectors, "DENSE", 64)
    order, starts, centres, radii = vectors.Tree.built(x)
    n, root = vectors.traversed(vectors.Tree(x[order], starts, centres, radii), None, 0.95)
    near = x[order] @ x[order].T >= 0.95
    assert (n == near.sum(1) - 1).all()
    links = [(a, b) for a, b in zip(*np.nonzero(near)) if a < b]
    assert groups(range(300), links) == dict(enumerate(root.tolist()))


def grown_trees(x, cells, basis=None):
    """Trees of the rows that are nearest to each cell's centre, with the places of their rows in x."""
    cell = (x @ cells.T).argmax(1)
    for k in range(len(cells)):
        at = np.flatnonzero(cell == k)
        order, *levels = vectors.Tree.built(x[at])
        yield at[order], vectors.Tree(x[at[order]], *levels, basis) if basis is not None else vectors.Tree(x[at[order]], *levels)


def test_cells_that_no_radius_excludes_compare_few_rows(monkeypatch):
    """Rows without clusters: two cells meet in a small part of their pairs, and every near pair is found."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x[:, 0] += np.repeat([2, -2], 2000)
    # Pairs on both sides of the plane between the cells.
    x[:100, 0] = rng.uniform(0, 1.5, size=100)
    x[2000:2100] = x[:100]
    x[2000:2100, 0] *= -1
    x = vectors.unit(x)
    (here, left), (there, right) = grown_trees(x, np.eye(64)[:1] * [[1], [-1]])
    compared, plain = [], vectors.touching

    def counted(a, b, *rest, **more):
        rows, cols = rest[5:7] if len(rest) > 5 else (a, b)
        compared.append(len(rows) * len(cols))
        return plain(a, b, *rest, **more)

    monkeypatch.setattr(vectors, "touching", counted)
    n, root = vectors.traversed(left, right, 0.95)
    near = x[here] @ x[there].T >= 0.95
    assert 50 < near.sum() < 100 and (n == np.concatenate((near.sum(1), near.sum(0)))).all()
    assert sum(compared) < 0.5 * len(here) * len(there)


@pytest.mark.parametrize("kind", ["even", "flat", "clusters", "copies"])
def test_trees_with_heads_against_all_pairs(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 40))
    if kind == "flat":
        x = x[:, :5] @ rng.normal(size=(5, 40)) + 0.05 * x
    if kind == "clusters":
        x = rng.normal(size=(9, 40))[rng.integers(0, 9, 1500)] + 0.15 * x
    if kind == "copies":
        x = x[rng.integers(0, 40, 1500)] + rng.choice([0, 0.01, 0.1], size=(1500, 1)) * x
    x = vectors.unit(x)
    basis = vectors.leading(x[:300], 0.95)
    trees = list(grown_trees(x, x[:3], basis))
    n, links = np.zeros(len(x), dtype=int), []
    for i, (at, left) in enumerate(trees):
        for other, right in trees[i:]:
            both = at if right is left else np.concatenate((at, other))
            count, root = vectors.traversed(left, None if right is left else right, 0.95)
            n[both] += count
            links += zip(both.tolist(), both[root].tolist())
    near = x @ x.T >= 0.95
    assert (n == near.sum(1) - 1).all()
    assert groups(range(len(x)), links) == groups(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])


def test_heads_never_understate_a_cosine():
    rng = np.random.default_rng(9)
    x = vectors.unit(rng.normal(size=(400, 48)) * np.linspace(2, 0.1, 48))
    for size in (1, 7, 47):
        basis = np.linalg.svd(x[:100])[2].T[:, :size]
        some = vectors.head(x, basis).astype(np.float64)
        assert (some @ some.T >= x @ x.T - 1e-6).all()
    basis = vectors.leading(x, 0.95)
    assert basis is not None and basis.shape[1] < 48 and np.allclose(basis.T @ basis, np.eye(basis.shape[1]))


@pytest.mark.parametrize("of", [1, 2, 5])
def test_groups_of_chunks_against_all_pairs(spark, monkeypatch, of):
    """Every pair of chunks meets once, however chunks are put into groups; a chunk is sent once for each other group."""
    monkeypatch.setattr(vectors, "GROUPS", of)
    rng = np.random.default_rng(10)
    rows = [list(map(float, v)) for v in rng.normal(size=(60, 24))]
    rows += [list(map(float, np.array(rows[i % 60]) + 0.04 * rng.normal(size=24))) for i in range(120)]
    rows += [rows[7]] * 30 + [[1.0, 0.1 * i] for i in range(20)] + [[1e150, 1.0], [3.0, 0.1 + 1e-12]]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r[0]: tuple(r[1:]) for r in vectors.near_vectors(df, chunk_rows=8).collect()}
    assert got == all_pairs(rows)


@pytest.mark.parametrize("dim, wide", [(3, 0.0), (64, 0.3), (64, 0.0), (900, 1.2)])
def test_centres_that_touch(dim, wide):
    """Single precision leaves out nothing that is near, also right at the threshold, and lets nothing else through."""
    rng = np.random.default_rng(dim)
    reach = float(vectors.chord(np.array(0.95)))
    x = vectors.unit(rng.normal(size=(70, dim)))
    side = vectors.unit(rng.normal(size=(70, dim)))
    side = vectors.unit(side - np.einsum("ij,ij->i", side, x)[:, None] * x)
    edge = 0.95 + rng.choice([-1e-9, 1e-9, -1e-5, 1e-5], size=70)[:, None]
    y = np.concatenate((edge * x + np.sqrt(1 - edge**2) * side, x[:5], vectors.unit(rng.normal(size=(20, dim)))))
    rx, ry = np.where(rng.random(70) < 0.5, 0, wide * rng.random(70)), np.where(rng.random(len(y)) < 0.5, 0, wide * rng.random(len(y)))
    want = np.nonzero(vectors.chord(x @ y.T) <= reach + rx[:, None] + ry[None, :] + vectors.SLACK)
    i, j, cos = vectors.touching(x, y, rx, ry, reach)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(v.tolist() for v in want))) and len(i) > 5
    assert np.allclose(cos, (x @ y.T)[i, j], atol=1e-12, rtol=0)
