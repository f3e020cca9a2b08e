import json
import random

import seed
from seed import rows

from motorlot.operators import hierarchy as H, tours as T
from motorlot.session import checkpointed
from motorlot.sources.loaders import load_requirements

# Requirement graph (fixed values): id -> ids it depends on.
DEPENDS = {"003": ["001", "002"], "004": ["003"], "005": ["003"], "006": ["003", "005"], "007": ["003", "005"], "008": ["003"],
           "009": ["004", "005", "006", "007"], "010": ["003"], "012": ["003"]}


def edges(spark, pairs=None):
    pairs = pairs or [(a, b) for a, bs in DEPENDS.items() for b in bs]
    return spark.createDataFrame(pairs, "src string, dst string")


def test_employees(spark):
    tree = H.connect_by(seed.employees(spark))
    assert rows(tree, "member", "level", "root", "is_leaf") == [
        ("  James Wong", 2, "Linda Torres", 1), ("  Mike Peters", 2, "Sarah Johnson", 1), ("Linda Torres", 1, "Linda Torres", 0),
        ("Sarah Johnson", 1, "Sarah Johnson", 0)]
    assert ("    Mike Peters", 2, "Sarah Johnson > Mike Peters") in rows(H.org_chart(seed.employees(spark)))
    ordered = [r.member.strip() for r in tree.orderBy("steps").collect()]
    assert ordered == ["Linda Torres", "James Wong", "Sarah Johnson", "Mike Peters"]


def test_orphans_and_cycles_hang_off_no_root(spark):
    nodes = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 4), (4, "d", 3), (5, "e", 99)], "id long, name string, parent long")
    assert rows(H.tree_walk(nodes), "id") == [(1,), (2,)]
    assert rows(H.tree_walk(nodes.where("id > 2")), "id") == []


def test_closure(spark):
    got = {r.src: (r.dependencies, r.depth) for r in H.closure_summary(edges(spark)).collect()}
    assert got == {"003": (2, 1), **{k: (3, 2) for k in ("004", "005", "008", "010", "012")}, "006": (4, 3), "007": (4, 3), "009": (7, 4)}
    assert H.closure(edges(spark)).count() == 32


def test_cycles_end(spark):
    loop = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "z")])
    assert H.closure(loop).count() == 13
    assert dict(rows(H.chain_depth(loop))) == {"a": None, "b": None, "c": None, "x": None, "y": 1}
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "id string")
    assert rows(T.dependency_checks(loop, nodes)) == [("a", "CYCLE"), ("b", "CYCLE"), ("c", "CYCLE"), ("z", "UNKNOWN_TARGET")]


def test_requirement_documents(spark, tmp_path):
    items = [
        {"@id": "u/R1", "@type": "T", "requirementId": "R1", "title": "one", "priority": "Must-Have", "status": "Approved", "technology": ["JVM", "SQL"]},
        {"@id": "u/R2", "@type": "F", "requirementId": "R2", "title": "two", "priority": "Must-Have", "status": "Approved", "dependsOn": ["R1"],
         "inputFields": [{"name": "id", "type": "xsd:integer", "nullable": False}, {"name": "note", "type": "xsd:string", "nullable": True}]},
    ]
    (tmp_path / "doc.jsonld").write_text(json.dumps({"@type": "P", "hasRequirement": items}, indent=1))
    reqs = load_requirements(spark, str(tmp_path))
    assert rows(reqs, "id", "type", "requirementId") == [("u/R1", "T", "R1"), ("u/R2", "F", "R2")]
    assert rows(H.dependency_edges(reqs)) == [("R2", "R1")]
    assert rows(H.requirement_fields(reqs)) == [("R2", "id", "xsd:integer", False), ("R2", "note", "xsd:string", True)]
    summary = {(r.facet, r.value): r.requirements for r in H.requirement_summary(reqs).collect()}
    assert summary[("priority", "Must-Have")] == 2 and summary[("technology", "SQL")] == 1 and summary[("type", "F")] == 1


def test_cyclic_core_keeps_cycles_and_what_joins_them(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "e"), ("e", "f"), ("x", "y")], "src string, dst string")
    assert sorted(map(tuple, H.cyclic_core(edges).select("src", "dst").collect())) == [("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "e")]
    assert H.cyclic_core(edges.where("src = 'x'")).count() == 0


def plain_tree(items):
    """items (id, name, parent) -> {id: (number, last, level, descendants)} by a walk."""
    below = {}
    for i, name, parent in items:
        below.setdefault(parent, []).append((name, i))
    out, stack, number = {}, [(i, 1) for _, i in sorted(below.get(None, []), reverse=True)], 0
    while stack:
        i, level = stack.pop()
        number += 1
        out[i] = (number, level)
        stack += [(c, level + 1) for _, c in sorted(below.get(i, []), reverse=True)]
    ordered = sorted(out, key=lambda i: -out[i][0])
    size = dict.fromkeys(out, 0)
    parents = {i: p for i, _, p in items}
    for i in ordered:
        if parents[i] in size:
            size[parents[i]] += size[i] + 1
    return {i: (n, n + size[i], level, size[i]) for i, (n, level) in out.items()}


def test_numbers_of_a_random_forest(spark):
    draw = random.Random(4)
    items = [(i, f"n{draw.randrange(40)}", None if i < 3 else 1 if draw.random() < 0.4 else draw.randrange(i)) for i in range(300)]
    items += [(400, "lost", 999), (401, "below", 400), (402, "loop", 403), (403, "loop", 402)]
    got = T.tree_numbering(spark.createDataFrame(items, "id long, name string, parent long"))
    assert {r.id: (r.number, r.last, r.level, r.descendants) for r in got.collect()} == plain_tree(items)
    assert T.tree_numbering(spark.createDataFrame([], "id long, name string, parent long")).count() == 0


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(T, "checkpointed", lambda df: calls.append(1) or checkpointed(df))
    nodes = spark.range(10_000).selectExpr("id", "if(id = 0, null, id - 1) as parent", "cast(id as string) as name")
    got = T.tree_numbering(nodes)
    assert got.where("number != id + 1 or last != 10000 or level != id + 1 or descendants != 9999 - id").count() == 0
    assert got.count() == 10_000 and len(calls) <= 20


def components_of(pairs):
    nodes = {n for p in pairs for n in p}
    reach = {n: {n} for n in nodes}
    grown = True
    while grown:
        grown = False
        for a, b in pairs:
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    grown = True
    root = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    return {n: (root[n], list(root.values()).count(root[n])) for n in nodes}


def test_strong_components(spark):
    draw = random.Random(8)
    for count, edge_count in ((12, 14), (30, 38), (30, 60)):
        pairs = [(draw.randrange(count), draw.randrange(count)) for _ in range(edge_count)] + [(50, 51), (51, 52), (52, 50), (53, 50), (60, 60), (61, 60)]
        got = T.strong_components(spark.createDataFrame(pairs, "src long, dst long"))
        assert {r.node: (r.component, r.size) for r in got.collect()} == components_of(pairs)
    assert T.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_long_ring_forms_no_pairs(spark):
    ring = spark.range(10_000).selectExpr("id as src", "(id + 1) % 10000 as dst").union(spark.createDataFrame([(20_000, 5)], "src long, dst long"))
    got = T.strong_components(ring)
    assert got.where("size = 10000 and component = 0").count() == 10_000 and got.count() == 10_001


def test_dependencies_of_a_forest_and_of_other_graphs(spark):
    forest = edges(spark, [("b", "a"), ("c", "a"), ("d", "c"), ("x", "y")])
    assert rows(T.dependency_summary(forest)) == [("b", 1, 1), ("c", 1, 1), ("d", 2, 2), ("x", 1, 1)]
    assert T.forest_depths(edges(spark)) is None and T.forest_depths(edges(spark, [("a", "b"), ("b", "a")])) is None
