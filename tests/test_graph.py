import itertools
import random
from collections import Counter, defaultdict, deque

import pytest

from litmine.operators import centrality, components, cocitation, graph, numbering, ranking, spread, traversal
from litmine.operators.graph import Graph
from litmine.session import cut, cut_by, discard


def make(spark, edges, nodes=None, weights=None):
    nodes = sorted(nodes if nodes is not None else {x for e in edges for x in e})
    v = spark.createDataFrame([(n, f"n{n}") for n in nodes], "id long, name string")
    rows = [(a, b, float(weights[i] if weights else 1.0)) for i, (a, b) in enumerate(edges)]
    return Graph(v, spark.createDataFrame(rows, "src long, dst long, weight double"))


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_paper_graph(spark):
    papers = spark.createDataFrame([(1, 2000, "a", "J1"), (2, 2001, "b", "J1"), (3, 2002, "c", "J2")],
                                   "pubmed_id long, pub_year int, title string, journal_id string")
    papers = papers.selectExpr("*", "journal_id as journal")
    sets = spark.createDataFrame([(1, [2, 3, 3, 9]), (8, [1])], "pubmed_id long, cited_in array<long>")
    links = graph.explode_links(sets)
    g = graph.build_paper_graph(papers, links)
    assert sorted((r["src"], r["dst"]) for r in g.edges.collect()) == [(2, 1), (3, 1), (3, 1)]
    check = graph.link_check(papers, links).first()
    assert (check["missing_nodes"], check["missing_links"], check["kept_links"]) == (1, 1, 3)
    j = graph.build_journal_graph(g)
    assert sorted((r["src"], r["dst"], r["weight"]) for r in j.edges.collect()) == [("J1", "J1", 1.0), ("J2", "J1", 2.0)]
    assert graph.build_paper_graph(papers, links, 2000, 2001).edges.count() == 1


def test_slices_match_single_windows(spark):
    rng = random.Random(1)
    papers = spark.createDataFrame([(i, 1990 + rng.randrange(10)) for i in range(40)], "pubmed_id long, pub_year int")
    links = spark.createDataFrame(random_edges(45, 200, 2), "src long, dst long")
    windows = [("a", 1990, 1994), ("b", 1993, 1999)]
    got = Counter((r["slice"], r["src"], r["dst"]) for r in graph.slice_edges(papers, links, windows).collect())
    for name, y0, y1 in windows:
        want = Counter((name, r["src"], r["dst"]) for r in graph.build_paper_graph(papers, links, y0, y1).edges.collect())
        assert Counter({k: v for k, v in got.items() if k[0] == name}) == want


def test_labels(spark):
    row = spark.createDataFrame([(7, "T" * 301, 1999, "J" * 101, "X1")],
                                "id long, title string, pub_year int, journal string, journal_id string")
    label = row.select(graph.paper_label().alias("x")).first()["x"]
    assert label == "T" * 299 + ".. || 7 || 1999 || " + "J" * 99 + ".. || X1"


def test_degrees_and_summary(spark):
    g = make(spark, [(1, 2), (1, 2), (2, 1), (3, 3), (1, 4)], nodes=range(1, 6), weights=[1, 2.7, 1, 1, 1])
    rows = {r["id"]: (r["in_degree"], r["out_degree"], r["in_weight"]) for r in graph.degrees(g).collect()}
    assert rows == {1: (1, 2, 1.0), 2: (1, 1, 2.7), 3: (1, 1, 1.0), 4: (1, 0, 1.0), 5: (0, 0, 0.0)}
    s = graph.summary(g).first().asDict()
    assert s == dict(no_in=1, no_out=2, no_in_no_out=1, in_and_out=3, total_out=4, total_in=4, nodes=5, self_links=1,
                     self_link_weight=1, reciprocal_links=3, total_in_weight=5)
    assert graph.isolated_count(g).first()["isolated"] == 1


def plain_peel(edges, nodes, rounds):
    edges, nodes, done = {e for e in edges if e[0] != e[1]}, set(nodes), 0
    while rounds is None or done < rounds:
        keep = {n for n in nodes if any(e[0] == n for e in edges) and any(e[1] == n for e in edges)}
        if keep == nodes:
            break
        nodes, edges, done = keep, {e for e in edges if e[0] in keep and e[1] in keep}, done + 1
    return edges


@pytest.mark.parametrize("rounds", [1, 2, None])
def test_clean_graph(spark, rounds):
    edges = random_edges(30, 45, 4)
    cleaned = graph.clean_graph(make(spark, edges, range(30)), (), rounds)
    got = {(r["src"], r["dst"]) for r in cleaned.edges.collect()}
    assert got == plain_peel(edges, range(30), rounds)
    assert {r["id"] for r in cleaned.vertices.collect()} == {x for e in got for x in e}


def test_clean_graph_hubs(spark):
    edges = [(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)]
    got = graph.clean_graph(make(spark, edges), ("3",)).edges.collect()
    assert {(r["src"], r["dst"]) for r in got} == {(1, 2), (2, 1)}


def plain_cocitation(edges):
    lists = defaultdict(set)
    for a, b in edges:
        lists[a].add(b)
    pairs = Counter()
    for refs in lists.values():
        pairs.update(itertools.permutations(refs, 2))
    return pairs


@pytest.mark.parametrize("block", [1, 3, 512])
def test_cocitation(spark, block):
    # A few papers with long lists, and cited papers with the very same citing papers.
    edges = random_edges(25, 120, 6) + [(99, k) for k in range(40)] + [(98, k) for k in range(30, 40)]
    g = make(spark, edges, range(100))
    want = plain_cocitation(edges)
    found = cocitation.cocitation_graph(g, block)
    got = {(r["src"], r["dst"]): r["weight"] for r in found.edges.collect()}
    assert got == dict(want)
    assert {r["id"] for r in found.vertices.collect()} == {a for a, _ in want}
    partners, strength = Counter(), Counter()
    for (a, _), n in want.items():
        partners[a] += 1
        strength[a] += n
    rows = {r["id"]: (r["partners"], r["strength"]) for r in cocitation.cocitation_strength(g, block).collect()}
    assert rows == {k: (partners[k], strength[k]) for k in partners}


def plain_pagerank(edges, nodes, alpha, rounds, teleport=None):
    out = defaultdict(dict)
    for a, b, w in edges:
        out[a][b] = max(w, out[a].get(b, 0.0))
    n = len(nodes)
    tele = teleport or {x: 1 / n for x in nodes}
    rank = {x: 1 / n for x in nodes}
    for _ in range(rounds):
        lost = sum(rank[x] for x in nodes if x not in out)
        new = {x: (alpha + (1 - alpha) * lost) * tele[x] for x in nodes}
        for a, targets in out.items():
            for b, w in targets.items():
                new[b] += (1 - alpha) * w / sum(targets.values()) * rank[a]
        total = sum(new.values())
        rank = {x: v / total for x, v in new.items()}
    return rank


@pytest.mark.parametrize("per_key", [2, 50_000])
def test_pagerank(spark, per_key):
    edges = random_edges(20, 40, 7) + [(0, k) for k in range(20)]
    weights = [1 + (i % 4) for i in range(len(edges))]
    g = make(spark, edges, range(22), weights)
    got = {r["id"]: r["pagerank"] for r in centrality.pagerank(g, 0.3, 12, 12, per_key=per_key).collect()}
    want = plain_pagerank([(a, b, w) for (a, b), w in zip(edges, weights)], range(22), 0.3, 12)
    assert got == pytest.approx(want, abs=1e-12)
    assert sum(got.values()) == pytest.approx(1.0)


def shuffles(df):
    """Shuffles that joins and aggregates ask for; the one that placed the kept edges is not of these."""
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


@pytest.fixture
def placed_in_place(spark, monkeypatch):
    """Edges in as many parts as a large graph has, and no side small enough to be broadcast."""
    monkeypatch.setattr(spread, "MIN_EDGES", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = cut(make(spark, random_edges(60, 400, 9)).edges.dropDuplicates(["src", "dst"]))
    placed = spread.place_edges(edges, "src", "dst")
    yield placed
    placed.release()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pagerank_round_shuffles_only_flows(spark, placed_in_place):
    rows = spark.range(60).selectExpr("id", "1 / 60d as teleport", "2d as out_sum", "1 / 60d as before", "1 / 60d as rank")
    state = cut_by(rows, "id", placed_in_place.parts)
    assert shuffles(centrality._pagerank_round(state, placed_in_place, 1.0, 0.5, 0.0)) == 1


def test_level_shuffles_only_new_ids(spark, placed_in_place):
    steps = spread.PlacedEdges(placed_in_place.rows.selectExpr("src as id", "dst as next"), "id", None, placed_in_place.parts)
    pieces = [cut_by(spark.range(n, n + 3), "id", steps.parts) for n in (0, 3, 6)]
    assert shuffles(traversal._next_level(pieces[-1], steps, pieces)) == 1


def test_bucketed_tables_are_removed(spark):
    first = cut_by(spark.range(5), "id", 3)
    second = cut_by(first, "id", 3, replaces=first)
    assert sorted(r["id"] for r in second.collect()) == list(range(5))
    names = {t.name for t in spark.catalog.listTables()}
    assert second._named in names
    name = second._named
    discard(second)
    assert name not in {t.name for t in spark.catalog.listTables()}


def test_long_chain_of_levels(spark):
    frame = make(spark, [(k, k + 1) for k in range(25)]).edges
    got = {r["id"]: r["level"] for r in traversal.reachable(spark.createDataFrame([(0,)], "id long"), frame).collect()}
    assert got == {k: k for k in range(26)}


def test_pagerank_node_weights_and_stop(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4)]
    g = make(spark, edges)
    weighted = Graph(g.vertices.selectExpr("id", "name", "cast(id as double) as node_weight"), g.edges)
    got = {r["id"]: r["pagerank"] for r in centrality.pagerank(weighted, 0.5, 5, 60, tol=1e-6).collect()}
    want = plain_pagerank([(a, b, 1.0) for a, b in edges], [1, 2, 3, 4], 0.5, 60, {k: k / 10 for k in (1, 2, 3, 4)})
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("per_key", [1, 50_000])
def test_pagerank_simple(spark, per_key):
    edges = sorted(set(random_edges(15, 40, 8)))
    frame = spark.createDataFrame(edges + edges[:5], "src long, dst long")
    out = Counter(a for a, _ in edges)
    rank = {a: 1.0 for a in out}
    for _ in range(4):
        flow = defaultdict(float)
        for a, b in edges:
            if a in rank:
                flow[b] += rank[a] / out[a]
        rank = {b: 0.15 + 0.85 * s for b, s in flow.items()}
    got = {r["id"]: r["rank"] for r in centrality.pagerank_simple(frame, 4, per_key, every=2).collect()}
    assert got == pytest.approx(rank)


def plain_betweenness(edges, nodes, sources):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    total = {n: 0.0 for n in nodes}
    for s in sources:
        dist, paths, before, order = {s: 0}, Counter({s: 1}), defaultdict(list), []
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        gain = Counter()
        for w in reversed(order):
            for v in before[w]:
                gain[v] += paths[v] / paths[w] * (1 + gain[w])
            if w != s:
                total[w] += gain[w]
    return total


@pytest.mark.parametrize("edges", [
    [(1, 2), (2, 3), (3, 4)],
    [(1, 0), (0, 2), (3, 0), (0, 4)],
    [(1, 2), (2, 3), (3, 4), (4, 1)],
    [(1, 2)],
    random_edges(12, 30, 9),
], ids=["path", "star", "cycle", "single", "random"])
def test_betweenness(spark, edges):
    nodes = sorted({x for e in edges for x in e})
    got = {r["id"]: r["betweenness"] for r in centrality.betweenness(make(spark, edges), chunk=5).collect()}
    assert got == pytest.approx(plain_betweenness(edges, nodes, nodes))


def test_betweenness_with_many_twins_at_both_ends(spark):
    middle = random_edges(6, 14, 3)
    edges = middle + [(100 + i, i % 3) for i in range(9)] + [(200 + i, x) for i in range(4) for x in (1, 4)]
    edges += [(x, 300 + i) for i in range(5) for x in (0, 5)] + [(3, 400 + i) for i in range(4)] + [(500, 501), (500, 502), (3, 3)]
    nodes = sorted({x for e in edges for x in e})
    got = {r["id"]: r["betweenness"] for r in centrality.betweenness(make(spark, edges)).collect()}
    assert got == pytest.approx(plain_betweenness(edges, nodes, nodes))
    some = [100, 103, 200, 2, 301, 500]
    got = centrality.betweenness(make(spark, edges), spark.createDataFrame([(i,) for i in some], "id long"), chunk=2)
    assert {r["id"]: r["betweenness"] for r in got.collect()} == pytest.approx(plain_betweenness(edges, nodes, some))


def test_betweenness_takes_start_nodes_in_portions_and_removes_their_rows(spark, monkeypatch):
    """Without a chunk given the rows on disk stay bounded: 10 start nodes of 10 nodes at 25 rows are several portions."""
    edges = [(i, (i + k) % 10) for i in range(10) for k in (1, 3)]
    stored, portions = [], []
    real_cut, real = centrality.cut, centrality._dependencies
    monkeypatch.setattr(centrality, "STATE_ROWS", 25)
    monkeypatch.setattr(centrality, "cut", lambda *a, **k: stored.append(real_cut(*a, **k)) or stored[-1])
    monkeypatch.setattr(centrality, "_dependencies", lambda *a: portions.append(1) or real(*a))
    found = centrality.betweenness(make(spark, edges))
    assert {r["id"]: r["betweenness"] for r in found.collect()} == pytest.approx(plain_betweenness(edges, range(10), range(10)))
    assert len(portions) == 5
    assert not [s for s in stored if "source" in s.columns and "_stored_at" in s.__dict__]


def test_betweenness_of_some_sources(spark):
    edges = random_edges(12, 30, 10)
    some = spark.createDataFrame([(1,), (5,)], "id long")
    g = make(spark, edges, range(12))
    got = {r["id"]: r["betweenness"] for r in centrality.betweenness(g, some).collect()}
    assert got == pytest.approx(plain_betweenness(edges, range(12), [1, 5]))


def plain_components(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("edges", [
    [(1, 1)],
    [(1, 2), (2, 1), (1, 2), (3, 3)],
    [(9, i) for i in range(9)] + [(20, 21)],
    random_edges(60, 45, 4),
], ids=["loop", "repeated", "star", "random"])
def test_components(spark, edges):
    found = components.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["component"] for r in found.collect()} == plain_components(edges)


def test_components_of_a_chain_take_few_rounds(spark):
    ids = [i * 7919 % 5000 for i in range(5000)]
    rows = [(ids[i], ids[i + 1]) for i in range(4999)] + [(6000, 6001), (None, 6002)]
    each = []
    found = components.components(spark.createDataFrame(rows, "src long, dst long"), each).collect()
    assert len(found) == 5002 and {r["component"] for r in found} == {0, 6000}
    assert len(each) < 20 and each[0] == 5000 and sum(each) < 3 * each[0]
    star = spark.range(1, 3000).selectExpr("0L as src", "id as dst")
    each.clear()
    assert {r["component"] for r in components.components(star, each).collect()} == {0} and len(each) < 20


def test_component_of_starts(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (8, 9)], "src long, dst long")
    starts = spark.createDataFrame([(4,), (77,), (4,), (None,)], "id long")
    found = components.component_of(starts, edges)
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (77, 77)} and found.count() == 5
    assert components.components(edges.limit(0)).count() == 0


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (8, 9)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "id long")
    assert {r["id"]: r["level"] for r in traversal.reachable(start, edges).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_closure(spark):
    links = [(1, 2), (1, 2), (3, 2), (3, 4), (8, 9)]
    seeds = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    papers, figures = traversal.citation_closure(seeds, spark.createDataFrame(links, "src long, dst long"))
    assert {r["id"]: (r["level"], r["hits"]) for r in papers.collect()} == {1: (0, 4), 2: (0, 4), 3: (1, 2), 4: (2, 1)}
    rows = {r["level"]: r.asDict() for r in figures.collect()}
    assert (rows[0]["retrieved"], rows[0]["retrieved_total"]) == (2, 3)
    assert (rows[0]["new_total"], rows[0]["new_unique"], rows[0]["not_seen_total"], rows[0]["not_seen_unique"]) == (5, 3, 1, 1)
    assert (rows[1]["retrieved"], rows[1]["not_seen_unique"]) == (1, 1)
    assert (rows[2]["retrieved"], rows[2]["new_unique"], rows[2]["not_seen_unique"]) == (1, 1, 0)


def test_numbers(spark):
    frame = spark.range(1000).selectExpr("id * 7 % 1000 as x").repartition(7)
    rows = numbering.number_rows(frame, "x", name="n").collect()
    assert sorted((r["x"], r["n"]) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_ranks(spark):
    rows = [(i, (i * 37) % 11, 1.0 / (1 + i % 5)) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, in_degree long, pagerank double")
    ranked = ranking.ranked(frame).collect()
    by_cites = sorted(rows, key=lambda r: (-r[1], r[0]))
    by_rank = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert {r["id"]: r["cite_rank"] for r in ranked} == {r[0]: i + 1 for i, r in enumerate(by_cites)}
    assert {r["id"]: r["pr_rank"] for r in ranked} == {r[0]: i + 1 for i, r in enumerate(by_rank)}
    top = ranking.rank_outliers(ranking.ranked(frame), n=20).collect()
    assert all(r["cite_rank"] // r["pr_rank"] >= 5 and r["pr_rank"] <= 20 for r in top) and top


def test_drugs(spark):
    rows = [("d1", "1AAA", "95%", "2BBB", "89%", "", "99%"), ("d1", "1AAA", "97%", "", "1%", "", "1%")]
    frame = spark.createDataFrame(rows, "generic_name string, pdb_id_1 string, sim_1 string, pdb_id_2 string, sim_2 string, pdb_id_3 string, sim_3 string")
    got = ranking.drug_targets(frame).collect()
    assert [(r["pdb_id"], r["generic_name"], r["similarity"]) for r in got] == [("1AAA", "d1", 97)]


def test_top_papers_as_by_full_ranks(spark):
    rows = [(i, i * 7 % 5, float(i * 3 % 4)) for i in range(60)]  # many ties
    frame = spark.createDataFrame(rows, "id long, in_degree long, pagerank double")
    full = ranking.ranked(frame)
    for by in ("pr_rank", "cite_rank"):
        for n in (7, 100):
            want = sorted(tuple(r) for r in full.filter(f"{by} <= {n}").select("id", "cite_rank", "pr_rank").collect())
            got = ranking.top_papers(frame, by, n).select("id", "cite_rank", "pr_rank").collect()
            assert sorted(tuple(r) for r in got) == want
    assert ranking.top_papers(frame.limit(0)).count() == 0


def test_loops_leave_few_folders(spark, tmp_path, monkeypatch):
    made = []

    def path(_, purpose):
        made.append(f"{tmp_path}/{purpose}-{len(made)}")
        return made[-1]

    monkeypatch.setattr("litmine.session.scratch_path", path)
    g = Graph(spark.range(20).select("id"), spark.range(20).selectExpr("id as src", "(id * 3 + 1) % 20 as dst", "1.0D as weight"))
    assert centrality.pagerank(g, min_iter=10, max_iter=10).count() == 20
    assert len(made) > 10 and len(list(tmp_path.iterdir())) <= 4


@pytest.mark.parametrize("per_key", [3, 50_000])
def test_blocked_edges_give_the_same_flows(spark, monkeypatch, per_key):
    monkeypatch.setattr(spread, "MIN_EDGES", 40)
    edges = sorted(set(random_edges(30, 200, 11) + [(0, k) for k in range(30)]))
    rows = [(a, b, 1.0 + (a + b) % 3) for a, b in edges] + [(None, 1, 1.0), (1, None, 1.0), (2, 99, None), (98, 1, 1.0)]
    frame = cut(spark.createDataFrame(rows, "src long, dst long, weight double"))
    push = spark.createDataFrame([(k, 1.0 + k) for k in range(25)] + [(3, 0.5), (None, 7.0), (97, 2.0)], "src long, share double")
    placed, blocked = spread.place_edges(frame, "src", "dst", per_key), spread.place_blocks(frame, per_key)
    want = {r["id"]: r["flow"] for r in placed.flows(push).collect() if r["id"] is not None and r["flow"]}
    got = {r["id"]: r["flow"] for r in blocked.flows(push).collect() if r["flow"]}
    assert got == pytest.approx(want) and len(got) > 20
    assert blocked.parts > 1 and blocked.sums(push).count() <= blocked.parts ** 2 < len(edges)  # not a row per edge
    placed.release()
    blocked.release()


def test_blocked_edges_of_names(spark):
    frame = cut(spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double"))
    blocked = spread.place_blocks(frame)
    push = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "src string, share double")
    assert {r["id"]: r["flow"] for r in blocked.flows(push).collect()} == {"b": 2.0, "c": 4.0}
    blocked.release()


def test_pagerank_round_moves_a_row_per_pair_of_blocks(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(spread.BlockedEdges, "flows", lambda self, push, made=spread.BlockedEdges.flows: calls.append(1) or made(self, push))
    centrality.pagerank(make(spark, random_edges(20, 60, 3)), 0.5, 3, 3).count()
    assert len(calls) == 3
