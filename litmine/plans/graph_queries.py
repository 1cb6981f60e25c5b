"""Registered queries on citation graphs, rankings, drug targets and the subject tree, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmine.operators import centrality, cocitation, components, graph, mesh, numbering, ranking, traversal
from litmine.operators.graph import Graph
from litmine.plans.tables import Tables, with_views
from litmine.session import cut

WINDOWS = [("early", 1990, 1999), ("late", 2000, 2014), ("middle", 1996, 2005)]
HUBS = ("Brand#11", "Brand#23", "Brand#35", "Brand#52")
PIVOTS = 4
# The SQL twins of the loops are unrolled; this is more than the longest shortest path at sf0.01.
LEVELS = 16
PEELS = 8
# The change of the ranks halves in every round at least; after this many it is below the operator's limit.
RANK_ROUNDS = 50


def papers_graph(t: Tables) -> Graph:
    return graph.build_paper_graph(t.v_papers, t.v_links)


def journal_graph(t: Tables) -> Graph:
    return graph.build_journal_graph(papers_graph(t))


def ranks_10(t: Tables) -> DataFrame:
    return centrality.pagerank(papers_graph(t), min_iter=10, max_iter=10)


def figures(t: Tables) -> DataFrame:
    """Degrees and ranks."""
    g = papers_graph(t).simple().stored()
    return cut(ranking.metrics_table(g, centrality.pagerank(g)))


def metrics(t: Tables) -> DataFrame:
    """The same with the rank rounded, so that equal ranks tie in every engine."""
    return figures(t).withColumn("pagerank", F.round("pagerank", 12))


def ranked(t: Tables) -> DataFrame:
    return ranking.ranked(metrics(t))


def report(rows: DataFrame, t: Tables) -> DataFrame:
    """Rank rows with the name of the paper."""
    names = t.v_papers.select(F.col("pubmed_id").alias("id"), "title", "journal")
    return rows.join(names, "id").select(
        "id", "in_degree", F.round("pagerank", 9).alias("pagerank"), "cite_rank", "pr_rank", "title", "journal"
    )


def pdb_metrics(t: Tables) -> DataFrame:
    """Figures of the primary citations only, with the ids they describe."""
    ids = ranking.ids_per_paper(t.v_id_papers.filter(F.col("pubmed_id").isNotNull())).withColumnRenamed("pubmed_id", "id")
    return metrics(t).join(ids, "id")


def pdb_report(rows: DataFrame) -> DataFrame:
    return rows.select("id", "pdb_ids", "in_degree", F.round("pagerank", 9).alias("pagerank"), "cite_rank", "pr_rank")


def years(t: Tables) -> DataFrame:
    return t.v_papers.select(F.col("pubmed_id").alias("id"), "pub_year")


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def pivots(t: Tables) -> DataFrame:
    return graph.degrees(papers_graph(t)).orderBy(F.desc("out_degree"), "id").limit(PIVOTS).select("id")


def year_components(t: Tables) -> DataFrame:
    """Components of the links between papers of the same year; a paper without such a link is alone."""
    papers = t.v_papers.select("pubmed_id", "pub_year")
    years = [papers.select(F.col("pubmed_id").alias(end), F.col("pub_year").alias(f"{end}_year")) for end in ("src", "dst")]
    links = t.v_links.join(years[0], "src").join(years[1], "dst").filter("src_year = dst_year")
    known = components.components(links)
    return papers.join(known, F.col("pubmed_id") == F.col("id"), "left").select(
        F.col("pubmed_id").alias("id"), F.coalesce("component", "pubmed_id").alias("component")
    )


def betweenness_papers(t: Tables) -> DataFrame:
    """All papers are start nodes. Sums of thousands of parts agree to fewer digits than those of four."""
    return centrality.betweenness(papers_graph(t)).select("id", F.round("betweenness", 5).alias("betweenness"))


def betweenness_pivots(t: Tables) -> DataFrame:
    """The part of the betweenness that comes from the given start nodes; the other two queries take all nodes."""
    return rounded(centrality.betweenness(papers_graph(t), pivots(t)), "betweenness")


def betweenness_tree(t: Tables) -> DataFrame:
    """Exact betweenness, all nodes as sources, of the subject tree with arcs from child to parent."""
    links = mesh.tree_links(descriptors(t))
    arcs = links.filter(F.col("mn") != "0").select(F.col("mn").alias("src"), F.col("parent_mn").alias("dst"))
    return centrality.betweenness(Graph(links.select(F.col("mn").alias("id")), arcs))


def seeds(t: Tables) -> DataFrame:
    return t.v_id_papers.filter(F.col("pubmed_id").isNotNull()).select(F.col("pubmed_id").alias("id"))


def closure(t: Tables, part: int) -> DataFrame:
    return traversal.citation_closure(seeds(t), t.v_links)[part]


def drug_rows(t: Tables) -> DataFrame:
    papers = t.v_id_papers.filter(F.col("pubmed_id").isNotNull())
    return rounded(ranking.drug_papers(ranking.drug_targets(t.v_drugs), papers, ranked(t)), "pagerank")


def descriptors(t: Tables) -> DataFrame:
    """One descriptor per tree number: heading and one more term."""
    heading = F.concat(F.lit("Heading "), F.col("mn"))
    return t.v_tree.select(
        F.concat(F.lit("U"), F.col("mn")).alias("ui"), heading.alias("mh"), F.array("mn").alias("mns"), F.array(heading).alias("terms")
    )


def term_reports(t: Tables) -> DataFrame:
    return t.v_term_report.withColumn("terms", F.split("terms", ", "))


def tree_report(t: Tables) -> DataFrame:
    known = descriptors(t)
    found, _ = mesh.match_terms(term_reports(t), known)
    return mesh.tree_report(mesh.tree_links(known), found)


QUERIES = {
    "paper_graph_edges": lambda t: papers_graph(t).edges,
    "paper_labels": lambda t: papers_graph(t).vertices.select("id", graph.paper_label().alias("label")),
    "light_labels": lambda t: graph.light_graph(papers_graph(t)).vertices,
    "year_window_edges": lambda t: graph.build_paper_graph(t.v_papers, t.v_links, 1996, 2005).edges,
    "graph_slices": lambda t: graph.slice_edges(t.v_papers, t.v_links, WINDOWS),
    "slice_papers": lambda t: graph.slice_papers(t.v_papers, WINDOWS).select("slice", "pubmed_id"),
    "missing_links": lambda t: graph.link_check(t.v_papers, t.v_links),
    "isolated_papers": lambda t: graph.isolated_count(papers_graph(t)),
    "isolated_journals": lambda t: graph.isolated_count(journal_graph(t)),
    "journal_graph": lambda t: journal_graph(t).edges,
    "journal_labels": lambda t: journal_graph(t).vertices.select("id", graph.journal_label().alias("label")),
    "clean_journal_graph": lambda t: graph.clean_graph(journal_graph(t), HUBS, rounds=1).edges,
    "clean_papers_rounds": lambda t: graph.clean_graph(papers_graph(t), (), rounds=3).edges,
    "clean_papers_fixpoint": lambda t: graph.clean_graph(papers_graph(t), (), rounds=None).edges,
    "cocitation": lambda t: cocitation.cocitation_graph(papers_graph(t)).edges,
    "cocitation_strength": lambda t: cocitation.cocitation_strength(papers_graph(t)),
    "degrees": lambda t: graph.degrees(papers_graph(t)),
    "network_summary": lambda t: graph.summary(papers_graph(t)),
    "journal_summary": lambda t: graph.summary(journal_graph(t)),
    "node_numbers": lambda t: numbering.number_rows(t.v_papers.select("pubmed_id"), "pubmed_id", name="node_no"),
    "numbered_edges": lambda t: graph.number_vertices(journal_graph(t)).edges,
    "pagerank_10": lambda t: rounded(ranks_10(t), "pagerank", digits=10),
    "pagerank": lambda t: rounded(centrality.pagerank(papers_graph(t)), "pagerank", digits=10),
    "pagerank_simple_5": lambda t: rounded(centrality.pagerank_simple(t.v_links, 5), "rank"),
    "pagerank_above": lambda t: rounded(
        centrality.top_ranked(
            rounded(centrality.pagerank_simple(t.v_links, 5), "rank"),
            t.v_papers.select(F.col("pubmed_id").alias("id"), "pubmed_id"),
        ),
        "rank",
    ),
    "top_papers": lambda t: report(ranking.top_papers(metrics(t)), t),
    "rank_outliers": lambda t: report(ranking.rank_outliers(metrics(t)), t),
    "top_pdb_papers": lambda t: pdb_report(ranking.top_papers(pdb_metrics(t), "cite_rank")),
    "pdb_outliers": lambda t: pdb_report(ranking.rank_outliers(pdb_metrics(t))),
    "year_stats": lambda t: rounded(ranking.year_stats(figures(t), years(t)), "relative_citations", "pagerank_deviation"),
    "year_isolated": lambda t: ranking.year_isolated(graph.degrees(papers_graph(t)), years(t)),
    "reach_from": lambda t: traversal.reachable(pivots(t).limit(1), t.v_links).select("id", "level"),
    "component_of": lambda t: components.component_of(pivots(t).limit(1), t.v_links),
    "year_components": year_components,
    "closure_papers": lambda t: closure(t, 0),
    "closure_levels": lambda t: closure(t, 1),
    "betweenness_pivots": betweenness_pivots,
    "betweenness_papers": betweenness_papers,
    "betweenness_journals": lambda t: rounded(centrality.betweenness(journal_graph(t)), "betweenness"),
    "betweenness_tree": betweenness_tree,
    "drug_similarities": lambda t: ranking.drug_similarities(t.v_drugs),
    "drug_targets": lambda t: ranking.drug_targets(t.v_drugs),
    "drug_target_counts": lambda t: ranking.drug_target_counts(ranking.drug_targets(t.v_drugs)),
    "drug_papers": drug_rows,
    "pdb_by_pubmed": lambda t: ranking.ids_per_paper(t.v_id_papers.filter(F.col("pubmed_id").isNotNull())),
    "seed_counts": lambda t: ranking.seed_counts(t.v_id_papers),
    "seed_hits": lambda t: ranking.seed_hits(t.v_id_papers),
    "mesh_rollup": lambda t: mesh.roll_up(t.v_mesh),
    "mesh_links": lambda t: mesh.tree_links(descriptors(t)),
    "mesh_match": lambda t: mesh.match_terms(term_reports(t), descriptors(t))[0],
    "mesh_match_counts": lambda t: mesh.match_terms(term_reports(t), descriptors(t))[1],
    "mesh_tree": tree_report,
    "mesh_tree_arcs": lambda t: mesh.tree_graph(tree_report(t)).edges,
    "mesh_tree_labels": lambda t: mesh.tree_graph(tree_report(t)).vertices,
}


def _graph_views(prefix: str, links: str) -> dict[str, str]:
    """Edges, simple edges and degrees of the paper graph over ``links``."""
    return {
        f"{prefix}_edges": f"""
            select src, dst, 1.0::double as weight from {{{links}}}
            where src in (select pubmed_id from {{v_papers}}) and dst in (select pubmed_id from {{v_papers}})""",
        f"{prefix}_simple": f"select src, dst, max(weight) as weight from {{{prefix}_edges}} group by 1, 2",
        f"{prefix}_degrees": f"""
            select p.pubmed_id as id, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree,
              coalesce(i.w, 0) as in_weight, coalesce(o.w, 0) as out_weight
            from {{v_papers}} p
            left join (select dst, count(*) as n, sum(weight) as w from {{{prefix}_simple}} group by 1) i on p.pubmed_id = i.dst
            left join (select src, count(*) as n, sum(weight) as w from {{{prefix}_simple}} group by 1) o on p.pubmed_id = o.src""",
    }


def _journal_views(prefix: str, edges: str) -> dict[str, str]:
    return {
        f"{prefix}_edges": f"""
            select a.journal_id as src, b.journal_id as dst, count(*)::double as weight
            from {{{edges}}} e join {{v_papers}} a on e.src = a.pubmed_id join {{v_papers}} b on e.dst = b.pubmed_id
            group by 1, 2""",
        f"{prefix}_nodes": "select journal_id as id, min(journal) as name from {v_papers} group by 1",
    }


def _summary_sql(nodes: str, edges: str) -> str:
    return f"""
        select (select count(*) from {nodes} where id not in (select dst from {edges})) as no_in,
          (select count(*) from {nodes} where id not in (select src from {edges})) as no_out,
          (select count(*) from {nodes} where id not in (select src from {edges})
            and id not in (select dst from {edges})) as no_in_no_out,
          (select count(*) from {nodes} where id in (select src from {edges})
            and id in (select dst from {edges})) as in_and_out,
          (select count(*) from {edges}) as total_out, (select count(*) from {edges}) as total_in,
          (select count(*) from {nodes}) as nodes,
          (select count(*) from {edges} where src = dst) as self_links,
          (select coalesce(sum(floor(weight)), 0)::bigint from {edges} where src = dst) as self_link_weight,
          (select count(*) from {edges} a join {edges} b on a.src = b.dst and a.dst = b.src) as reciprocal_links,
          (select sum(floor(weight))::bigint from {edges}) as total_in_weight"""


def _peel_views(rounds: int) -> dict[str, str]:
    views = {"c0": "select src, dst, weight from {g_simple} where src <> dst"}
    for k in range(1, rounds + 1):
        views[f"c{k}"] = f"""
            select * from {{c{k - 1}}} where src in (select dst from {{c{k - 1}}}) and dst in (select src from {{c{k - 1}}})"""
    return views


def _pagerank_views(rounds: int, alpha: float) -> dict[str, str]:
    views = {
        "pr_out": "select src, sum(weight) as w from {g_simple} group by 1",
        "pr0": """select pubmed_id as id, 1.0::double / (select count(*) from {v_papers}) as r,
            1.0::double / (select count(*) from {v_papers}) as tele from {v_papers}""",
    }
    for k in range(1, rounds + 1):
        p = f"{{pr{k - 1}}}"
        views[f"raw{k}"] = f"""
            select v.id, v.tele, ({alpha} + {1 - alpha} * (select coalesce(sum(r), 0) from {p}
                where id not in (select src from {{pr_out}}))) * v.tele + {1 - alpha} * coalesce(f.flow, 0) as r
            from {p} v left join (select e.dst, sum(e.weight / o.w * s.r) as flow from {{g_simple}} e
              join {{pr_out}} o on e.src = o.src join {p} s on e.src = s.id group by 1) f on v.id = f.dst"""
        views[f"pr{k}"] = f"select id, tele, r / (select sum(r) from {{raw{k}}}) as r from {{raw{k}}}"
    return views


def _simple_rank_views(rounds: int) -> dict[str, str]:
    views = {
        "sr_edges": "select distinct src, dst from {v_links}",
        "sr_out": "select src, count(*) as n from {sr_edges} group by 1",
        "sr0": "select src as id, 1.0::double as rank from {sr_out}",
    }
    for k in range(1, rounds + 1):
        views[f"sr{k}"] = f"""
            select e.dst as id, 0.15 + 0.85 * sum(s.rank / o.n) as rank from {{sr_edges}} e
            join {{sr_out}} o on e.src = o.src join {{sr{k - 1}}} s on e.src = s.id group by 1"""
    return views


def _between_views(p: str, starts: str, edges: str, levels: int) -> dict[str, str]:
    """Shortest paths from the start nodes level by level, then dependencies back; an error if a level is left."""
    views = {
        f"{p}_starts": starts,
        f"{p}_b0": f"select id as source, id as v, 1.0::double as paths from {{{p}_starts}}",
        f"{p}_seen0": f"select source, v from {{{p}_b0}}",
    }
    for k in range(1, levels + 1):
        views[f"{p}_b{k}"] = f"""
            select l.source, e.dst as v, sum(l.paths) as paths from {{{p}_b{k - 1}}} l join {{{edges}}} e on e.src = l.v
            where not exists (select 1 from {{{p}_seen{k - 1}}} s where s.source = l.source and s.v = e.dst) group by 1, 2"""
        views[f"{p}_seen{k}"] = f"select * from {{{p}_seen{k - 1}}} union all select source, v from {{{p}_b{k}}}"
    views[f"{p}_d{levels}"] = f"""
        select source, v, paths, case when paths > 0 then error('a path is longer than {levels}')::double end as delta
        from {{{p}_b{levels}}}"""
    for k in range(levels - 1, 0, -1):
        views[f"{p}_d{k}"] = f"""
            select l.source, l.v, l.paths, l.paths * coalesce(sum((1 + w.delta) / w.paths), 0) as delta
            from {{{p}_b{k}}} l left join {{{edges}}} e on e.src = l.v
              left join {{{p}_d{k + 1}}} w on w.source = l.source and w.v = e.dst group by 1, 2, 3"""
    return views


def _between_sql(p: str, nodes: str, digits: int = 9) -> str:
    return f"""select p.id, round(coalesce(sum(d.delta), 0), {digits}) as betweenness
        from {nodes} p left join ({_upto([f'{p}_d{k}' for k in range(1, LEVELS + 1)])}) d on d.v = p.id group by 1"""


def _upto(names: list[str]) -> str:
    return " union all ".join(f"select * from {{{n}}}" for n in names)


ORACLE_VIEWS = {
    **_graph_views("g", "v_links"),
    **_journal_views("j", "g_edges"),
    **_peel_views(PEELS),
    **_pagerank_views(RANK_ROUNDS, centrality.TELEPORT),
    **_simple_rank_views(5),
    **_between_views(
        "p", f"select id from {{g_degrees}} order by out_degree desc, id limit {PIVOTS}", "g_simple", LEVELS),
    **_between_views("pb", "select id from {g_degrees}", "g_simple", LEVELS),
    **_between_views("jb", "select id from {j_nodes}", "j_edges", LEVELS),
    "slices": "select * from (values " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in WINDOWS) + ") w(slice, y0, y1)",
    "cocited": """
        select a.dst as src, b.dst as dst, count(*)::double as weight from {g_simple} a join {g_simple} b
          on a.src = b.src and a.dst <> b.dst group by 1, 2""",
    "figures": f"""
        select d.id, d.in_degree, d.out_degree, p.r as pagerank from {{g_degrees}} d join {{pr{RANK_ROUNDS}}} p on d.id = p.id""",
    "ranks": "select * replace (round(pagerank, 12) as pagerank) from {figures}",
    "ranked": """
        select *, row_number() over (order by in_degree desc, id) as cite_rank,
          row_number() over (order by pagerank desc, id) as pr_rank from {ranks}""",
    "pdb_ranked": """
        select r.id, i.pdb_ids, r.in_degree, r.pagerank, row_number() over (order by in_degree desc, r.id) as cite_rank,
          row_number() over (order by pagerank desc, r.id) as pr_rank
        from {ranks} r join (select pubmed_id, string_agg(distinct pdb_id, '|' order by pdb_id) as pdb_ids
          from {v_id_papers} where pubmed_id is not null group by 1) i on r.id = i.pubmed_id""",
    "named": """
        select r.id, r.in_degree, round(r.pagerank, 9) as pagerank, r.cite_rank, r.pr_rank, p.title, p.journal
        from {ranked} r join {v_papers} p on r.id = p.pubmed_id""",
    "steps": """
        select src as id, dst as next from {v_links} union all select dst, src from {v_links}""",
    "seed_ids": "select pubmed_id as id from {v_id_papers} where pubmed_id is not null",
    "l0": "select distinct id, 0 as level from {seed_ids}",
    **{f"l{k}": f"""
        select distinct s.next as id, {k} as level from {{l{k - 1}}} l join {{steps}} s on s.id = l.id
        where {' and '.join(f's.next not in (select id from {{l{j}}})' for j in range(k))}""" for k in range(1, LEVELS)},
    "casc": " union all ".join(f"select * from {{l{k}}}" for k in range(LEVELS)),
    "casc_named": """
        select s.next as id, c.level as at, count(*) as n from {casc} c join {steps} s on s.id = c.id group by 1, 2""",
    "sims": """
        select generic_name, pdb_id, cast(replace(sim, '%', '') as int) as similarity from (
          select generic_name, pdb_id_1 as pdb_id, sim_1 as sim from {v_drugs} union all
          select generic_name, pdb_id_2, sim_2 from {v_drugs} union all
          select generic_name, pdb_id_3, sim_3 from {v_drugs}) x where pdb_id <> ''""",
    "targets": "select pdb_id, generic_name, max(similarity) as similarity from {sims} where similarity >= 90 group by 1, 2",
    "mesh_up": """
        select pdb_id, mn, mn as node from {v_mesh} union all select pdb_id, mn, substr(mn, 1, 7) from {v_mesh} union all
        select pdb_id, mn, substr(mn, 1, 3) from {v_mesh} union all select pdb_id, mn, substr(mn, 1, 1) from {v_mesh} union all
        select pdb_id, mn, '0' from {v_mesh}""",
    "links": """
        select mn, case when mn = '0' then '' when length(mn) = 1 then '0' when length(mn) = 3 then substr(mn, 1, 1)
          else substr(mn, 1, length(mn) - 4) end as parent_mn, 'U' || mn as ui, 'Heading ' || mn as mh from {v_tree}""",
    "below": """
        select a.mn, count(*) filter (b.parent_mn = a.mn) as children, count(*) as descendants
        from {links} a join {links} b on b.mn <> a.mn and b.mn <> '0'
          and (a.mn = '0' or starts_with(b.mn, a.mn)) group by 1""",
    "rollup": """
        select node as mn, count(distinct pdb_id) filter (node = mn) as direct, count(distinct pdb_id) as cumulative
        from {mesh_up} group by 1""",
    "tree": """
        select l.*, coalesce(r.direct, 0) as direct, coalesce(r.cumulative, 0) as cumulative,
          coalesce(b.children, 0) as children, coalesce(b.descendants, 0) as descendants
        from {links} l left join {rollup} r on l.mn = r.mn left join {below} b on l.mn = b.mn""",
}

ORACLES = {
    "paper_graph_edges": "select * from {g_edges}",
    "paper_labels": """select pubmed_id as id, concat_ws(' || ', title, cast(pubmed_id as varchar),
        cast(pub_year as varchar), journal, journal_id) as label from {v_papers}""",
    "light_labels": "select pubmed_id as id, cast(pubmed_id as varchar) as name from {v_papers}",
    "year_window_edges": """select src, dst, weight from {g_edges} where
        src in (select pubmed_id from {v_papers} where pub_year between 1996 and 2005) and
        dst in (select pubmed_id from {v_papers} where pub_year between 1996 and 2005)""",
    "graph_slices": """select w.slice, e.src, e.dst from {v_links} e join {v_papers} a on e.src = a.pubmed_id
        join {v_papers} b on e.dst = b.pubmed_id join {slices} w
        on a.pub_year between w.y0 and w.y1 and b.pub_year between w.y0 and w.y1""",
    "slice_papers": """select w.slice, p.pubmed_id from {v_papers} p join {slices} w on p.pub_year between w.y0 and w.y1""",
    "missing_links": """select count(distinct dst) filter (dst not in (select pubmed_id from {v_papers})) as missing_nodes,
        count(*) filter (dst in (select pubmed_id from {v_papers}) and src not in (select pubmed_id from {v_papers})) as missing_links,
        count(*) filter (dst in (select pubmed_id from {v_papers}) and src in (select pubmed_id from {v_papers})) as kept_links
        from {v_links}""",
    "isolated_papers": """select count(*) as nodes, count(*) filter (in_degree = 0 and out_degree = 0) as isolated
        from {g_degrees}""",
    "isolated_journals": """select count(*) as nodes, count(*) filter (id not in (select src from {j_edges})
        and id not in (select dst from {j_edges})) as isolated from {j_nodes}""",
    "journal_graph": "select * from {j_edges}",
    "journal_labels": "select id, name || ' || ' || id as label from {j_nodes}",
    "clean_journal_graph": f"""select * from {{j_edges}} where src <> dst and src not in {HUBS} and dst not in {HUBS}""",
    "clean_papers_rounds": "select * from {c3}",
    "clean_papers_fixpoint": f"select * from {{c{PEELS}}}",
    "cocitation": "select * from {cocited}",
    "cocitation_strength": "select src as id, count(*) as partners, sum(weight)::bigint as strength from {cocited} group by 1",
    "degrees": "select * from {g_degrees}",
    "network_summary": _summary_sql("(select pubmed_id as id from {v_papers})", "{g_simple}"),
    "journal_summary": _summary_sql("{j_nodes}", "{j_edges}"),
    "node_numbers": "select pubmed_id, row_number() over (order by pubmed_id) as node_no from {v_papers}",
    "numbered_edges": """select a.n as src, b.n as dst, weight from {j_edges} e
        join (select id, row_number() over (order by id) as n from {j_nodes}) a on e.src = a.id
        join (select id, row_number() over (order by id) as n from {j_nodes}) b on e.dst = b.id""",
    "pagerank_10": "select id, round(r, 10) as pagerank from {pr10}",
    "pagerank": f"select id, round(r, 10) as pagerank from {{pr{RANK_ROUNDS}}}",
    "pagerank_simple_5": "select id, round(rank, 9) as rank from {sr5}",
    "pagerank_above": """select id, round(rank, 9) as rank, id as pubmed_id from {sr5}
        where round(rank, 9) > 0.8 and id in (select pubmed_id from {v_papers})""",
    "top_papers": "select * from {named} order by pr_rank limit 100",
    "rank_outliers": "select * from {named} where pr_rank <= 100 and floor(cite_rank / pr_rank) >= 5",
    "top_pdb_papers": "select * replace (round(pagerank, 9) as pagerank) from {pdb_ranked} order by cite_rank limit 100",
    "pdb_outliers": """select * replace (round(pagerank, 9) as pagerank) from {pdb_ranked}
        where pr_rank <= 100 and floor(cite_rank / pr_rank) >= 5""",
    "year_stats": """select p.pub_year, count(*) as papers, sum(r.in_degree)::bigint as citations,
          round(avg(r.in_degree) / (select avg(in_degree) from {figures}), 9) as relative_citations,
          round(avg(abs(r.pagerank * (select count(*) from {figures}) - 1)), 9) as pagerank_deviation
        from {figures} r join {v_papers} p on r.id = p.pubmed_id group by 1""",
    "year_isolated": """select p.pub_year, count(*) as papers, sum(d.in_degree)::bigint as citations,
          count(*) filter (d.in_degree = 0 and d.out_degree = 0) as isolated
        from {g_degrees} d join {v_papers} p on d.id = p.pubmed_id group by 1""",
    "closure_papers": """select c.id, c.level, coalesce(s.n, 0) + coalesce(m.n, 0) as hits from {casc} c
        left join (select id, count(*) as n from {seed_ids} group by 1) s on c.id = s.id
        left join (select id, sum(n)::bigint as n from {casc_named} group by 1) m on c.id = m.id""",
    "closure_levels": """select e.level, e.retrieved, e.retrieved_total, coalesce(f.new_total, 0) as new_total,
          coalesce(f.new_unique, 0) as new_unique, coalesce(f.not_seen_total, 0) as not_seen_total,
          coalesce(f.not_seen_unique, 0) as not_seen_unique
        from (select level, count(*) as retrieved, sum(n)::bigint as retrieved_total from (
            select id, 0 as level, count(*) as n from {seed_ids} group by 1 union all
            select c.id, c.level, n.n from {casc} c join {casc_named} n on n.id = c.id and n.at = c.level - 1) x group by 1) e
        left join (select n.at as level, sum(n.n)::bigint as new_total, count(*) as new_unique,
            sum(case when c.level = n.at + 1 then n.n else 0 end)::bigint as not_seen_total,
            count(*) filter (c.level = n.at + 1) as not_seen_unique
          from {casc_named} n join {casc} c on c.id = n.id group by 1) f on e.level = f.level""",
    "betweenness_pivots": _between_sql("p", "(select pubmed_id as id from {v_papers})"),
    "betweenness_papers": _between_sql("pb", "(select pubmed_id as id from {v_papers})", 5),
    "betweenness_journals": _between_sql("jb", "{j_nodes}"),
    # In a tree each pair of a node below and a node above has one path, through the node.
    "betweenness_tree": """select l.mn as id, coalesce(b.descendants, 0)::double * case length(l.mn) when 1 then
          case l.mn when '0' then 0 else 1 end when 3 then 2 when 7 then 3 else 4 end as betweenness
        from {links} l left join {below} b on l.mn = b.mn""",
    "drug_similarities": "select * from {sims}",
    "drug_targets": "select * from {targets}",
    "drug_target_counts": "select count(distinct pdb_id) as ids, count(*) as matches from {targets}",
    "drug_papers": """select t.pdb_id, t.generic_name, t.similarity, i.pubmed_id, r.in_degree, r.out_degree,
          round(r.pagerank, 9) as pagerank, r.cite_rank, r.pr_rank
        from {targets} t join {v_id_papers} i on t.pdb_id = i.pdb_id join {ranked} r on r.id = i.pubmed_id""",
    "pdb_by_pubmed": """select pubmed_id, string_agg(distinct pdb_id, '|' order by pdb_id) as pdb_ids from {v_id_papers}
        where pubmed_id is not null group by 1""",
    "seed_counts": """select count(*) as ids, count(pubmed_id) as with_citation, count(distinct pubmed_id) as citations
        from {v_id_papers}""",
    "seed_hits": "select pubmed_id, count(*) as n from {v_id_papers} where pubmed_id is not null group by 1",
    "mesh_rollup": "select * from {rollup}",
    "mesh_links": "select * from {links}",
    "mesh_match": "select distinct pdb_id, 'U' || substr(split_part(terms, ', ', 1), 9) as ui from {v_term_report}",
    "mesh_match_counts": """select count(*) as found,
        count(*) filter (contains(terms, 'Unheard')) as not_found from {v_term_report}""",
    "mesh_tree": "select * from {tree}",
    "mesh_tree_arcs": "select mn as src, parent_mn as dst, 1.0::double as weight from {links} where mn <> '0'",
    "mesh_tree_labels": """select mn as id, mh || ' [' || mn || '] | ' || direct || ' | ' || cumulative as name from {tree}""",
    "reach_from": """with_recursive""",
}
_COMPONENT = """with recursive {views}, walk(id) as (
    select id from (select id from g_degrees order by out_degree desc, id limit 1) s
    union select s.next from walk w join (select distinct id, next from steps) s on s.id = w.id)
    select id, (select min(id) from walk) as component from walk"""
_YEARS = """with recursive {views}, years as (
    select distinct s.id, s.next from steps s join v_papers a on a.pubmed_id = s.id join v_papers b on b.pubmed_id = s.next
    where a.pub_year = b.pub_year), walk(id, other) as (
    select pubmed_id, pubmed_id from v_papers union select w.id, y.next from walk w join years y on y.id = w.other)
    select id, min(other) as component from walk group by 1"""
_REACH = """with recursive {views}, walk(id, level) as (
    select id, 0 from (select id from g_degrees order by out_degree desc, id limit 1) s
    union select s.next, w.level + 1 from walk w join (select distinct id, next from steps) s on s.id = w.id where w.level < 40)
    select id, min(level) as level from walk group by 1"""


def _walk_sql(walk: str) -> str:
    body = with_views("select 1 from {g_degrees}, {steps}", **ORACLE_VIEWS)
    views = body[len("with ") : body.rindex("\nselect 1 from")]
    return walk.format(views=views)


ORACLES = {name: with_views(sql, **ORACLE_VIEWS) for name, sql in ORACLES.items() if name != "reach_from"}
ORACLES |= {name: _walk_sql(walk) for name, walk in (
    ("reach_from", _REACH), ("component_of", _COMPONENT), ("year_components", _YEARS))}
