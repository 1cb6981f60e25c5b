"""Stand-in views on the driver tables. Each is one SQL text that Spark and DuckDB both run.

``{name}`` marks a base table or another view; Spark gets DataFrames for the marks, DuckDB gets names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_ids": """
        select p_partkey, concat(cast(1 + p_partkey % 9 as varchar(2)),
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(1 + p_partkey % 26 as int), 1),
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(1 + floor(p_partkey / 26.0) % 26 as int), 1),
          cast(p_partkey % 10 as varchar(2))) as id from {part}""",
    "corpus": """
        select p_partkey, concat('f', cast(p_partkey as varchar(20))) as file_name, case p_partkey % 17
          when 0 then 'Structure PDB ID: '||id||' was solved.'
          when 1 then 'The archive holds '||id||'entry and '||id||' today.'
          when 2 then 'Load '||id||'.pdb now.'
          when 3 then 'Go to explore.do?structureId='||id||' now.'
          when 4 then 'Go to explore.cgi?pdbId='||id||' now.'
          when 5 then 'Go to structidSearch.do?structureId='||id||' now.'
          when 6 then '<ext-link ext-link-type="pdb" xlink:href="'||id||'">'||id||'</ext-link>'
          when 7 then 'Found in PDB ('||id||').'
          when 8 then 'Found under PDB code '||id||'.'
          when 9 then 'Found in PDB entry number '||id||'.'
          when 10 then 'Deposited, accession '||id||'.'
          when 11 then 'Deposited, accession code '||id||'.'
          when 12 then 'Deposited, Accession number of '||id||'.'
          when 13 then 'The enzyme ('||lower(id)||') binds.'
          when 14 then 'See doi 10.2210/pdb'||lower(id)||'/pdb here.'
          when 15 then 'A dose of 0.'||id||' was used.'
          when 16 then 'In 2015 there were 1999 samples.' end as sentence from {v_ids}""",
    "v_files": """
        select concat('f', cast(p_partkey as varchar(20))) as file_name,
          concat('PMC', cast(p_partkey as varchar(20))) as pmc_id,
          cast(100000 + p_partkey as varchar(20)) as pm_id,
          date '2015-01-01' + cast(p_partkey % 365 as int) as update_date
        from {part} where p_partkey % 29 <> 0""",
    "v_articles": """
        select p_brand as journal, cast(1990 + p_partkey % 25 as int) as publication_year,
          concat('PMC', cast(p_partkey as varchar(20))) as pmc_id from {part}""",
    "v_entries": """
        select id as pdb_id,
          case p_partkey % 3 when 0 then null when 1 then concat('PMC', cast(p_partkey as varchar(20)))
            else 'PMC0' end as pmc_id,
          cast(100000 + p_partkey as varchar(20)) as pm_id,
          case when p_partkey % 41 = 0 then null else cast(1985 + (p_partkey * 3) % 25 as int) end as deposition_year,
          cast(case p_partkey % 5 when 0 then 2 when 1 then 3 else 1 end as int) as entry_type
        from {v_ids} where p_partkey % 7 <> 0""",
    "v_external": """
        select concat('PMC', cast(p_partkey as varchar(20))) as pmc_id from {part} where p_partkey % 4 = 0""",
    "v_papers": """
        select p_partkey as pubmed_id, p_name as title, cast(1990 + p_partkey % 25 as int) as pub_year,
          p_brand as journal, p_brand as journal_id, p_type as last_author from {part} where p_partkey % 31 <> 0""",
    "v_links": """
        select a.l_partkey as src, b.l_partkey as dst from {lineitem} a join {lineitem} b
          on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1""",
    "v_drugs": """
        select p_name as generic_name, id as pdb_id_1, concat(cast(70 + p_partkey % 31 as varchar(3)), '%') as sim_1,
          case when p_partkey % 2 = 0 then id else '' end as pdb_id_2,
          concat(cast(70 + (p_partkey * 2) % 31 as varchar(3)), '%') as sim_2,
          case when p_partkey % 3 = 0 then id else '' end as pdb_id_3,
          concat(cast(70 + (p_partkey * 3) % 31 as varchar(3)), '%') as sim_3
        from (select p.p_name, v.id, v.p_partkey from {part} p join {v_ids} v on p.p_partkey = v.p_partkey) t""",
    "v_mesh": """
        select id as pdb_id, concat(substr('ABCDE', cast(1 + p_partkey % 5 as int), 1), '0',
          cast(1 + p_partkey % 4 as varchar(2)), '.', cast(100 + p_partkey % 30 as varchar(4)), '.',
          cast(200 + p_partkey % 50 as varchar(4))) as mn from {v_ids}""",
    "v_id_papers": """
        select id as pdb_id, case when p_partkey % 3 = 1 then p_partkey end as pubmed_id
        from {v_ids} where p_partkey % 7 <> 0""",
    "v_tree": """
        select distinct mn from (
          select mn from {v_mesh} union all select substr(mn, 1, 7) from {v_mesh} union all
          select substr(mn, 1, 3) from {v_mesh} union all select substr(mn, 1, 1) from {v_mesh} union all
          select '0' as mn) t""",
    "v_term_report": """
        select id as pdb_id, cast(1990 + p_partkey % 25 as varchar(4)) as pub_year,
          concat('PMC', cast(p_partkey as varchar(20))) as pmc_id, cast(100000 + p_partkey as varchar(20)) as pm_id,
          concat('Heading ', mn, case when p_partkey % 3 = 0 then ', Unheard of' else '' end) as terms
        from (select v.id, v.p_partkey, concat(substr('ABCDE', cast(1 + p_partkey % 5 as int), 1), '0',
          cast(1 + p_partkey % 4 as varchar(2)), '.', cast(100 + p_partkey % 30 as varchar(4)), '.',
          cast(200 + p_partkey % 50 as varchar(4))) as mn from {v_ids} v) t""",
    "v_article_files": """
        select doc_id, concat('a', cast(doc_id % 300 as varchar(10))) as file_name,
          case when doc_id % 2 = 0 then 'nxml' else 'txt' end as format, text from {documents}""",
}

_MARK = re.compile(r"\{([a-z]\w*)\}")


class Tables:
    """Base tables and views of one folder, made on first use and never registered under a global name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                parts = {m: getattr(self, m) for m in _MARK.findall(VIEWS[name])}
                self._made[name] = self.spark.sql(VIEWS[name], **parts)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]


def with_views(sql: str, **extra: str) -> str:
    """Prefix ``sql`` with the views it names as ``{view}``; ``extra`` adds views of its own."""
    views = {**VIEWS, **extra}
    order: list[str] = []

    def visit(text: str) -> None:
        for mark in _MARK.findall(text):
            if mark in views and mark not in order:
                visit(views[mark])
                order.append(mark)

    visit(sql)
    plain = {name: _MARK.sub(r"\1", views[name]) for name in order}
    head = ",\n".join(f"{name} as materialized ({text})" for name, text in plain.items())
    return (f"with {head}\n" if head else "") + _MARK.sub(r"\1", sql)
