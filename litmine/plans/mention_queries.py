"""Registered queries on mentions, labels and yearly reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmine.operators import analysis, labels, mentions, model
from litmine.operators.rules import CONTACT, PDB, RulePack
from litmine.plans.tables import Tables, with_views
from litmine.session import cut, spread
from litmine.sources.archives import format_rank


def corpus_docs(t: Tables) -> DataFrame:
    return spread(t.corpus.select("file_name", F.col("sentence").alias("text")), "file_name")


def corpus_mentions(t: Tables) -> DataFrame:
    return mentions.mine_mentions(corpus_docs(t)).drop("sentence_no")


def merged(t: Tables, found: DataFrame | None = None) -> DataFrame:
    found = corpus_mentions(t) if found is None else found
    return labels.merge_metadata(found, labels.publications(t.v_files, t.v_articles), t.v_entries)


def labelled(t: Tables, found: DataFrame | None = None) -> DataFrame:
    """All label sets, of all mentions or of those in ``found``."""
    return labels.label_mentions(merged(t, found))


def counted(t: Tables) -> DataFrame:
    """The rows of ``labelled`` without the entry's year, equal ones counted."""
    return labels.count_labelled(corpus_mentions(t), labels.publications(t.v_files, t.v_articles), t.v_entries)


def final_mentions(t: Tables) -> DataFrame:
    """Positives and, in place of a model's choice, the unassigned mentions of an enzyme."""
    wanted = F.col("set_name").isin(labels.POSITIVES_I, labels.POSITIVES_II, labels.UNASSIGNED)
    sets = cut(labelled(t).filter(wanted).select("set_name", *analysis.DETAIL_COLUMNS))
    chosen = labels.label_set(sets, labels.UNASSIGNED).filter(F.contains("sentence", F.lit("enzyme")))
    return analysis.merge_details(
        labels.label_set(sets, labels.POSITIVES_I), labels.label_set(sets, labels.POSITIVES_II), chosen
    )


def documents(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("file_name"), "text")


def contact_mentions(t: Tables) -> DataFrame:
    return mentions.mine_mentions(documents(t), CONTACT, "found")


def sentence_rows(t: Tables) -> DataFrame:
    rows = mentions.sentences(t.documents.select("doc_id", "text"))
    return rows.select("doc_id", "sentence_no", F.length("raw").alias("n_chars"), F.md5("raw").alias("md5"))


def format_choice(t: Tables) -> DataFrame:
    files = t.v_article_files.select("doc_id", "file_name", "format", F.md5("text").alias("md5"), format_rank().alias("format_rank"))
    kept = mentions.first_format(files, order=("format_rank", "doc_id"))
    return kept.select("file_name", "doc_id", "format", "md5")


def incremental_files(t: Tables) -> DataFrame:
    return mentions.since(t.corpus.select("file_name", "p_partkey"), t.v_files, "2015-07-01")


def confusion_of_rule(t: Tables) -> DataFrame:
    """Taking every structured mention for a positive, against the label of the weak supervision."""
    rows = labels.mention_training_set(labelled(t))
    scored = rows.withColumn("prediction", (F.col("match_type") != PDB.default).cast("double"))
    rates = ("f1", "fpr", "fnr", "sensitivity", "specificity", "roc")
    return model.confusion(scored).select("tp", "tn", "fp", "fn", *[F.round(c, 9).alias(c) for c in rates])


QUERIES = {
    "mention_ids": lambda t: corpus_docs(t).select(
        "file_name", F.array_join(mentions.find_ids(F.col("text")), ",").alias("ids")
    ),
    "mention_types": lambda t: mentions.sentences(corpus_docs(t).filter(mentions.may_hold_id(F.col("text")))).select(
        "file_name", mentions.classify(F.col("raw")).alias("match_type")
    ),
    "mention_rows": corpus_mentions,
    "mentions_by_type": lambda t: analysis.mentions_by_type(corpus_mentions(t)),
    "corpus_prefilter": lambda t: corpus_docs(t).filter(mentions.may_hold_id(F.col("text"))).select("file_name"),
    "doc_prefilter": lambda t: documents(t).filter(mentions.may_hold_id(F.col("text"), CONTACT)).select("file_name"),
    "sentence_split": sentence_rows,
    "contact_mentions": contact_mentions,
    "contact_by_type": lambda t: analysis.mentions_by_type(contact_mentions(t)),
    "known_id_semi": lambda t: mentions.mentions_known(corpus_docs(t), t.v_entries, "file_name"),
    "merged_mentions": lambda t: merged(t).drop("sentence", "blinded_sentence"),
    "label_sets": labelled,
    "label_counts": lambda t: labelled(t).groupBy("set_name").agg(F.count("*").alias("n"), F.sum("label").alias("positives")),
    "exclusion_filter": lambda t: labels.drop_excluded(corpus_mentions(t)).select("pdb_id", "file_name"),
    "mention_train_set": lambda t: labels.mention_training_set(labelled(t)).select("pdb_id", "pmc_id", "blinded_sentence", "label"),
    "primary_train_set": lambda t: labels.primary_training_set(labelled(t)),
    "confusion_of_rule": confusion_of_rule,
    "merge_details": final_mentions,
    "merge_unique": lambda t: analysis.merge_unique(final_mentions(t)),
    "mentions_by_year": lambda t: analysis.mentions_by_year(final_mentions(t)),
    "final_by_type": lambda t: analysis.mentions_by_type(final_mentions(t)),
    "rollup_mean": lambda t: analysis.mean_mentions(final_mentions(t)).select(
        "publication_year", *[F.round(c, 9).alias(c) for c in ("mean_rollup", "mean_per_article")]
    ),
    "articles_by_year": lambda t: analysis.articles_by_year(final_mentions(t)),
    "publications_by_year": lambda t: analysis.publications_by_year(t.v_articles),
    "mention_ratio": lambda t: analysis.mention_ratio(final_mentions(t), t.v_articles).withColumn("ratio", F.round("ratio", 9)),
    "compare_ours_only": lambda t: analysis.only_ours(final_mentions(t), t.v_external, t.v_articles),
    "compare_theirs_only": lambda t: analysis.only_theirs(final_mentions(t), t.v_external, t.v_articles),
    "frame_counts": lambda t: analysis.row_counts(
        files=t.v_files, articles=t.v_articles, entries=t.v_entries, mentions=corpus_mentions(t)
    ),
    "latest_format": format_choice,
    "incremental_files": incremental_files,
}


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _class_sql(column: str, pack: RulePack) -> str:
    arms = []
    for rule in pack.rules:
        hit = f"regexp_extract({column}, {_quote(rule.pattern)})"
        test = f"{hit} <> ''"
        if rule.unless:
            test += f" and not regexp_matches({hit}, {_quote(rule.unless)})"
        arms.append(f"when {test} then '{rule.name}'")
    return "case " + " ".join(arms) + f" else '{pack.default}' end"


# RE2 has no look-around: take the character before along, and drop the hit afterwards.
_IDS = r"""list_sort(list_distinct(list_concat(
    list_transform(list_filter(
        regexp_extract_all(raw, '[.·]?\b[1-9](?:[A-Z0-9]{3}|[a-z0-9]{3})\b'),
        lambda x: not regexp_matches(x, '^[.·]') and not regexp_matches(x, '[0-9]{4}')), lambda x: upper(x)),
    case when regexp_matches(raw, '10.2210/pdb[1-9](?:[A-Z0-9]{3}|[a-z0-9]{3})/pdb')
      then [upper(regexp_extract(raw, '10.2210/pdb([1-9](?:[A-Z0-9]{3}|[a-z0-9]{3}))/pdb', 1))] else [] end)))"""
_CLEAN = r"trim(regexp_replace(translate(regexp_replace(raw, '<.*?>', ' ', 'g'), chr(10) || chr(9), '  '), ' +', ' ', 'g'), ' ')"
_BLIND = "list_reduce(list_prepend(lower(sentence), ids), lambda acc, x: replace(acc, lower(x), 'XXXX'))"

ORACLE_VIEWS = {
    "o_sent": f"""
        select file_name, {_CLEAN} as sentence, {_IDS} as ids, {_class_sql('raw', PDB)} as match_type
        from (select file_name, sentence as raw from {{corpus}}) c""",
    "o_mentions": f"""
        select unnest(ids) as pdb_id, file_name, sentence, {_BLIND} as blinded_sentence, match_type,
          match_type <> 'PDB_NONE' as match from {{o_sent}} where len(ids) > 0""",
    "o_merged": """
        select m.pdb_id, m.sentence, m.blinded_sentence, m.match_type, f.pmc_id, f.pm_id, a.publication_year,
          e.deposition_year, e.entry_type,
          coalesce(e.pmc_id is not null and (e.pmc_id = f.pmc_id or e.pm_id = f.pm_id), false) as primary_citation
        from {o_mentions} m join {v_files} f on m.file_name = f.file_name
          join {v_articles} a on f.pmc_id = a.pmc_id left join {v_entries} e on m.pdb_id = e.pdb_id""",
    "o_labelled": """
        select s.set_name, m.* exclude (entry_type), case when s.set_name like 'positives%' then 1.0::double
          else 0.0::double end as label
        from {o_merged} m, lateral (
          select 'positives_i' as set_name where primary_citation and publication_year >= deposition_year
          union all select 'positives_ii' where match_type <> 'PDB_NONE' and not primary_citation
            and publication_year >= deposition_year
          union all select 'negatives_i' where entry_type is not null and publication_year < deposition_year
          union all select 'negatives_ii' where entry_type is null
          union all select 'unassigned' where entry_type is not null and match_type = 'PDB_NONE'
            and publication_year >= deposition_year and not primary_citation) s""",
    "o_final": """
        select pdb_id, match_type, deposition_year, pmc_id, pm_id, publication_year, primary_citation, sentence
        from {o_labelled} where set_name like 'positives%' or (set_name = 'unassigned' and contains(sentence, 'enzyme'))""",
    "o_scope": """
        select x.pmc_id from (select distinct pmc_id from {v_external}) x join {v_articles} a on x.pmc_id = a.pmc_id""",
    "o_docs": """
        select cast(doc_id as varchar) as file_name, unnest(parts) as raw, generate_subscripts(parts, 1) - 1 as sentence_no
        from (select doc_id, string_split(
          regexp_replace(text, '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as parts
          from {documents} where regexp_matches(text, '""" + CONTACT.id_pattern + """')) d""",
    "o_contact": f"""
        select file_name, cast(sentence_no as int) as sentence_no, unnest(ids) as found, sentence,
          {_BLIND} as blinded_sentence, match_type, match_type <> 'NONE' as match
        from (select *, list_sort(list_distinct(regexp_extract_all(raw, {_quote(CONTACT.id_pattern)}))) as ids,
            {_CLEAN} as sentence, {_class_sql('raw', CONTACT)} as match_type from {{o_docs}}) s where len(ids) > 0""",
}
_TRAIN = """pdb_id not in ('3DNA', '1AND') and pdb_id not like '%H2O'"""
_LABELLED = "set_name like 'positives%' or set_name like 'negatives%'"

ORACLE_VIEWS["o_mention_train"] = f"""
    select pdb_id, pmc_id, blinded_sentence, label from {{o_labelled}} where ({_LABELLED}) and {_TRAIN}"""
ORACLE_VIEWS["o_primary_train"] = """
    select * exclude (set_name, primary_citation, label), cast(primary_citation as double) as label
    from {o_labelled} where set_name = 'positives_i' or (set_name = 'positives_ii'
      and sentence not like '%deposited%' and sentence not like '%submitted%')"""

ORACLES = {
    "mention_ids": "select file_name, array_to_string(ids, ',') as ids from {o_sent}",
    "mention_types": """select file_name, match_type from {o_sent} where len(ids) > 0 or file_name in (
        select file_name from {corpus} where p_partkey % 17 = 15)""",
    "mention_rows": "select * from {o_mentions}",
    "mentions_by_type": "select match_type, count(*) as mentions from {o_mentions} group by 1",
    "corpus_prefilter": """select file_name from {corpus} where len(list_filter(
        regexp_extract_all(sentence, '\\b[1-9](?:[A-Z0-9]{3}|[a-z0-9]{3})\\b'),
        lambda x: not regexp_matches(x, '[0-9]{4}'))) > 0
        or regexp_matches(sentence, '10.2210/pdb[1-9](?:[A-Z0-9]{3}|[a-z0-9]{3})/pdb')""",
    "doc_prefilter": f"""select cast(doc_id as varchar) as file_name from {{documents}}
        where regexp_matches(text, {_quote(CONTACT.id_pattern)})""",
    "sentence_split": """select doc_id, cast(generate_subscripts(parts, 1) - 1 as int) as sentence_no,
        cast(length(unnest(parts)) as int) as n_chars, md5(unnest(parts)) as md5
        from (select doc_id, string_split(
          regexp_replace(text, '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as parts from {documents}) d""",
    "contact_mentions": "select * from {o_contact}",
    "contact_by_type": "select match_type, count(*) as mentions from {o_contact} group by 1",
    "known_id_semi": """select distinct file_name from (select file_name, unnest(regexp_extract_all(sentence,
        '(?:\\b|pdb|PDB)[1-9][A-Za-z0-9]{3}\\b')) as hit from {corpus}) c
        where upper(right(hit, 4)) in (select pdb_id from {v_entries})""",
    "merged_mentions": "select * exclude (sentence, blinded_sentence) from {o_merged}",
    "label_sets": "select * from {o_labelled}",
    "label_counts": "select set_name, count(*) as n, sum(label) as positives from {o_labelled} group by 1",
    "exclusion_filter": f"select pdb_id, file_name from {{o_mentions}} where {_TRAIN}",
    "mention_train_set": "select * from {o_mention_train}",
    "primary_train_set": "select * from {o_primary_train}",
    "confusion_of_rule": f"""select *, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) as f1,
          round(1.0 * fp / nullif(fp + tn, 0), 9) as fpr, round(1.0 * fn / nullif(fn + tp, 0), 9) as fnr,
          round(1.0 * tp / nullif(tp + fn, 0), 9) as sensitivity, round(1.0 * tn / nullif(tn + fp, 0), 9) as specificity,
          round((1 + 1.0 * tp / nullif(tp + fn, 0) - 1.0 * fp / nullif(fp + tn, 0)) / 2, 9) as roc
        from (select count(*) filter (p and l) as tp, count(*) filter (not p and not l) as tn,
          count(*) filter (p and not l) as fp, count(*) filter (not p and l) as fn
          from (select match_type <> 'PDB_NONE' as p, label = 1.0 as l from {{o_labelled}}
            where ({_LABELLED}) and {_TRAIN}) r) c""",
    "merge_details": "select * from {o_final}",
    "merge_unique": "select distinct * exclude (match_type, sentence) from {o_final}",
    "mentions_by_year": "select publication_year, count(*) as mentions from {o_final} group by 1",
    "final_by_type": "select match_type, count(*) as mentions from {o_final} group by 1",
    "rollup_mean": """select publication_year, round(avg(n), 9) as mean_rollup,
          round(avg(n) filter (level = 0), 9) as mean_per_article
        from (select publication_year, count(*) as n, grouping(publication_year, pmc_id) as level
          from {o_final} group by rollup (publication_year, pmc_id)) r group by 1""",
    "articles_by_year": """select publication_year, count(*) as mentions from (
        select pmc_id, min(publication_year) as publication_year from {o_final} group by 1) a group by 1""",
    "publications_by_year": "select publication_year, count(*) as publications from {v_articles} group by 1",
    "mention_ratio": """select p.publication_year, p.publications, m.mentions, round(m.mentions / p.publications, 9) as ratio
        from (select publication_year, count(*) as publications from {v_articles} group by 1) p
        join (select publication_year, count(distinct pmc_id) as mentions from {o_final} group by 1) m
          on p.publication_year = m.publication_year""",
    "compare_ours_only": "select pmc_id from {o_final} except select pmc_id from {o_scope}",
    "compare_theirs_only": "select pmc_id from {o_scope} except select pmc_id from {o_final}",
    "frame_counts": """select 'files' as name, count(*) as n from {v_files} union all
        select 'articles', count(*) from {v_articles} union all select 'entries', count(*) from {v_entries} union all
        select 'mentions', count(*) from {o_mentions}""",
    "latest_format": """select file_name, doc_id, format, md5(text) as md5 from (select *, row_number() over (
        partition by file_name order by case format when 'nxml' then 0 else 1 end, doc_id) as rn
        from {v_article_files}) f where rn = 1""",
    "incremental_files": """select c.file_name, c.p_partkey from {corpus} c left join {v_files} f
        on c.file_name = f.file_name where f.update_date is null or f.update_date >= date '2015-07-01'""",
}
ORACLES = {name: with_views(sql, **ORACLE_VIEWS) for name, sql in ORACLES.items()}
