"""Registered queries on similar articles and on the classifiers, with the SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmine.functions.text import STOP_WORDS, content_words
from litmine.operators import labels, model, similarity
from litmine.operators.labels import drop_excluded
from litmine.operators.rules import PDB
from litmine.plans.mention_queries import ORACLE_VIEWS as MENTION_VIEWS
from litmine.plans.mention_queries import corpus_mentions, counted, labelled
from litmine.plans.tables import Tables, with_views
from litmine.session import cut, scratch_path, spread, union


def articles(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text"), "doc_id")


def similar(t: Tables) -> tuple[DataFrame, DataFrame]:
    return similarity.similar_articles(articles(t), "doc_id", content_words(F.col("text")))


def similar_lsh(t: Tables) -> DataFrame:
    _, sets = similarity.copy_groups(articles(t), "doc_id", content_words(F.col("text")))
    return similarity.similar_sets_lsh(sets)


def lsh_recall(t: Tables) -> DataFrame:
    """Pairs of the exact and of the approximate join, those that only the latter has, and whether nine tenths are found."""
    _, sets = similarity.copy_groups(articles(t), "doc_id", content_words(F.col("text")))
    found = similarity.similar_sets_lsh(sets).select("a", "b", F.lit(1).alias("approximate"))
    exact = similarity.similar_sets(sets).select("a", "b", F.lit(1).alias("exact"))
    both = exact.join(found, ["a", "b"], "full")
    counts = both.agg(
        F.count("exact").alias("exact_pairs"), F.count_if(F.col("exact").isNotNull() & F.col("approximate").isNotNull()).alias("found"),
        F.count_if(F.col("exact").isNull()).alias("wrong"),
    )
    return counts.withColumn("enough", 10 * F.col("found") >= 9 * F.col("exact_pairs"))


def similar_hashed(t: Tables) -> DataFrame:
    features = similarity.hashed_features(F.col("text")).cast("array<string>")
    return similarity.similar_articles(articles(t), "doc_id", features)[1]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def article_hash(t: Tables) -> DataFrame:
    return articles(t).select(
        "doc_id", F.array_join(similarity.hashed_features(F.col("text")), ",").alias("features")
    )


def feature_pairs(t: Tables) -> DataFrame:
    """The tables have no features over the usual limit of 0.9, so this takes 0.5."""
    features = similarity.hashed_features(F.col("text"))
    return rounded(similarity.feature_similarity(articles(t), features, above=0.5), "cosine")


def vector_sizes(t: Tables) -> DataFrame:
    """The hashed vectors of the ML library, by the number of features they set."""
    from pyspark.ml.functions import vector_to_array

    vectors = similarity.article_vectors(articles(t)).select("doc_id", vector_to_array("features").alias("v"))
    return vectors.select("doc_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).cast("int").alias("n_features"))


def mention_model(t: Tables):
    sets = cut(counted(t))
    training, test = model.split(labels.mention_training_set(sets), "pdb_id", "pmc_id", "blinded_sentence")
    return sets, model.fit(training), training, test


def primary_model(t: Tables):
    sets = cut(counted(t))
    training, test = model.split(labels.primary_training_set(sets), "pdb_id", "pmc_id", "blinded_sentence")
    return sets, model.fit(training, tol=model.PRIMARY_TOL), training, test


def mention_model_metrics(t: Tables) -> DataFrame:
    _, fitted, training, test = mention_model(t)
    return model.evaluate(fitted, training, test)


def primary_model_metrics(t: Tables) -> DataFrame:
    _, fitted, training, test = primary_model(t)
    return model.evaluate(fitted, training, test)


def primary_optimum(t: Tables) -> DataFrame:
    """The tolerance of the other classifier lets it stop before the optimum, so only this one is held against it."""
    _, fitted, training, _ = primary_model(t)
    return model.optimum_check(fitted, training, 1e-3)


def mention_scores(t: Tables) -> DataFrame:
    """What the mention classifier accepts and refuses, against its weights."""
    sets, fitted, _, _ = mention_model(t)
    return model.score_check(fitted, drop_excluded(labels.label_set(sets, labels.UNASSIGNED)))


def model_report(t: Tables) -> DataFrame:
    """The report of the mention classifier, written as text in one file and read again."""
    path = scratch_path(t.spark, "report")
    model.write_report(mention_model_metrics(t), path)
    read = t.spark.read.schema("part string, tp long, tn long, fp long, fn long").json(path)
    files = read.select(F.input_file_name().alias("file")).distinct().count()
    return totals(read).withColumn("files", F.lit(files))


def auc_probability(t: Tables) -> DataFrame:
    """Area under the curve of a plain score on the mention training set: the longer a blinded sentence, the likelier."""
    rows = labels.mention_training_set(labelled(t))
    score = (F.length("blinded_sentence") / (F.length("blinded_sentence") + 40.0)).alias("score")
    return rounded(model.area_under_roc(rows.select("label", score)), "area")


def _rows_of(t: Tables, found: DataFrame, *names: str) -> DataFrame:
    """The rows of the sets ``names`` that mentions make with the entries."""
    return labels.label_set(labelled(t, found), *names)


def mention_predictions(t: Tables) -> DataFrame:
    """Mentions are scored once and only accepted ones meet their entries, of which an id may have many."""
    _, fitted, _, _ = mention_model(t)
    default = corpus_mentions(t).filter(F.col("match_type") == PDB.default)  # all that can be unassigned
    found = model.accepted(fitted, drop_excluded(default))
    return _rows_of(t, found, labels.UNASSIGNED).select(*labels.LABEL_COLUMNS)


def primary_predictions(t: Tables) -> DataFrame:
    """Scored with the saved and loaded model, as ``mention_predictions``."""
    _, fitted, _, _ = primary_model(t)
    path = scratch_path(t.spark, "model")
    model.save(fitted, path)
    found = model.accepted(model.load(path), corpus_mentions(t))
    return _rows_of(t, found, labels.POSITIVES_II, labels.UNASSIGNED).select(*model.PRIMARY_COLUMNS)


def totals(metrics: DataFrame) -> DataFrame:
    """What the confusion counts add up to, which does not depend on the model."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return metrics.select("part", (tp + tn + fp + fn).alias("n"), (tp + fn).alias("positives"))


def prediction_check(t: Tables) -> DataFrame:
    """Candidates, predictions that are none of them, and rows on which the saved and loaded model differs."""
    sets, fitted, _, _ = primary_model(t)
    path = scratch_path(t.spark, "model")
    model.save(fitted, path)
    candidates = labels.label_set(sets, labels.POSITIVES_II, labels.UNASSIGNED)
    first, again = (cut(model.predict_primary(m, candidates)) for m in (fitted, model.load(path)))
    outside = labels.beyond(first, candidates.select(*first.columns))
    changed = labels.beyond(first, again).unionAll(labels.beyond(again, first))
    marked = [
        frame.select(F.lit(name).alias("name"), labels.COPIES) for name, frame in
        (("candidates", candidates), ("outside", outside), ("changed", changed))
    ]
    found = [F.coalesce(F.sum(F.when(F.col("name") == n, F.col(labels.COPIES))), F.lit(0)).alias(n) for n in ("candidates", "outside", "changed")]
    return union(marked).agg(*found)


def split_sizes(t: Tables) -> DataFrame:
    rows = labels.mention_training_set(labelled(t))
    training, test = model.split(rows, "pdb_id", "pmc_id", "blinded_sentence")
    return training.withColumn("part", F.lit("training")).unionByName(test.withColumn("part", F.lit("testing"))).groupBy(
        "part"
    ).agg(F.count("*").alias("n"))


QUERIES = {
    "article_hash": article_hash,
    "article_vector_sizes": vector_sizes,
    "similar_docs": lambda t: rounded(similar(t)[1], "cosine"),
    "similar_doc_members": lambda t: similar(t)[0],
    "similar_doc_count": lambda t: similarity.similar_pair_count(*similar(t)),
    "similar_lsh": lambda t: rounded(similar_lsh(t), "cosine"),
    "lsh_recall": lsh_recall,
    "similar_hashed": lambda t: rounded(similar_hashed(t), "cosine"),
    "feature_similarity": feature_pairs,
    "mention_split": split_sizes,
    "mention_model_metrics": mention_model_metrics,
    "primary_model_metrics": primary_model_metrics,
    "mention_model_totals": lambda t: totals(mention_model_metrics(t)),
    "primary_model_totals": lambda t: totals(primary_model_metrics(t)),
    "prediction_check": prediction_check,
    "auc_probability": auc_probability,
    "primary_optimum": primary_optimum,
    "mention_scores": mention_scores,
    "model_report": model_report,
    "mention_predictions": mention_predictions,
    "primary_predictions": primary_predictions,
}

_PART = """case when ('0x' || md5(concat_ws('|', '1', pdb_id, pmc_id, blinded_sentence))[1:8])::bigint % 10 < 8
    then 'training' else 'testing' end"""


def _totals_sql(rows: str) -> str:
    return f"""select {_PART} as part, count(*) as n, count(*) filter (label = 1.0) as positives from {{{rows}}} group by 1"""


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS if w.isalpha())


def _pairs(prefix: str, items: str) -> dict[str, str]:
    """Distinct item sets, their members and all pairs over the limit, by the inverted index."""
    return {
        f"{prefix}_marked": f"""
            select doc_id, items, md5(array_to_string(items, ' ')) as mark from {{{items}}} where len(items) > 0""",
        f"{prefix}_sets": f"""
            select min(doc_id) as rep, mark, count(*) as copies, any_value(items) as items from {{{prefix}_marked}} group by mark""",
        f"{prefix}_rows": f"select rep, len(items) as n, unnest(items) as item from {{{prefix}_sets}}",
        f"{prefix}_pairs": f"""
            select a, b, common, common / sqrt(n_a * n_b::double) as cosine from (
              select x.rep as a, y.rep as b, x.n as n_a, y.n as n_b, count(*)::int as common
              from {{{prefix}_rows}} x join {{{prefix}_rows}} y on x.item = y.item and x.rep < y.rep
                and least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) group by 1, 2, 3, 4) p
            where common / sqrt(n_a * n_b::double) > 0.9""",
    }


_SEEDS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(similarity.hash_family(similarity.LSH_BANDS * similarity.LSH_ROWS)))

ORACLE_VIEWS = {
    "seeds": f"select * from (values {_SEEDS}) s(k, a, b)",
    "w_minima": f"""
        select rep, k, min((a * (('0x' || md5(item)[1:8])::bigint % {similarity.HASH_PRIME}) + b) % {similarity.HASH_PRIME}) as h
        from {{w_rows}}, {{seeds}} group by 1, 2""",
    "w_bands": f"""
        select rep, k // {similarity.LSH_ROWS} as band, string_agg(h, ',' order by k) as hashes from {{w_minima}} group by 1, 2""",
    "w_found": """
        select p.* from {w_pairs} p semi join (select x.rep as a, y.rep as b from {w_bands} x join {w_bands} y
          on x.band = y.band and x.hashes = y.hashes and x.rep < y.rep) c on p.a = c.a and p.b = c.b""",
    "w_words": f"""
        select doc_id, list_sort(list_distinct(list_filter(list_transform(
          regexp_extract_all(regexp_replace(text, '<.*?>', ' ', 'g'), '[a-zA-Z]{{4,}}'), lambda x: lower(x)),
          lambda x: x not in ({_STOPS})))) as items from {{documents}}""",
    "h_numbers": """
        select doc_id, list_sort(list_distinct(list_transform(items,
          lambda x: ('0x' || md5(x)[1:8])::bigint % 1000))) as numbers from {w_words}""",
    "h_words": "select doc_id, list_transform(numbers, lambda x: cast(x as varchar)) as items from {h_numbers}",
    **_pairs("w", "w_words"),
    **_pairs("h", "h_words"),
    # A feature's articles as a bit string; articles two features share are the bits of both.
    "h_bits": """
        with docs as (select row_number() over (order by doc_id) as nr, numbers from {h_numbers}),
        held as (select unnest(numbers) as f, nr from docs)
        select x.f, string_agg(case when h.f is null then '0' else '1' end, '' order by d.nr)::bit as bits
        from (select distinct f from held) x cross join (select nr from docs) d left join held h on h.f = x.f and h.nr = d.nr group by 1""",
    "h_joint": """
        select a.f as i, b.f as j, bit_count(a.bits & b.bits) as n from {h_bits} a join {h_bits} b on a.f <= b.f
        where bit_count(a.bits & b.bits) > 0""",
}

ORACLES = {
    "article_hash": "select doc_id, array_to_string(numbers, ',') as features from {h_numbers}",
    "similar_docs": "select a, b, common, round(cosine, 9) as cosine from {w_pairs}",
    "similar_lsh": "select a, b, common, round(cosine, 9) as cosine from {w_found}",
    "lsh_recall": """select e.n as exact_pairs, f.n as found, 0::bigint as wrong, 10 * f.n >= 9 * e.n as enough
        from (select count(*) as n from {w_pairs}) e, (select count(*) as n from {w_found}) f""",
    "similar_doc_members": "select m.doc_id, s.rep from {w_marked} m join {w_sets} s on m.mark = s.mark",
    "similar_doc_count": """select (coalesce((select sum(copies * (copies - 1) / 2) from {w_sets}), 0) + coalesce((
        select sum(x.copies * y.copies) from {w_pairs} p join {w_sets} x on p.a = x.rep
        join {w_sets} y on p.b = y.rep), 0))::bigint as pairs""",
    "similar_hashed": "select a, b, common, round(cosine, 9) as cosine from {h_pairs}",
    "mention_split": f"""
        select {_PART} as part, count(*) as n
        from {{o_mention_train}} group by 1""",
    "mention_model_totals": _totals_sql("o_mention_train"),
    "primary_model_totals": _totals_sql("o_primary_train"),
    "primary_optimum": f"""select count(*) as n, count(*) filter (label = 1.0) as positives, true as gradient_small,
        true as better_than_share from {{o_primary_train}} where {_PART} = 'training'""",
    "mention_scores": """select count(*) as candidates, 0::bigint as accepted_wrongly, 0::bigint as refused_wrongly from {o_labelled}
        where set_name = 'unassigned'""",
    "model_report": f"select *, 1 as files from ({_totals_sql('o_mention_train')})",
    # By mean ranks: the ranks of the positive rows, less the least they can add up to, over the number of pairs.
    "auc_probability": """select n, positives, round((ranks - positives * (positives + 1) / 2.0) / (positives * (n - positives)), 9) as area
        from (select count(*) as n, count(*) filter (label = 1.0) as positives, sum(place) filter (label = 1.0) as ranks from (
          select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as place from (
            select label, length(blinded_sentence) / (length(blinded_sentence) + 40.0::double) as score from {o_mention_train})))""",
    "prediction_check": """select count(*) as candidates, 0::bigint as outside, 0::bigint as changed from {o_labelled}
        where set_name in ('positives_ii', 'unassigned')""",
    "feature_similarity": """select p.i::int as i, p.j::int as j, round(p.n / sqrt(a.n * b.n::double), 9) as cosine
        from {h_joint} p join {h_joint} a on a.i = p.i and a.j = p.i join {h_joint} b on b.i = p.j and b.j = p.j
        where p.i < p.j and p.n / sqrt(a.n * b.n::double) > 0.5""",
}
ORACLES = {name: with_views(sql, **{**MENTION_VIEWS, **ORACLE_VIEWS}) for name, sql in ORACLES.items()}
