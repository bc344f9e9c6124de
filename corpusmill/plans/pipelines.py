"""The three entry points: corpus construction, extraction to final dataset, queries to evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boolean as B
from ..functions import text as T
from ..functions.years import normalise_year_range
from ..operators import aggregate as A
from ..operators import align
from ..operators import dedupe as D
from ..operators import filters as P
from ..operators import joins as J

SLIM_COLUMNS = (
    "id title doi abstract year type source cited_by_count referenced_works_count referenced_works pdf_url language field subfield topics keywords concepts authors"
).split()


def corpus_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: reasoned filter, first-wins dedup, labels, and counts per cohort."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    t = F.lower("text")
    rules = [("language", P.is_english(F.col("lang"))), ("excluded", ~P.contains_any(t, ("for the", "to the"))), ("not_included", P.contains_any(t, ("of the", "and the")))]
    judged = P.with_reason(docs, rules)
    # a row that goes is a group of its own, so that texts are read once and only digests shuffle
    key = F.when(F.col("reason").isNull(), D.digest(T.title_key_plain(F.col("text")))).otherwise(F.col("doc_id").cast("string"))
    first = judged.select("doc_id", "reason", key.alias("key")).groupBy("reason", "key").agg(F.min("doc_id").alias("doc_id"))
    rows = first.select("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason"))
    joined = rows.join(labels, "doc_id", "left")
    cohort = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 1, "good").otherwise("poor")
    return joined.groupBy("reason", cohort.alias("cohort")).agg(F.count(F.lit(1)).alias("n"))


COHORTS_SQL = """
WITH j AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key, CASE WHEN lower(trim(lang)) NOT IN ('en', 'eng', 'english') THEN 'language'
  WHEN contains(lower(text), 'for the') OR contains(lower(text), 'to the') THEN 'excluded' WHEN NOT (contains(lower(text), 'of the') OR contains(lower(text), 'and the')) THEN 'not_included' END AS reason FROM documents),
r AS (SELECT min(doc_id) AS doc_id, 'kept' AS reason FROM j WHERE reason IS NULL GROUP BY key UNION ALL SELECT doc_id, reason FROM j WHERE reason IS NOT NULL)
SELECT reason, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS cohort, count(*) AS n FROM r LEFT JOIN labels USING (doc_id) GROUP BY 1, 2
"""


def slim(works: DataFrame) -> DataFrame:
    """Raw work records to the eighteen columns of the corpus."""
    best, primary = F.col("best_oa_location"), F.col("primary_location")
    pdfs = T.ranked_pdf_urls(best, F.col("open_access.oa_url"), F.col("locations"), primary)
    out = {
        "id": T.clean_string(F.col("id")), "title": F.coalesce(T.clean_string(F.col("title")), T.clean_string(F.col("display_name"))),
        "doi": T.pick_doi(F.col("doi"), F.col("ids.doi"), F.col("requested_doi")), "abstract": T.text_of_inverted_index(F.col("abstract_inverted_index")),
        "year": F.col("publication_year"), "type": T.clean_string(F.col("type")), "source": T.clean_string(F.col("primary_location.source.display_name")),
        "cited_by_count": F.col("cited_by_count"), "referenced_works_count": F.col("referenced_works_count"), "referenced_works": T.cleaned_names(F.col("referenced_works")),
        "pdf_url": F.get(pdfs, F.lit(0)), "language": T.clean_string(F.col("language")), "field": T.clean_string(F.col("primary_topic.field.display_name")),
        "subfield": T.clean_string(F.col("primary_topic.subfield.display_name")), "topics": T.display_names(F.col("topics")), "keywords": T.display_names(F.col("keywords")),
        "concepts": T.display_names(F.col("concepts")), "authors": T.simplified_authors(F.col("authorships")),
    }
    return works.select(*(out[c].alias(c) for c in SLIM_COLUMNS))


def build_corpus(benchmark: DataFrame, works: DataFrame, include: Sequence[str], exclude: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entry A: (slim corpus, drop reasons). Works are filtered with a reason; benchmark records come first and win; three dedup stages."""
    title = T.title_key_plain(F.coalesce("display_name", "title"))
    rules = [
        ("language", P.is_english(F.col("language"))), ("update", ~P.contains_any(title, exclude)),
        ("title", P.contains_any(title, include)), ("no_references", P.non_empty(F.col("referenced_works"))),
    ]
    judged = P.with_reason(works, rules)
    everything = D.concat([benchmark, judged.where("reason is null").drop("reason")])
    order = F.struct("src_ord", "ord")
    keys = [T.pick_doi(F.col("doi"), F.col("ids.doi"), F.col("requested_doi")), T.work_id(F.col("id")), T.title_key_spaced(F.coalesce("display_name", "title"))]
    return slim(D.cascade(everything, keys, order)), P.reason_counts(judged)


def final_dataset(extractions: DataFrame, corpus: DataFrame, texts: DataFrame, scorer: Callable = align.containment, fields: Sequence[str] = ("objective", "year_range")) -> DataFrame:
    """Entry B: evidence verified against the text and by a scorer, failed evidence nulled, values joined to metadata, years normalised.

    ``extractions`` (doc_id, evidence structs of string values), ``texts`` (doc_id, text), ``corpus`` with id and year.
    """
    joined = align.verify_fields(extractions, "doc_id", fields, texts)
    checked = align.fact_check(align.pairs(joined, "doc_id", fields), scorer).where("status != 'PASS'")
    failed = checked.groupBy("doc_id").agg(F.collect_set("field").alias("_failed"))
    clean = joined.join(failed, "doc_id", "left")
    bare = clean.select("doc_id", *(F.when(~F.coalesce(F.array_contains("_failed", f), F.lit(False)), F.col(f)["value"]).alias(f) for f in fields))
    meta = corpus.withColumn("doc_id", T.after_last_slash(F.col("id")))
    out = J.override_join(meta, bare, "doc_id", "doc_id")
    year = normalise_year_range(F.col("year_range"), F.col("year"))
    return out.withColumns({"year_range_normalized": year["range"], "year_range_normalization_rule": year["rule"]})


def evaluate_queries(records: DataFrame, relevant: DataFrame, transport, annotate: Callable) -> tuple[DataFrame, DataFrame]:
    """Entry C: (per record, summary). Repair, addresses, counts, buckets, ids of matches and retrieval measures.

    ``records`` (id, queries, years), ``relevant`` (id, relevant array); ``annotate`` asks the service for counts or ids.
    """
    fixed = records.select("id", "years", B.repair_list_udf("queries").alias("queries")).where("queries is not null")
    urls = fixed.select("id", B.search_urls(F.col("queries"), F.col("years")).alias("urls"))
    counts = annotate(urls, "id", "urls", transport, "count").select("id", P.count_bucket(P.count_score(F.col("values"), "sum")).alias("bucket"))
    found = annotate(urls, "id", "urls", transport, "ids").select("id", T.flat_distinct(F.col("values")).alias("retrieved"))
    rows = A.retrieval_rows(relevant.join(found, "id"), "id", "relevant", "retrieved").join(counts, "id")
    return rows, A.retrieval_summary(rows)
