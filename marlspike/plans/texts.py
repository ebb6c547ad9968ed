"""Queries of pages and their terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.names import lower_name
from marlspike.operators import latent, text
from marlspike.scratch import Scratch
from marlspike.session import read

#: Words left out, an example of a list that callers give (fixed values).
STOP_WORDS = ["the", "and", "that", "was", "were", "for", "with", "had", "has", "not", "but", "from", "are", "this", "its"]


def _articles(spark: SparkSession, directory: str) -> DataFrame:
    pages = read(spark, directory, "doctexts").dropDuplicates(["page_id", "contents"])
    return pages.where(text.is_article(F.col("title"), F.col("contents")))


def article_pages(spark: SparkSession, directory: str) -> DataFrame:
    return _articles(spark, directory).select("page_id", "title")


def page_terms(spark: SparkSession, directory: str) -> DataFrame:
    """How often each term is on the pages, markup and stop words left out."""
    plain = text.plain_wiki_text(F.col("contents"))
    terms = _articles(spark, directory).select("page_id", text.terms(plain, STOP_WORDS).alias("terms"))
    return terms.where(F.size("terms") > 1).select(F.explode("terms").alias("term")).groupBy("term").count()


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with their words, no lemmas, for which SQL has the same rule."""
    documents = read(spark, directory, "documents").where("text is not null")
    return documents.select("doc_id", text.terms(F.col("text"), STOP_WORDS, lemmas=False).alias("terms"))


def tfidf_idf(spark: SparkSession, directory: str) -> DataFrame:
    """Document frequencies of all terms and their inverse."""
    documents = Scratch(spark).save(_documents(spark, directory).where(F.size("terms") > 1))
    counts = text.document_terms(documents, "doc_id", "terms")
    weights = text.inverse_frequencies(text.document_frequencies(counts, "doc_id"), documents.count())
    return weights.select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark: SparkSession, directory: str) -> DataFrame:
    """Weights of the 20,000 most frequent terms in documents."""
    documents = Scratch(spark).save(_documents(spark, directory).where(F.size("terms") > 1))
    counts = Scratch(spark).save(text.document_terms(documents, "doc_id", "terms"))
    weights = text.inverse_frequencies(text.document_frequencies(counts, "doc_id", vocabulary=20_000), documents.count())
    return counts.join(F.broadcast(weights), "term").select("doc_id", "term", "tf", F.round(F.col("tf") * F.col("idf"), 6).alias("weight"))


def _latent(spark: SparkSession, directory: str) -> latent.Decomposition:
    """100 concepts of the 20,000 most frequent terms (the operators' defaults); spellings of a term count as one."""
    pages = read(spark, directory, "doctermmatrix").select("page_id", F.filter(F.transform("terms", lower_name), lambda t: t.isNotNull()).alias("terms"))
    longest = pages.where(F.size("terms") > 1).groupBy("page_id").agg(F.max(F.struct(F.size("terms").alias("n"), "terms")).alias("row"))
    matrix, names, idf = text.term_matrix(longest.select("page_id", "row.terms"), "terms")
    return latent.decompose(matrix, "page_id", "weights", names, idf)


def lsa_topdocs(spark: SparkSession, directory: str) -> DataFrame:
    """Pages for a query of two terms in a space of a hundred concepts."""
    return _latent(spark, directory).documents_for_query(["castle", "railway"])


def lsa_topterms(spark: SparkSession, directory: str) -> DataFrame:
    """Terms that weigh most in each of the first four concepts."""
    rows = [(c, term, weight) for c, best in enumerate(_latent(spark, directory).top_terms(4, 10)) for term, weight in best]
    return spark.createDataFrame(rows, "concept int, term string, weight double")


def lsa_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """Terms and pages nearest to a term and to the page that weighs most in the first concept."""
    space = _latent(spark, directory)
    page = space.top_documents(1, 1)[0].first()["doc_id"]
    found = [("term like term", str(t), w) for t, w in space.terms_like(space.vocabulary[0], 5)]
    for kind, pages in (("page for term", space.documents_for_term(space.vocabulary[0], 5)), ("page like page", space.documents_like(page, 5))):
        found += [(kind, str(r["doc_id"]), r["score"]) for r in pages.collect()]
    return spark.createDataFrame(found, "kind string, name string, score double")


def lsa_checks(spark: SparkSession, directory: str) -> DataFrame:
    """What must hold of any decomposition: factors of length 1 at right angles, falling strengths, and what is nearest to itself."""
    space = _latent(spark, directory)
    documents, k = Scratch(spark).save(space.documents), min(6, len(space.strengths))
    products = documents.agg(*(F.sum(F.element_at("u", i + 1) * F.element_at("u", j + 1)) for i in range(k) for j in range(k))).first()
    own = space.terms.T @ space.terms
    page = documents.agg(F.min("doc_id")).first()[0]
    near = space.documents_like(page, 1).first()
    checks = [
        ("documents", bool(np.abs(np.array(products).reshape(k, k) - np.eye(k)).max() < 1e-6)),
        ("terms", bool(np.abs(own - np.eye(len(own))).max() < 1e-6)),
        ("strengths", bool((np.diff(space.strengths) <= 1e-9).all() and space.strengths[-1] > 0)),
        ("like itself", abs(space.terms_like(space.vocabulary[0], 1)[0][1] - 1) < 1e-9 and abs(near["score"] - 1) < 1e-9),
    ]
    return spark.createDataFrame(checks, "name string, holds boolean")


def queries() -> dict:
    return {f.__name__: f for f in (article_pages, page_terms, tfidf_idf, tfidf_weights, lsa_topdocs, lsa_topterms, lsa_neighbours, lsa_checks)}


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TERMS = f"""
words as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as term from documents where text is not null),
kept as (select doc_id, term from words where length(term) > 2 and term not in ({_STOP}) and regexp_full_match(term, '\\p{{L}}+')),
docs as (select doc_id from kept group by doc_id having count(*) > 1),
counts as (select doc_id, term, count(*) as tf from kept semi join docs using (doc_id) group by 1, 2),
total as (select count(*)::double as n from docs)"""


def oracles() -> dict[str, str]:
    return {
        "lsa_checks": "select name, true as holds from (values ('documents'), ('terms'), ('strengths'), ('like itself')) t(name)",
        "article_pages": "select page_id, title from (select distinct page_id, title, contents from doctexts where contents is not null) where trim(contents) <> '' and not regexp_matches(contents, '^\\s*#redirect\\b', 'i') and not contains(coalesce(title, ''), '(disambiguation)')",
        "tfidf_idf": f"with {_TERMS} select term, count(*) as df, round(ln((max(n) + 1) / (count(*) + 1)), 6) as idf from counts, total group by term",
        "tfidf_weights": f"with {_TERMS}, v as (select term, count(*) as df from counts group by term order by sum(tf) desc, term limit 20000) select doc_id, term, tf, round(tf * ln((n + 1) / (df + 1)), 6) as weight from counts join v using (term), total",
    }
