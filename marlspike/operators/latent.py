"""Retrieval in the space of a truncated singular value decomposition.

Rows carry an explicit document id through the decomposition, and singular vectors get the sign that makes their entry of
greatest size positive.  The factor of the documents stays distributed; that of the terms is a local matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: list[float]) -> Column:
    return F.aggregate(F.zip_with(a, F.array(*map(F.lit, map(float, b))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def row_normalized(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros becomes NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


@dataclass
class Decomposition:
    """documents: (doc_id, u array); terms: the local factor, a row per term; strengths: the singular values."""

    documents: DataFrame
    terms: np.ndarray
    strengths: np.ndarray
    vocabulary: list[str]
    idf: np.ndarray

    def _scaled(self) -> Column:
        return F.zip_with("u", F.array(*map(F.lit, map(float, self.strengths))), lambda x, y: x * y)

    def _best_documents(self, score: Column, most: int) -> DataFrame:
        scored = self.documents.select("doc_id", score.alias("score")).where(~F.isnan("score"))
        return scored.orderBy(F.desc("score"), F.desc("doc_id")).limit(most)

    def top_terms(self, concepts: int, most: int) -> list[list[tuple[str, float]]]:
        """(term, weight) of the terms that weigh most in each of the first concepts, or of all if there are fewer."""
        return [[(self.vocabulary[i], float(self.terms[i, c])) for i in np.argsort(-self.terms[:, c], kind="stable")[:most]] for c in range(min(concepts, len(self.strengths)))]

    def top_documents(self, concepts: int, most: int) -> list[DataFrame]:
        """(doc_id, score) of the documents that weigh most in each of the first concepts."""
        return [self._best_documents(F.element_at("u", c + 1), most) for c in range(concepts)]

    def terms_like(self, term: str, most: int = 10) -> list[tuple[str, float]]:
        """Terms by the cosine of their rows, scaled by the singular values, with that of the term."""
        rows = row_normalized(self.terms * self.strengths)
        cosines = np.nan_to_num(rows @ rows[self.vocabulary.index(term)], nan=-np.inf)
        return [(self.vocabulary[i], float(cosines[i])) for i in np.argsort(-cosines, kind="stable")[:most]]

    def documents_for_term(self, term: str, most: int = 10) -> DataFrame:
        return self._best_documents(dot(self._scaled(), self.terms[self.vocabulary.index(term)]), most)

    def documents_like(self, doc_id: int, most: int = 10) -> DataFrame:
        """Documents by the cosine of their rows, scaled by the singular values, with that of the document."""
        scaled = self.documents.select("doc_id", self._scaled().alias("us"))
        unit = scaled.select("doc_id", F.transform("us", lambda x: F.try_divide(x, norm(F.col("us")))).alias("u"))
        own = unit.where(F.col("doc_id") == doc_id).select(F.col("u").alias("own"))
        cosine = F.aggregate(F.zip_with("u", "own", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        met = unit.join(F.broadcast(own.limit(1)), F.lit(True)).select("doc_id", cosine.alias("score")).where("score is not null")
        return met.orderBy(F.desc("score"), F.desc("doc_id")).limit(most)

    def documents_for_query(self, query: list[str], most: int = 10) -> DataFrame:
        """Documents for several terms, each weighing its idf; unknown terms weigh nothing."""
        known = [self.vocabulary.index(t) for t in query if t in self.vocabulary]
        wanted = (self.terms[known] * self.idf[known][:, None]).sum(axis=0) if known else np.zeros(len(self.strengths))
        return self._best_documents(dot(self._scaled(), wanted), most)


def decompose(matrix: DataFrame, doc_id: str, vector: str, vocabulary: list[str], idf: np.ndarray, k: int = 100) -> Decomposition:
    """The decomposition of the matrix whose rows are the vectors; ids are integers.

    ``k`` is bounded by the numbers of documents and terms; a matrix of lower rank has fewer concepts still.  Lanczos rounds
    read the rows over and over, so these stay in the JVM and are kept there until the terms' factor is known.  That factor
    has a row per term of the vocabulary, so its size is bounded; documents are projected onto it in Arrow batches.
    """
    rows = matrix.select(F.col(doc_id).cast("long").alias("index"), F.col(vector).alias("vector"))
    held = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector"))
    kept = held._java_matrix_wrapper._java_model.rows().persist(matrix.sparkSession.sparkContext._getJavaStorageLevel(StorageLevel.MEMORY_AND_DISK))
    k = min(k, kept.count(), len(vocabulary))
    svd = held.computeSVD(k, computeU=False)
    kept.unpersist(False)
    local, strengths = svd.V.toArray(), svd.s.toArray()
    sign = np.sign(local[np.abs(local).argmax(axis=0), np.arange(local.shape[1])])
    sign[sign == 0] = 1
    terms = local * sign
    onto = terms / strengths

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = [np.arange(len(v)) if i is None else i for i, v in zip(batch["indices"], batch["values"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["index"], "u": [np.asarray(v, dtype=float) @ onto[np.asarray(i, dtype=int)] for i, v in zip(places, batch["values"], strict=True)]})

    parts = rows.withColumn("v", F.unwrap_udt("vector")).select("index", "v.indices", "v.values")
    return Decomposition(parts.mapInPandas(project, "doc_id long, u array<double>"), terms, strengths, vocabulary, np.asarray(idf))
