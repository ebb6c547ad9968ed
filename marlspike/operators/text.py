"""Pages to terms, and weights of terms in documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.scratch import Scratch

REDIRECT = r"(?i)^\s*#redirect\b"
DISAMBIGUATION = "(disambiguation)"


def is_article(title: Column, contents: Column) -> Column:
    """Neither empty, nor a redirect, nor a disambiguation page."""
    return contents.isNotNull() & (F.length(F.btrim(contents)) > 0) & ~contents.rlike(REDIRECT) & ~F.coalesce(title, F.lit("")).contains(DISAMBIGUATION)


def plain_wiki_text(contents: Column) -> Column:
    """Wiki text with templates, tags, links' targets and emphasis taken out."""
    text = F.regexp_replace(contents, r"(?s)<ref[^>]*/>|<ref[^>]*>.*?</ref>", "")
    text = F.regexp_replace(text, r"\{\{[^{}]*\}\}", "")
    text = F.regexp_replace(text, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    text = F.regexp_replace(text, r"\[https?://\S+ ([^\]]*)\]", "$1")
    return F.btrim(F.regexp_replace(text, r"'{2,}|={2,}|<[^>]*>", ""))


#: Forms that no rule leads to their lemma (fixed values); auxiliaries and pronouns stay as they are, as stop words name them so.
IRREGULAR = {
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "people": "person",
    "was": "was", "has": "has", "does": "does", "this": "this", "his": "his", "its": "its", "always": "always", "perhaps": "perhaps", "series": "series", "species": "species",
    "went": "go", "gone": "go", "goes": "go",
    "began": "begin", "begun": "begin", "became": "become", "brought": "bring", "built": "build", "bought": "buy", "came": "come", "chose": "choose", "chosen": "choose",
    "drew": "draw", "drawn": "draw", "fell": "fall", "fallen": "fall", "felt": "feel", "found": "find", "gave": "give", "given": "give", "grew": "grow", "grown": "grow",
    "held": "hold", "kept": "keep", "knew": "know", "known": "know", "led": "lead", "left": "leave", "lost": "lose", "made": "make", "met": "meet", "paid": "pay",
    "ran": "run", "said": "say", "saw": "see", "seen": "see", "sent": "send", "shown": "show", "sold": "sell", "spoke": "speak", "spoken": "speak", "stood": "stand",
    "taken": "take", "took": "take", "taught": "teach", "thought": "think", "told": "tell", "won": "win", "wrote": "write", "written": "write",
}


def lemma(word: Column) -> Column:
    """The form a word stands under: irregular forms by a table, plurals and forms in -ing and -ed by their ending.

    A doubled consonant before the ending is halved (hopping, hop); a stem of one syllable that ends in a single vowel and
    consonant, or one in -at, -iz, -ur, -as, -c, -v or -g after a vowel, gets its e back (hoping, hope).  Parts of speech aren't known.
    """
    ies = F.regexp_replace(word, r"(?<=[a-z]{2})ies$", "y")
    plural = F.regexp_replace(ies, r"(?<=(?:s|x|z|ch|sh))es$|(?<=[a-rt-z]{2})(?<!u)s$", "")
    doubled = F.regexp_replace(plural, r"(?<=[aeiouy][a-z]{0,6})([bdgmnprt])\1(?:ing|ed)$", "$1")
    silent = F.regexp_replace(doubled, r"^([^aeiouy]*[aeiouy][b-df-hj-np-tvz])(?:ing|ed)$|^([a-z]*[aeiouy][a-z]*(?:at|iz|ur|as|[aeiouy][cvg]))(?:ing|ed)$", "$1$2e")
    stem = F.regexp_replace(silent, r"(?<=[aeiouy][a-z]{1,9})(?:ing|ed)$", "")
    table = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    return F.coalesce(F.element_at(table, word), stem)


def terms(text: Column, stop_words: Iterable[str], lower_first: bool = True, lemmas: bool = True) -> Column:
    """The words of a text of more than two letters that are no stop words, in lower case.

    ``lower_first=False`` looks stop words up before the change to lower case, so that those with a capital stay.
    """
    stop = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if lower_first:
        words = F.transform(words, F.lower)
    if lemmas:
        words = F.transform(words, lemma)
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w) & w.rlike(r"^\p{L}+$"))
    return F.transform(kept, F.lower)


def document_terms(documents: DataFrame, doc_id: str, term_list: str, least: int = 2) -> DataFrame:
    """(doc id, term, tf) of documents with at least ``least`` terms."""
    long_enough = documents.where(F.size(term_list) >= least)
    return long_enough.select(doc_id, F.explode(term_list).alias("term")).groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(counts: DataFrame, doc_id: str, vocabulary: int | None = None) -> DataFrame:
    """(term, df, total): documents with the term; only the ``vocabulary`` most frequent terms (by occurrences) if given."""
    sums = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("_occurrences"))
    if vocabulary is not None:
        sums = sums.orderBy(F.desc("_occurrences"), "term").limit(vocabulary)
    return sums.drop("_occurrences")


def inverse_frequencies(frequencies: DataFrame, documents: int) -> DataFrame:
    """(term, df, idf) with idf = ln((documents + 1) / (df + 1))."""
    return frequencies.withColumn("idf", F.log((F.lit(float(documents)) + 1) / (F.col("df") + 1)))


def term_matrix(documents: DataFrame, term_list: str, vocabulary: int = 20_000):
    """(documents with counts and weights as vectors, the vocabulary, the idf vector)."""
    counted = CountVectorizer(inputCol=term_list, outputCol="term_freqs", vocabSize=vocabulary).fit(documents)
    frequencies = Scratch(documents.sparkSession).save(counted.transform(documents))
    weighted = IDF(inputCol="term_freqs", outputCol="weights").fit(frequencies)
    result = weighted.transform(frequencies).drop("term_freqs")
    return result, counted.vocabulary, weighted.idf.toArray()
