"""How demanding a text is to read: unigram language models of grade levels, seeded by a formula."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.scratch import Scratch
from marlspike.skew import lookup

#: School grades at which a level ends and the next begins (the last level has no end).
GRADES = (2, 5, 8, 12, 16, 20)
#: Texts the models are fitted on, about; they are the same share of all texts by a hash of the id, or all if fewer.
SEED_TEXTS = 50_000
#: Most frequent words of those texts that the models know, if a caller bounds them; None is all.
VOCABULARY: int | None = None
#: Added to each count.
SMOOTHING = 0.1

_WORD = r"\p{L}+(?:['’\-]\p{L}+)*"
_SENTENCE_END = r"[.!?]+(?=[\s\"'”’)\]]|$)"
#: Runs of vowels are syllables ...
_VOWELS = "[aeiouyáéíóúàèêëïöüäâôûî]+"
#: ... less an e at a word's end after a consonant, but for one that is the word's only vowel or follows a consonant and l.
_LAST_E = r"[b-df-hj-np-tv-xz]e\b"
_ONLY_E = r"\b[b-df-hj-np-tv-xz]+e\b"
_LE = r"[aeiouy][b-df-hj-np-tv-xz]+le\b"


def school_grade(text: Column, words: Column) -> Column:
    """The Flesch-Kincaid grade; sentences end in a full stop, exclamation or question mark, not at a line break."""
    low = F.lower(text)

    def count(pattern: str, of: Column = low) -> Column:
        return F.regexp_count(of, F.lit(pattern))

    sentences = F.greatest(F.lit(1), count(_SENTENCE_END, text))
    syllables = F.greatest(words, count(_VOWELS) - count(_LAST_E) + count(_ONLY_E) + count(_LE))
    return 0.39 * words / sentences + 11.8 * syllables / words - 15.59


def reading_levels(texts: DataFrame, text_id: str, text: str, least_words: int = 20) -> DataFrame:
    """(text id, level) of each text of at least ``least_words`` words; ``level`` counts the GRADES reached, from 0.

    A sample of the texts is given levels by the formula, and a smoothed unigram language model is fitted to each level:
    the logarithms of the level's share and of each word's share in it; words that no seed has say nothing of the level.
    Every text, whole, gets the level of greatest posterior probability: its words are joined with the models and their
    weights added up by text, on the map side first.

    The models know every word of the seeds.  While those words, counted before, are few enough they are broadcast; more
    are joined by ``skew_join``.  Fitting reads about SEED_TEXTS texts, which is the bound of the model, while all texts are
    scored.  Texts aren't copied: they are read once to count them, once for the seeds and once for the scores.  Levels
    without a seed text are never given; of equally probable levels the lower is.
    Missing and shorter texts have no row, nor have rows without id; rows that share an id are scored as one text.  An
    empty table gives an empty result.
    """
    scratch = Scratch(texts.sparkSession)
    given = texts.select(F.col(text_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")

    # null for short texts; as no filter or generator refers to the expression, words are extracted once a row
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    enough = F.get(F.filter(F.array(words), lambda w: F.size(w) >= least_words), F.lit(0)).alias("words")
    share = min(1.0, SEED_TEXTS / max(1, given.count()))
    seeds = given.where(F.pmod(F.xxhash64("id", F.lit(37)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else given
    leveled = scratch.save(seeds.select("text", enough).select("words", level_of(school_grade(F.col("text"), F.size("words"))).alias("level"))).where("words is not null")
    levels = range(len(GRADES) + 1)
    priors = {r["level"]: r["n"] for r in leveled.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    used = [k for k in levels if priors.get(k)]
    if not used:
        return given.select(F.col("id").alias(text_id), F.lit(0).alias("level")).limit(0)
    counts = leveled.select("level", F.explode("words").alias("word")).groupBy("word").agg(*(F.count_if(F.col("level") == k).alias(f"c{k}") for k in used))
    if VOCABULARY is not None:
        counts = counts.orderBy(F.desc(sum((F.col(f"c{k}") for k in used[1:]), F.col(f"c{used[0]}"))), "word").limit(VOCABULARY)
    known, sums = scratch.save_observed(counts, F.count(F.lit(1)).alias("words"), *(F.sum(f"c{k}").alias(f"c{k}") for k in used))
    below = {k: sums[f"c{k}"] + SMOOTHING * sums["words"] for k in used}
    model = known.select("word", *(F.log((F.col(f"c{k}") + SMOOTHING) / below[k]).alias(f"w{k}") for k in used))
    scored = given.select("id", F.explode_outer(enough).alias("word")).where("word is not null")
    met = lookup(scored, model, "word", sums["words"], how="left")
    scores = met.groupBy("id").agg(*(F.sum(F.coalesce(f"w{k}", F.lit(0.0))).alias(f"s{k}") for k in used))
    whole = sum(priors.values())
    ranked = [F.struct((F.col(f"s{k}") + math.log(priors[k] / whole)).alias("s"), F.lit(-k).alias("k")) for k in used]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    return scores.select(F.col("id").alias(text_id), (-best["k"]).alias("level"))


def level_of(grade: Column) -> Column:
    """The number of GRADES that a grade reaches."""
    return sum((F.when(grade >= g, 1).otherwise(0) for g in GRADES[1:]), F.when(grade >= GRADES[0], 1).otherwise(0))


def band_of(level: Column) -> Column:
    """easy below grade 5, medium from 5 to below 16, hard from 16."""
    return F.when(level < GRADES.index(5) + 1, "easy").when(level < GRADES.index(16) + 1, "medium").otherwise("hard")
