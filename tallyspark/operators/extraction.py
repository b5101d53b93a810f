"""Field extraction over a table of documents: every function appends columns to df from the text in text_col."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions import text as tx


def with_amounts(df: DataFrame, text_col: str, out: str = "amounts") -> DataFrame:
    """Distinct (amount, currency) of each text, largest first. Two projections: the second one looks back
    into the sorted candidates, so they are computed once and named."""
    chains = df.withColumn("_chains", tx.number_chains(F.col(text_col)))
    named = chains.withColumn("_candidates", tx.amount_candidates(F.col("_chains")))
    return named.withColumn(out, tx.distinct_amounts(F.col("_candidates"))).drop("_chains", "_candidates")


def with_dates(df: DataFrame, text_col: str, out: str = "dates") -> DataFrame:
    groups = df.withColumn("_groups", tx.digit_groups(F.col(text_col)))
    return groups.withColumn(out, tx.dates(F.col(text_col), F.col("_groups"))).drop("_groups")


def top_amounts(df: DataFrame, text_col: str, keys: list[str], k: int) -> DataFrame:
    """The k largest distinct amounts of each text as rows; sorted inside the row, so nothing is shuffled."""
    found = with_amounts(df, text_col, "_a")
    return found.select(*keys, F.posexplode(F.slice("_a", 1, k)).alias("pos", "a")).select(
        *keys, (F.col("pos") + 1).alias("rank"), F.col("a.amount").alias("amount"), F.col("a.currency").alias("currency")
    )


def key_data(df: DataFrame, text_col: str) -> DataFrame:
    """All extracted fields of each text in one pass over the table."""
    text = F.col(text_col)
    # Shared inputs are columns of their own, so that they are computed once per row.
    shared = {
        "_chains": tx.number_chains(text),
        "_groups": tx.digit_groups(text),
        "_lowered": F.lower(text),
        "_runs": tx.long_runs(text),
    }
    candidates = tx.amount_candidates(F.col("_chains"))
    found = df.withColumns(shared).withColumn("_candidates", candidates).withColumns(
        {
            "invoice_number": tx.invoice_number(text),
            "dates": tx.dates(text, F.col("_groups")),
            "amounts": tx.distinct_amounts(F.col("_candidates")),
            "vat_ids": tx.vat_ids(F.col("_runs")),
            "companies": tx.companies(text),
            "language": tx.document_language(F.col("_lowered")),
            "emails": tx.emails(text),
            "phone_numbers": tx.phones(text),
        }
    )
    return found.drop(*shared, "_candidates")


def with_vat_ids(df: DataFrame, text_col: str, out: str = "vat_ids") -> DataFrame:
    runs = df.withColumn("_runs", tx.long_runs(F.col(text_col)))
    return runs.withColumn(out, tx.vat_ids(F.col("_runs"))).drop("_runs")


def with_language(df: DataFrame, text_col: str, out: str = "language") -> DataFrame:
    lowered = df.withColumn("_lowered", F.lower(F.col(text_col)))
    return lowered.withColumn(out, tx.document_language(F.col("_lowered"))).drop("_lowered")


def fallback_record(df: DataFrame, text_col: str) -> DataFrame:
    """Small header record for texts whose structured extraction failed."""
    text = F.col(text_col)
    return df.withColumns(
        {
            "invoice_id": tx.fallback_number(text),
            "issue_date": tx.fallback_date(text),
            "total_incl_vat": tx.fallback_total(text),
            "raw_text": text,
            "extraction_method": F.lit("fallback"),
            "confidence_score": F.lit(0.3),
        }
    )


def language_profile(df: DataFrame, text_col: str) -> DataFrame:
    """Documents per detected language and their share. The window runs over one row per language."""
    from pyspark.sql import Window

    counted = with_language(df, text_col).groupBy("language").agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy())
    return counted.withColumn("share", F.round(F.col("n") / everything, 6))


def pair_similarity(texts: DataFrame, pairs: DataFrame, key: str, text_col: str) -> DataFrame:
    """Jaccard similarity of the word sets of given pairs (left, right) of text keys. Each set is built before the
    join, where the texts still lie spread over their partitions; pairs are joined by key, never formed here."""
    sets = texts.select(key, tx.word_set(F.col(text_col)).alias("words"))
    both = pairs.join(sets.select(F.col(key).alias("left"), F.col("words").alias("_l")), "left").join(
        sets.select(F.col(key).alias("right"), F.col("words").alias("_r")), "right"
    )
    return both.withColumn("similarity", tx.jaccard(F.col("_l"), F.col("_r"))).drop("_l", "_r")


def page_language(tokens: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Language vote over the tokens of a page. Keywords hold no spaces, so one occurs in the joined page text
    exactly when one token holds it: a bool_or per keyword replaces collecting the page."""
    words = sorted({w for ws in fv.PAGE_LANGUAGE_WORDS.values() for w in ws})
    lowered = F.lower(F.col(text_col))
    seen = tokens.groupBy(*keys).agg(*[F.max(lowered.contains(w)).alias(f"w{i}") for i, w in enumerate(words)])
    scores = [
        (lang, sum((F.col(f"w{words.index(w)}").cast("int") for w in ws), F.lit(0)))
        for lang, ws in fv.PAGE_LANGUAGE_WORDS.items()
    ]
    return seen.select(*keys, tx.vote(scores, 1).alias("language"))
