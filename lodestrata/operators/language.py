"""Language of texts by common words of seven languages, with shares, margins and reasons for doubt.

A light detector for routing. It is a Column expression: every paragraph is scored by how many of
its words are function words of a language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words by language.
COMMON = {
    "de": "der die das und ist nicht mit für auf ein eine den von zu sie wir werden unsere ihre oder im bei haben einen",
    "en": "the and of to in is you we with for that on your our are will as be this from have or an at who",
    "es": "el la los las de y en que un una con por para su nuestros del se como más es tus vas al lo",
    "fr": "le la les des et en que un une avec pour dans vous nous votre nos est sur du au plus aux ses qui",
    "it": "il lo la gli le di e in che un una con per nostri del della dei si come più è al ai nel",
    "nl": "de het een en van in is dat met voor op je we onze zijn te wij om naar bij als aan uit ons",
    "pt": "o a os as de e em que um uma com por para seu nossos do da dos das se como mais é ao",
}
LEAST_CONFIDENCE, LEAST_MARGIN, LEAST_WORDS, LEAST_PARAGRAPH = 0.90, 0.25, 30, 25


def _count(words, known: str):
    return F.size(F.filter(words, lambda w: w.isin(*known.split())))


def _votes_for(lang: str):
    return F.aggregate("votes", F.lit(0), lambda s, v: s + F.when(v["lang"] == lang, v["n"]).otherwise(0))


def _scores(words):
    hits = [F.struct(_count(words, v).alias("n"), F.lit(k).alias("lang")) for k, v in COMMON.items()]
    return F.array_sort(F.array(*hits), lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1)).otherwise(F.when(a["lang"] < b["lang"], -1).when(a["lang"] > b["lang"], 1).otherwise(0)))


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, language, primary_share, confidence, second, second_confidence, other_paragraphs, reasons)``.

    Paragraphs of at least ``LEAST_PARAGRAPH`` words vote with their words; without any the whole
    text decides. ``reasons`` joins low_confidence, small_margin, short_text, whole_text_disagrees
    and other_language_paragraphs; a blank or null text has language null and reason empty_text.
    Keys must be unique; the paragraphs of a row are aggregated within it, without a shuffle.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != "")
    body = F.coalesce(text, F.lit(""))
    words = split(body)
    top = _scores(words)
    total = F.greatest(F.aggregate(top, F.lit(0), lambda s, x: s + x["n"]), F.lit(1))
    parts = F.filter(F.split(body, r"\n\s*\n"), lambda p: F.size(F.filter(F.split(p, r"(?U)\s+"), lambda w: w != "")) >= LEAST_PARAGRAPH)
    votes = F.transform(parts, lambda p: F.struct(F.get(_scores(split(p)), F.lit(0))["lang"].alias("lang"), F.size(F.filter(F.split(p, r"(?U)\s+"), lambda w: w != "")).alias("n")))
    base = df.select(key, body.alias("t"), top.alias("top"), total.alias("total"), votes.alias("votes"), F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != "")).alias("n"))
    shares = F.array(*[F.struct(_votes_for(k).alias("n"), F.lit(k).alias("lang")) for k in COMMON])
    shared = base.withColumn("share", shares).withColumn("voted", F.aggregate("share", F.lit(0), lambda s, x: s + x["n"]))
    best = F.array_max(F.transform("share", lambda x: x["n"]))
    primary = F.when(F.col("voted") > 0, F.array_min(F.transform(F.filter("share", lambda x: x["n"] == best), lambda x: x["lang"]))).otherwise(F.get("top", F.lit(0))["lang"])
    blank = F.trim("t") == ""
    whole, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    confidence, runner = whole["n"] / F.col("total"), second["n"] / F.col("total")
    found = shared.withColumn("p", primary)
    others = F.size(F.filter("votes", lambda v: v["lang"] != F.col("p")))
    reasons = F.array_join(F.array_compact(F.array(
        F.when(confidence < LEAST_CONFIDENCE, "low_confidence"), F.when(confidence - runner < LEAST_MARGIN, "small_margin"), F.when(F.col("n") < LEAST_WORDS, "short_text"),
        F.when(whole["lang"] != F.col("p"), "whole_text_disagrees"), F.when(others > 0, "other_language_paragraphs"),
    )), ";")
    value = lambda c: F.when(~blank, c)
    return found.select(
        key, value(F.col("p")).alias("language"), value(F.when(F.col("voted") > 0, best / F.col("voted"))).alias("primary_share"), value(confidence).alias("confidence"),
        value(second["lang"]).alias("second"), value(runner).alias("second_confidence"), F.when(blank, 0).otherwise(others).alias("other_paragraphs"),
        F.when(blank, "empty_text").otherwise(reasons).alias("reasons"),
    )
