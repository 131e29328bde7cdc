"""Questions made ready: spelling, abbreviations spelt out, Hindi glossed; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import search

# --- Fixed values: abbreviations and Hindi terms of questions ---
ABBREVIATIONS = [(r"\bCSR\b", "Corporate Social Responsibility (Section 135)"), (r"\bAGM\b", "Annual General Meeting (Section 96)"), (r"\bEGM\b", "Extraordinary General Meeting"), (r"\bKMP\b", "Key Managerial Personnel"), (r"\bMD\b", "Managing Director"), (r"\bROC\b", "Registrar of Companies"), (r"\bNCLT\b", "National Company Law Tribunal"), (r"\bNCLAT\b", "National Company Law Appellate Tribunal"), (r"(?i)\bsub[- ]?sec\.?\s+", "sub-section "), (r"(?i)\bsec\.?\s+", "section ")]
HINDI = {"सीएसआर": "CSR", "एजीएम": "AGM", "केएमपी": "KMP", "एनसीएलटी": "NCLT", "धारा": "section", "उपधारा": "sub-section", "कंपनी": "company", "निदेशक": "director", "अधिनियम": "act", "नियम": "rule", "परिभाषा": "definition", "अध्याय": "chapter", "दंड": "penalty", "संशोधन": "amendment", "शेयर": "share", "लाभांश": "dividend", "पूंजी": "capital", "सदस्य": "member", "लेखा": "accounts", "लेखापरीक्षा": "audit", "प्रतिभूति": "securities", "शक्ति": "power", "अनुसूची": "schedule", "प्रबंध": "management", "प्रशासन": "administration", "बैठक": "meeting", "प्रस्ताव": "resolution", "समापन": "winding up", "विलय": "merger", "संबंधित पक्ष": "related party", "कर्तव्य": "duties", "उत्तरदायित्व": "liability", "सामाजिक उत्तरदायित्व": "corporate social responsibility"}
HINDI_PHRASES = {"क्या है": "what is", "क्या कहती है": "what does it say", "क्या कहता है": "what does it say", "क्या हैं": "what are", "कौन से": "which", "कौन सी": "which", "कितने": "how many", "कितनी": "how many", "कैसे": "how", "बताइए": "tell me about", "बताओ": "tell me about", "दिखाइए": "show me", "दिखाओ": "show me", "के बारे में": "about", "के तहत": "under", "में क्या": "what in", "का अर्थ": "meaning of", "की सूची": "list of"}
# --- end of fixed values ---

GLOSSED = 0.1


def expanded(text: Column) -> Column:
    for pattern, to in ABBREVIATIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def glossed(text: Column) -> Column:
    """English words for the Hindi ones that are known, longest first; what is left of the script goes."""
    for terms in (HINDI, HINDI_PHRASES):
        for term in sorted(terms, key=len, reverse=True):
            text = F.replace(text, F.lit(term), F.lit(terms[term]))
    return T.strip(F.regexp_replace(F.regexp_replace(text, "[\\u0900-\\u097F?\\u0964]+", ""), "\\s+", " "))


def prepared(questions: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """key, text -> key, prepared. A question in Hindi is kept, with its English gloss behind it."""
    asked = questions.select(F.col(key).alias("key"), T.strip(F.col(text)).alias("asked"))
    asked = asked.withColumn("hindi", T.share(F.col("asked"), T.DEVANAGARI) > GLOSSED)
    plain = asked.withColumn("plain", F.when(F.col("hindi"), glossed(F.col("asked"))).otherwise(F.col("asked")))
    fixed = search.correct_text(plain, "key", "plain").withColumnRenamed("plain", "fixed")
    both = plain.join(fixed, "key", "left").withColumn("english", expanded(F.coalesce("fixed", F.lit(""))))
    whole = F.when(~F.col("hindi"), F.col("english")).when(F.col("english") != "", expanded(F.concat("asked", F.lit(" [English: "), "english", F.lit("]")))).otherwise(expanded(F.col("asked")))
    return both.select(F.col("key").alias(key), whole.alias("prepared"))
