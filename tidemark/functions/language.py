"""Language of a text among en, de, ja, zh and other, from its script, stop words and German spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and character ranges.
EN = [
    "the", "and", "for", "that", "with", "this", "from", "have", "has", "not", "are", "was", "were", "you", "your", "but", "they", "their", "which",
    "when", "what", "about", "would", "there", "been", "more", "will", "can", "all", "into", "than", "them", "these", "some", "also", "other", "only",
    "over",
]
DE = [
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "einen", "einem", "mit", "auf", "für", "von", "den", "dem", "des", "sich", "auch", "sind",
    "wird", "werden", "wurde", "noch", "nach", "bei", "aber", "oder", "wenn", "sie", "man", "kann", "mehr", "schon", "durch", "über", "unter", "wie",
]
OTHER_LATIN = [
    "les", "des", "une", "pour", "dans", "est", "sur", "avec", "sont", "plus", "que", "los", "las", "por", "para", "con", "una", "como", "este", "pero",
    "não", "uma", "são", "mais", "pelo", "che", "per", "del", "sono", "anche", "come", "het", "een", "van", "zijn", "niet", "voor", "maar", "och", "att",
    "som", "för", "inte", "med",
]
KANA, HAN, HANGUL = "[぀-ヿ]", "[㐀-䶿一-鿿豈-﫿]", "[가-힯ᄀ-ᇿ]"
FOREIGN = ["[Ѐ-ӿ]", "[؀-ۿ]", "[ऀ-ॿ]", "[฀-๿]", "[Ͱ-Ͽ]"]
CJK = "[぀-ゟ゠-ヿ㐀-䶿一-鿿豈-﫿가-힯]"
UMLAUTS = "[äöüßÄÖÜ]"


def cjk_ratio(text: Column) -> Column:
    """Share of characters that are CJK; 0 for a null or empty text."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(CJK)) / F.length(text)).otherwise(0.0)


def long_enough(text: Column, latin: int = 400, cjk: int = 150) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) >= F.when(cjk_ratio(text) > 0.15, cjk).otherwise(latin)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def detect_language(text: Column) -> Column:
    """Struct (lang, confidence) from the whole text; null and blank texts are `other` with confidence 0.

    The text is cut into words once; one pass keeps those that any list knows and the long ones, which are few, and the lists count in them.
    Scripts are counted only in texts that have a character beyond the Latin ones.
    """
    one = lambda lang, confidence: F.struct(F.lit(lang).alias("lang"), F.least(F.lit(1.0), confidence).cast("double").alias("confidence"))

    def judged(t):
        share = lambda chars: F.regexp_count(t, F.lit(chars)) / F.length(t)
        foreign = share(HANGUL) > 0.05
        for chars in FOREIGN:
            foreign = foreign | (share(chars) > 0.05)
        script = _let(
            F.struct(share(KANA).alias("kana"), share(HAN).alias("han")),
            lambda s: F.when(s["kana"] > 0.02, one("ja", 0.7 + s["kana"] * 3)).when(s["han"] > 0.15, one("zh", 0.7 + s["han"])).when(foreign, one("other", F.lit(0.9))),
        )
        script = F.when(t.rlike(r"[^\x{0}-\x{24F}]"), script)
        words = F.filter(F.split(F.regexp_replace(F.lower(t), r"[^\p{L}\s]", " "), r"\s+"), lambda w: w != "")
        every = sorted({*EN, *DE, *OTHER_LATIN})

        def latin(w):
            def voted(hits):
                among = lambda known: F.size(F.filter(hits, lambda x: x.isin(known))).cast("double")
                de = among(DE) + 0.5 * F.regexp_count(t, F.lit(UMLAUTS)) + 0.5 * F.size(F.filter(hits, lambda x: F.length(x) > 14))

                def decided(v):
                    total = v["en"] + v["de"] + v["other"]
                    return (
                        F.when(total == 0, one("en", F.lit(0.35))).when((v["other"] > v["en"]) & (v["other"] > v["de"]), one("other", v["other"] / total))
                        .when(v["de"] > v["en"], one("de", v["de"] / total)).otherwise(one("en", v["en"] / total))
                    )

                return _let(F.struct(among(EN).alias("en"), de.alias("de"), among(OTHER_LATIN).alias("other")), decided)

            return F.when(F.size(w) < 8, one("en", F.lit(0.3))).otherwise(_let(F.filter(w, lambda x: x.isin(every) | (F.length(x) > 14)), voted))

        return F.when(F.trim(t) == "", one("other", F.lit(0.0))).otherwise(F.coalesce(script, _let(words, latin)))

    return _let(F.coalesce(text, F.lit("")), judged)
