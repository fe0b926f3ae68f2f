"""English stems after the published Snowball rules ("Porter2"), and the stop words that full-text search leaves out."""

from __future__ import annotations

import re

#: Stop words of English full-text search.
STOP_WORDS = frozenset((
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
))

#: Fixed values of the published algorithm: words with stems of their own, and words that stay after the plural goes.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_WHOLE = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STARTS = ("gener", "commun", "arsen")
#: Suffixes of the second, third and fourth step and what takes their place; a None has a condition of its own.
_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less", "ogi": None, "li": None,
}
_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": None}
_FOURTH = {s: "" for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")} | {"ion": None}

_VOWEL = "[aeiouy]"
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region of a word begin."""
    def after(start: int) -> int:
        found = _REGION.search(word, start)
        return found.end() if found else len(word)

    first = next((len(s) for s in _STARTS if word.startswith(s)), None)
    first = after(0) if first is None else first
    return first, after(first)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_VOWEL, word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if not suffix:
        return word
    left = word[: -len(suffix)]
    if suffix.startswith("eed"):
        return left + "ee" if len(left) >= first else word
    if not re.search(_VOWEL, left):
        return word
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", left):
        return left[:-1]
    return left + "e" if first >= len(left) and _SHORT_END.search(left) else left


def _replaced(word: str, suffixes: dict, region: int, special) -> str:
    """The longest of the suffixes gives way if it lies in the region; `special` decides on those without a replacement."""
    suffix = _longest(word, suffixes)
    if not suffix or len(word) - len(suffix) < region:
        return word
    left, new = word[: -len(suffix)], suffixes[suffix]
    return special(left, suffix) if new is None else left + new


def stem(word: str) -> str:
    """Stem of a lower-case word. Words of up to two letters stay; other alphabets' letters count as consonants."""
    if len(word) < 3:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    first, second = _regions(word)
    word = _plural(word)
    if word in _WHOLE:
        return word
    word = _past(word, first)
    word = re.sub("(?<=.[^aeiouy])[yY]$", "i", word)
    word = _replaced(word, _SECOND, first, lambda left, s: left + "og" if s == "ogi" and left.endswith("l") else left if s == "li" and left.endswith(tuple("cdeghkmnrt")) else left + s)
    word = _replaced(word, _THIRD, first, lambda left, s: left if len(left) >= second else left + s)
    word = _replaced(word, _FOURTH, second, lambda left, s: left if left.endswith(("s", "t")) else left + s)
    left = word[:-1]
    if word.endswith("e") and (len(left) >= second or len(left) >= first and not _SHORT_END.search(left)) or word.endswith("ll") and len(left) >= second:
        word = left
    return word.replace("Y", "y")


def stem_by(word: str, forms: dict[str, str]) -> str:
    """Stem of a lower-case word; `forms` has a pattern for each stem whose forms are listed. Other words of such a stem stay whole."""
    found = stem(word)
    return found if found not in forms or re.fullmatch(forms[found], word) else word
