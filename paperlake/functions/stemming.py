"""English stop words and the Snowball English ("Porter2") stemmer.

Written from the published algorithm description. It is called once per distinct word of an Arrow
batch, never once per token.
"""

import re
from functools import lru_cache
from os.path import commonprefix

# The Snowball English stop-word list.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now""".split()
)

# Whole-word exceptions of the algorithm.
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STOP_AFTER_1A = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}

# Suffix replacements of steps 2 and 3, and deletions of step 4.
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "",
}
_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
)

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_R1_PREFIXES = ("gener", "commun", "arsen")
_VOWEL = re.compile(r"[aeiouy]")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z")
_SHORT_END = re.compile(r"([^aeiouy][aeiouy][^aeiouywxY]|\A[aeiouy][^aeiouy])\Z")
_LI_ENDINGS = "cdeghkmnrt"


def _longest(word, suffixes):
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _regions(word):
    """Start offsets of the two regions suffixes must lie in."""
    r1 = next((len(p) for p in _R1_PREFIXES if word.startswith(p)), None)
    if r1 is None:
        hit = _REGION.search(word)
        r1 = hit.end() if hit else len(word)
    hit = _REGION.search(word, r1)
    return r1, hit.end() if hit else len(word)


def _plural(word):
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")):
        return word
    if word.endswith("s") and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past_tense(word, r1):
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if suffix.startswith("eed"):
        return stem + "ee" if len(stem) >= r1 else word
    if not _VOWEL.search(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _DOUBLE.search(stem):
        return stem[:-1]
    if len(stem) <= r1 and _SHORT_END.search(stem):
        return stem + "e"
    return stem


def _derivations(word, r1, r2):
    suffix = _longest(word, (*_STEP2, "ogi", "li"))
    if suffix and len(word) - len(suffix) >= r1:
        stem = word[: -len(suffix)]
        if suffix == "ogi":
            word = word[:-1] if stem.endswith("l") else word
        elif suffix == "li":
            word = stem if stem and stem[-1] in _LI_ENDINGS else word
        else:
            word = stem + _STEP2[suffix]

    suffix = _longest(word, (*_STEP3, "ative"))
    if suffix == "ative":
        word = word[:-5] if len(word) - 5 >= r2 else word
    elif suffix and len(word) - len(suffix) >= r1:
        word = word[: -len(suffix)] + _STEP3[suffix]

    suffix = _longest(word, (*_STEP4, "ion"))
    if suffix and len(word) - len(suffix) >= r2:
        stem = word[: -len(suffix)]
        if suffix != "ion" or stem.endswith(("s", "t")):
            word = stem
    return word


def _final_letter(word, r1, r2):
    if word.endswith("e"):
        stem = word[:-1]
        if len(stem) >= r2 or (len(stem) >= r1 and not _SHORT_END.search(stem)):
            return stem
    elif word.endswith("ll") and len(word) - 1 >= r2:
        return word[:-1]
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words with letters outside a-z are returned unchanged."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    # A "y" that acts as a consonant is marked "Y" until the end.
    word = re.sub(r"\Ay|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in _STOP_AFTER_1A:
        return word
    word = _past_tense(word, r1)
    word = re.sub(r"(?<=.[^aeiouy])[yY]\Z", "i", word)
    word = _derivations(word, r1, r2)
    return _final_letter(word, r1, r2).lower()


def english_term(word: str):
    """Index term of a token, or None for a stop word."""
    return None if word in STOP_WORDS else stem(word)


def common_start(term: str) -> str:
    """Letters that every word with this stem starts with.

    Stemming cuts a word's end and changes at most the last letter of what is left, but for the
    listed exceptions.
    """
    return commonprefix([term[:-1], *(w for w, stem_ in _EXCEPTIONS.items() if stem_ == term)])
