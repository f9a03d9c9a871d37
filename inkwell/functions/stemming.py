"""Suffix stripping after Porter's paper of 1980, as tables of rules and conditions.

The extensions commonly added since are an option: a pool of irregular forms, -ies and -ied of short words, -y after a
consonant of longer words, and three more endings.
"""

from __future__ import annotations

#: Irregular forms of the extended rules.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Endings replaced if the stem before them has a measure above 0 (steps 2 and 3) and removed if above 1 (step 4).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_2_EXTENDED = {"bli": "ble", "fulli": "ful", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    kinds = ""
    for letter in word:
        vowel = letter in "aeiou" or letter == "y" and kinds.endswith("c")
        kinds += "v" if vowel else "c"
    return kinds


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(stem).count("vc")


def has_vowel(stem: str) -> bool:
    return "v" in shape(stem)


def double_end(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem).endswith("c")


def short_end(stem: str, extended: bool) -> bool:
    """Consonant, vowel, consonant other than w, x, y; by the extensions also vowel, consonant as the whole."""
    if extended and len(stem) == 2 and shape(stem) == "vc":
        return True
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, endings: dict[str, str], least: int) -> str:
    """Only the longest ending that fits is looked at."""
    for size in range(min(7, len(word)), 0, -1):
        end = word[-size:]
        if end in endings:
            rest = word[: len(word) - size]
            return rest + endings[end] if measure(rest) > least else word
    return word


def _plural(word: str, extended: bool) -> str:
    if extended and word.endswith("ies") and len(word) == 4:
        return word[:-1]
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str, extended: bool) -> str:
    if extended and word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        if word.endswith(end) and has_vowel(word[: -len(end)]):
            rest = word[: -len(end)]
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if double_end(rest) and rest[-1] not in "lsz":
                return rest[:-1]
            return rest + "e" if measure(rest) == 1 and short_end(rest, extended) else rest
    return word


def _final_y(word: str, extended: bool) -> str:
    rest = word[:-1]
    if not word.endswith("y"):
        return word
    turns = len(rest) > 1 and shape(rest).endswith("c") if extended else has_vowel(rest)
    return rest + "i" if turns else word


def _second(word: str, extended: bool) -> str:
    if not extended:
        return _longest(word, STEP_2, 0)
    if word.endswith("alli") and measure(word[:-4]) > 0:
        return _second(word[:-2], extended)
    if word.endswith("logi"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    endings = {k: v for k, v in STEP_2.items() if k != "abli"} | STEP_2_EXTENDED
    return _longest(word, endings, 0)


def _fourth(word: str) -> str:
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            return rest if measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")) else word
    return word


def _final_e(word: str, extended: bool) -> str:
    if word.endswith("e"):
        rest = word[:-1]
        m = measure(rest)
        if m > 1 or m == 1 and not short_end(rest, extended):
            return rest
    return word


def stem(word: str, extended: bool = True) -> str:
    """The stem of one word, in lower case."""
    word = word.lower()
    if extended and word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _second):
        word = step(word, extended)
    word = _fourth(_longest(word, STEP_3, 0))
    word = _final_e(word, extended)
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def singular(word: str) -> str:
    """A noun without its plural ending by rule; stands in where a dictionary of lemmas is not at hand."""
    for end, to in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zes", "z"), ("men", "man")):
        if word.endswith(end) and len(word) > len(end) + 1:
            return word[: -len(end)] + to
    if word.endswith("s") and len(word) > 3 and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    return word
