"""English word stems after the published Snowball "English" rules."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
# Irregular words, words left alone, and the suffix tables.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
FINISHED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
SHORTENED = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
ENDINGS = (
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
)


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        found = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
        return found.end() if found else len(word)

    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            return len(prefix), after(len(prefix))
    first = after(0)
    return first, after(first)


def _short_syllable_end(word: str) -> bool:
    return bool(re.search(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", word) or re.fullmatch(f"[{VOWELS}][^{VOWELS}]", word))


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return word
    root = word[: -len(suffix)]
    if suffix.startswith("ee"):
        return root + "ee" if len(root) >= r1 else word
    if not re.search(f"[{VOWELS}]", root):
        return word
    if root.endswith(("at", "bl", "iz")):
        return root + "e"
    if root.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return root[:-1]
    if len(root) <= r1 and _short_syllable_end(root):
        return root + "e"
    return root


def stem(word: str) -> str:
    """Stem of one lower-case word; words with other letters are left alone."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    word = re.sub(f"(^|(?<=[{VOWELS}]))y", "Y", word.lstrip("'"))
    r1, r2 = _regions(word)
    word = _plural(re.sub("('s'|'s|')$", "", word))
    if word in FINISHED:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    suffix = _longest(word, (*DERIVED, "ogi", "li"))
    if suffix and len(word) - len(suffix) >= r1:
        root = word[: -len(suffix)]
        if suffix in DERIVED:
            word = root + DERIVED[suffix]
        elif suffix == "ogi" and root.endswith("l"):
            word = root + "og"
        elif suffix == "li" and root[-1:] in tuple("cdeghkmnrt"):
            word = root

    suffix = _longest(word, (*SHORTENED, "ative"))
    if suffix:
        cut = len(word) - len(suffix)
        if suffix == "ative":
            word = word[:cut] if cut >= r2 else word
        elif cut >= r1:
            word = word[:cut] + SHORTENED[suffix]

    suffix = _longest(word, (*ENDINGS, "ion"))
    if suffix:
        cut = len(word) - len(suffix)
        if cut >= r2 and (suffix != "ion" or word[cut - 1 : cut] in ("s", "t")):
            word = word[:cut]

    if word.endswith("e"):
        cut = len(word) - 1
        if cut >= r2 or (cut >= r1 and not _short_syllable_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
