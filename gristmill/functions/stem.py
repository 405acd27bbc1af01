"""English stems by the published Porter2 algorithm, for a corpus' distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gristmill.session import small_side

# Fixed values of the algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# End of the fixed values.

V = "[aeiouy]"
REGION = re.compile(rf"{V}[^aeiouy]")
SHORT_END = re.compile(rf"(?:[^aeiouy]{V}[^aeiouywxY]|^{V}[^aeiouy])$")


def _regions(word: str) -> tuple[int, int]:
    head = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if head is None:
        found = REGION.search(word)
        head = found.end() if found else len(word)
    found = REGION.search(word, head)
    return head, found.end() if found else len(word)


def _longest(word: str, ends) -> str | None:
    return max((e for e in ends if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) <= 2 or not word.isalpha():
        return EXCEPTIONS.get(word, word)
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub(rf"^y|(?<={V})y", "Y", word)
    r1, r2 = _regions(word)
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(V, word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_1A:
        return word
    # 1b: past tense and participles
    if end := _longest(word, ("eed", "eedly")):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif (end := _longest(word, ("ed", "edly", "ing", "ingly"))) and re.search(V, word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and SHORT_END.search(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # 2 and 3: derived endings
    end = _longest(word, STEP_2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if end == "li":
            word = before if before[-1:] in tuple("cdeghkmnrt") else word
        elif end != "ogi" or before.endswith("l"):
            word = before + STEP_2[end]
    end = _longest(word, STEP_3)
    if end and len(word) - len(end) >= r1 and (end != "ative" or len(word) - len(end) >= r2):
        word = word[: -len(end)] + STEP_3[end]
    # 4
    end = _longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not SHORT_END.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stemmed_terms(terms: DataFrame) -> DataFrame:
    """terms with their column `term` stemmed: each different word is stemmed once, numbers stay."""
    stems = terms.select("term").distinct().withColumn("stem", F.when(F.col("term").rlike("^[a-z]+$"), stemmed("term")).otherwise(F.col("term")))
    return terms.join(small_side(stems, 500_000), "term").drop("term").withColumnRenamed("stem", "term")
