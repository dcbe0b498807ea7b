"""Tokens, stems, sentences and small text functions as Columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English function words by kind. Forms with an apostrophe can't occur as tokens, which lose theirs, and aren't listed.
STOPWORDS = tuple(
    sorted(
        {
            *"i me my myself we our ours ourselves you your yours yourself yourselves".split(),
            *"they them their theirs themselves he him his himself she her hers herself it its itself".split(),
            *"who whom what which this that these those".split(),
            *"is am are was were be been being have has had having do does did doing".split(),
            *"would should could ought can cannot".split(),
            *"and but or nor if because as until while than so".split(),
            *"of at by for with about against between into through during before after above below to from up down in out on off over under".split(),
            *"a an the no not only own same too very".split(),
            *"again further then once here there when where why how".split(),
            *"all any both each few more most other some such".split(),
        }
    )
)


def tokens(text: Column, stopwords: bool = False) -> Column:
    """Lower-case ASCII alphanumeric runs of 2 to 40 characters, apostrophes deleted first; without stopwords on request."""
    keep = (lambda t: F.length(t).between(2, 40) & ~t.isin(*STOPWORDS)) if stopwords else (lambda t: F.length(t).between(2, 40))
    return F.filter(F.split(_plain(text), " "), keep)


def token_rows(rows: DataFrame, id_column: str, stopwords: bool = False) -> DataFrame:
    """(id_column, term): a row for each of tokens(text). Lengths are tested on rows, inside whole-stage code."""
    out = rows.select(id_column, F.explode(F.split(_plain(F.col("text")), " ")).alias("term")).filter(F.length("term").between(2, 40))
    return out.filter(~F.col("term").isin(*STOPWORDS)) if stopwords else out


def _plain(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs with single blanks between them. Other letters go before case is folded: some of them fold to ASCII."""
    return F.lower(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("'"), F.lit("")), "[^A-Za-z0-9]+", " "))


def _pattern(word: str) -> str:
    """word as c (consonant) and v (vowel); y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and k and out[-1] == "c" else "c"
    return out


def _m(word: str) -> int:
    return len(re.findall("v+c+", _pattern(word)))


def _short_end(word: str) -> bool:
    return _pattern(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _pattern(word)[-1] == "c"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_RULES = [[tuple(r.split(":")) for r in step.split()] for step in (_STEP2, _STEP3)]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize tion".split()


def stem(word: str) -> str:
    """A Porter stem, in the variant that goes on to later suffixes when a step 2 or 3 suffix fails its measure."""
    if len(word) <= 2:
        return word
    for end, cut in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if word.endswith(end):
            word = word[: len(word) - cut]
            break
    if word.endswith("eed"):
        word = word[:-1] if _m(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                base = word[: -len(end)]
                if "v" in _pattern(base):
                    word = base
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _doubled(word):
                        word = word if word[-1] in "lsz" else word[:-1]
                    elif _m(word) == 1 and _short_end(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _pattern(word[:-1]):
        word = word[:-1] + "i"
    for rules in _RULES:
        for end, new in rules:
            if word.endswith(end) and _m(word[: len(word) - len(end)]) > 0:
                word = word[: len(word) - len(end)] + new
                break
    for end in _STEP4:
        if word.endswith(end):
            base = word[: len(word) - len(end)]
            if base and _m(base) > 1:
                word = base + "t" if end == "tion" else base
            break
    if word.endswith("e") and len(word) > 1:
        m = _m(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if _m(word) > 1 and _doubled(word) and word[-1] == "l":
        word = word[:-1]
    return word


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """terms with `column` stemmed, rows whose stem is shorter than 2 dropped. Only the distinct vocabulary goes through Python."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    vocabulary = terms.select(column).distinct().withColumn("__stem", stems(column))
    joined = terms.join(vocabulary, column).drop(column).withColumnRenamed("__stem", column)
    return joined.filter(F.length(column) >= 2).select(terms.columns)


def sentences(text: Column, longer_than: int = 2) -> Column:
    """Sentences with their closing . ! ? or line end, trimmed, of more than so many bytes."""
    parts = F.regexp_extract_all(text, F.lit("[^.!?\n]*[.!?\n]|[^.!?\n]+$"), F.lit(0))
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: F.octet_length(s) > longer_than)


def ws_tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def canonical_key(target: Column) -> Column:
    """Key by which links find documents: no fragment, query, folders or extension; lower-case letters and digits alone."""
    u = F.regexp_replace(F.regexp_replace(target, "#.*$", ""), r"\?.*$", "")
    u = F.regexp_replace(F.regexp_replace(u, "^.*/", ""), r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(u, "[^A-Za-z0-9]", ""))


LANGUAGES = {
    "c_like": ".c .h .cpp .hpp .cc .cxx .java .cs .js .ts .tsx .jsx .swift .kt .scala .php".split(),
    "python": [".py"], "ruby": [".rb"], "go": [".go"], "rust": [".rs"],
    "markup": ".md .markdown .html .htm .rst".split(),
}


def language(extension: Column) -> Column:
    out = F.lit("unknown")
    for name, exts in reversed(LANGUAGES.items()):
        out = F.when(extension.isin(*exts), name).otherwise(out)
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^(#{1,6}) ", 1))


def heading_text(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, "^[# ]+", ""), "[ #]+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / union)


def html_text(html: Column) -> Column:
    """Readable text of simple HTML, by patterns. sources.html is the scanner with every rule."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head|noscript)\b.*?</(script|style|head|noscript)>", "")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|blockquote|pre)\b[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), " *\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")
