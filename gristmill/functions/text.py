"""Column functions on text: normalisation, tokens, overlap metrics and containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, dropped by answer normalisation; the articles; white space as text splitting has it.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """Lower case, punctuation dropped, articles dropped as words, white space collapsed. Null stays null."""
    bare = F.translate(F.lower(_col(c)), PUNCTUATION, "")
    # a look at the first letter comes first, and white space that is one space already is passed over
    return F.trim(F.regexp_replace(F.regexp_replace(bare, rf"(?U)(?=[{''.join(sorted({a[0] for a in ARTICLES}))}])\b({'|'.join(ARTICLES)})\b", " "), r"(?U)(?:(?! )\s| (?=\s))\s*", " "))


def normalized_tokens(c: Column | str) -> Column:
    """The words of the normalised text; an empty text has none."""
    return F.array_remove(F.split(normalize_text(c), " "), "")


def lexical_tokens(c: Column | str) -> Column:
    """Runs of letters, digits and underscores of any script, lower case."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(?U)\w+"), F.lit(0))


def words(c: Column | str) -> Column:
    """Words between white space: the reversible tokenizer of the chunkers (C1 with decode(encode(x)) = x up to spaces)."""
    return F.array_remove(F.split(_col(c), r"\s+"), "")


def shared_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays.

    Each distinct common token counts the smaller number of its occurrences: that is the occurrences in a and b less
    those of the larger side, found as the drop in size when it is removed.
    """
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(F.size(a) - F.size(F.array_remove(a, t)), F.size(b) - F.size(F.array_remove(b, t))))


def f1_of_tokens(a: Column, b: Column) -> Column:
    """A1: 1 if both are empty, 0 if one is or nothing is shared, else the harmonic mean of precision and recall."""
    shared = shared_tokens(a, b).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * shared / (F.size(a) + F.size(b)))


def token_f1(prediction: Column | str, gold: Column | str) -> Column:
    return f1_of_tokens(normalized_tokens(prediction), normalized_tokens(gold))


def best_f1(prediction: Column | str, references: Column) -> Column:
    """A1: the best over references; without any, 1 where the prediction normalises to nothing."""
    own = normalized_tokens(prediction)
    return F.when(F.size(references) == 0, (F.size(own) == 0).cast("double")).otherwise(F.array_max(F.transform(references, lambda r: f1_of_tokens(own, normalized_tokens(r)))))


def best_exact_match(prediction: Column | str, references: Column) -> Column:
    own = normalize_text(prediction)
    return F.when(F.size(references) == 0, (own == "").cast("double")).otherwise(F.array_max(F.transform(references, lambda r: (normalize_text(r) == own).cast("double"))))


def contains_tokens(text: Column | str, answers: Column) -> Column:
    """A normalised, non-empty answer is a run of the text's normalised tokens."""
    padded = F.concat(F.lit(" "), normalize_text(text), F.lit(" "))
    return F.exists(answers, lambda a: (normalize_text(a) != "") & F.contains(padded, F.concat(F.lit(" "), normalize_text(a), F.lit(" "))))


def contains_substring(text: Column | str, spans: Column) -> Column:
    """P3's test: a normalised, non-empty span is a substring of the normalised text, also inside words."""
    own = normalize_text(text)
    return F.exists(spans, lambda s: (normalize_text(s) != "") & F.contains(own, normalize_text(s)))


def evidence_grade(text, document, gold_documents: Column, spans: Column, mode: str = "substring") -> Column:
    """P3 (mode 'substring') and P4 ('token'): 2 for evidence in the text, 1 for a relevant document, else 0."""
    if mode not in ("substring", "token"):
        raise ValueError(f"unknown mode {mode!r}")
    found = contains_substring(text, spans) if mode == "substring" else contains_tokens(text, spans)
    return F.when(found, 2).when(F.array_contains(gold_documents, _col(document)), 1).otherwise(0)


def sentences(c: Column | str) -> Column:
    """Cut after . ! or ? before white space; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(_col(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


# Words whose full stop belongs to them, and marks that end a sentence whatever stands before them.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Rev", "Gen", "Sen", "Gov", "Jr", "Sr", "St", "Mt", "Ave", "Blvd", "Inc", "Ltd", "Co", "Corp", "Bros", "vs", "etc", "No", "approx", "e.g", "i.e", "a.m", "p.m", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec")
ENDS = "!?\u2026\u203d\u3002\uff01\uff1f\u061f\u06d4\u0964"

_AFTER = r"(?<=[\p{Ll}\p{Nd}%\p{Pe}\p{Pf}\"'\s]|\p{Lu}{2})"
_ABBREVIATED = "(?<!(?:^|[^\\p{L}\\p{N}.])(?:" + "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS) + "))"
#: A look at the stop itself comes first, so that what stands before it is tested there alone.
_STOP = rf"(?:[{ENDS}]|(?=\.){_AFTER}{_ABBREVIATED}(?<!\.)\.(?!\.))"
#: To the first mark that ends a sentence, with all punctuation and white space up to the next word; or to the end.
_SENTENCE = rf"(?Us)(?=\S).*?(?:{_STOP}\p{{P}}*\s[\p{{P}}\s]*(?=[^\p{{P}}\s])|(?=\.)(?<=\p{{Ll}})\.(?=\p{{Lu}})|\z)"


def rule_sentences(c: Column | str) -> Column:
    """C2 by rules on tokens instead of characters: a full stop is a token of its own at the end of a word, after a small
    letter, a digit, a closing mark or two capitals (not after a lone initial, an abbreviation or another full stop), or
    between a small letter and a capital; other end marks are at the end of any word.  The next sentence starts with the
    first token that isn't punctuation, so quotes and brackets after the end stay with it.  Trimmed, empty ones dropped."""
    parts = F.regexp_extract_all(_col(c), F.lit(_SENTENCE), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)\s+\z", "")), lambda s: s != "")  # they start with no white space
