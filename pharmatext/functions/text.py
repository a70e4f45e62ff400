"""Tokenizer and part-of-speech rules as column expressions.

The tokenizer lower-cases, splits contractions (``don't`` gives ``do`` and ``n't``) and takes runs
of letters and digits, and single symbols. Punctuation and white space go; symbols and digits stay.
Unlike a statistical tokenizer it also splits URLs, e-mail addresses, decimals and abbreviations.
The patterns avoid ``\\b`` and look-around, so they mean the same in Java and in RE2.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from pharmatext.functions.fixed_values import POS_TAGS, STOP_WORDS

CLITIC = r"([a-z])(n't|'(?:s|re|ve|ll|d|m))"
TOKEN = r"(n't|'(?:s|re|ve|ll|d|m)|[\p{L}\p{N}]+|\p{S})"

# (pattern, tag) in order of precedence; anything else is a noun.
TAG_RULES = [
    (r"^\p{N}+$", "NUM"),
    (r"^\p{S}$", "SYM"),
    (r"ly$", "ADV"),
    (r"(ing|ed)$", "VERB"),
    (r"(able|ible)$", "ADJ"),
    (r"(tion|ment)$", "NOUN"),
]
DEFAULT_TAG = "NOUN"

# Frequent closed-class words that the stop list does not hold.
CLOSED_CLASS = {
    "ADP": ["among", "around", "near", "since", "toward", "upon", "within", "without"],
    "AUX": ["could", "may", "might", "must", "shall", "would", "'ve", "'ll", "'m", "'re"],
    "PART": ["n't", "'s"],
    "PRON": ["anyone", "everyone", "mine", "nobody", "someone", "something"],
    "SCONJ": ["although", "unless", "whether", "though"],
    "CCONJ": ["either", "neither", "yet"],
    "DET": ["another", "every", "many", "several"],
    "INTJ": ["hello", "oh", "please", "wow"],
}


def raw_tokens(text: Column) -> Column:
    """All tokens of a text, stop words included."""
    spaced = F.regexp_replace(F.lower(text), CLITIC, "$1 $2")
    return F.regexp_extract_all(spaced, F.lit(TOKEN), F.lit(1))


def tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Tokens of a text without stop words, in text order."""
    stops = list(stop_words)
    found = raw_tokens(text)
    return F.filter(found, lambda t: ~t.isin(stops)) if stops else found


def check_tags(tags: Iterable[str]) -> list[str]:
    """The tags in upper case; an unknown one is an error."""
    wanted = [t.strip().upper() for t in tags]
    unknown = [t for t in wanted if t not in POS_TAGS]
    if unknown:
        raise ValueError(f"not part-of-speech tags: {', '.join(unknown)}")
    return wanted


def rule_tag(token: Column) -> Column:
    """Tag by closed-class word, then by shape and suffix."""
    cases = [(token.isin(words), tag) for tag, words in CLOSED_CLASS.items()]
    cases += [(token.rlike(pattern), tag) for pattern, tag in TAG_RULES]
    return F.coalesce(*[F.when(test, tag) for test, tag in cases], F.lit(DEFAULT_TAG))
