"""An inverted lexicon: which of many phrases occur in a text, found in one pass over it."""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import Searched, once, words_array

#: Characters of an anchor.
ANCHOR = 4
#: Characters that are told apart one by one where a prefix tree branches.
RUN = 4
#: In a regular expression these stand for themselves after a backslash alone.
_SPECIAL = set(r"\.[]{}()*+-?^$|&~#")


def grams(phrase: str) -> list[str]:
    """The runs of ``ANCHOR`` characters; a shorter phrase is its own."""
    return [phrase[i : i + ANCHOR] for i in range(len(phrase) - ANCHOR + 1)] or [phrase]


def _literal(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def _class(chars: Iterable[str]) -> str:
    return "[" + "".join(map(_literal, chars)) + "]"


def _one_of(branches: dict[str, str]) -> str:
    """A choice by first character; of many, a look at the next character rules out all of a run of them at once."""
    if len(branches) <= RUN:
        return "|".join(branches.values())
    width = max(RUN, math.isqrt(len(branches)))
    chars = list(branches)
    runs = [chars[i : i + width] for i in range(0, len(chars), width)]
    return "|".join(f"(?={_class(r)})(?:{'|'.join(branches[c] for c in r)})" for r in runs)


def _trie(words: Iterable[str]) -> str:
    """A pattern of all words in which each beginning is tried once, the longest word that fits first."""
    tails: dict[str, list[str]] = defaultdict(list)
    ends = False
    for w in words:
        if w:
            tails[w[0]].append(w[1:])
        else:
            ends = True
    branches = {c: _literal(c) + _trie(t) for c, t in sorted(tails.items())}
    if not branches:
        return ""
    if len(branches) == 1 and not ends:
        return next(iter(branches.values()))
    return f"(?:{_one_of(branches)})" + ("?" if ends else "")


class PhraseIndex:
    """Phrases held under their rarest run of four characters, the anchor.

    The anchors that occur in a text are found by one pass of a prefix tree; only phrases under such an anchor are then
    looked for as substrings. So a text costs one pass however many phrases there are, and few
    checks. Runs are called rare by how many phrases have them, then by how common their characters are in all phrases.
    """

    def __init__(self, phrases: Iterable[str]):
        self.phrases = tuple(dict.fromkeys(phrases))
        if "" in self.phrases:
            raise ValueError("an empty phrase occurs everywhere")
        shared = Counter(g for p in self.phrases for g in set(grams(p)))
        letters = Counter("".join(self.phrases))
        weight = {c: math.log(n / letters.total()) for c, n in letters.items()}
        held: dict[str, list[str]] = defaultdict(list)
        for p in self.phrases:
            held[min(grams(p), key=lambda g: (2 * weight[g[0]] + sum(weight[c] for c in g), shared[g], g))].append(p)
        self.held = dict(held)

    def candidates(self) -> dict[str, list[str]]:
        """Phrases to check where an anchor is the longest one at some place: its own, and those of the anchors that it begins with."""
        return {a: [p for b in (a[:n] for n in range(1, len(a) + 1)) for p in self.held.get(b, ())] for a in self.held}

    def pattern(self) -> str:
        first = _class(sorted({a[0] for a in self.held}))
        return f"(?={first})(?=({_trie(self.held)}))"

    def found(self, text: Column) -> Column:
        """The phrases that occur in the text as substrings, each once, in no particular order; none in a null text."""
        if not self.phrases:
            return F.array().cast("array<string>")
        under = F.create_map(*[x for a, ps in self.candidates().items() for x in (F.lit(a), words_array(ps))])

        def search(t: Column) -> Column:
            anchors = F.array_distinct(F.regexp_extract_all(t, F.lit(self.pattern()), F.lit(1)))
            likely = F.flatten(F.transform(anchors, lambda a: F.element_at(under, a)))
            return F.array_distinct(F.filter(likely, lambda p: F.contains(t, p)))

        return once(F.coalesce(text, F.lit("")), search)


def searched(df: DataFrame, text_col: str, index: PhraseIndex, found_col: str = "found") -> tuple[DataFrame, Searched]:
    """The rows with the phrases of an index that occur in a text, and what stands for the text where phrases are counted."""
    return df.withColumn(found_col, index.found(F.col(text_col))), Searched(F.col(text_col), F.col(found_col), frozenset(index.phrases))


@functools.cache
def whole_lexicon() -> PhraseIndex:
    """All phrases that a rule of this library looks for as substrings."""
    from siftwork.functions import lexicons as lex

    rules = [p for groups in lex.SAFETY_RULES.values() for _, phrases in groups for p in phrases]
    lists = (
        lex.MARKETING_PHRASES, lex.COURSE_PHRASES, lex.POLITICAL_CAMPAIGN_PHRASES, lex.POLITICAL_TOPIC_PHRASES, lex.ANIMAL_CRUELTY_PHRASES,
        lex.HUMAN_KILLING_PHRASES, lex.HERITAGE_KEYWORDS, lex.ADVERTISING_PHRASES, lex.AFFILIATE_PHRASES, lex.SOCIAL_MEDIA_PHRASES,
        lex.COURSE_PROMOTION_PHRASES, lex.BLOCKED_PHRASES, lex.SPAM_PHRASES, lex.SCAM_PHRASES, lex.PROMOTIONAL_PHRASES, lex.FAKE_HISTORY_PHRASES,
        lex.PHISHING_TERMS, lex.COPYRIGHT_TERMS, lex.SENSITIVE_TERMS, lex.FINANCIAL_TERMS, lex.IDENTITY_TERMS, ("watermark", "qr"),
    )
    return PhraseIndex([*rules, *[p for words in lists for p in words]])
