"""Text normalisation and phrase-list scores as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, spelt out so that every engine reads it alike.
SPACE = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def clamp(c: Column) -> Column:
    """Between 0 and 1; null as 0 (least and greatest would pass over it)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def collapse(c: Column) -> Column:
    """White space runs to one blank, none at the ends; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def normalise(c: Column) -> Column:
    return F.lower(collapse(c))


def joined(*parts: Column) -> Column:
    """Texts with one blank between, null as empty (a missing part leaves its blank)."""
    out: list[Column] = []
    for p in parts:
        out += [F.lit(" ")] * bool(out) + [F.coalesce(p, F.lit(""))]
    return F.concat(*out)


def label_norm(c: Column) -> Column:
    """Lower case, hyphens and underscores as blanks."""
    return F.translate(F.lower(F.trim(c)), "-_", "  ")


def words_array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def once(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once a row, however often it is used or whatever lambda uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


@dataclass(frozen=True)
class Searched:
    """A text column beside the column of those of the known phrases that occur in it; it stands for the text where phrases are counted."""

    text: Column
    found: Column
    known: frozenset[str]

    def among(self, phrases: Iterable[str]) -> Column:
        """Those of the phrases that occur."""
        wanted = tuple(dict.fromkeys(phrases))
        if unknown := [p for p in wanted if p not in self.known]:
            raise ValueError(f"phrases that the text was not searched for: {unknown[:3]}")
        return F.filter(self.found, lambda p: p.isin(*wanted))


def text_of(text: Column | Searched) -> Column:
    return text.text if isinstance(text, Searched) else text


def phrases_in(text: Column | Searched, phrases: Sequence[str]) -> Column:
    """The phrases that occur in the text as substrings, each once."""
    if isinstance(text, Searched):
        return text.among(phrases)
    words = words_array(tuple(dict.fromkeys(phrases)))
    return once(text, lambda t: F.filter(words, lambda p: F.contains(t, p)))


def phrase_count(text: Column | Searched, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur in the text, each counted once, as substrings."""
    return F.size(phrases_in(text, phrases))


def has_any(text: Column | Searched, phrases: Sequence[str]) -> Column:
    if isinstance(text, Searched):
        return F.size(text.among(phrases)) > 0
    words = words_array(tuple(dict.fromkeys(phrases)))
    return once(text, lambda t: F.exists(words, lambda p: F.contains(t, p)))


def linear_score(count: Column, base: float) -> Column:
    """0 for none, else base plus 0.15 for each phrase after the first."""
    return F.when(count == 0, 0.0).otherwise(clamp(F.lit(base) + (count - 1) * 0.15))


def capped_score(count: Column) -> Column:
    """0 for none, else 0.35 plus 0.15 for each of at most three more phrases."""
    return F.when(count == 0, 0.0).otherwise(clamp(F.lit(0.35) + F.least(count - 1, F.lit(3)) * 0.15))


def grouped_score(text: Column | Searched, rules: Sequence[tuple[float, Sequence[str]]]) -> Column:
    """Sum over rules of weight plus 0.1 for each phrase after the first, 0.3 more at most."""
    total: Column | None = None
    for weight, phrases in rules:
        n = phrase_count(text, phrases)
        part = F.when(n > 0, F.least(F.lit(weight) + (n - 1) * 0.10, F.lit(weight + 0.30))).otherwise(0.0)
        total = part if total is None else total + part
    return clamp(total)


def step_score(count: Column) -> Column:
    return F.when(count == 0, 0.0).when(count >= 4, 0.70).when(count >= 2, 0.55).otherwise(0.35)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")
