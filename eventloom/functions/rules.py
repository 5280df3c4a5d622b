"""Text rules over news: names, event types, polarity, facts and scores. The vocabularies are parameters with demonstration values."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import occurrences

#: Endings of Russian nouns and names in their cases (fixed values of the language).
CASE_ENDINGS = ("а", "ам", "ами", "ах", "е", "ей", "ем", "и", "о", "ов", "ой", "ом", "у", "ы", "ь", "ью", "ю", "я", "ям", "ями", "ях")
LETTER = "a-zа-яё0-9"


def alias_pattern(alias: str) -> str:
    """A lower-case pattern without borders; Cyrillic words of five letters and more take case endings."""

    def form(word: str) -> str:
        if len(word) < 5 or not re.fullmatch("[а-яё]+", word):
            return re.escape(word)
        return re.sub("[аеёийоуыьэюя]$", "", word) + "(?:" + "|".join(sorted(CASE_ENDINGS, key=lambda e: (-len(e), e))) + ")?"

    return " ".join(form(w) for w in alias.lower().split())


def named_in(lower: Column, aliases: tuple[str, ...]) -> Column:
    """Whether any alias stands in a lower-case text as whole words; the pattern is only tried where its beginning is found."""
    patterns = [alias_pattern(a) for a in aliases]
    begins = reduce(lambda a, b: a | b, [lower.contains(p.partition("(?:")[0].replace("\\", "")) for p in patterns])
    return begins & lower.rlike(f"(?:^|[^{LETTER}])(?:{'|'.join(patterns)})(?:$|[^{LETTER}])")


@dataclass(frozen=True)
class Instrument:
    """A traded name: its aliases, words that hint at it in a title, its sector, and the parent whose alias its own may hold."""

    ticker: str
    aliases: tuple[str, ...]
    hints: tuple[str, ...] = ()
    sector: str = "other"
    parent: str | None = None


def mentions(title: Column, body: Column, instruments: list[Instrument], most: int = 20) -> Column:
    """Array of (ticker, relevance), best first: .96 named in the title, .84 hinted at there and named below, .78 named below.

    A parent goes where its child is found as relevant; at most `most` stay.
    """
    def hits(x: Column) -> Column:
        """Of the two lower-case texts: for each instrument its relevance."""
        out = []
        for i in instruments:
            hinted = reduce(lambda a, b: a | b, [x["title"].contains(h) for h in i.hints], F.lit(False))
            out.append(F.when(named_in(x["title"], i.aliases), 0.96).when(named_in(x["body"], i.aliases), F.when(hinted, 0.84).otherwise(0.78)).alias(i.ticker))
        return F.struct(*out)

    def ranked(found: Column) -> Column:
        kept = []
        for i in instruments:
            own = found[i.ticker]
            for child in (c for c in instruments if c.parent == i.ticker):
                own = F.when(~F.coalesce(found[child.ticker] >= found[i.ticker], F.lit(False)), own)
            kept.append(F.struct((-own).alias("order"), F.lit(i.ticker).alias("ticker"), own.alias("relevance")))
        listed = F.filter(F.array(*kept), lambda x: x["relevance"].isNotNull())
        return F.transform(F.slice(F.array_sort(listed), 1, most), lambda x: F.struct(x["ticker"].alias("ticker"), x["relevance"].alias("relevance")))

    # Bound variables, so that a text is put into lower case once and each name is looked for once.
    texts = F.array(F.struct(F.lower(title).alias("title"), F.lower(body).alias("body")))
    return F.get(F.transform(F.transform(texts, hits), ranked), F.lit(0))


def first_rule(text: Column, rules: list[tuple[str, float, tuple[str, ...]]], other: tuple[str, float] = ("other", 0.35)) -> tuple[Column, Column]:
    """Name and weight of the first rule with a term in the text, which is in lower case."""
    name, weight = F.lit(other[0]), F.lit(other[1])
    for rule, base, terms in reversed(rules):
        hit = reduce(lambda a, b: a | b, [text.contains(t) for t in terms])
        name, weight = F.when(hit, rule).otherwise(name), F.when(hit, base).otherwise(weight)
    return name, weight


def term_polarity(text: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """(positive - negative) / (positive + negative) by occurrences, terms within one another included; 0 without any."""
    p, n = (reduce(lambda a, b: a + b, [occurrences(text, t) for t in terms]) for terms in (positive, negative))
    return F.coalesce(F.try_divide((p - n).cast("double"), (p + n).cast("double")), F.lit(0.0))


def tense(text: Column, future: tuple[str, ...], past: tuple[str, ...]) -> Column:
    """X11: future before past before current."""
    any_of = lambda terms: reduce(lambda a, b: a | b, [text.contains(t) for t in terms])
    return F.when(any_of(future), "future").when(any_of(past), "past").otherwise("current")


SENTENCE_END = r"[.!?]+ +|\n+"
PERCENT, MONEY = r"([0-9]+(?:[.,][0-9]+)?) ?%", r"([0-9]+(?:[.,][0-9]+)? ?(?:k|mln|bln) ?(?:usd|eur))"


def facts(text: Column, most: int = 20) -> Column:
    """Array of (kind, value, quote): the percentages, then the amounts of money, of sentence after sentence."""

    def of(kind: str, pattern: str, sentence: Column) -> Column:
        quote = F.substring(F.trim(sentence), 1, 500)
        return F.transform(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), F.replace(v, F.lit(","), F.lit(".")).alias("value"), quote.alias("quote")))

    every = F.transform(F.split(text, SENTENCE_END), lambda s: F.concat(of("percentage", PERCENT, s), of("money", MONEY, s)))
    return F.slice(F.flatten(every), 1, most)


@dataclass(frozen=True)
class ClauseTable:
    """What clauses say of financial metrics, read from one letter a word.

    Each word of a clause becomes the letter of the first class that it matches whole, others a dot; VERDICTS are then
    patterns over these letters, tried in order. Both are plain regular expressions, so that any engine can repeat them.
    """

    #: Phrases that stand for an earlier year, joined to one word first.
    year_ago: str = "a year earlier|last year|in the previous year"
    clause_end: str = r"[.!?;]+[ \n]+|\n+|, | (?:and|but|however|while) "
    word: str = r"[0-9]+(?:[.,][0-9]+)? ?(?:%|(?:k|mln|bln|usd|eur|times)(?:[^a-z]|$))|[0-9]+(?:[.,][0-9]+)?|[a-z]+"
    classes: tuple[tuple[str, str], ...] = (
        ("a", "[0-9].*[%a-z].*"), ("g", "(?:profit|revenue|ebitda|margin)[a-z]*"), ("l", "loss(?:es)?"), ("b", "(?:cost|expense)s?"), ("o", "client[a-z]*|borrower[a-z]*|debtor[a-z]*|wrote"), ("d", "debts?"),
        ("n", "growth|increase"), ("u", "fall|decline|decrease|drop"), ("p", "grew|grown?|grows|growing|rose|risen?|rises|rising|increased|increases|increasing|doubled|doubles|higher|widen(?:ed|s)"),
        ("m", "fell|falls|fallen|falling|declined|declines|declining|decreased|decreases|shrank|shrunk|shrinks|narrow(?:ed|s)|lower|dropped|drops"),
        ("h", "not|no|if|may|might|could|expect[a-z]*|forecast[a-z]*|plan(?:s|ned)?|intend[a-z]*|den(?:y|ies|ied)|without"), ("r", "with|after|amid|thanks|due"), ("i", "it|they|result|figure"),
        ("k", "posted|recorded|suffered"), ("q", "compared|against|than|from"), ("y", "yearago"),
    )
    surprise: tuple[tuple[str, str], ...] = (("+", "(?:above|better)"), ("-", "(?:below|worse)"))
    expected: str = "(?: [a-z]+){0,3} (?:expectation|forecast|consensus)"

    #: A clause that has none of these words' beginnings says nothing.
    hint: str = "profit|revenue|ebitda|margin|loss|cost|expense|debt|(?:^|[^a-z])(?:it|they|result|figure)(?:[^a-z]|$)"


#: A metric and a change that nothing but other words parts: metrics g (good), l, b, d (bad); changes p, m, and n, u as nouns before a metric.
_PART = "[^glbdrpmnu]"
_RISES = "(?:{0}" + _PART + "{{0,9}}p|p" + _PART + "{{0,9}}{0}|n" + _PART + "{{0,3}}{0})"
_FALLS = "(?:{0}" + _PART + "{{0,9}}m|m" + _PART + "{{0,9}}{0}|u" + _PART + "{{0,3}}{0})"
_GOOD, _BAD = (f"{_RISES.format('g')}|{_FALLS.format('[lbd]')}", f"{_FALLS.format('g')}|{_RISES.format('[lbd]')}")
#: (letter, patterns that have to be found, patterns that must not be): the first row that holds is the clause's verdict; ? is unclear.
VERDICTS = (
    ("?", ("i", "[pm]", "a"), ("[glbd]",)),  # a pronoun may stand for a metric
    ("", (), ("[glbd]",)),
    ("", ("^y",), ()),  # history
    ("?", ("h",), ()),
    ("", (), ("a",)),
    ("?", ("o", "d"), ()),  # someone else's debt
    ("?", ("y",), ("q",)),  # a past change that nothing is compared with
    ("=", (_GOOD,), (_BAD,)),
    ("~", (_BAD,), (_GOOD,)),
    ("?", (_GOOD,), ()),
    ("~", ("k[^glbdr]{0,6}l",), ()),  # a loss that was booked
    ("?", ("[glbd][^glbd]*[pmnu]",), ()),  # a change behind a barrier, or another subject's
)


def verdict(code: Column) -> Column:
    """= for good, ~ for bad, ? for unclear, else nothing."""
    out = F.lit("")
    for letter, needs, lacks in reversed(VERDICTS):
        out = F.when(reduce(lambda x, y: x & y, [*(code.rlike(n) for n in needs), *(~code.rlike(n) for n in lacks)]), letter).otherwise(out)
    return out


def financial_polarity(text: Column, table: ClauseTable = ClauseTable()) -> Column:
    """1.0 or -1.0 where all clauses with a verdict agree, 0.0 where they don't or one is unclear, null where none has one."""

    def letter(word: Column) -> Column:
        out = F.lit(".")
        for name, pattern in reversed(table.classes):
            out = F.when(word.rlike(f"^(?:{pattern})$"), name).otherwise(out)
        return out

    lower = F.regexp_replace(F.lower(text), table.year_ago, "yearago")
    clauses = F.filter(F.split(lower, table.clause_end), lambda c: c.rlike(table.hint))
    codes = F.transform(clauses, lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit(table.word), F.lit(0)), letter), ""))
    said = F.array_join(F.transform(codes, verdict), "")
    hopes = F.concat(*[F.when(lower.rlike(f"{word}{table.expected}"), sign).otherwise("") for sign, word in table.surprise])

    def weigh(x: Column) -> Column:
        s, hoped = x["said"], x["hopes"]
        clash = s.contains("?") | (s.contains("=") & (s.contains("~") | hoped.contains("-"))) | (s.contains("~") & hoped.contains("+"))
        return F.when(clash, 0.0).when(s.contains("="), 1.0).when(s.contains("~"), -1.0)

    return F.get(F.transform(F.array(F.struct(said.alias("said"), hopes.alias("hopes"))), weigh), F.lit(0))  # a bound variable: worked out once


def canonical(token: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The name of the first prefix rule that holds, else the token."""
    out = token
    for prefix, name in reversed(prefixes):
        out = F.when(token.startswith(prefix), name).otherwise(out)
    return out


def headline_and_publisher(title: Column, publishers: tuple[str, ...]) -> tuple[Column, Column]:
    """What stands after the last spaced dash is a publisher only if it is a domain or a known name; else all is headline."""
    pattern = r"^(.*\S)\s+[—–-]\s+(\S.*?)\s*$"
    last = F.regexp_extract(title, pattern, 2)
    plain = F.trim(F.regexp_replace(F.lower(last), f"[^{LETTER}]+", " "))
    known = F.lower(last).rlike(r"^(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/.*)?$") | plain.isin(*publishers)
    known = (last != "") & known
    return F.when(known, F.regexp_extract(title, pattern, 1)).otherwise(title), F.when(known, last)
