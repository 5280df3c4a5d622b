"""News to features, signals, gates and scopes by the text rules.

The news are the documents, each under one of TITLES and BODIES by its id, with its whole text below: rules meet phrases
whose reading is known, and every text runs through them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import MONEY, PERCENT, SENTENCE_END, VERDICTS, ClauseTable, Instrument, alias_pattern, canonical, facts, financial_polarity as clause_polarity, first_rule, headline_and_publisher, mentions, tense, term_polarity
from ..functions.text import tokens
from ..sources.fixtures import table
from .registry import query
from .text_ops import TOKENS

TITLES = [
    "Alfa Steel: quarterly results — Newswire", "Steelmaker of the north reports", "Borneo Gas — update — markets.example.com", "Доля Северстали растёт", "Weekly market review",
    "Delta Retail Logistics opens a plant", "Regulator fines brokers - unknown voice", "Trading halt on the exchange!!", "Alfa Energo and Borneo Gas sign a merger deal",
]
#: Bodies and what the clause table reads in them alone.
BODIES = [
    ("Net profit grew 12% to 3.4 bln usd.", 1), ("Net loss narrowed 30%.", 1), ("Costs rose 8% and revenue fell 5%.", -1), ("Profit grew 10% but debt rose 20%.", 0), ("Profit did not grow 5%.", 0),
    ("The group expects revenue growth of 15%.", 0), ("A year earlier profit fell 40%.", None), ("The board approves a 7% dividend.", None), ("The company posted a loss of 2,1 mln usd.", -1),
    ("Profit rose 6% amid growth of its client base.", 1), ("Profit reached 6 mln usd amid growth of sales.", 0), ("Revenue grew 4%. Profit was below expectations at 3%.", 0),
    ("Revenue rose 9%. The result is worse than forecast.", 0), ("Profit grew.", None), ("Revenue fell 5% compared with last year.", -1), ("Profit fell 5% last year.", 0),
]
NAMED = ["", "Alfa Steel was named.", "Delta Retail said so.", "Borneo Gas commented on Северсталью."]
INSTRUMENTS = [
    Instrument("AAA", ("Alfa Steel", "Alfa"), ("steelmaker",), "metals"), Instrument("BBB", ("Borneo Gas",), ("gas field",), "energy"), Instrument("CCC", ("Северсталь",), (), "metals"),
    Instrument("DDD", ("Delta Retail",), ("retailer",), "retail"), Instrument("DDL", ("Delta Retail Logistics",), (), "transport", "DDD"), Instrument("EEE", ("Alfa Energo",), (), "energy", "AAA"),
]
EVENTS = [
    ("deal", 0.9, ("merger", "acquire", "stake in")), ("dividend", 0.85, ("dividend",)), ("results", 0.8, ("profit", "revenue", "net loss")), ("regulation", 0.75, ("regulator", "licence")), ("court", 0.7, ("lawsuit", "court of")),
    ("credit", 0.7, ("rating agency", "bond issue")), ("guidance", 0.65, ("guidance", "outlook for")), ("production", 0.6, ("opens a plant", "output of")), ("management", 0.55, ("resigns", "appoints")), ("trading", 0.5, ("trading halt", "listing")),
]
POSITIVE, NEGATIVE = ("profit", "growth", "grew", "approves"), ("loss", "fines", "fell", "halt", "below")
FUTURE, PAST = ("expects", "will ", "plans to"), ("last year", "a year earlier", "was named")
PREFIXES = [("steel", "metal"), ("regulat", "authority"), ("quarter", "period"), ("week", "period"), ("trad", "market"), ("exchang", "market"), ("merg", "deal"), ("север", "north")]
PUBLISHERS = ("newswire", "daily voice")
SOURCE_QUALITY, QUALITY = {"src0": 0.9, "src1": 0.8, "src2": 0.7}, 0.6
SECTORS = {"metals": ("steel",), "energy": ("gas", "energo"), "retail": ("retail",)}
CONTEXT_ONLY, RETAINS_NEUTRAL = "src3", "src1"

_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_any = lambda column, terms: "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"
_count = lambda terms: "(" + " + ".join(f"(length(lt) - length(replace(lt, '{t}', ''))) // {len(t)}" for t in terms) + ")"


def _named_sql(column: str, i: Instrument) -> str:
    letters = "a-zа-яё0-9"
    return f"regexp_matches({column}, '(?:^|[^{letters}])(?:{'|'.join(map(alias_pattern, i.aliases))})(?:$|[^{letters}])')"


def _found_sql(i: Instrument) -> str:
    hint = _any("lti", i.hints) if i.hints else "false"
    return f"CAST(CASE WHEN {_named_sql('lti', i)} THEN 0.96 WHEN {hint} AND {_named_sql('lb', i)} THEN 0.84 WHEN {_named_sql('lb', i)} THEN 0.78 END AS DOUBLE) AS r_{i.ticker}"


def _kept_sql(i: Instrument) -> str:
    own = f"r_{i.ticker}"
    for c in (c for c in INSTRUMENTS if c.parent == i.ticker):
        own = f"CASE WHEN NOT coalesce(r_{c.ticker} >= r_{i.ticker}, false) THEN {own} END"
    return f"{{o: -({own}), ticker: '{i.ticker}', relevance: {own}}}"


_facts_sql = "flatten(list_transform(regexp_split_to_array(text, '" + SENTENCE_END + "'), lambda s: list_concat(" + ", ".join(
    f"list_transform(regexp_extract_all(s, '{p}', 1), lambda v: {{kind: '{k}', value: replace(v, ',', '.'), quote: substring(trim(s), 1, 500)}})" for k, p in (("percentage", PERCENT), ("money", MONEY))
) + ")))[1:20]"

_table = ClauseTable()
_word = " ".join(f"WHEN regexp_matches(w, '^(?:{pattern})$') THEN '{name}'" for name, pattern in _table.classes)
_verdict = " ".join(f"WHEN {' AND '.join([*(f'regexp_matches(k, {chr(39)}{n}{chr(39)})' for n in needs), *(f'NOT regexp_matches(k, {chr(39)}{n}{chr(39)})' for n in lacks)])} THEN '{letter}'" for letter, needs, lacks in VERDICTS)
_clauses = f"list_filter(regexp_split_to_array(ly, '{_table.clause_end}'), lambda c: regexp_matches(c, '{_table.hint}'))"
_codes = f"list_transform({_clauses}, lambda c: array_to_string(list_transform(regexp_extract_all(c, '{_table.word}'), lambda w: CASE {_word} ELSE '.' END), ''))"
_hopes = " || ".join(f"CASE WHEN regexp_matches(ly, '{word}{_table.expected}') THEN '{sign}' ELSE '' END" for sign, word in _table.surprise)
#: The clause table over whole texts, worked out again.
_polarity_sql = f"""q0 AS (SELECT news_id, regexp_replace(lt, '{_table.year_ago}', 'yearago', 'g') AS ly FROM n1),
q1 AS (SELECT news_id, {_hopes} AS hopes, array_to_string(list_transform({_codes}, lambda k: CASE {_verdict} ELSE '' END), '') AS said FROM q0),
q2 AS (SELECT news_id, CASE WHEN contains(said, '?') OR contains(said, '=') AND (contains(said, '~') OR contains(hopes, '-')) OR contains(said, '~') AND contains(hopes, '+') THEN 0.0 WHEN contains(said, '=') THEN 1.0 WHEN contains(said, '~') THEN -1.0 END AS fp FROM q1)"""

#: The analysed news for DuckDB.
SQL = f"""WITH n0 AS (SELECT doc_id AS news_id, source, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS published_at, {_list(TITLES)}[1 + doc_id % {len(TITLES)}] AS title,
  {_list([b for b, _ in BODIES])}[1 + (doc_id // 5) % {len(BODIES)}] || ' ' || {_list(NAMED)}[1 + (doc_id // 3) % {len(NAMED)}] AS body,
  coalesce(text, '') AS t FROM documents),
n1 AS (SELECT *, title || '. ' || body || chr(10) || t AS text, lower(title) AS lti, lower(body || chr(10) || t) AS lb, lower(title || '. ' || body || chr(10) || t) AS lt FROM n0),
{_polarity_sql},
n2 AS (SELECT *, {', '.join(map(_found_sql, INSTRUMENTS))},
  CASE {' '.join(f"WHEN {_any('lt', terms)} THEN '{k}'" for k, _, terms in EVENTS)} ELSE 'other' END AS kind, CAST(CASE {' '.join(f"WHEN {_any('lt', terms)} THEN {w}" for _, w, terms in EVENTS)} ELSE 0.35 END AS DOUBLE) AS base,
  coalesce(({_count(POSITIVE)} - {_count(NEGATIVE)}) / CAST(nullif({_count(POSITIVE)} + {_count(NEGATIVE)}, 0) AS DOUBLE), 0) AS lexical,
  CASE WHEN {_any('lt', FUTURE)} THEN 'future' WHEN {_any('lt', PAST)} THEN 'past' ELSE 'current' END AS tense, {_facts_sql} AS facts FROM n1 JOIN q2 USING (news_id)),
an AS (SELECT *, list_sort(list_filter([{', '.join(map(_kept_sql, INSTRUMENTS))}], lambda x: x.relevance IS NOT NULL)) AS m, CAST(coalesce(fp, lexical) AS DOUBLE) AS pol,
  CAST(CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_QUALITY.items())} ELSE {QUALITY} END AS DOUBLE) AS srcq, 0.5 + 0.25 * (news_id % 3) AS novelty,
  contains(title, '!!') OR contains(lti, 'review') AS title_noise, len(regexp_extract_all(text, '%')) >= 5 AS recap FROM n2),
ax AS (SELECT *, least(CAST(1.0 AS DOUBLE), base + CASE WHEN len(facts) > 0 THEN 0.05 ELSE 0 END + CASE WHEN abs(pol) >= 0.75 THEN 0.05 ELSE 0 END) AS materiality, least(len(facts) / CAST(3 AS DOUBLE), 1) AS coverage,
  len(m) > 0 AND m[1].relevance >= 0.9 AS named, title_noise OR recap AS noise FROM an)
"""


def news(spark, d) -> DataFrame:
    """news_id, source, published_at, title, body, lead (the generated phrase) and text."""
    docs = table(spark, d, "documents")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    n = F.col("doc_id")
    body = F.concat(pick([b for b, _ in BODIES], F.floor(n / 5)), F.lit(" "), pick(NAMED, F.floor(n / 3)))
    out = docs.select(n.alias("news_id"), "source", (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(hours=n.cast("int"))).alias("published_at"), pick(TITLES, n).alias("title"), body.alias("lead"), F.coalesce("text", F.lit("")).alias("t"))
    out = out.withColumn("body", F.concat("lead", F.lit("\n"), "t"))
    return out.select("news_id", "source", "published_at", "title", "lead", "body", F.concat("title", F.lit(". "), "body").alias("text"))


def analysed(spark, d, names: bool = True) -> DataFrame:
    """News with all that the rules say of them; with names, also the instruments that they name (m).

    Names come out of a generator of one row, which Spark doesn't inline, so that they are looked for once a text.
    """
    x = news(spark, d)
    if names:
        x = x.select("*", F.explode(F.array(mentions(F.col("title"), F.col("body"), INSTRUMENTS))).alias("m"))
    lower = F.lower("text")
    kind, base = first_rule(lower, EVENTS)
    quality = F.lit(QUALITY)
    for source, q in SOURCE_QUALITY.items():
        quality = F.when(F.col("source") == source, q).otherwise(quality)
    x = x.select(
        "*", kind.alias("kind"), base.alias("base"), term_polarity(lower, POSITIVE, NEGATIVE).alias("lexical"),
        clause_polarity(F.col("text")).alias("fp"), tense(lower, FUTURE, PAST).alias("tense"), facts(F.col("text")).alias("facts"), quality.alias("srcq"),
        (0.5 + 0.25 * (F.col("news_id") % 3)).alias("novelty"), (F.col("title").contains("!!") | F.lower("title").contains("review")).alias("title_noise"), (F.regexp_count("text", F.lit("%")) >= 5).alias("recap"),
    ).withColumn("pol", F.coalesce("fp", "lexical"))
    extra = lambda c: F.when(c, 0.05).otherwise(0.0)
    materiality = F.least(F.lit(1.0), F.col("base") + extra(F.size("facts") > 0) + extra(F.abs("pol") >= 0.75))
    x = x.withColumns({"materiality": materiality, "coverage": F.least(F.size("facts") / F.lit(3.0), F.lit(1.0)), "noise": F.col("title_noise") | F.col("recap")})
    return x.withColumn("named", (F.size("m") > 0) & (F.coalesce(F.get("m", F.lit(0))["relevance"], F.lit(0.0)) >= 0.9)) if names else x


@query("event_type", SQL + "SELECT news_id, kind, base FROM an", base=False)
def event_type(spark, d):
    """The first of ten ordered rules, with its base materiality."""
    return analysed(spark, d, names=False).select("news_id", "kind", "base")


@query("lexical_polarity", SQL + "SELECT news_id, round(lexical, 6) AS polarity FROM an", base=False)
def lexical_polarity(spark, d):
    """X8."""
    return analysed(spark, d, names=False).select("news_id", F.round("lexical", 6).alias("polarity"))


@query("financial_polarity", SQL + "SELECT news_id, CAST(fp AS DOUBLE) AS polarity FROM an", base=False)
def financial_polarity(spark, d):
    """What clauses say of metrics, over whole texts."""
    return analysed(spark, d, names=False).select("news_id", F.col("fp").alias("polarity"))


@query("temporal_status", SQL + "SELECT news_id, tense FROM an", base=False)
def temporal_status(spark, d):
    """X11."""
    return analysed(spark, d, names=False).select("news_id", "tense")


@query("extract_facts", SQL + "SELECT news_id, f.kind, f.value, f.quote FROM (SELECT news_id, unnest(facts) AS f FROM an)", base=False)
def extract_facts(spark, d):
    """Percentages and money with their sentence, 20 at most (the rule's own bound)."""
    return analysed(spark, d, names=False).select("news_id", F.explode("facts").alias("f")).select("news_id", "f.kind", "f.value", "f.quote")


@query("instrument_mentions", SQL + "SELECT news_id, x.ticker AS instrument, x.relevance FROM (SELECT news_id, unnest(m) AS x FROM an)", base=False)
def instrument_mentions(spark, d):
    """Names in their cases, by title, hint and body; children before parents."""
    return analysed(spark, d).select("news_id", F.explode("m").alias("x")).select("news_id", F.col("x.ticker").alias("instrument"), "x.relevance")


@query("canonical_tokens", SQL + f"SELECT news_id, array_to_string(list_sort(list_distinct(list_transform({TOKENS.format(x='text')}, lambda t: CASE {' '.join(f'WHEN starts_with(t, {chr(39)}{a}{chr(39)}) THEN {chr(39)}{b}{chr(39)}' for a, b in PREFIXES)} ELSE t END))), ' ') AS tokens FROM an", base=False)
def canonical_tokens(spark, d):
    """The tokens of title and text under the names of the first prefix rule that holds."""
    named = F.array_sort(F.array_distinct(F.transform(tokens(F.col("text")), lambda t: canonical(t, PREFIXES))))
    return news(spark, d).select("news_id", F.array_join(named, " ").alias("tokens"))


_last = r"regexp_extract(title, '^(.*[^ ]) +[—–-] +([^ ].*?) *$', {})"


@query("split_publisher", SQL + f"""SELECT news_id, CASE WHEN k THEN {_last.format(1)} ELSE title END AS headline, CASE WHEN k THEN p END AS publisher FROM (SELECT *, p <> '' AND (regexp_matches(lower(p), '^(?:[a-z0-9-]+[.])+[a-z]+(?:/.*)?$')
OR trim(regexp_replace(lower(p), '[^a-zа-яё0-9]+', ' ', 'g')) IN ('{"', '".join(PUBLISHERS)}')) AS k FROM (SELECT *, {_last.format(2)} AS p FROM an))""", base=False)
def split_publisher(spark, d):
    """A suffix is a publisher only if it is a domain or a known name."""
    headline, publisher = headline_and_publisher(F.col("title"), PUBLISHERS)
    return news(spark, d).select("news_id", headline.alias("headline"), publisher.alias("publisher"))


@query("news_features", SQL + "SELECT news_id, kind, tense, len(facts) AS n_facts, round(pol, 6) AS polarity, round(materiality, 6) AS materiality FROM ax", base=False)
def news_features(spark, d):
    """Type, tense, facts, polarity (of clauses, else of terms) and materiality."""
    return analysed(spark, d, names=False).select("news_id", "kind", "tense", F.size("facts").cast("long").alias("n_facts"), F.round("pol", 6).alias("polarity"), F.round("materiality", 6).alias("materiality"))


WEIGHTS = {"semantic_effect": 0.55, "event_materiality": 0.20, "event_novelty": 0.10, "source_quality": 0.10, "fact_coverage": 0.05}
_parts = {"semantic_effect": "eff", "event_materiality": "sgn * materiality", "event_novelty": "sgn * novelty", "source_quality": "sgn * srcq", "fact_coverage": "sgn * coverage"}
SCORED = SQL + f""", tg AS (SELECT ax.*, unnest(m) AS x FROM ax), sc AS (SELECT tg.*, x.ticker AS ticker, x.relevance AS relevance, CASE WHEN kind <> 'other' AND materiality >= 0.5 AND abs(pol) >= 0.15 THEN pol ELSE 0 END AS eff FROM tg),
sg AS (SELECT *, CAST(sign(eff) AS DOUBLE) AS sgn FROM sc), fa AS (SELECT *, {', '.join(f'{w} * ({_parts[k]}) * relevance * 0.55 AS f_{k}' for k, w in WEIGHTS.items())} FROM sg),
sx AS (SELECT *, round(greatest(-100, least(100, ({' + '.join(f'f_{k}' for k in WEIGHTS)}) * 100)), 1) AS score, least(CAST(0.95 AS DOUBLE), 0.10 + 0.30 * relevance + 0.20 * materiality + 0.15 * srcq + 0.10 * novelty + 0.10 * coverage + 0.05 * abs(pol)) AS conf FROM fa),
sd AS (SELECT *, CASE WHEN score >= 18 THEN 'up' WHEN score <= -30 AND conf >= 0.8 THEN 'down' ELSE 'neutral' END AS direction FROM sx)"""


def scored_news(spark, d) -> DataFrame:
    """A row for each news and instrument, with its factors, score, confidence and direction."""
    x = analysed(spark, d).withColumn("x", F.explode("m")).withColumns({"ticker": F.col("x.ticker"), "relevance": F.col("x.relevance")})
    x = x.withColumn("eff", F.when((F.col("kind") != "other") & (F.col("materiality") >= 0.5) & (F.abs("pol") >= 0.15), F.col("pol")).otherwise(0.0)).withColumn("sgn", F.signum("eff"))
    x = x.withColumns({f"f_{k}": w * F.expr(_parts[k]) * F.col("relevance") * 0.55 for k, w in WEIGHTS.items()})
    total = sum((F.col(f"f_{k}") for k in list(WEIGHTS)[1:]), F.col(f"f_{next(iter(WEIGHTS))}"))
    conf = 0.10 + 0.30 * F.col("relevance") + 0.20 * F.col("materiality") + 0.15 * F.col("srcq") + 0.10 * F.col("novelty") + 0.10 * F.col("coverage") + 0.05 * F.abs("pol")
    x = x.withColumns({"score": F.round(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), total * 100)), 1), "conf": F.least(F.lit(0.95), conf)})
    return x.withColumn("direction", F.when(F.col("score") >= 18, "up").when((F.col("score") <= -30) & (F.col("conf") >= 0.8), "down").otherwise("neutral"))


@query("score_signals", SCORED + " SELECT news_id, ticker, score, round(conf, 4) AS confidence, direction FROM sd", base=False)
def score_signals(spark, d):
    """Five weighted factors times relevance; capped confidence; thresholds of direction."""
    return scored_news(spark, d).select("news_id", "ticker", "score", F.round("conf", 4).alias("confidence"), "direction")


@query("factor_changes", SCORED + f""", lg AS (SELECT news_id, ticker, {', '.join(f'f_{k}, lag(f_{k}) OVER w AS p_{k}' for k in WEIGHTS)}, lag(news_id) OVER w AS prev FROM sd WINDOW w AS (PARTITION BY ticker ORDER BY published_at, news_id))
{' UNION ALL '.join(f"SELECT news_id, ticker, '{k}' AS code, round(f_{k}, 4) AS now, round(p_{k}, 4) AS before FROM lg WHERE prev IS NOT NULL AND coalesce(round(f_{k}, 4) <> round(p_{k}, 4), false)" for k in WEIGHTS)}""", base=False)
def factor_changes(spark, d):
    """The factor maps of a ticker's consecutive signals, zipped; codes whose contribution moved."""
    own = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.round(f"f_{k}", 4)) for k in WEIGHTS]))
    x = scored_news(spark, d).select("news_id", "ticker", "published_at", own.alias("f"))
    x = x.withColumn("p", F.lag("f").over(Window.partitionBy("ticker").orderBy("published_at", "news_id"))).where("p IS NOT NULL")
    both = F.map_zip_with("f", "p", lambda k, a, b: F.struct(a.alias("now"), b.alias("before")))
    return x.select("news_id", "ticker", F.explode(both).alias("code", "v")).select("news_id", "ticker", "code", "v.now", "v.before").where("now <> before")


@query("exclusion_reason", SQL + f"SELECT news_id, CASE WHEN source = '{CONTEXT_ONLY}' THEN 'context_only' WHEN len(m) >= 2 AND title_noise THEN 'roundup' WHEN recap AND NOT named THEN 'price_recap' END AS reason FROM ax", base=False)
def exclusion_reason(spark, d):
    """context-only source, then roundup of several companies, then a recap that names none in its title."""
    reason = F.when(F.col("source") == CONTEXT_ONLY, "context_only").when((F.size("m") >= 2) & F.col("title_noise"), "roundup").when(F.col("recap") & ~F.col("named"), "price_recap")
    return analysed(spark, d).select("news_id", reason.alias("reason"))


@query("noise_filter", SQL + "SELECT news_id, title_noise, recap, noise FROM ax", base=False)
def noise_filter(spark, d):
    """F8: marks in the title, and bodies that are lists of percentages."""
    return analysed(spark, d, names=False).select("news_id", "title_noise", "recap", "noise")


_gates = "len(m) > 0 AS company, kind <> 'other' AS event, abs(pol) >= 0.15 AS semantic"
GATED = SQL + f", gt AS (SELECT *, {_gates} FROM ax), gx AS (SELECT *, named AND event AND NOT noise AS signal, (company OR event) AND semantic AND NOT noise AS routed FROM gt)"


def gated(spark, d) -> DataFrame:
    g = analysed(spark, d).withColumns({"company": F.size("m") > 0, "event": F.col("kind") != "other", "semantic": F.abs("pol") >= 0.15})
    return g.withColumns({"signal": F.col("named") & F.col("event") & ~F.col("noise"), "routed": (F.col("company") | F.col("event")) & F.col("semantic") & ~F.col("noise")})


@query("candidate_gates", GATED + " SELECT news_id, company, event, semantic, signal, routed FROM gx", base=False)
def candidate_gates(spark, d):
    """gates composed of one another."""
    return gated(spark, d).select("news_id", "company", "event", "semantic", "signal", "routed")


@query("source_gates", GATED + " SELECT news_id, CASE source WHEN 'src1' THEN company WHEN 'src2' THEN event AND NOT noise WHEN 'src3' THEN contains(lti, 'newswire') OR contains(lti, 'regulator') ELSE true END AS passes FROM gx", base=False)
def source_gates(spark, d):
    """a predicate of its own for some feeds: named companies, events, trusted publishers or authorities."""
    s, lower = F.col("source"), F.lower("title")
    passes = F.when(s == "src1", F.col("company")).when(s == "src2", F.col("event") & ~F.col("noise")).when(s == "src3", lower.contains("newswire") | lower.contains("regulator")).otherwise(True)
    return gated(spark, d).select("news_id", passes.alias("passes"))


@query("candidate_priority", GATED + " SELECT news_id, CASE WHEN signal AND base >= 0.85 THEN 3 WHEN signal THEN 2 WHEN company OR event THEN 1 ELSE 0 END AS priority FROM gx", base=False)
def candidate_priority(spark, d):
    """0 to 3."""
    p = F.when(F.col("signal") & (F.col("base") >= 0.85), 3).when(F.col("signal"), 2).when(F.col("company") | F.col("event"), 1).otherwise(0)
    return gated(spark, d).select("news_id", p.alias("priority"))


_sectors = "list_filter([" + ", ".join(f"CASE WHEN {_any('lti', terms)} THEN '{s}' END" for s, terms in SECTORS.items()) + "], lambda x: x IS NOT NULL)"
SCOPED = SQL + f", sp AS (SELECT *, {_sectors} AS sectors FROM ax), so AS (SELECT *, CASE WHEN named THEN 'company' WHEN {_any('lti', ('halt', 'regulator'))} THEN 'priority_market' WHEN len(sectors) > 0 THEN 'sector' ELSE 'market' END AS scope FROM sp)"


def scoped(spark, d) -> DataFrame:
    lower = F.lower("title")
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: lower.contains(t))
    sectors = F.array_compact(F.array(*[F.when(has(terms), s) for s, terms in SECTORS.items()]))
    x = analysed(spark, d).withColumn("sectors", sectors)
    return x.withColumn("scope", F.when(F.col("named"), "company").when(has(("halt", "regulator")), "priority_market").when(F.size("sectors") > 0, "sector").otherwise("market"))


@query("event_scope", SCOPED + " SELECT news_id, scope, array_to_string(list_transform(m, lambda x: x.ticker), ',') AS tickers, array_to_string(sectors, ',') AS sectors FROM so", base=False)
def event_scope(spark, d):
    """company before priority market before sector before market, with tickers and sectors."""
    return scoped(spark, d).select("news_id", "scope", F.array_join(F.transform("m", lambda x: x["ticker"]), ",").alias("tickers"), F.array_join("sectors", ",").alias("sectors"))


_targets = "CASE scope WHEN 'priority_market' THEN ['index_all'] WHEN 'company' THEN [] ELSE list_transform(sectors, lambda s: 'index_' || s) END"


@query("context_targets", SCOPED + f" SELECT news_id, unnest({_targets}) AS target FROM so", base=False)
def context_targets(spark, d):
    """what a context signal is about: the whole market, or each sector named."""
    targets = F.when(F.col("scope") == "priority_market", F.array(F.lit("index_all"))).when(F.col("scope") != "company", F.transform("sectors", lambda s: F.concat(F.lit("index_"), s)))
    return scoped(spark, d).select("news_id", F.explode(targets).alias("target"))


@query("process_documents", SCORED + f""", own AS (SELECT news_id, source, published_at, ticker, score, direction FROM sd WHERE relevance >= 0.9 AND source <> '{CONTEXT_ONLY}'),
sp AS (SELECT *, {_sectors} AS sectors FROM ax WHERE NOT named AND source <> '{CONTEXT_ONLY}'), ctx AS (SELECT news_id, source, published_at, 'index_' || unnest(sectors) AS ticker, CAST(0.0 AS DOUBLE) AS score, 'neutral' AS direction FROM sp),
al AS (SELECT * FROM own WHERE direction <> 'neutral' OR source = '{RETAINS_NEUTRAL}' UNION ALL SELECT * FROM ctx)
SELECT news_id, ticker, direction, score, substr(sha256(news_id || '|' || ticker || '|m1'), 1, 16) AS signal_id, epoch_us(published_at + INTERVAL 3 DAY) AS expires_us FROM al""", base=False)
def process_documents(spark, d):
    """Signals of instruments named in the title; else a neutral context signal by sector; neutral ones stay for some sources only."""
    own = scored_news(spark, d).where(f"relevance >= 0.9 AND source <> '{CONTEXT_ONLY}' AND (direction <> 'neutral' OR source = '{RETAINS_NEUTRAL}')").select("news_id", "published_at", "ticker", "score", "direction")
    context = scoped(spark, d).where(f"NOT named AND source <> '{CONTEXT_ONLY}'").select("news_id", "published_at", F.explode("sectors").alias("s"))
    both = own.unionByName(context.select("news_id", "published_at", F.concat(F.lit("index_"), "s").alias("ticker"), F.lit(0.0).alias("score"), F.lit("neutral").alias("direction")))
    name = F.substring(F.sha2(F.concat_ws("|", F.col("news_id").cast("string"), "ticker", F.lit("m1")), 256), 1, 16)
    return both.select("news_id", "ticker", "direction", "score", name.alias("signal_id"), F.unix_micros((F.col("published_at") + F.expr("INTERVAL '3' DAY")).cast("timestamp")).alias("expires_us"))
