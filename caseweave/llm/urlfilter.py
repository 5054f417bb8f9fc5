"""URL filter: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds every vocabulary term in the lower-cased URL in
one pass. A hit counts only between boundaries: the characters beside it are
not ASCII letters or digits. One strict term blocks; soft terms block together
once there are several distinct ones and their weights reach a limit. The
vocabulary is a parameter, and may be a table (term, strict, weight).

Defined cases: a null URL or one without ``://`` has an empty host and path and
so meets no rule; a null URL is allowed; repeated rows are judged alike; other
columns of the input are kept out of the way by the internal names ``uf_*``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.errors import ValidationError
from caseweave.functions.arrow import text_udf
from caseweave.llm.tables import named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER_SCHEME = "://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict on a host with its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules, and the vocabulary with its weights.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
STRICT = frozenset("""
casino warez xxx porn porno pornhub xvideos hentai camgirl camgirls escort escorts milf nsfw sexcam sexchat sextape malware phishing ransomware botnet
keylogger spyware trojan rootkit exploit-kit crackz keygen keygens nulled serialz torrent-crack spam-farm link-farm linkfarm doorway-page payday-loan
payday-loans viagra cialis levitra tramadol oxycontin steroids-shop replica-watches fake-id fake-passport carding cvv-shop darknet-market
hacked-accounts stresser booter ddos-for-hire slot-online slots-online togel sbobet poker88 judi
""".split())
SOFT = dict.fromkeys("""
ads advert affiliate banner bargain bet bets betting bingo bonus cheap cheapest clearance click clickbait coupon coupons credit deal deals discount
discounts earn forex free freebie gambling giveaway jackpot join loan loans lottery lucky offer offers popup prize promo promos redirect rewards sale
signup slots sponsor sponsored subscribe survey surveys tracker unlimited voucher vouchers win winner winners
""".split(), 1) | dict.fromkeys("""
adult bitcoin-doubler dating detox diet-pills erotic flirt hookup horoscope instant-cash lingerie miracle-cure multi-level nude nudes onlyfans
pharmacy pills poker pyramid seo-links sex sexy singles weight-loss work-from-home
""".split(), 2)
#: Weight of distinct soft terms from which a URL is blocked, and how many of them it takes at least.
SOFT_LIMIT, SOFT_LEAST = 3, 2
#: A vocabulary is data of a stated size: it goes to every task.
VOCABULARY_MOST = 1_000_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


def rule_fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def first_rule(rules, host: Column, path: Column, pick) -> Column:
    """``pick(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(rule_fits(rule, host, path), F.lit(pick(rule))).otherwise(out)
    return out


def vocabulary_of(table: DataFrame) -> tuple[frozenset[str], dict[str, int]]:
    """(strict terms, soft terms with their weights) of a table (term, strict, weight) of at most VOCABULARY_MOST rows.

    Terms are lower-cased. A term that is strict in any row is strict; of several
    weights of a soft one the largest counts; null or empty terms and soft ones
    without a positive weight are left out.
    """
    rows = table.select(F.lower("term").alias("term"), F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce(F.col("weight").cast("int"), F.lit(0)).alias("weight"))
    rows = rows.filter("term <> '' and (strict or weight > 0)").groupBy("term").agg(F.max("strict").alias("strict"), F.max("weight").alias("weight"))
    found = rows.limit(VOCABULARY_MOST + 1).collect()
    if len(found) > VOCABULARY_MOST:
        raise ValidationError(f"the vocabulary has more than {VOCABULARY_MOST} terms")
    return frozenset(r.term for r in found if r.strict), {r.term: r.weight for r in found if not r.strict}


def vocabulary_hits(url: Column, strict=STRICT, soft=SOFT) -> Column:
    """struct(strict, soft, weight): distinct strict terms, distinct soft terms, and the weight of these."""
    terms = dict.fromkeys(strict, -1) | {t: w for t, w in soft.items() if t not in strict}
    sent = SparkSession.active().sparkContext.broadcast(terms)
    made: list = []

    @text_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("strict", "soft", "weight")]))
    def hits(urls: pa.Array) -> pa.Array:
        import ahocorasick

        if not made:
            made.append(ahocorasick.Automaton())
            for term, weight in sent.value.items():
                made[0].add_word(term, (term, weight))
            made[0].make_automaton()
        plain = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        out: list[list[int]] = [[], [], []]
        for url in urls.cast(pa.binary()):
            text = (url.as_py() or b"").lower().decode("utf-8", "replace")
            found = {}
            for last, (term, weight) in made[0].iter(text) if sent.value else ():
                first = last - len(term)
                if (first < 0 or text[first] not in plain) and (last + 1 == len(text) or text[last + 1] not in plain):
                    found[term] = weight
            soft_weights = [w for w in found.values() if w > 0]
            for column, value in zip(out, (len(found) - len(soft_weights), len(soft_weights), sum(soft_weights)), strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in out], names=["strict", "soft", "weight"])

    return hits(url)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT, soft_least: int = SOFT_LEAST) -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight) for every row."""
    url = F.col("uf_url")
    host, path = F.col("host"), F.col("path")
    cut = pages.select(named(id_col).alias("uf_id"), named(url_col).alias("uf_url")).withColumns({"host": host_of(url), "path": path_of(url), "uf_hits": vocabulary_hits(url, strict, soft)})
    strict_hits, soft_hits, soft_weight = (F.col(f"uf_hits.{c}") for c in ("strict", "soft", "weight"))
    method = F.when((strict_hits > 0) | (soft_hits >= soft_least) & (soft_weight >= soft_limit), "block").otherwise("allow")
    return cut.select(
        F.col("uf_id").alias(id_col),
        "host",
        "path",
        first_rule(rules, host, path, lambda r: r.text).alias("rule"),
        F.coalesce(first_rule(rules, host, path, lambda r: r.verdict), method).alias("verdict"),
        strict_hits.alias("strict_hits"),
        soft_hits.alias("soft_hits"),
        soft_weight.alias("soft_weight"),
    )


def oracle_sql(table: str = "pages", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT, soft_least: int = SOFT_LEAST) -> str:
    """The same as SQL: a regular expression with the boundaries for each term."""
    values = ", ".join(f"('{t}', {w})" for t, w in (dict.fromkeys(sorted(strict), -1) | soft).items())
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(rules, key=lambda r: (-len(r.text), r.text))
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{pick(r)}'" for r in longest) + " END"
    return f"""
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '{AFTER_SCHEME}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{AFTER_SCHEME}', 2), '') AS path,
         translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low
  FROM {table}),
vocabulary(term, weight) AS (VALUES {values}),
found AS (
  SELECT low, CAST(count(*) FILTER (weight < 0) AS INTEGER) AS strict_hits, CAST(count(*) FILTER (weight > 0) AS INTEGER) AS soft_hits, CAST(coalesce(sum(weight) FILTER (weight > 0), 0) AS INTEGER) AS soft_weight
  FROM (SELECT DISTINCT low FROM cut) u JOIN vocabulary ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY low),
hits AS (SELECT cut.*, coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(soft_weight, 0) AS soft_weight FROM cut LEFT JOIN found USING (low))
SELECT page_id, host, path, {case(lambda r: r.text)} AS rule,
       coalesce({case(lambda r: r.verdict)}, CASE WHEN strict_hits > 0 OR soft_hits >= {soft_least} AND soft_weight >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits, soft_weight
FROM hits"""
