"""URL filter: domain and path rules first, then a weighted vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "page_id long, host string, path string, rule string, verdict string, strict int, soft int, weight int"
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Vocabulary:
    """Terms to look for. A strict term rejects alone; soft terms reject when ``distinct`` of them or more weigh ``limit``."""

    strict: Sequence[str]
    soft: Sequence[tuple[str, int]]
    limit: int = 3
    distinct: int = 2

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in [*((t, 0) for t in self.strict), *self.soft]:
            found.add_word(term, (term, weight))
        found.make_automaton()
        return found


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Terms of each category by weight, in English, German, Spanish and French; weight 0 marks strict terms. Words that are
# also plain topics, or lure to anything, weigh 1, so that two of them do not reject.
CATEGORIES: dict[str, dict[int, str]] = {
    "gambling": {
        0: "casino casinos kasino kasinos machines-a-sous paris-sportifs spielbank sportsbook sportsbooks sportsbetting sportwetten tragamonedas"
        " tragaperras",
        2: "apuesta apuestas baccarat bet bets betting bettor bettors bingo blackjack bookie bookies bookmaker bookmakers gamble gambler"
        " gamblers gambling gluecksspiel gluecksspiele jackpot jackpots loteria loterie lotterie lotteries lottery lotto poker roulette"
        " ruleta slots spielautomaten tipster tipsters wager wagering wagers wette wetten",
        1: "gagner gewinnen odds paris quoten spin spins slot stakes win winner winners winning wins",
    },
    "adult": {
        0: "adults-only camgirl camgirls hentai milf milfs nsfw porn porno pornos pornstar pornstars sexcam sexcams x-rated xrated xvideos xxx",
        2: "cams dating erotic erotica erotico erotik erotique escort escorts fetisch fetish fetishes hardcore hookup hookups nackt nude"
        " nudes pornography sex sexe sexo sexy",
        1: "adult adulte adultes adulto adultos adults desnudo erwachsene naked nue rated seitensprung singles webcam webcams",
    },
    "ads and tracking": {
        0: "adclick adclicks adserver adservers adserving adtrack adtracker adtracking clicktrack clicktracker clicktracking doubleclick"
        " popunder popunders",
        2: "ads advert advertisement advertisements advertiser advertisers advertising adverts affiliate affiliates anuncios popup popups"
        " publicidad publicite retargeting sponsored tracker trackers tracking werbung",
        1: "ad banner banners beacon beacons impressions pixel pixels promo promos telemetry track tracked tracks",
    },
    "pharmacy": {
        0: "cialis levitra no-prescription ohne-rezept rezeptfrei sans-ordonnance sin-receta viagra without-prescription",
        2: "meds pastillas pill pillen pills pilules potenzmittel rx tramadol xanax",
        1: "apotheke drug drugs drugstore farmacia generics medikamente pharma pharmacie pharmacies pharmacy prescription prescriptions",
    },
    "spam": {
        0: "keygen keygens phish phishing warez",
        2: "abnehmen backlink backlinks clickbait payday replica replicas scam scams spam spammer spammers spamming",
        1: "barato billig bonus bonuses cash cheap cheapest click clicks coupon coupons credito discount discounts free giveaway giveaways"
        " gratis gratuit kostenlos kredit kredite loan loans prize prizes rabatt",
    },
}
VOCABULARY = Vocabulary(
    strict=tuple(term for weights in CATEGORIES.values() for term in weights.get(0, "").split()),
    soft=tuple((t, w) for weights in CATEGORIES.values() for w, terms in weights.items() if w for t in terms.split()),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, lower-cased in A-Z, and path; both empty for null and for text without ``://``."""
    found = URL.search(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


class Judge:
    def __init__(self, rules: Sequence[Rule], vocabulary: Vocabulary):
        self.rules: dict[str, list[Rule]] = {}
        for rule in rules:
            self.rules.setdefault(rule.host, []).append(rule)
        self.automaton, self.limit, self.distinct = vocabulary.automaton(), vocabulary.limit, vocabulary.distinct

    def rule(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of two as long, the one with the longer host."""
        best, tail = None, host
        while True:
            for rule in self.rules.get(tail, []):
                if path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
                    best = rule
            _, dot, tail = tail.partition(".")
            if not dot:
                return best

    def hits(self, url: str | None) -> tuple[int, int, int]:
        """Distinct strict and soft terms that stand between boundaries, and the weight of the soft ones."""
        text, seen = (url or "").translate(LOWER), {}
        for end, (term, weight) in self.automaton.iter(text):
            start = end - len(term) + 1
            if text[start - 1 : start] not in INNER and text[end + 1 : end + 2] not in INNER:
                seen[term] = weight
        soft = [w for w in seen.values() if w]
        return len(seen) - len(soft), len(soft), sum(soft)

    def row(self, url: str | None) -> tuple[str, str, str | None, str, int, int, int]:
        host, path = split_url(url)
        rule = self.rule(host, path)
        strict, soft, weight = self.hits(url)
        own = "block" if strict or (soft >= self.distinct and weight >= self.limit) else "allow"
        return host, path, rule.name if rule else None, rule.verdict if rule else own, strict, soft, weight


def judged(pages: DataFrame, rules: Sequence[Rule], vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """One row per page. Terms are looked for in the whole URL, with A-Z lower-cased; a boundary is
    any character but a-z and 0-9, or an end. A null or empty URL has empty host and path, meets no
    term and is allowed unless a rule for the empty host exists; repeated rows are judged alike;
    further columns are not read; an empty table gives no rows.
    """
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Judge(rules, vocabulary)
        kinds = [pa.string()] * 4 + [pa.int32()] * 3
        for batch in batches:
            rows = [held.row(url) for url in batch.column("url").to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *columns],
                names=["page_id", "host", "path", "rule", "verdict", "strict", "soft", "weight"],
            )

    return read.mapInArrow(judge, RESULT)


def sql(rules: Sequence[Rule], vocabulary: Vocabulary = VOCABULARY) -> str:
    """The same for DuckDB, with one regular expression per term."""
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def hit(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){re.escape(term)}($|[^a-z0-9])')::INT"

    strict = " + ".join(map(hit, vocabulary.strict)) or "0"
    soft = " + ".join(hit(t) for t, _ in vocabulary.soft) or "0"
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in vocabulary.soft) or "0"
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))

    def arm(rule: Rule, value: str) -> str:
        return f"WHEN (host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}') THEN '{value}'"

    named = f"CASE {' '.join(arm(r, r.name) for r in ordered)} END" if rules else "NULL::VARCHAR"
    verdict = f"CASE {' '.join(arm(r, r.verdict) for r in ordered)} ELSE own END" if rules else "own"
    return f"""
        WITH a AS (SELECT page_id, {low} AS low, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
        b AS (SELECT page_id, low, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
        c AS (SELECT page_id, low, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
        d AS (SELECT page_id, host, path, ({strict})::INT AS strict, ({soft})::INT AS soft, ({weight})::INT AS weight FROM c),
        e AS (SELECT *, CASE WHEN strict > 0 OR (soft >= {vocabulary.distinct} AND weight >= {vocabulary.limit}) THEN 'block' ELSE 'allow' END AS own FROM d)
        SELECT page_id, host, path, {named} AS rule, {verdict} AS verdict, strict, soft, weight FROM e"""
