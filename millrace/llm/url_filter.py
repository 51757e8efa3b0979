"""URL filtering: host and path rules first, then a weighted vocabulary found by one automaton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import ship

#: (verdict, host, path). A rule fits its host and all subdomains of it, if the url's path starts with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A url is rejected when the weights of the different terms in it add up to this.
REJECT = 100
#: The vocabulary of the query: strict terms, which reject a url alone, and soft ones, of which two or, of the weakest, three different ones must be found.
STRICT = "porn porno pornstar xxx hentai camgirl camgirls escort escorts milf fetish bdsm warez keygen phishing malware ransomware botnet stalkerware cardersite hitman onlyfansleak".split()
SOFT = "adult casino casinos gambling betting bet bets poker roulette jackpot slots lottery dating hookup sexy nude nudes erotic pills viagra cialis torrent torrents crack cracked serial payday loans spam clickbait steroids vape".split()
WEAK = "free win winner bonus cheap discount deal click hot girls singles credit crypto airdrop leaked mirror proxy unblocked".split()
WEIGHTS = dict.fromkeys(STRICT, 100) | dict.fromkeys(SOFT, 50) | dict.fromkeys(WEAK, 34)
#: Terms of a vocabulary at most; it is sent to every task.
MOST_TERMS = 200_000


def read_weights(table: DataFrame) -> dict[str, int]:
    """A vocabulary from a table (term, weight), of MOST_TERMS terms at most. Of a repeated term the greatest weight counts; empty terms and weights that
    aren't positive are left out."""
    rows = table.select(F.lower("term").alias("term"), F.col("weight").cast("int").alias("weight")).where("term <> '' and weight > 0").groupBy("term").agg(F.max("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms")
    return dict(map(tuple, rows))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path of a url; both empty without ``://``."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    rest = rest[2]
    ends = [i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0]
    at = min(ends, default=len(rest))
    ends = [i for i in (rest.find("?", at), rest.find("#", at)) if i >= 0]
    host = rest[:at].encode().lower().decode()
    return host, rest[at : min(ends, default=len(rest))]


def best_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest fitting rule (host and path together) and its verdict. Walks the host's suffixes, not the rules."""
    best, verdict, at = None, None, 0
    while at >= 0:
        suffix = host[at:]
        for start, says in by_host.get(suffix, ()):
            if path.startswith(start) and (best is None or len(suffix) + len(start) > len(best)):
                best, verdict = suffix + start, says
        at = host.find(".", at) + 1 or -1
    return best, verdict


class UrlVocabulary:
    """Finds whole terms: a hit needs no ASCII letter or digit right before and after it."""

    def __init__(self, weights: Mapping[str, int]):
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term.lower(), (term.lower(), weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str) -> dict[str, int]:
        """The different terms in the url and their weights."""
        found: dict[str, int] = {}
        if not len(self.automaton):
            return found
        low = url.lower() if url.isascii() else "".join(c.lower() if c.isascii() else c for c in url)
        for end, (term, weight) in self.automaton.iter(low):
            start = end - len(term) + 1
            before, after = low[start - 1 : start] if start else "", low[end + 1 : end + 2]
            if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
                found[term] = weight
        return found


def filter_urls(pages: DataFrame, rules=RULES, weights: Mapping[str, int] = WEIGHTS, reject: int = REJECT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, weight) of every page.

    A rule decides where one fits; else the url is blocked if the weights of its different terms add up to ``reject``: on one strict
    term, which weighs as much alone, or several soft ones. Of rules of equal length the first counts. Only id and url are read, so other columns' names don't
    clash. A null or empty url has empty host and path, no rule and verdict allow. Repeated rows are judged each; an empty table gives no rows.
    """
    ship(pages.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, by_host = UrlVocabulary(weights), {}
        for says, host, path in rules:
            by_host.setdefault(host, []).append((path, says))
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = best_rule(host, path, by_host)
                found = words.hits(url or "").values()
                strict, weight = sum(w >= reject for w in found), sum(found)
                out.append((host, path, rule, verdict or ("block" if weight >= reject else "allow"), strict, len(found) - strict, weight))
            columns = [list(c) for c in zip(*out)] or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()] * 3))], names=[id_col, "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(id_col, url_col).mapInArrow(judge, f"{id_col} {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long, weight long")


#: The same in DuckDB SQL, for op9's rules and terms.
ORACLE = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS sep FROM pages),
h AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h),
terms(term, w) AS (VALUES {", ".join(str(x) for x in WEIGHTS.items())}),
hits AS (SELECT DISTINCT low, term, w FROM (SELECT low, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS word FROM p) JOIN terms ON word = term),
c AS (SELECT low, count(*) FILTER (w >= {REJECT}) AS n_strict, count(*) FILTER (w < {REJECT}) AS n_soft, CAST(sum(w) AS BIGINT) AS weight FROM hits GROUP BY low),
v AS (SELECT p.*, coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(weight, 0) AS weight FROM p LEFT JOIN c ON p.low = c.low),
rules(says, rhost, rpath) AS (VALUES {", ".join(str(r) for r in RULES)}),
m AS (SELECT page_id, host, path, low, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(says, length(rhost || rpath)) AS says
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT v.page_id, v.host, v.path, m.rule, coalesce(m.says, CASE WHEN weight >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft, weight
FROM v LEFT JOIN (SELECT DISTINCT * FROM m) m ON v.page_id IS NOT DISTINCT FROM m.page_id AND v.low = m.low
"""
