"""URL filters: a weighted vocabulary matched by an Aho-Corasick automaton, and host rules.

One pass of the automaton over a url (A-Z lower-cased) finds all terms; a hit
counts only between boundaries (no ASCII letter or digit beside it).  A url is
blocked on one strict term or on ``min_soft`` distinct soft terms.  An explicit
rule (host and path prefix) overrides the vocabulary; the longest rule wins.

Vocabulary and rules are parameters of bounded size that travel with the plan:
there is no shuffle and no broadcast of data.

Nulls and odd rows: a null url, or one without ``://``, has an empty host and
path; a null url matches no term; repeated rows are judged one by one.
"""

from __future__ import annotations

import functools

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common as C

# The default vocabulary.
STRICT = ("camgirls", "escorts", "hentai", "keygen", "malware", "phishing", "porn", "porno", "spam", "warez", "xvideos", "xxx")
SOFT = ("ads", "adult", "bet", "bets", "bonus", "casino", "click", "crack", "farm", "free", "jackpot", "loans", "lottery", "nude", "pills", "poker", "sex", "torrent", "track", "tracker", "viagra", "win")
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII = str.maketrans(_UPPER, _LOWER)
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@functools.lru_cache(maxsize=8)  # a worker builds it once, not for each batch
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def hits(found: ahocorasick.Automaton, url: str | None) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms between boundaries."""
    out: dict[str, set[str]] = {"strict": set(), "soft": set()}
    text = (url or "").translate(_ASCII)
    for end, (kind, term) in found.iter(text) if text else ():
        start = end - len(term) + 1
        if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            out[kind].add(term)
    return out["strict"], out["soft"]


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, min_soft: int = 2, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``id, host, path, rule, verdict, n_strict, n_soft`` of every row."""
    C.importable(pages)

    @F.pandas_udf("n_strict int, n_soft int")
    def count(urls: pd.Series) -> pd.DataFrame:
        found = automaton(strict, soft)
        return pd.DataFrame([tuple(map(len, hits(found, u))) for u in urls], columns=["n_strict", "n_soft"])

    # the part after the first "://"
    after = F.when(F.instr("_url", "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.translate(F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    df = pages.select(F.col(id_col), F.col(url_col).alias("_url")).withColumns({"host": host, "path": path, "_n": count("_url")})
    chosen = [F.lit(None).cast("string")]
    for _, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        chosen.append(F.when(fits, F.lit(f"{h}{p}")))
    rule = F.coalesce(*reversed(chosen))
    verdict = F.when((F.col("_n.n_strict") > 0) | (F.col("_n.n_soft") >= min_soft), "block").otherwise("allow")
    for action, h, p in rules:
        verdict = F.when(F.col("rule") == f"{h}{p}", action).otherwise(verdict)
    return df.withColumn("rule", rule).select(id_col, "host", "path", "rule", verdict.alias("verdict"), "_n.n_strict", "_n.n_soft")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(C.read(spark, sf_dir, "pages"))


def _oracle() -> str:
    low = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    n = lambda terms: " + ".join(f"(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)', 's'))::INT" for t in terms)
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -(len(r[1]) + len(r[2])))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in RULES) + " ELSE CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END END"
    return f"""
    WITH a AS (SELECT page_id, {low.format("coalesce(url, '')")} AS u,
                      CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
         b AS (SELECT page_id, u, {low.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
         c AS (SELECT page_id, host, path, {rule} AS rule, ({n(STRICT)})::INT AS n_strict, ({n(SOFT)})::INT AS n_soft FROM b)
    SELECT page_id, host, path, rule, {action} AS verdict, n_strict, n_soft FROM c"""


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES = {"op5_url_filter": _oracle()}
