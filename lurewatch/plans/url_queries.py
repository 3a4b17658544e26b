"""URL extraction, canonical form, target classification and lexical score."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import urls as U
from lurewatch.plans.inputs import MESSAGES_SQL, PAGE_URLS_SQL, messages, page_urls, quote, with_
from lurewatch.plans.registry import query, table

SP, W = L.SPACE, L.WORD
_END = rf"{SP}<>\"')\]"
_RX = (
    rf"(?i)(?:^|[^{W}])((?:https?://|hxxps?://)(?:\[\.\]|[^{_END}])+"
    rf"|[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:(?:\.|\[\.\])[a-z0-9\-]+)+(?:/(?:\[\.\]|[^{_END}])*)?)"
)


def refang_sql(x: str) -> str:
    for a, b in [("[.]", "."), ("(.)", "."), ("[:]", ":"), ("[://]", "://"), ("hxxp", "http"), ("hXXp", "http")]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, {quote('[' + L.TRAILING_PUNCTUATION + ']+$')}, '')"


def scheme_sql(x: str) -> str:
    return f"CASE WHEN contains({x}, '://') THEN {x} ELSE 'http://' || {x} END"


def host_sql(x: str) -> str:
    return f"lower(regexp_extract(regexp_replace(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1))"


EXTRACT_SQL = f"""cand AS (SELECT message_id, unnest(c) AS c, generate_subscripts(c, 1) AS pos FROM
   (SELECT message_id, regexp_extract_all(text, {quote(_RX)}, 1) AS c FROM messages)),
trimmed AS (SELECT message_id, pos, {trim_sql('c')} AS u FROM cand),
hosted AS (SELECT message_id, pos, u, {host_sql('full_u')} AS host FROM (SELECT *, {scheme_sql('r')} AS full_u FROM (SELECT *, {refang_sql('u')} AS r FROM trimmed))),
plausible AS (SELECT message_id, u, min(pos) AS pos FROM hosted WHERE regexp_matches(host, '^[a-z0-9\\-.]+\\.[a-z]{{2,}}$') OR regexp_matches(host, {quote(U.IPV4)}) GROUP BY message_id, u),
ranked AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY pos) AS rn FROM plausible)"""


@query("fu1_o3_extract_urls", with_(MESSAGES_SQL, EXTRACT_SQL) + """
SELECT message_id, string_agg(u, ' ' ORDER BY rn) AS urls, count(*) AS n FROM ranked WHERE rn <= 25 GROUP BY message_id""")
def extract_urls(spark, sf):
    out = messages(spark, sf).select("message_id", U.extract_urls(F.col("text")).alias("u"))
    exploded = out.select("message_id", F.explode_outer("u").alias("x"), F.col("u")).filter("x IS NOT NULL")
    return exploded.groupBy("message_id").agg(F.array_join(F.first("u"), " ").alias("urls"), F.count("*").alias("n"))


def observe_sql(x: str) -> str:
    """CTE chain giving investigation_id, raw, normalized, host, was_defanged."""
    return f"""o1 AS (SELECT *, {trim_sql('trim(' + refang_sql('raw') + ')')} AS t, {refang_sql('raw')} <> raw AS was_defanged FROM {x}),
o2 AS (SELECT *, {scheme_sql('t')} AS f FROM o1),
o3 AS (SELECT *, lower(regexp_extract(f, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme, {host_sql('f')} AS h0,
  TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_extract(f, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':([0-9]+)$', 1), '') AS INT) AS port,
  regexp_extract(f, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(f, '^[^?#]*\\?([^#]*)', 1) AS q FROM o2),
observed AS (SELECT * EXCLUDE (t, f), scheme || '://' || h0 || CASE WHEN port IS NOT NULL AND port <> 0 AND NOT (scheme = 'http' AND port = 80) AND NOT (scheme = 'https' AND port = 443)
    THEN ':' || port::VARCHAR ELSE '' END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS normalized, h0 AS host FROM o3)"""


@query("fu2_refang", with_(PAGE_URLS_SQL) + f"SELECT investigation_id, {refang_sql('raw')} AS url, {refang_sql('raw')} <> raw AS was_defanged FROM page_urls")
def refang(spark, sf):
    return page_urls(spark, sf).select(
        "investigation_id", U.refang(F.col("raw")).alias("url"), (U.refang(F.col("raw")) != F.col("raw")).alias("was_defanged")
    )


@query("fu3_fu4_observe_urls", with_(PAGE_URLS_SQL, observe_sql("page_urls")) + "SELECT investigation_id, raw, normalized, host, was_defanged FROM observed")
def observe(spark, sf):
    return page_urls(spark, sf).select("investigation_id", U.observe(F.col("raw")).alias("o")).select("investigation_id", "o.*")


def _ip(n: int) -> str:
    return f"split_part(host, '.', {n})::BIGINT"


_NUM = f"(({_ip(1)} * 256 + {_ip(2)}) * 256 + {_ip(3)}) * 256 + {_ip(4)}"
_CIDR = {
    "loopback": ["127.0.0.0/8"], "link-local": ["169.254.0.0/16"], "multicast": ["224.0.0.0/4"], "reserved": ["0.0.0.0/32"],
    "private": ["0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15",
                "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"],
}


def _between(cidr: str) -> str:
    import ipaddress

    net = ipaddress.ip_network(cidr)
    return f"n BETWEEN {int(net.network_address)} AND {int(net.broadcast_address)}"


CATEGORY_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(_between(c) for c in nets)} THEN '{name}'" for name, nets in _CIDR.items()) + " END"


@query("fu5_classify_target", """WITH hosts AS (SELECT page_id, unnest([
   'http://' || (page_id % 256)::VARCHAR || '.' || (page_id * 7 % 256)::VARCHAR || '.2.9/x', 'https://127.0.0.' || (page_id % 256)::VARCHAR || ':8443/',
   'http://192.168.1.' || (page_id % 256)::VARCHAR, 'http://172.' || (page_id % 40)::VARCHAR || '.0.1/', 'ftp://files.example.com/', url, 'http://169.254.169.254/latest',
   'http://' || (200 + page_id % 56)::VARCHAR || '.1.1.1/', 'http://0.0.0.0/']) AS url FROM pages)""" + f""",
p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {host_sql('url')} AS host FROM hosts),
c AS (SELECT *, CASE WHEN regexp_matches(host, {quote(U.IPV4)}) THEN {_NUM} END AS n FROM p)
SELECT page_id, url, CASE WHEN scheme NOT IN ('http', 'https') THEN 'unsupported scheme ''' || scheme || '''' WHEN host = '' THEN 'no host'
  ELSE ({CATEGORY_SQL}) || ' address ' || host END AS reason FROM c""")
def classify_target(spark, sf):
    p = F.col("page_id")

    def octet(col):
        return col.cast("string")

    urls = F.array(
        F.concat(F.lit("http://"), octet(p % 256), F.lit("."), octet(p * 7 % 256), F.lit(".2.9/x")),
        F.concat(F.lit("https://127.0.0."), octet(p % 256), F.lit(":8443/")), F.concat(F.lit("http://192.168.1."), octet(p % 256)),
        F.concat(F.lit("http://172."), octet(p % 40), F.lit(".0.1/")), F.lit("ftp://files.example.com/"), F.col("url"),
        F.lit("http://169.254.169.254/latest"), F.concat(F.lit("http://"), octet(p % 56 + 200), F.lit(".1.1.1/")), F.lit("http://0.0.0.0/"),
    )
    u = table(spark, sf, "pages").select("page_id", F.explode(urls).alias("url"))
    return u.select("page_id", "url", U.block_reason(F.col("url")).alias("reason"))


_TLD_IN = ", ".join(quote(t) for t in L.RISKY_TLDS)
_SHORT_IN = ", ".join(quote(t) for t in L.SHORTENERS)
LEXICAL_SQL = f"""l1 AS (SELECT *, list_filter(string_split(lower(host), '.'), lambda x: x <> '') AS labels FROM observed),
l2 AS (SELECT *, coalesce(labels[len(labels)], '') AS tld, array_to_string(labels, '-') AS joined, CASE WHEN len(labels) > 2 THEN labels[1:len(labels) - 2] ELSE labels END AS head FROM l1),
l3 AS (SELECT *, list_filter({L.WATCHED_BRANDS}, lambda b: contains(joined, b) AND NOT list_contains(head, b))[1] AS brand FROM l2),
l4 AS (SELECT *, list_filter([CASE WHEN regexp_matches(host, {quote(U.IPV4)}) THEN 'ip_literal_host' END, CASE WHEN tld IN ({_TLD_IN}) THEN 'suspicious_tld:.' || tld END,
  CASE WHEN host IN ({_SHORT_IN}) THEN 'url_shortener' END, CASE WHEN len(labels) >= 4 THEN 'excessive_subdomains' END, CASE WHEN brand IS NOT NULL THEN 'brand_lookalike:' || brand END,
  CASE WHEN was_defanged THEN 'defanged_in_message' END], lambda x: x IS NOT NULL) AS reasons FROM l3),
scored AS (SELECT *, least(1.0, list_sum(list_append(list_transform(reasons, lambda r: CASE WHEN r = 'ip_literal_host' THEN 0.3 WHEN r LIKE 'suspicious_tld%' THEN 0.25
  WHEN r = 'url_shortener' THEN 0.15 WHEN r = 'excessive_subdomains' THEN 0.15 WHEN r LIKE 'brand%' THEN 0.35 ELSE 0.1 END), 0.0)))::DOUBLE AS score,
  CASE WHEN len(reasons) = 0 THEN 'no_lexical_flags' ELSE array_to_string(reasons, ', ') END AS label FROM l4)"""


def scored_urls(spark, sf):
    """URL observations with their lexical score, label and confidence."""
    o = page_urls(spark, sf).select("investigation_id", U.observe(F.col("raw")).alias("o")).select("investigation_id", "o.*")
    r = o.withColumn("reasons", U.lexical_reasons(F.col("host"), F.col("was_defanged")))
    return r.select(
        "investigation_id", "raw", "normalized", "host", "was_defanged", U.lexical_score(F.col("reasons")).alias("score"),
        U.lexical_label(F.col("reasons")).alias("label"), F.when(F.size("reasons") > 0, 1.0).otherwise(0.5).alias("confidence"),
    )


@query("fu6_lexical_url_score", with_(PAGE_URLS_SQL, observe_sql("page_urls"), LEXICAL_SQL) + """
SELECT investigation_id, host, round(score, 6) AS score, label, CASE WHEN len(reasons) > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM scored""")
def lexical_url_score(spark, sf):
    return scored_urls(spark, sf).select("investigation_id", "host", F.round("score", 6).alias("score"), "label", "confidence")


@query("a22_max_url_risk", with_(PAGE_URLS_SQL, observe_sql("page_urls"), LEXICAL_SQL) + """
SELECT 'user_' || (investigation_id % 97)::VARCHAR AS owner, round(coalesce(max(score), 0), 6) AS max_score FROM scored GROUP BY 1""")
def max_url_risk(spark, sf):
    s = scored_urls(spark, sf)
    owner = F.concat(F.lit("user_"), (F.col("investigation_id") % 97).cast("string")).alias("owner")
    return s.groupBy(owner).agg(F.round(F.coalesce(F.max("score"), F.lit(0.0)), 6).alias("max_score"))


FINDINGS_SQL = """findings AS (SELECT *, scheme NOT IN ('http', 'https') AS blocked FROM scored)"""


@query("p6_url_findings", with_(PAGE_URLS_SQL, observe_sql("page_urls"), LEXICAL_SQL, FINDINGS_SQL) + """
SELECT investigation_id, raw AS url, CASE WHEN blocked THEN 'suspicious' WHEN score = 0 THEN 'likely_safe' WHEN score >= 0.5 THEN 'suspicious' ELSE 'unknown' END AS verdict,
  CASE WHEN blocked THEN 'unsupported scheme ''' || scheme || '''' ELSE array_to_string(reasons, '|') END AS reasons,
  CASE WHEN blocked THEN 0.0 ELSE round(score, 3) END::DOUBLE AS confidence FROM findings""")
def url_findings(spark, sf):
    from lurewatch.operators.reports import url_finding

    s = scored_urls(spark, sf)
    reason = F.when(~U.scheme_of(F.col("normalized")).isin("http", "https"), U.block_reason(F.col("normalized")))
    f = s.select("investigation_id", url_finding(F.col("raw"), F.col("normalized"), reason, F.col("score"), F.col("label")).alias("f"))
    return f.select("investigation_id", "f.url", "f.verdict", F.array_join("f.reasons", "|").alias("reasons"), "f.confidence")


@query("p3_blocked_urls", with_(PAGE_URLS_SQL, observe_sql("page_urls"), f"b AS (SELECT *, CASE WHEN regexp_matches(host, {quote(U.IPV4)}) THEN {_NUM} END AS n FROM observed)") + f"""
SELECT investigation_id, raw FROM b WHERE scheme NOT IN ('http', 'https') OR ({CATEGORY_SQL}) IS NOT NULL""")
def blocked_urls(spark, sf):
    o = page_urls(spark, sf).select("investigation_id", F.array(U.observe(F.col("raw"))).alias("urls"))
    kept = F.filter("urls", lambda u: U.block_reason(u["normalized"]).isNotNull())
    return o.select("investigation_id", F.inline_outer(kept)).filter("raw IS NOT NULL").select("investigation_id", "raw")
