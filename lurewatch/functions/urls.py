"""URL extraction, canonical form, target classification and lexical score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions.bind import let

_SP = L.SPACE
_W = L.WORD
# One candidate: a scheme plus everything up to a delimiter, or a dotted bare
# host with an optional path.  "[.]" counts as part of the address.  The long
# tail is unrolled so that the matcher does not recurse once per character.
_END = rf"{_SP}<>\"')\]"
_TAIL = rf"[^{_END}\[]*+(?:(?:\[\.\]|\[)[^{_END}\[]*+)*+"
CANDIDATE = (
    rf"(?iu)(?<![{_W}])(?:h(?:tt|xx)ps?://(?=[^{_END}]){_TAIL}"
    rf"|[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:(?:\.|\[\.\])[a-z0-9\-]+)+(?:/{_TAIL})?)"
)
DOTTED_HOST = r"^[a-z0-9\-.]+\.[a-z]{2,}$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
# Full or compressed IPv6, optionally with a dotted IPv4 tail and a zone.
_H = "[0-9a-f]{1,4}"
_V4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
IPV6 = (
    rf"^(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{6}}{_V4}"
    + "".join(
        rf"|(?:{_H}(?::{_H}){{0,{left - 1}}})?::(?:{_H}(?::{_H}){{0,{max(6 - left, 0)}}})?" if left else
        rf"|::(?:{_H}(?::{_H}){{0,6}})?"
        for left in range(0, 8)
    )
    + rf"|(?:{_H}(?::{_H}){{0,4}})?::(?:{_H}:){{0,4}}{_V4})(?:%[^%]+)?$"
)


def refang(url: Column) -> Column:
    for defanged, plain in [("[.]", "."), ("(.)", "."), ("[:]", ":"), ("[://]", "://"), ("hxxp", "http"), ("hXXp", "http")]:
        url = F.replace(url, F.lit(defanged), F.lit(plain))
    return url


def trim_punctuation(url: Column) -> Column:
    return F.regexp_replace(url, f"[{L.TRAILING_PUNCTUATION}]+\\z", "")


def with_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def _host_port(url: Column) -> Column:
    return F.regexp_replace(authority_of(url), r"^.*@", "")


def host_of(url: Column) -> Column:
    """Lower-case host without user info, port or IPv6 brackets."""
    hp = _host_port(url)
    return F.lower(
        F.when(hp.startswith("["), F.regexp_extract(hp, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(hp, r"^([^:]*)", 1))
    )


def canonicalize(url: Column) -> Column:
    """Scheme and host in lower case, default port, user info and fragment dropped."""
    def parts(full: Column) -> Column:
        return F.struct(
            scheme_of(full).alias("scheme"), host_of(full).alias("host"),
            F.regexp_extract(_host_port(full), r":([0-9]+)$", 1).try_cast("int").alias("port"),
            F.regexp_extract(full, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1).alias("path"),
            F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        )

    def join(p: Column) -> Column:
        port = p["port"]
        default = ((p["scheme"] == "http") & (port == 80)) | ((p["scheme"] == "https") & (port == 443))
        shown = port.isNotNull() & (port != 0) & ~default
        return F.concat(
            p["scheme"], F.lit("://"), p["host"], F.when(shown, F.concat(F.lit(":"), port.cast("string"))).otherwise(""),
            F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]),
            F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])),
        )

    clean = trim_punctuation(F.trim(refang(url)))
    return let(let(clean, with_scheme), lambda full: let(parts(full), join))


def is_ip_literal(host: Column) -> Column:
    return host.rlike(IPV4) | F.lower(host).rlike(IPV6)


def _plausible(candidate: Column) -> Column:
    host = let(let(refang(candidate), with_scheme), host_of)
    return let(host, lambda h: h.rlike("(?i)" + DOTTED_HOST) | is_ip_literal(h))


def extract_urls(text: Column, limit: int | None = L.LIMITS["urls"]) -> Column:
    """Distinct plausible URLs in order of appearance, at most ``limit`` of them."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), trim_punctuation)
    kept = F.array_distinct(F.filter(found, _plausible))
    return kept if limit is None else F.slice(kept, 1, limit)


def merge_candidates(request_urls: Column, text_urls: Column, limit: int | None = L.LIMITS["urls"]) -> Column:
    """Caller-supplied URLs first, then those read from the text; first-seen order."""
    merged = F.array_distinct(F.concat(F.coalesce(request_urls, F.array().cast("array<string>")), text_urls))
    return merged if limit is None else F.slice(merged, 1, limit)


def observe(raw: Column) -> Column:
    """struct(raw, normalized, host, was_defanged)"""
    return let(canonicalize(raw), lambda n: F.struct(
        raw.alias("raw"), n.alias("normalized"), host_of(n).alias("host"), (refang(raw) != raw).alias("was_defanged")
    ))


def _ipv4_number(host: Column) -> Column:
    octet = F.split(host, r"\.")
    return sum(F.try_element_at(octet, F.lit(i + 1)).try_cast("bigint") * (256 ** (3 - i)) for i in range(4))


def _range(number: Column, low: str, high: str) -> Column:
    def value(dotted: str) -> int:
        a, b, c, d = (int(x) for x in dotted.split("."))
        return ((a * 256 + b) * 256 + c) * 256 + d

    return number.between(F.lit(value(low)), F.lit(value(high)))


def address_category(host: Column) -> Column:
    """null for a public literal (or a name), else the reason it is refused."""
    def v4(n: Column) -> Column:
        return (
            F.when(_range(n, "127.0.0.0", "127.255.255.255"), "loopback")
            .when(_range(n, "169.254.0.0", "169.254.255.255"), "link-local")
            .when(_range(n, "224.0.0.0", "239.255.255.255"), "multicast")
            .when(n == 0, "reserved")
            .when(_range(n, "192.0.0.9", "192.0.0.10"), F.lit(None))
            .when(
                _range(n, "0.0.0.0", "0.255.255.255") | _range(n, "10.0.0.0", "10.255.255.255")
                | _range(n, "172.16.0.0", "172.31.255.255") | _range(n, "192.168.0.0", "192.168.255.255")
                | _range(n, "192.0.0.0", "192.0.0.255") | _range(n, "192.0.2.0", "192.0.2.255")
                | _range(n, "198.18.0.0", "198.19.255.255") | _range(n, "198.51.100.0", "198.51.100.255")
                | _range(n, "203.0.113.0", "203.0.113.255") | _range(n, "240.0.0.0", "255.255.255.255"),
                "private",
            )
        )
    v6 = (
        F.when(host.rlike(r"^(?:0{0,4}:){1,7}0{0,3}1$"), "loopback")
        .when(host.rlike(r"^fe[89ab][0-9a-f]:"), "link-local")
        .when(host.rlike(r"^ff[0-9a-f]{2}:"), "multicast")
        .when(host.rlike(r"^[0:]+$"), "reserved")
        .when(host.rlike(r"^(?:f[cd][0-9a-f]{2}|2001:0?db8|2002|100:(?::|0:0:0:)|64:ff9b:0?0?0?1|3fff:0?[0-9a-f]{1,3}|2001:[01]?[0-9a-f]{1,2}):"), "private")
        .when(~host.rlike(r"^(?:[23][0-9a-f]{3}|fe[c-f][0-9a-f]|64:ff9b):"), "reserved")
    )
    # An IPv4 address written inside IPv6 is judged as the IPv4 address.
    plain = F.regexp_replace(host, r"^(?:0{0,4}:){1,5}(?::|0{1,4}:)?ffff:(?=[0-9]+\.)", "")
    return let(plain, lambda h: F.when(h.rlike(IPV4), let(_ipv4_number(h), v4)).when(h.rlike(IPV6), v6))


def block_reason(url: Column) -> Column:
    """null when the target may be contacted as far as a literal can tell."""
    def judge(p: Column) -> Column:
        return (
            F.when(~p["scheme"].isin("http", "https"), F.concat(F.lit("unsupported scheme '"), p["scheme"], F.lit("'")))
            .when(p["host"] == "", F.lit("no host"))
            .otherwise(let(address_category(p["host"]), lambda c: F.when(c.isNotNull(), F.concat(c, F.lit(" address "), p["host"]))))
        )

    return let(F.struct(scheme_of(url).alias("scheme"), host_of(url).alias("host")), judge)


def lexical_reasons(host: Column, was_defanged: Column) -> Column:
    """array<struct<points, reason>> of the red flags visible in the host name."""
    def flag(cond: Column, points: float, reason) -> Column:
        text = reason if isinstance(reason, Column) else F.lit(reason)
        return F.when(cond, F.struct(F.lit(points).alias("points"), text.alias("reason")))

    def brand_of(labels: Column) -> Column:
        """First watched brand inside the host whose own domain it is not."""
        head = F.when(F.size(labels) > 2, F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))).otherwise(labels)
        joined = F.array_join(labels, "-")
        hits = F.filter(F.lit(L.WATCHED_BRANDS), lambda b: F.contains(joined, b) & ~F.array_contains(head, b))
        return F.try_element_at(hits, F.lit(1))

    def judge(p: Column) -> Column:
        return F.array_compact(F.array(
            flag(is_ip_literal(p["host"]), 0.3, "ip_literal_host"),
            flag(p["tld"].isin(L.RISKY_TLDS), 0.25, F.concat(F.lit("suspicious_tld:."), p["tld"])),
            flag(p["host"].isin(L.SHORTENERS), 0.15, "url_shortener"),
            flag(p["n"] >= 4, 0.15, "excessive_subdomains"),
            flag(p["brand"].isNotNull(), 0.35, F.concat(F.lit("brand_lookalike:"), p["brand"])),
            flag(was_defanged, 0.1, "defanged_in_message"),
        ))

    low = F.lower(host)
    return let(F.filter(F.split(low, r"\."), lambda x: x != ""), lambda labels: let(F.struct(
        low.alias("host"), F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")).alias("tld"),
        F.size(labels).alias("n"), brand_of(labels).alias("brand"),
    ), judge))


def lexical_score(reasons: Column) -> Column:
    return F.least(F.lit(1.0), F.aggregate(reasons, F.lit(0.0), lambda acc, r: acc + r["points"]))


def lexical_label(reasons: Column) -> Column:
    return F.when(F.size(reasons) == 0, F.lit("no_lexical_flags")).otherwise(
        F.array_join(F.transform(reasons, lambda r: r["reason"]), ", ")
    )
