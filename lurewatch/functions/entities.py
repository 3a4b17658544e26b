"""Entity extraction and validation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import lexicon as L

_W = L.WORD
# A match may begin at the start of a run or right where the last one ended;
# trying every offset of a long run would be quadratic and find the same text.
_UPI = rf"(?:\G|(?<![{L.UPI_BODY}]))[{L.UPI_BODY}]++@[a-zA-Z]{{2,}}"
_ACCOUNT = rf"(?<![{_W}])\p{{Nd}}{{9,18}}(?![{_W}])"
_URL = "(?i)" + L.URL_IN_TEXT.replace("{s}", L.SPACE).replace("{{", "{").replace("}}", "}")
_PREFIX = r"^(?:\+91|91|0)"


def _all(text: Column, pattern: str, gate: Column) -> Column:
    """All matches; ``gate`` is a cheap test every matching text passes."""
    none = F.array().cast("array<string>")
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _digits(text: Column) -> Column:
    return text.rlike(r"\p{Nd}{9}")


def upi_ids(text: Column) -> Column:
    """Payment handles in lower case; addresses at mail domains are left out."""
    found = F.transform(_all(text, _UPI, F.contains(text, F.lit("@"))), F.lower)
    mail = "@.*(?:" + "|".join(L.MAIL_DOMAINS) + ")"
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.rlike(mail))))


def phone_numbers(text: Column) -> Column:
    bare = F.transform(_all(text, L.PHONE, _digits(text)), lambda x: F.regexp_replace(x, _PREFIX, ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: (F.length(x) == 10) & x.rlike("^[6-9]"))))


def bank_accounts(text: Column) -> Column:
    runs = _all(text, _ACCOUNT, _digits(text))
    return F.array_sort(F.array_distinct(F.filter(runs, lambda x: ~((F.length(x) == 10) & x.rlike("^[6-9]")))))


def suspicious_links(text: Column) -> Column:
    risky = F.filter(
        _all(text, _URL, F.contains(text, F.lit("://"))),
        lambda u: u.rlike(L.LINK_IP) | u.rlike("(?i)" + L.LINK_LURES) | u.rlike("(?i)" + L.LINK_TLDS) | F.contains(u, F.lit("@")),
    )
    return F.array_sort(F.array_union(_all(text, "(?i)" + L.SHORT_LINK, F.contains(text, F.lit("/"))), risky))


# -- validators: struct(valid, confidence, reason) ---------------------------

def _check(valid: bool, confidence, reason) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    why = reason if isinstance(reason, Column) else F.lit(reason)
    return F.struct(F.lit(valid).alias("valid"), conf.alias("confidence"), why.alias("reason"))


def check_upi(upi: Column) -> Column:
    handle = F.lower(F.substring_index(upi, "@", -1))
    return (
        F.when(~upi.rlike(r"^[a-zA-Z0-9._-]+@[a-zA-Z]{2,}$"), _check(False, 0.0, "Invalid format"))
        .when(handle.isin(L.UPI_HANDLES), _check(True, 0.95, "Valid format and known bank handle"))
        .otherwise(_check(True, 0.7, "Valid format but unknown bank handle"))
    )


def check_phone(phone: Column) -> Column:
    bare = F.regexp_replace(phone, _PREFIX, "")
    return (
        F.when(~bare.rlike(r"^[6-9]\p{Nd}{9}$"), _check(False, 0.0, "Invalid Indian mobile format"))
        .when(bare.rlike(r"^(.)\1{9}$"), _check(False, 0.1, "Suspicious repeating digits"))
        .otherwise(_check(True, 0.9, "Valid Indian mobile format"))
    )


def check_account(account: Column) -> Column:
    return F.when(~account.rlike(r"^\p{Nd}{9,18}$"), _check(False, 0.0, "Invalid length")).otherwise(
        _check(True, 0.8, "Valid account number format")
    )


def check_url(url: Column) -> Column:
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))
    host = F.substring_index(F.regexp_extract(full, r"://([^/?#]*)", 1), ":", 1)
    dotted = F.contains(F.btrim(host, F.lit(".")), F.lit("."))
    tests = [
        (url.rlike(L.URL_CHECK_IP), 0.4, "IP address usage"),
        (url.rlike("(?i)" + L.URL_CHECK_TLDS), 0.3, "Risky TLD"),
        (url.rlike("(?i)" + L.URL_CHECK_LURES), 0.2, "Phishing keywords in URL"),
        (url.rlike("(?i)" + L.URL_CHECK_SHORT), 0.1, "URL shortener used"),
    ]
    risk = sum((F.when(hit, F.lit(points)).otherwise(0.0) for hit, points, _ in tests), F.lit(0.0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(hit, F.lit(why)) for hit, _, why in tests])), ", ")
    return (
        F.when(~dotted, _check(False, 0.0, "Not a URL"))
        .when(risk > 0, _check(True, F.least(F.lit(0.5) + risk, F.lit(1.0)), reasons))
        .otherwise(_check(True, 0.5, "URL detected but no specific phishing indicators"))
    )


def extract(text: Column, keywords: Column) -> Column:
    """struct of five sorted arrays, each value past its validator.

    ``keywords`` is the suspicious-keyword array (see ``keywords.suspicious``).
    """
    text = F.coalesce(text, F.lit(""))
    return F.struct(
        F.filter(bank_accounts(text), lambda x: check_account(x)["valid"]).alias("bankAccounts"),
        F.filter(upi_ids(text), lambda x: check_upi(x)["valid"]).alias("upiIds"),
        F.filter(suspicious_links(text), lambda x: check_url(x)["valid"]).alias("phishingLinks"),
        F.filter(phone_numbers(text), lambda x: check_phone(x)["valid"]).alias("phoneNumbers"),
        keywords.alias("suspiciousKeywords"),
    )


def intel_score(intel: Column) -> Column:
    """Presence-based score of one message, 0 to 100."""
    def present(bucket: str, points: int) -> Column:
        return F.when(F.size(intel[bucket]) > 0, F.lit(points)).otherwise(0)

    kw = F.least(F.size(intel["suspiciousKeywords"]) * 5, F.lit(30))
    return F.least(
        present("upiIds", 30) + present("phoneNumbers", 15) + present("phishingLinks", 40) + kw, F.lit(100)
    )


def model_entity(label: Column, text: Column) -> Column:
    """Bucket and value of one externally tagged span; null when unused."""
    digits = F.regexp_replace(text, r"\P{Nd}", "")
    numeric = label.isin("NUM", "NUMBER")

    def put(bucket: str, value: Column) -> Column:
        return F.struct(F.lit(bucket).alias("bucket"), value.alias("value"))

    return (
        F.when(numeric & (F.length(digits) == 10) & digits.rlike("^[6-9]"), put("phoneNumbers", digits))
        .when(numeric & F.length(digits).between(9, 18), put("bankAccounts", digits))
        .when(label == "MONEY", put("amounts", text))
        .when(label == "ORG", put("organizations", text))
    )
