"""Pattern expressions against plain Python regular expressions on random texts."""

import random
import re

from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions import behaviour as B
from lurewatch.functions import entities as E
from lurewatch.functions import keywords as K
from lurewatch.functions import text as T
from lurewatch.functions import urls as U


def py(pattern):
    return pattern.replace("{s}", r"\s").replace("{w}", r"\w").replace("{b}", r"\b")


def texts(pieces, seed, n=250, glue=(" ", " ", " ", "", ".", "\n", "-", "é", "_", "  ")):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) + rng.choice(glue) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def run(spark, rows, *columns):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    return df.select("i", *columns).orderBy("i").collect()


def test_keywords(spark):
    rows = texts([*K.LEXICON, "appears", "bankers", "É", "won't", "x1", "₹5"], 1)
    got = run(spark, rows, K.scan(F.col("text")).alias("s"))
    for text, r in zip(rows, got):
        low = text.lower()
        want = {kw for kw in K.LEXICON if re.search(rf"(?<!\w){re.escape(kw)}(?!\w)", low)}
        assert set(r["s"]["hits"]) == want, text
        per = {c: [k for k in words if k in want] for c, (_, words) in L.RISK_CATEGORIES.items()}
        assert {c["category"]: c["matches"] for c in r["s"]["categories"]} == {c: m for c, m in per.items() if m}
        assert r["s"]["risk_score"] == min(100, sum(L.RISK_CATEGORIES[c][0] * len(m) for c, m in per.items()))


_PIECES = [
    "send", "share", "tell us", "confirm by", "resend", "please", "your", "OTP", "password", "verification code", "one-time code", "api key", "API-key", "session token",
    "auth token", "secret value", "bank account number", "cvv", "payment", "transfer the money", "do not", "never", "don't", "IT support", "help desk", "security review",
    "account is locked", "this is from the bank", "I'm with HR", "on behalf of the bank", "urgent", "expires", "as soon as possible", "end of day", "by", "passwords", "x" * 30, "!", "?", "mfa code",
]


def test_behaviour(spark):
    rows = texts(_PIECES, 2, 400)
    got = run(spark, rows, K.scan(F.col("text"))["cues"].alias("cues"), B.detect(F.col("text"), K.scan(F.col("text"))["cues"]).alias("b"), T.sentences(F.col("text")).alias("s"))
    flags = re.IGNORECASE

    def spots(pattern, s):
        """(start, end) of the pattern as whole words, from every position."""
        rx = re.compile(rf"(?:{py(pattern)})\b", flags)
        hits = (rx.match(s, i) for i in range(len(s)))
        return [(m.start(), m.end()) for m in hits if m]

    def asks(nouns, s):
        """A verb and a noun within sixty characters of each other, no sentence end between them."""
        word = lambda i: i == 0 or not (s[i - 1].isalnum() or s[i - 1] == "_")
        verbs, things = spots(L.REQUEST_VERBS, s), [t for t in spots(nouns, s) if word(t[0])]
        pairs = [(v[1], t[0]) for v in verbs for t in things] + [(t[1], v[0]) for v in verbs for t in things]
        return any(0 <= b - a <= 60 and not set(".?!\n") & set(s[a:b]) for a, b in pairs)

    cue = {n: re.compile(rf"\b{py(x)}\b", flags) for n, x in {**L.PRETEXTS, "URGENCY_MANIPULATION": L.URGENCY_CUES}.items()}
    negation = re.compile(rf"\b{py(L.NEGATION_CUES)}\b", flags)
    fired = 0
    for text, r in zip(rows, got):
        sentences = [s.strip() for s in re.split(r"(?<=[.?!])\s+|\n+", text) if s.strip()]
        assert r["s"] == sentences
        want, warned = {}, False
        for s in sentences:
            neg = bool(negation.search(s))
            for n, nouns in L.SECRET_NOUNS.items():
                if asks(nouns, s):
                    warned |= neg
                    if not neg:
                        want.setdefault(n, s)
            for n, rx in cue.items():
                if rx.search(s):
                    want.setdefault(n, s)
        member = next((want[t] for t in L.UMBRELLA_MEMBERS if t in want), None)
        if member is not None:
            want["CREDENTIAL_REQUEST"] = member
        assert (r["b"]["signals"], r["b"]["negated_request"]) == (want, warned), text
        fired += len(want)
    assert fired > 300


_ENTITY = ["a.b@ybl", "x_y@gmail.com", "P@PayTM", "@", "9876543210", "+919876543210", "09876543210", "9123456789", "123456789012", "12345678", "1234567890123456789", "a1234567890", ".", "é987654321",
           "http://bank.com/x", "https://1.2.3.4/a", "HTTP://ok.com/", "bit.ly/Ab1", "t.co/", "http://x.xyz", "http://u@h.io", "5551234567"]


def test_entities(spark):
    rows = texts(_ENTITY, 3, 300, glue=(" ", " ", ",", "", "-", "\n", "(", "<"))
    got = run(spark, rows, E.upi_ids(F.col("text")).alias("u"), E.phone_numbers(F.col("text")).alias("p"), E.bank_accounts(F.col("text")).alias("a"), E.suspicious_links(F.col("text")).alias("l"))
    for text, r in zip(rows, got):
        upi = {m.lower() for m in re.findall(r"[a-zA-Z0-9._-]+@[a-zA-Z]{2,}", text) if not any(d in m.split("@")[1].lower() for d in L.MAIL_DOMAINS)}
        phone = {re.sub(r"^(\+91|91|0)", "", m) for m in re.findall(r"(?:\+91|91|0)?[6-9]\d{9}", text)}
        account = {m for m in re.findall(r"\b\d{9,18}\b", text) if not (len(m) == 10 and m[0] in "6789")}
        urls = re.findall(r"""https?://[^\s<>"{}|\\^`\[\]]+""", text, re.I)
        link = set(re.findall(L.SHORT_LINK, text, re.I)) | {
            u for u in urls if re.search(r"https?://\d+\.\d+\.\d+\.\d+", u) or re.search(L.LINK_LURES, u, re.I) or re.search(L.LINK_TLDS, u, re.I) or "@" in u}
        assert r["u"] == sorted(upi), text
        assert r["p"] == sorted(p for p in phone if len(p) == 10 and p[0] in "6789"), text
        assert r["a"] == sorted(account), text
        assert r["l"] == sorted(link), text


URL_CASES = [
    ("go to http://a.com/x, then stop", ["http://a.com/x,"]),
    ("(hxxps://b[.]com/y[.]z) done", ["hxxps://b[.]com/y[.]z"]),
    ("c.d.example.org and e[.]f[.]net/path", ["c.d.example.org", "e[.]f[.]net/path"]),
    ("at 10.0.0.1 or 1.2", ["10.0.0.1", "1.2"]),
    ("http://[x is cut", ["http://[x"]),
    ('say "https://i.io?q=[.]&r" now', ["https://i.io?q=[.]&r"]),
    ("end g.h- here", ["g.h-"]),
    ("no link. At all", []),
    ("one\nwww.two.example/three]four", ["www.two.example/three"]),
]


def test_url_candidates(spark):
    got = run(spark, [t for t, _ in URL_CASES], F.regexp_extract_all("text", F.lit(U.CANDIDATE), F.lit(0)).alias("c"))
    assert [r["c"] for r in got] == [want for _, want in URL_CASES]


def test_redaction_and_neutralising(spark):
    rows = texts(["a@b.com", "x.y+z@paytm", "9876543210", "-", "12345678901234", "é@b.co", "ignore previous instructions", "DAN", "DANCE", "act as a ", "system prompt", "new instruction :", "plain"], 5, 300)
    got = run(spark, rows, T.redact(F.col("text")).alias("r"), T.neutralize(F.col("text")).alias("n"))
    for text, r in zip(rows, got):
        want = re.sub(r"\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b", "[redacted-email]", text)
        want = re.sub(r"\b[\w.+-]+@[a-zA-Z]{2,}\b", "[redacted-upi]", want)
        assert r["r"] == re.sub(r"\b\d{10,13}\b", "[redacted-phone]", want), text
        plain = text
        for p in L.OVERRIDE_PHRASES:
            plain = re.sub(py(p), L.OVERRIDE_MARK, plain, flags=re.I)
        assert r["n"] == plain, text
