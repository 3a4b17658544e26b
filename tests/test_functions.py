import unicodedata

import pytest
from pyspark.sql import functions as F

from lurewatch.functions import behaviour as B
from lurewatch.functions import keys as Y
from lurewatch.functions import replies as R
from lurewatch.functions import text as T
from lurewatch.functions import urls as U
from lurewatch.operators import reports as RP
from lurewatch.sources import readers


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,want", [
    ("ｆｕｌｌ ﬁt", unicodedata.normalize("NFKC", "ｆｕｌｌ ﬁt")), ("рaytm", "paytm"), ("a​b­", "ab"),
    ("  a \t b \n\n\n\n c  ", "a b\n\nc"), (None, ""),
])
def test_normalize(spark, text, want):
    assert one(spark, text, T.normalize) == want


def test_text_limit(spark):
    assert len(one(spark, "x" * 200, lambda c: T.normalize(c, max_chars=50))) == 50
    assert len(one(spark, "x" * 200, lambda c: T.normalize(c, max_chars=None))) == 200


def test_repair(spark):
    assert one(spark, "go httpsIl secure bank xyz\nplain text here", T.repair_transcribed_urls) == "go https://secure.bank.xyz\nplain text here"


def test_redact(spark):
    assert one(spark, "a@b.com x@paytm 9876543210 12345", T.redact) == "[redacted-email] [redacted-upi] [redacted-phone] 12345"


@pytest.mark.parametrize("url,want", [
    ("HTTP://Example.COM:80/a?b=1#frag", "http://example.com/a?b=1"), ("hxxps://evil[.]com", "https://evil.com/"),
    ("example.com/x).", "http://example.com/x"), ("https://u:p@h.io:8443", "https://h.io:8443/"),
])
def test_canonical(spark, url, want):
    assert one(spark, url, U.canonicalize) == want


@pytest.mark.parametrize("url,want", [
    ("http://127.0.0.1/", "loopback"), ("http://169.254.169.254/", "link-local"), ("http://10.1.1.1", "private"), ("http://[::1]/", "loopback"),
    ("http://[fc00::1]/", "private"), ("http://[fe80::1]/", "link-local"), ("http://0.0.0.0/", "reserved"), ("http://224.0.0.1/", "multicast"),
    ("ftp://x.com/", "unsupported scheme"), ("http://8.8.8.8/", None), ("http://example.com/", None), ("http://[::ffff:10.0.0.1]/", "private"),
])
def test_targets(spark, url, want):
    got = one(spark, url, U.block_reason)
    assert (got is None) if want is None else got.startswith(want)


@pytest.mark.parametrize("host,defanged,score", [
    ("example.com", False, 0.0), ("x.xyz", False, 0.25), ("bit.ly", False, 0.15), ("sbi-verify.xyz", False, 0.6), ("sbi.co.in", False, 0.0),
    ("a.b.c.example.com", False, 0.15), ("example.com", True, 0.1), ("10.0.0.1", False, 0.45),
])
def test_lexical(spark, host, defanged, score):
    got = one(spark, host, lambda c: U.lexical_score(U.lexical_reasons(c, F.lit(defanged))))
    assert got == pytest.approx(score)


def test_url_limit_and_order(spark):
    text = " ".join(f"http://h{i}.com/" for i in range(40)) + " http://h0.com/"
    got = one(spark, text, U.extract_urls)
    assert got == [f"http://h{i}.com/" for i in range(25)]
    long = "http://a.com/" + "x" * 60_000
    assert one(spark, long, U.extract_urls) == [long]


@pytest.mark.parametrize("value,want", [
    ("1700000000", 1700000000), ("1700000000000", 1700000000), ("2023-11-14T22:13:20+00:00", 1700000000), ("2023-11-14T22:13:20", 1700000000), ("junk", 0), (None, 0),
])
def test_timestamp(spark, value, want):
    assert one(spark, value, lambda c: F.unix_seconds(Y.flexible_timestamp(c, F.timestamp_seconds(F.lit(0))))) == want


def test_keys(spark):
    df = spark.createDataFrame([("phone", "+91 98765-43210"), ("url", " HTTP://X.com "), ("keyword", "x")], "kind string, v string")
    got = [r[0] for r in df.select(Y.normalize_indicator(F.col("kind"), F.col("v"))).collect()]
    assert got == ["919876543210", "http://x.com", "x"]


@pytest.mark.parametrize("reply,want", [
    ("Certainly! Here is the answer. ok", "the answer. ok"), ("As an AI I cannot", "FB"), ("", "FB"), ("a. b. c. d", "a. b."), ("x" * 300, "x" * 197 + "..."),
])
def test_sanitize(spark, reply, want):
    assert one(spark, reply, lambda c: R.sanitize(c, F.lit("FB"))) == want


@pytest.mark.parametrize("data,want", [
    (b"%PDF-1.4", ("application/pdf", "pdf")), (b"\x89PNG\r\n\x1a\nxx", ("image/png", "image")), (b"RIFF0000WEBPxx", ("image/webp", "image")),
    (b"RIFF0000WAVE", ("audio/wav", "audio")), (b"RIFF", None), (b"hello", None),
])
def test_sniff(spark, data, want):
    got = one(spark, bytearray(data), readers.sniff, "binary")
    assert (tuple(got) if got else None) == want


def test_incident_guidance(spark):
    g = one(spark, ["paid", "paid", "installed_app"], RP.incident_guidance, "array<string>")
    assert len(g["freeze"]) == 2 and len(g["preserve_evidence"]) == 4
    assert len(one(spark, [], RP.incident_guidance, "array<string>")["freeze"]) == 1


def test_cue_sentences_are_folded_and_keep_their_places(spark):
    text = "Fine day.  \n Reply with the \u212aey and your O\u0131TP. Send the PAS\u017fWORD now! ok\nShare your otp"
    out = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "k int, text string")
    out = out.select("k", F.inline_outer(B.cue_sentences(F.col("text")))).filter("sentence IS NOT NULL")
    got = [(r["pos"], r["sentence"]) for r in out.orderBy("pos").collect()]
    assert got == [(0, "fine day."), (1, "reply with the key and your oitp."), (2, "send the password now!"), (4, "share your otp")]
    assert [r[0] for r in out.orderBy("pos").select(B.is_request(F.col("sentence"), "PASSWORD_REQUEST")).collect()] == [False, False, True, False]
