"""Rule-layer expectations on our own and pinned sentences."""

import pytest
from pyspark.sql import functions as F

from lurewatch.functions import detection as D
from lurewatch.operators import detection as P

CASES = [
    # text, risk, categories, is_scam
    ("Jackpot! The prize draw picked you, pay the claim fee today.", 64, ["financial", "rewards", "urgency"], True),
    ("Branch notice: account blocked, finish kyc verification immediately.", 40, ["urgency", "verification"], True),
    ("Give 900 rupees to shop.one@okaxis as refund fee now", 55, ["financial", "urgency"], True),
    ("URGENT please share your OTP before the account gets suspended", 90, ["urgency", "verification"], True),
    ("where did you put the green bucket", 0, [], False),
    ("Shall we have a coffee near the station on Sunday", 0, [], False),
]
EXTRACT = [
    ("rohan_77@ybl settles it; Meera.K@oksbi works as well", ["meera.k@oksbi", "rohan_77@ybl"], [], [], [], 30),
    ("The landline is dead. Text 07788990011, after six 9988776655.", [], ["7788990011", "9988776655"], ["07788990011"], [], 15),
    ("Our society keeps its fund in 220033445566, says the treasurer", [], [], ["220033445566"], [], 0),
    ("Forms lie under https://parcel-login.club/f?i=3 and t.co/k2k2", [], [], [], ["https://parcel-login.club/f?i=3", "t.co/k2k2"], 40),
    ("That reward expires tonight", [], [], [], [], 10),
    ("mail b@gmail.com or Z@PAYTM", ["z@paytm"], [], [], [], 35),
    ("", [], [], [], [], 0),
]


def _df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_pattern_verdict(spark):
    rows = P.pattern_verdict(_df(spark, [c[0] for c in CASES])).orderBy("i").collect()
    for row, (text, risk, categories, scam) in zip(rows, CASES):
        assert (row["risk_score"], sorted(row["category_names"]), row["is_scam"]) == (risk, categories, scam), text


def test_types(spark):
    texts = ["Please tell me your OTP at once", "Kindly send your password so we can proceed.", "We need you to share your card number.", "Kindly send the payment to the supplier's new account."]
    got = [r["scam_type"] for r in P.pattern_verdict(_df(spark, texts)).orderBy("i").collect()]
    assert got == ["mfa_code_theft", "credential_access", "bank_fraud", "payment_fraud"]


def test_extraction(spark):
    from lurewatch.functions import entities as E

    df = P.with_intel(_df(spark, [c[0] for c in EXTRACT])).withColumn("score", E.intel_score(F.col("intel")))
    for row, (text, upi, phone, acct, link, score) in zip(df.orderBy("i").collect(), EXTRACT):
        i = row["intel"]
        assert (i["upiIds"], i["phoneNumbers"], i["bankAccounts"], i["phishingLinks"], row["score"]) == (upi, phone, acct, link, score), text


@pytest.mark.parametrize("text,negated,asked", [
    ("Reminder of the day: never share your password, not even with us.", True, False),
    ("Kindly send your password so we can proceed.", False, True),
    ("Nothing of note in here.", False, False),
])
def test_negation(spark, text, negated, asked):
    row = P.with_behaviour(_df(spark, [text])).first()
    assert (row["negated_request"], "PASSWORD_REQUEST" in row["signals"]) == (negated, asked)


def test_rupee_needs_free_neighbours(spark):
    rows = P.with_keywords(_df(spark, ["₹5000 due", "₹ 5000 due"])).orderBy("i").collect()
    assert [("₹" in r["hits"]) for r in rows] == [False, True]


def test_grounding(spark):
    df = spark.createDataFrame([("bank_fraud", "Tell me the password then."), ("bank_fraud", "This concerns your bank account."), ("phishing", "look at http://y")], "t string, text string")
    got = [r[0] for r in df.select(D.type_has_evidence(F.col("t"), F.col("text"))).collect()]
    assert got == [False, True, True]
