"""Behavioural signals: requests for secrets, pretexts, urgency, negation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch.functions.bind import let
from lurewatch.functions.text import pieces_of, sentences, strip_space

REQUEST_RX = {name: L.request(noun) for name, noun in L.SECRET_NOUNS.items()}
PRETEXT_RX = {name: L.whole(body) for name, body in L.PRETEXTS.items()}
URGENCY_RX = L.whole(L.URGENCY_CUES)
NEGATION_RX = L.whole(L.NEGATION_CUES)
ANY_REQUEST_RX = "|".join(f"(?:{p})" for p in REQUEST_RX.values())

# One of these words stands in every sentence that can raise the signal, so
# everything else is skipped without running its pattern.
_CUES = {
    "MFA_CODE_REQUEST": ["verification", "authenticator", "mfa", "time"],
    "OTP_REQUEST": ["otp"],
    "PASSWORD_REQUEST": ["password"],
    "API_KEY_REQUEST": ["api", "apikey"],
    "SESSION_TOKEN_REQUEST": ["session"],
    "AUTH_TOKEN_REQUEST": ["auth", "authentication"],
    "SECRET_REQUEST": ["secret"],
    "BANK_DETAIL_REQUEST": ["account", "ifsc", "card", "cvv"],
    "PAYMENT_REQUEST": ["payment", "transfer"],
    "IT_SUPPORT_PRETEXT": ["support", "operations", "team", "department", "helpdesk", "desk"],
    "SECURITY_REVIEW_PRETEXT": ["review", "reconciliation", "comparison", "queue", "check"],
    "ACCOUNT_LOCK_PRETEXT": ["account", "orphaned"],
    "IMPERSONATION": ["from", "with", "behalf"],
    "URGENCY_MANIPULATION": [
        "urgent", "urgently", "immediately", "away", "possible", "asap", "closes", "closing", "later", "day", "deadline", "expir",
    ],
}
CUE_WORDS = list(dict.fromkeys(w for words in _CUES.values() for w in words))
_ODD_LETTERS = "ſıİK"  # letters equal to ASCII ones when case is ignored


def with_special_cues(cues: Column, lower_text: Column) -> Column:
    """Add the one cue that is a word stem; texts with odd letters keep every cue."""
    stem = F.when(F.contains(lower_text, F.lit("expir")), F.array(F.lit("expir"))).otherwise(F.array().cast("array<string>"))
    return F.when(lower_text.rlike(f"[{_ODD_LETTERS}]"), F.lit(CUE_WORDS)).otherwise(F.array_union(cues, stem))


def _fold(sentence: Column) -> Column:
    """Lower case; ``translate`` looks up every letter, so it only sees texts that hold an odd one."""
    odd = reduce(or_, [F.contains(sentence, F.lit(c)) for c in _ODD_LETTERS])
    return F.lower(F.when(odd, F.translate(sentence, _ODD_LETTERS, "siik")).otherwise(sentence))


def cue_sentences(text: Column) -> Column:
    """array<struct<pos, sentence>> of the folded sentences that hold a cue, with their places among all pieces, blank ones too."""
    pieces = F.transform(let(text, lambda t: pieces_of(_fold(t))), lambda s, i: F.struct(i.alias("pos"), strip_space(s).alias("sentence")))
    any_cue = lambda s: reduce(or_, [F.contains(s, F.lit(w)) for w in CUE_WORDS])
    return F.filter(pieces, lambda p: any_cue(p["sentence"]))


def is_request(folded: Column, signal: str) -> Column:
    """Request test of one folded sentence."""
    return _has_cue(folded, signal) & folded.rlike(REQUEST_RX[signal])


def is_cue(folded: Column, signal: str) -> Column:
    """Pretext or urgency test of one folded sentence."""
    return _has_cue(folded, signal) & folded.rlike(PRETEXT_RX.get(signal, URGENCY_RX))


def is_negated(sentence: Column) -> Column:
    return _fold(sentence).rlike(NEGATION_RX)


def _has_cue(folded: Column, signal: str) -> Column:
    return reduce(or_, [F.contains(folded, F.lit(w)) for w in _CUES[signal]])


def _candidates(text: Column, cues: Column) -> Column:
    """array<struct<raw, folded>> of the sentences that hold some cue."""
    pairs = F.transform(sentences(text), lambda s: F.struct(s.alias("raw"), _fold(s).alias("folded")))
    return F.filter(pairs, lambda p: F.exists(cues, lambda c: F.contains(p["folded"], c)))


def _first(candidates: Column, cues: Column, signal: str) -> Column:
    pattern = REQUEST_RX.get(signal) or PRETEXT_RX.get(signal, URGENCY_RX)

    def test(p: Column) -> Column:
        hit = _has_cue(p["folded"], signal) & p["folded"].rlike(pattern)
        return hit & ~p["folded"].rlike(NEGATION_RX) if signal in REQUEST_RX else hit

    found = F.try_element_at(F.filter(candidates, test), F.lit(1))["raw"]
    return F.when(F.arrays_overlap(cues, F.lit(_CUES[signal])), found)


def detect(text: Column, cues: Column) -> Column:
    """struct(signals map<type, first triggering sentence>, negated_request).

    ``cues`` comes from ``keywords.scan``; without any the text is not split.
    The umbrella credential request is added when a member type is present.
    """
    def build(found: Column) -> Column:
        entries = F.array(*[F.struct(F.lit(n).alias("key"), _first(found, cues, n).alias("value")) for n in _CUES])
        signals = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
        return let(signals, lambda s: F.struct(with_umbrella(s).alias("signals"), negated_request(found).alias("negated_request")))

    nothing = F.struct(
        F.create_map().cast("map<string,string>").alias("signals"), F.lit(False).alias("negated_request")
    )
    return F.when(F.size(cues) == 0, nothing).otherwise(let(_candidates(text, cues), build))


def with_umbrella(signals: Column) -> Column:
    evidence = F.coalesce(*[F.try_element_at(signals, F.lit(t)) for t in L.UMBRELLA_MEMBERS])
    return F.when(
        evidence.isNotNull(), F.map_concat(signals, F.create_map(F.lit("CREDENTIAL_REQUEST"), evidence))
    ).otherwise(signals)


def negated_request(candidates: Column) -> Column:
    """Some sentence is at once a request shape and negated: a warning."""
    return F.exists(candidates, lambda p: p["folded"].rlike(NEGATION_RX) & p["folded"].rlike(ANY_REQUEST_RX))


def severity(signal: Column) -> Column:
    return F.when(signal.isin([*REQUEST_RX, "CREDENTIAL_REQUEST"]), F.lit("high")).otherwise(F.lit("medium"))
