"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, schemes, digits, plus signs and
cue words. From each anchor a deterministic local parser expands to the
boundaries of an email, address or account and validates what it got.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.spans import Span, of_kinds, ordered, scan, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "street")

# Cue words of accounts and of streets, by where the number stands.
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta")
STREET_AFTER_NUMBER = ("street", "avenue", "road", "lane", "boulevard", "drive")
STREET_BEFORE_NUMBER = ("straße", "strasse", "gasse", "calle", "avenida")
STREET_WITH_NUMBER_FIRST = ("rue", "boulevard")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_RUN = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_SCHEME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+;=-]+:[^\s/@:]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[\s:#.]{0,3}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|num)\.?)?[\x20:#.]{1,3}([0-9](?:[\x20-]?[0-9]){7,16})(?![0-9])", re.I | re.A)
_WORDS_BACK = re.compile(r"(?<![\w])([0-9]{1,5}[A-Za-z]?\x20(?:[^\W\d_][\w'-]*\x20){1,3})\Z")
_NUMBER_BACK = re.compile(r"(?<![\w])([0-9]{1,5}(?:\x20?bis|\x20?ter)?,?\x20)\Z")
_NUMBER_CHARS = 11  # the most that it can match
_NUMBER_ON = re.compile(r"(?:\x20[^\W\d_][\w'-]*){0,4},?\x20([0-9]{1,5})(?![0-9])")
_NAME_ON = re.compile(r"(?:\x20[^\W\d_][\w'-]*){1,4}")
_CASE = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, what in (("@", "@"), ("://", "://"), ("+", "+"), *((str(d), "digit") for d in range(10))):
        found.add_word(word, (what, len(word)))
    for cues, what in ((IBAN_CUES, "iban"), (ACCOUNT_CUES, "account"), (STREET_AFTER_NUMBER, "after"), (STREET_BEFORE_NUMBER, "before"), (STREET_WITH_NUMBER_FIRST, "first")):
        for cue in cues:
            roles = f"{found.get(cue)[0]} {what}" if cue in found else what
            found.add_word(cue, (roles, len(cue)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _word_at(text: str, a: int, b: int) -> bool:
    return (a == 0 or not (text[a - 1].isalnum() or text[a - 1] == "_")) and (b == len(text) or not (text[b].isalnum() or text[b] == "_"))


def _words_back(text: str, at: int, words: int = 4) -> int:
    """Where the last ``words`` words before ``at`` begin, however long they are."""
    for _ in range(words):
        at = text.rfind(" ", 0, max(at - 1, 0)) + 1
    return at


def find_in(text: str) -> list[Span]:
    """All spans of a text, sorted; see :func:`find_personal`."""
    found: list[Span] = []
    after = dict.fromkeys(BASE, 0)  # where the next match of each base kind can start
    for at, (what, length) in _ANCHORS.iter(text.translate(_CASE)):
        a = at - length + 1
        if what == "digit":
            if a >= after["card"]:
                m = _CARD.match(text, a)
                after["card"] = m.end() if m else a + 1
                if m:
                    digits = re.sub(r"[\x20-]", "", m[0])
                    if 14 <= len(digits) <= 19 and _luhn(digits):
                        found.append(("card", *m.span()))
            if a >= after["ip"]:
                m = _IP.match(text, a)
                after["ip"] = (m or _RUN.match(text, a)).end()
                if m and all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m.groups()):
                    found.append(("ip", *m.span()))
        elif what == "@":
            lo = a
            while lo > after["email"] and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < a and (m := _DOMAIN.match(text, a + 1)):
                after["email"] = m.end()
                found.append(("email", lo, m.end()))
        elif what == "+":
            if a >= after["phone"] and (m := _PHONE.match(text, a)):
                after["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
        elif what == "://":
            if m := _USERINFO.match(text, at + 1):
                lo = a
                while lo > 0 and text[lo - 1] in _SCHEME_CHARS:
                    lo -= 1
                if s := _SCHEME.search(text, lo, a):
                    found.append(("login", s.start(), m.end()))
        elif what == "iban":
            if (m := _IBAN.match(text, at + 1)) and _word_at(text, a, at + 1):
                letters = re.sub(r"\x20", "", m[1])
                # The longest valid prefix: an IBAN ends where its check digits hold.
                for n in range(min(34, len(letters)), 14, -1):
                    if letters[:n].isascii() and _mod97(letters[:n]):
                        end, left = m.start(1), n
                        while left:
                            left -= text[end] != " "
                            end += 1
                        found.append(("iban", m.start(1), end))
                        break
        elif what == "account":
            if (m := _ACCOUNT.match(text, at + 1)) and _word_at(text, a, at + 1):
                found.append(("account", *m.span(1)))
        else:
            if "after" in what and _word_at(text, a, at + 1) and (m := _WORDS_BACK.search(text, _words_back(text, a), a)):
                found.append(("street", m.start(1), at + 1))
            if "before" in what and (m := _NUMBER_ON.match(text, at + 1)):
                lo = a
                while lo > 0 and text[lo - 1].isalpha():
                    lo -= 1
                found.append(("street", lo, m.end(1)))
            if "first" in what and _word_at(text, a, at + 1) and (m := _NUMBER_BACK.search(text, max(0, a - _NUMBER_CHARS), a)) and (n := _NAME_ON.match(text, at + 1)):
                found.append(("street", m.start(1), n.end()))
    return ordered(list(dict.fromkeys(found)), KINDS)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in whole texts.

    Returns ``doc_id`` and ``spans`` (array of kind, start, end in code points,
    end exclusive, by start then kind as in ``KINDS``), one row per input row,
    repeated rows included. Null and empty texts have no spans; an empty table gives
    an empty result; other columns are ignored. Texts, words and numbers may be of
    any length.
    """
    return scan(docs, id_col, text_col, find_in)


def op7_anchor_pii(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scanned where it lies; nothing is shuffled."""
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(of_kinds(F.col("spans"), (k,))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written(of_kinds(F.col("spans"), BASE)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
