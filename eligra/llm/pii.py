"""Personal data by anchor expansion: an automaton finds cues, local parsers expand and validate around them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligra.llm.common import texts

# The kinds in the order of the digest, then those that the cues add.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = regex.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
IP = regex.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = regex.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = regex.compile(r"://([^\s/?#@:]++:[^\s/?#@]++)@")
IBAN = regex.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ACCOUNT = regex.compile(r"[\s:#=.]{1,4}(?:(?:no|nr|number)[\s:#=.]{1,3})?([0-9][0-9\x20-]{4,22}[0-9])(?![0-9])", regex.IGNORECASE)
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account",
        "ssn": "account", "passport": "account"}


def _automaton():
    """Cues of every kind: an at-sign, a dot behind a digit, a plus before one, two digits together or apart by one sign, ``://``, words."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 0))
    a.add_word("://", ("login", 2))
    for d in DIGITS:
        a.add_word(f"{d}.", ("ip", 1))
        a.add_word(f"+{d}", ("phone", 1))
        for e in DIGITS:
            for sign in ("", " ", "-"):
                a.add_word(f"{d}{sign}{e}", ("card", 1 + len(sign)))
    for word, kind in CUES.items():
        for form in {word, word.upper(), word.capitalize()}:
            a.add_word(form, (kind, len(form) - 1))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _back(text: str, at: int, low: int, allowed) -> int:
    """Start of the run of ``allowed`` characters that ends before ``at``, not before ``low``."""
    while at > low and text[at - 1] in allowed:
        at -= 1
    return at


def find(text: str, automaton) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all spans, sorted. Anchors come from left to right, so each parser starts behind its last match.

    A parser takes the leftmost, longest form around its anchor; what fails its check is passed over and not tried shorter.
    """
    out = []
    done = dict.fromkeys(KINDS, 0)  # end of the last form of each kind, valid or not
    for last, (kind, back) in automaton.iter(text):
        start = last - back
        if kind == "email":
            low = _back(text, start, done["email"], LOCAL)
            if low < start and (m := DOMAIN.match(text, start + 1)):
                out.append((0, low, m.end()))
                done["email"] = m.end()
        elif kind == "ip":
            if start < done["ip"]:
                continue
            low = _back(text, start, done["ip"], DIGITS)
            if m := IP.match(text, low):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    out.append((1, low, m.end()))
        elif kind == "card":
            if start < done["card"]:
                continue
            m = CARD.match(text, start)
            done["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, start, m.end()))
        elif kind == "phone":
            if start < done["phone"]:
                continue
            if m := PHONE.match(text, start):
                done["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((3, start, m.end()))
        elif kind == "login":
            if m := LOGIN.match(text, start):
                out.append((4, m.start(1), m.end(1)))
        elif kind == "iban":
            if m := IBAN.match(text, _skip(text, last + 1)):
                code = m[0].replace(" ", "")
                if 15 <= len(code) <= 34 and _mod97(code):
                    out.append((5, m.start(), m.end()))
        elif (m := ACCOUNT.match(text, last + 1)) and 6 <= sum(c in DIGITS for c in m[1]) <= 18:
            out.append((6, m.start(1), m.end(1)))
    return sorted(set(out))


def _skip(text: str, at: int) -> int:
    end = min(len(text), at + 4)
    while at < end and text[at] in " :#=.\t\n":
        at += 1
    return at


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def _tag(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    automaton = _automaton()
    for column in parts:
        rows = []
        for text in column:
            found = find(text, automaton)
            base = [s for s in found if s[0] < len(BASE)]
            rows.append((*[sum(k == i for k, _, _ in base) for i in range(len(BASE))],
                         hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
        yield pd.DataFrame(rows, columns=[*[f"n_{k}" for k in BASE], "base_sha256", "spans"])


def tag(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (code points, end exclusive).

    The base kinds are exactly the forms of their patterns that pass their checks. Cues add: ``login`` (name and password
    in an address), ``iban`` (behind the word, checksum 97) and ``account`` (6 to 18 digits behind an account word). Null and
    empty texts have no span; null ids, repeated rows and equal texts are kept. Other columns are not read. An empty table
    gives no rows. Rows are independent: nothing is shuffled.
    """
    run = F.pandas_udf(_tag, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
    return texts(docs, id_col, text_col).select("doc_id", run("text").alias("t")).select("doc_id", "t.*")
