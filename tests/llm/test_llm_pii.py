"""Personal-data spans against plain patterns on random strings; cues and odd rows."""

import hashlib
import random
import re

from eligra.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    return sorted(out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


PIECES = ["@", ".", "a", "b-", "1", "12", "255", "+", "+4", "(", ")", " ", "-", "1.2.3.4", "x@y.z", "@@", "..", "é", "300.1.1.1", "1 2", "4111 1111 1111 1111",
          "+49 (0) 123 4567", "\n", "%", "٣", "5500005555555559", "://"]


def test_base_spans_equal_plain_patterns():
    rng, automaton = random.Random(8), pii._automaton()
    for _ in range(20_000):
        text = "".join(rng.choices(PIECES, k=rng.randint(1, 14)))
        assert [s for s in pii.find(text, automaton) if s[0] < 4] == plain(text), text


def test_cues_add_spans():
    text = "https://bob:pw1@host.x/ IBAN: DE89 3704 0044 0532 0130 00 and account no: 12345678, IBAN DE00 3704 0044 0532 0130 00"
    assert pii._joined(pii.find(text, pii._automaton())) == "email:12:22,login:8:15,iban:30:57,account:74:82"


def test_table_with_odd_rows(spark):
    texts = {1: "mail a@b.cd", 2: None, 3: "", 4: "z " * 100_000 + "+49 123 456789", 5: "9" * 50_000}
    rows = [(d, t, "x") for d, t in texts.items()] + [(None, "1.2.3.4", "x"), (1, "mail a@b.cd", "x")]
    got = pii.tag(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == 7
    for r in got:
        text = "1.2.3.4" if r.doc_id is None else texts[r.doc_id] or ""
        want = plain(text)
        assert r.base_sha256 == hashlib.sha256(pii._joined(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in want) for i in range(4))
    assert pii.tag(spark.createDataFrame([], "doc_id long, text string")).count() == 0
