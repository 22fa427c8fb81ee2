"""Token links against plain loops over byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from eligra.llm import alignment as al
from eligra.llm.queries import TOKENIZERS

LEVEL, PIECE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pair():
    with open(LEVEL, encoding="utf-8") as f, open(PIECE, "rb") as g:
        return al.Pair(f.read(), g.read())


def plain(pair, rows):
    """(doc_id, n_a, ...) by comparing the byte ranges of all tokens of a text."""

    def ranges(ids, table):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(table[i])))
            at += len(table[i])
        return out

    docs = []
    for d, t in rows:
        t = t or ""
        a = ranges(pair.level.encode(" " + t, add_special_tokens=False).ids, pair.a)
        b = ranges(pair.piece.encode(t), pair.b)
        whole = (" " + t).encode()
        if not t or b"".join(pair.a[i] for i, _, _ in a) != whole or b"".join(pair.b[i] for i, _, _ in b) != whole:
            docs.append((d, [], [], [], []))
            continue
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        cuts = [0, *sorted({e for _, _, e in a} & {e for _, _, e in b})]
        groups = [([i for i, s, e in a if lo <= s and e <= hi], [j for j, s, e in b if lo <= s and e <= hi]) for lo, hi in zip(cuts, cuts[1:])]
        docs.append((d, a, b, links, groups))
    count = Counter(x for doc in docs for x in doc[3])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for d, a, b, links, groups in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def data():
    rng = random.Random(5)
    words = "the and Über naïve 日本語 token izer's 12345 \U0001f600 a▁b <|endoftext|> <unk> <s> <0x41> x\ty \n\n   é́ ﬁ don't \x00 internationalisation".split(" ")
    rows = [(i, rng.choice(["", " "]).join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(220)]
    return rows + [(None, "the and the"), (None, "the and the"), (3, rows[3][1]), (3, rows[3][1]), (900, None), (901, ""), (902, " "), (903, "abc" * 700), (904, "a b " * 700)]


@pytest.mark.parametrize("limit", [al.PAIRS, 40])
def test_equals_plain_loops(spark, pair, monkeypatch, limit):
    monkeypatch.setattr(al, "PAIRS", limit)
    rows = data()
    df = spark.createDataFrame([(d, t, 1, "p") for d, t in rows], "doc_id long, text string, block int, pair string").repartition(4)
    got = al.align(df, LEVEL, PIECE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain(pair, rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[1] == 0 and r[0] not in (900, 901) for r in want) and sum(r[1] > 0 for r in want) > 100


def test_identity_array_holds_same_bytes(pair):
    assert all(pair.b[j] == pair.a[i] for i, j in enumerate(pair.identity) if j >= 0)
    assert (pair.identity >= 0).sum() > 10_000


def test_empty_table_and_ids_of_another_type(spark):
    assert al.align(spark.createDataFrame([], "doc_id long, text string"), LEVEL, PIECE).count() == 0
    got = al.align(spark.createDataFrame([("x", "one two"), (None, None)], "doc_id string, text string"), LEVEL, PIECE).collect()
    assert {r.doc_id: r.n_groups > 0 for r in got} == {"x": True, None: False}


def test_names_are_made_once_and_counts_need_no_table_of_keys(pair):
    text = "one two three, Über 日本語"
    first = al.Links(pair, [text, "", "two"]).digests()
    made = list(pair.names)
    assert al.Links(pair, [text]).digests() == first[:1] and first[1] == ""
    assert all(x is y for x, y in zip(made, pair.names)) and 0 < sum(x is not None for x in made) == pair.named.sum()
    rng = np.random.default_rng(1)
    doc, key = np.sort(rng.integers(0, 9, 500)), rng.integers(0, 40, 500)
    for x, y in zip(al._counted(doc, key), al._counted(doc, key, 40)):
        assert x.tolist() == y.tolist()
