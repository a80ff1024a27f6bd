"""What the review of round 1 found."""

import collections
import re

import numpy as np
import pytest

from loamwork.llm import lm, pii, queries


def brute_scores(rows, target):
    """(target, background) bits a token of each row (id, words): all counts but the row's own, matched in size."""
    grams = [(collections.Counter(t), collections.Counter(zip(t, t[1:], strict=False))) for _, t in rows]
    models = []
    for chosen in (target, lambda i: True):
        one, two = collections.Counter(), collections.Counter()
        for (i, _), (a, b) in zip(rows, grams, strict=True):
            if chosen(i):
                one += a
                two += b
        models.append((one, two))
    size = len(models[1][0]) + 1
    scale = models[0][0].total() / models[1][0].total() if models[0][0] else 1.0

    def cost(i, t, own, model, r, chosen):
        one, two = model
        mine = own if chosen(i) else (collections.Counter(), collections.Counter())
        n = {w: one[w] - mine[0][w] for w in own[0]}
        p = [(r * n[w] + 1) / (r * (one.total() - mine[0].total()) + size) for w in t]
        p[1:] = [0.7 * q + 0.3 * (two[a, b] - mine[1][a, b]) / max(n[a], 1) for q, a, b in zip(p[1:], t, t[1:], strict=False)]
        return -np.log2(p).sum() / len(t) if t else 0.0

    return [(cost(i, t, own, models[0], 1.0, target), cost(i, t, own, models[1], scale, lambda i: True)) for (i, t), own in zip(rows, grams, strict=True)]


def test_lm_counts_are_exact(spark):
    rnd = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(3000)])
    texts = [" ".join(words[rnd.integers(0, 3000, n)]) for n in rnd.integers(0, 300, 60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, None), (None, "w1 w2"), (7, texts[7])], "doc_id long, text string").repartition(3)
    rows = [(i, t.split()) for i, t in [*enumerate(texts), (60, ""), (None, "w1 w2"), (7, texts[7])]]
    want = brute_scores(rows, lambda i: i is not None and i < 20)
    want = sorted((i is None, i or 0, len(t), round(a, 9), round(b, 9)) for (i, t), (a, b) in zip(rows, want, strict=True))
    got = lm.score(docs, docs.where("doc_id < 20").select("doc_id")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.target_bits, 9), round(r.background_bits, 9)) for r in got) == want


def test_lm_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    good = {r.doc_id for r in queries.labels(spark, sf).where("quality = 1").collect()}
    rows = [(r.doc_id, re.findall(r"\w+", (r.text or "").lower())) for r in queries.documents(spark, sf).collect()]
    want = {i: x for (i, _), x in zip(rows, brute_scores(rows, good.__contains__), strict=True)}
    got = queries.op9_lm_scoring(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose((r.target_bits, r.background_bits, r.bits_difference), (*want[r.doc_id], want[r.doc_id][0] - want[r.doc_id][1]), atol=1e-9)


def test_documents_that_occur_twice_stand_apart(spark):
    rnd = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rnd.integers(0, 5000, 200)]) for _ in range(120)]
    rows = [*enumerate(texts), *((200 + i, texts[i]) for i in range(10))]
    got = {r.doc_id: r.background_bits for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(50, 80)], "doc_id long")).collect()}
    assert max(got[i] for i in (*range(10), *range(200, 210))) < min(got[i] for i in range(10, 120))


def test_lm_keys_do_not_share_slots():
    keys = lm.Keys().of(" ".join(f"w{i}" for i in range(300_000)))
    assert len(np.unique(keys)) == 300_000 and len(np.unique(lm.pair_keys(keys[:-1], keys[1:]))) == 299_999


def test_lm_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, docs.select("doc_id")).collect() == []


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("BE68 5390 0754 7034 EUR", "iban"), ("ES91 2100 0418 4502 0005 1332 BIC", "iban"), ("HU42 1177 3016 1111 1018 0000 0000", "iban"), ("CZ6508000000192000145399", "iban"),
        ("GR16 0110 1250 0000 0001 2300 695", "iban"), ("RO49 AAAA 1B31 0075 9384 0000", "iban"), ("TR33 0006 1005 1978 6457 8413 26", "iban"), ("PO42 4111 1111 1111 1111", "card"),
        ("1-800-555-1234", "phone"), ("(555)123-4567", "phone"), ("1 (800) 555-1234", "phone"), ("+33 1 23 45 67 89", "phone"), ("0033 1 23 45 67 89", "phone"), ("01 23 45 67 89", "phone"),
        ("+33 1 23 45 67 89 2024-01", "phone"), ("3/14/1999", "date"), ("12-31-1999", "date"), ("1999-1-2", "date"), ("1.2.1999", "date"),
    ],
)
def test_pii_is_found_in_all_forms(text, kind):
    new, counts = pii.mask(f"See {text}, please", b"key")
    assert counts == {kind: 1} and text not in new
    assert pii.mask(new, b"key")[1] == counts
    assert kind == "date" or len(new) == len(f"See {text}, please")


def test_dates_stay_linked_in_all_forms():
    for day, month, year in ((31, 12, 1999), (14, 3, 2020)):
        forms = f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{month:02d}/{day:02d}/{year}"
        a, b, c = (re.split("[-./]", pii.mask(f, b"key")[0]) for f in forms)
        assert a == b[::-1] == [c[2], c[0], c[1]] and int(a[2]) > 12


def test_equal_values_are_linked_in_all_forms():
    digits = lambda t: re.sub("[^0-9]", "", pii.mask(t, b"key")[0])
    forms = ["+1 (017) 555-7713", "+1 017 555 7713", "+1 017-555-7713", "+10175557713", "1-017-555-7713", "1 (017) 555-7713"]
    assert len({digits(f) for f in forms}) == 1 and digits("(017) 555-7713") == digits(forms[0])[1:]
    assert digits("+33 1 23 45 67 89")[2:] == digits("01 23 45 67 89")[1:] == digits("0033 1 23 45 67 89")[4:]
    mails = [pii.mask(m, b"key")[0] for m in ("john.doe@mail.example.com", "John.Doe@Mail.example.com", "JOHN.DOE@MAIL.EXAMPLE.COM")]
    assert len({m.lower() for m in mails}) == 1 and len(set(mails)) == 3 and mails[0] != "john.doe@mail.example.com"
    low, up = (pii.mask(f"token={t}", b"key")[0].partition("=")[2] for t in ("0a1b2c3d" * 5, "0A1B2C3D" * 5))
    assert low.upper() == up and low != "0a1b2c3d" * 5


def test_long_values_have_no_clear_part():
    name, token = "n" * 300 + "x7", "a1" * 200
    new, counts = pii.mask(f"{name}@mail.example.com secret: {token} key=AbC9_xYz-12345678901 password = onlyletterspassword", b"key")
    assert counts == {"email": 1, "secret": 2} and name[:20] not in new and token[:20] not in new and "AbC9" not in new and "onlyletterspassword" in new


def test_pii_query_is_row_by_row(spark, sf):
    """The query over the whole table against a plain search with the same definitions of cards, dates and secrets."""
    key = queries.pii_key(spark)
    texts = {r.doc_id: r.text for r in queries.documents(spark, sf).collect()}
    found = collections.Counter()
    for r in queries.op10_pii(spark, sf).collect():
        t = texts[r.doc_id]
        if t is None:
            assert r.text is None and r.n_found == 0
            continue
        assert (r.text, r.n_found) == (pii.mask(t, key)[0], sum(pii.mask(t, key)[1].values()))
        cards = [m for m in re.findall(r"(?<![0-9A-Za-z.])[0-9]{16}(?![0-9A-Za-z]|[.-][0-9])", t) if not _luhn(m) and len(set(m)) > 1]
        tokens = re.findall(r"token = \"([0-9a-f]{40})\"", t)
        assert r.n_card >= len(cards) and r.n_secret >= len(tokens)
        assert not any(x in r.text for x in (*cards, *tokens))
        found.update(cards=len(cards), tokens=len(tokens), mails=r.n_email, rows=r.n_found > 0)
    assert min(found[k] for k in ("tokens", "mails", "rows")) > 3


def _luhn(digits):
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10
