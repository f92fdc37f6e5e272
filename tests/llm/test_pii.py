import hashlib
import random
import re

from helpers import documents

from millrace.llm import pii

BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def naive(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns_on_random_texts():
    rng = random.Random(1)
    pieces = ["@", "a", "b.", "-", ".", "1", "4111111111111111", "255", "256", "+", " ", "(", ")", "x@y.z", "é", "1.2.3.4", "\n", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        got = [(s, k, e) for s, e, k, _ in pii.find_spans(text) if k < 4]
        assert got == naive(text), text


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = lambda t: [pii.KINDS[k] for *_, k, _ in pii.find_spans(t)]
    assert "iban" in kinds("IBAN GB82 WEST 1234 5698 7654 32 ok")
    assert "iban" not in kinds("IBAN GB83 WEST 1234 5698 7654 32 ok")
    assert "ssn" in kinds("social security 123-45-6789") and "ssn" not in kinds("part 123-45-6789")
    plain, near = pii.find_spans("x a@b.cd"), pii.find_spans("mail a@b.cd")
    assert near[0][3] > plain[0][3]


def test_long_runs_take_linear_time():
    assert pii.find_spans("a" * 300_000 + "1" * 300_000 + "+" * 1000 + "@" * 1000) == []


def test_query_columns(spark):
    text = "é mail a@b.cd and 10.0.0.1"
    rows = pii.digest(pii.detect(documents(spark, [text, None, "", text], [1, 2, None, 1]).selectExpr("*", "1 as id", "2 as t"))).collect()
    assert len(rows) == 4
    for r in rows:
        if r.doc_id == 1:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0) and r.spans == "email:7:13,ip:18:26"
            assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        else:
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.detect(documents(spark, [])).count() == 0
    assert pii.redact(documents(spark, [text])).first().text == "é mail <email> and <ip>"
