"""Forms of secrets that are no ``token = "<40 hex>"``, planted among plain findings."""

import random
import string

import pytest

from gabble.llm import secrets
from tests.llm import data

RNG = random.Random(12)
HEX = "".join(RNG.choice("0123456789abcdef") for _ in range(40))


def some(n, signs=string.ascii_letters + string.digits):
    return "".join(RNG.choice(signs) for _ in range(n))


JWT = f"eyJ{some(20)}.eyJ{some(40)}.{some(43)}"
PEM = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(some(64) for _ in range(4)) + "\n-----END RSA PRIVATE KEY-----"
AWS = "AKIA" + some(16, string.ascii_uppercase + string.digits)
FORMS = [
    (f"the key {AWS} is live", AWS), (x := "ghp_" + some(36), x), (f"Authorization: Bearer {HEX}", HEX), (f"see {JWT} there", JWT),
    (f"before\n{PEM}\nafter", PEM), (f'accessToken = "{HEX}"', HEX), (f"dbPassword: {HEX}", HEX),
    ('password = "P@ssw0rd!xyz12345"', "P@ssw0rd!xyz12345"), ("password=Tr0ub4dor&3isthesecret", "Tr0ub4dor&3isthesecret"),
    ('secret = "hunter2x"', "hunter2x"), ("url?token=abc123def456&user=me", "abc123def456"), ('pwd = "it\'s 4 me!"', "it's 4 me!"),
]


@pytest.mark.parametrize("text, value", FORMS)
def test_forms_are_candidates_as_a_whole(text, value):
    assert value in [v for _, _, v, _, _ in secrets.find(text)]


def test_planted_forms_are_secrets_and_plain_findings_are_not(spark):
    rows = [(i, f"Some plain words. {text}\nMore words.") for i, (text, _) in enumerate(FORMS)]
    plain = [f"commit {some(40, '0123456789abcdef')} merged" for _ in range(150)]
    plain += [f"order number {some(16, string.digits)} shipped" for _ in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(plain)]
    found = secrets.scan(data.frame(spark, rows)).where("is_secret").collect()
    got = {(r.doc_id, r.value) for r in found}
    assert got == {(i, value) for i, (_, value) in enumerate(FORMS)}
    left = {r.doc_id: r.text for r in secrets.redact(data.frame(spark, rows)).collect()}
    assert all(value not in left[i] for i, (_, value) in enumerate(FORMS)) and left[1000] == plain[0]


def test_rare_secrets_are_among_the_labels(spark):
    rows = [([float(i), 0.0], 0) for i in range(3000)] + [([float(i), 1.0], 1) for i in (500, 1500, 2500)]
    model = secrets.train(spark.createDataFrame(rows, "features array<double>, label int"), 100)
    assert not isinstance(model, float)
    got = secrets.scored(spark.createDataFrame([([1700.0, 1.0],), ([700.0, 0.0],)], "features array<double>"), model).collect()
    assert [r.score > 0.5 for r in got] == [True, False]
