"""The base spans of the secret and PII scans against the contracts' patterns, on random texts."""

import hashlib
import random
import re

from lexmill.llm import pii, secrets

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRETS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def keep(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
        "assign": lambda: len(m[2]) >= 8,
        "access": lambda: len(m[0]) >= 16,
        "hex": lambda: len(m[0]) >= 32,
    }[kind]()


def by_hand(text, patterns):
    found = [(m.start(), k, m.end(), name) for k, (name, p) in enumerate(patterns.items()) for m in re.finditer(p, text) if keep(name, m)]
    joined = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))
    return {name: sum(f[3] == name for f in found) for name in patterns}, hashlib.sha256(joined.encode()).hexdigest()


def texts(rng, pieces):
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", None]


def test_personal_data(spark):
    rng = random.Random(1)
    card = "4111 1111 1111 1111"
    rows = list(enumerate(texts(rng, ["a", "é", "@", ".", "-", " ", "b.c", "x@y.z", "%", "1.2.3.4", "255", "256", ".", "0", "7", "12", card, card[:-1], "-", "+", "+1 ", "(", ")", "555", "4111-1111-1111-1111", "+1 (415) 555-2671", " 8.8.4.4 ", " ", " ", "\n", "😀"])))
    out = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        counts, digest = by_hand(t or "", PII)
        assert {k: out[i][f"n_{k}"] for k in PII} == counts and out[i].base_sha256 == digest, t
    assert sum(r.n_email for r in out.values()) > 100 and min(sum(r[f"n_{k}"] for r in out.values()) for k in PII) > 20


def test_secrets(spark):
    rng = random.Random(2)
    rows = list(enumerate(texts(rng, ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", "api", "'", '"', " ", ":", "=", "a1B2", "abcdef01", "é", "/", "AKIA", "AKIAB", "Z9Z9Z9Z9", "0af1" * 8, "0af1", "\n", "ghp_", "x" * 12, "\tq", "ſecret", "toKen"])))
    out = {r.doc_id: r for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        counts, digest = by_hand(t or "", SECRETS)
        assert {k: out[i][f"n_{k}"] for k in SECRETS} == counts and out[i].base_sha256 == digest, t
    assert min(sum(r[f"n_{k}"] for r in out.values()) for k in SECRETS) > 5
