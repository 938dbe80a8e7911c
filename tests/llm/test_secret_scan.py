import hashlib
import random
import re

from cohortspark.llm import secret_scan
from tests.conftest import SF_ORACLE
from tests.llm.conftest import rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TOKEN = "ghp_" + "aB3" * 10 + secret_scan.crc62(b"aB3" * 10).decode()


def brute(text):
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def scanned(text):
    raw = text.encode()
    return secret_scan._code_points(raw, secret_scan.find_secrets(raw))


def test_base_kinds_on_random_texts():
    rnd = random.Random(3)
    parts = ["password", "PassWord", "ſecret", "toKen", "api_key", "APIKEY", "=", " = ", ":",
             '"', "'", " ", "abc", "abcdef", "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef",
             "deadbeef" * 3, "é", "ß", "\n", "_", ".", "K", "İ", "card", "iban"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        assert [s for s in scanned(text) if s[2] in secret_scan.KINDS[:3]] == brute(text), text


def test_checksums_decide():
    text = (f"é {TOKEN} {TOKEN[:-1]}x iban: DE89 3704 0044 0532 0130 00, "
            "iban DE88 3704 0044 0532 0130 00; card 4111 1111 1111 1111 card 4111 1111 1111 1112 "
            "4111 1111 1111 1111")
    kinds = [(text[a:b], k) for a, b, k in scanned(text)]
    assert kinds == [(TOKEN, "forge"), ("DE89 3704 0044 0532 0130 00", "account"),
                     ("4111 1111 1111 1111", "card"), ("4111 1111 1111 1111", "card")]


def test_numbers_before_and_after_other_words():
    card, account = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    for text, want in [
            (f"card {card} 12/27", card), ("card: 4111111111111111 123", "4111111111111111"),
            (f"card {card} 4", card), (f"card 7 {card}", card), (f"card no. 2024 {card} 12", card),
            (f"card {card} 0000 1111", card), ("card 4111 1111 1111 1112 12/27", None),
            ("card 41111111111111111111111", None), ("card x4111111111111111", None),
            (f"IBAN {account} BIC COBADEFFXXX", account), (f"iban AB12 CD {account} EUR", account),
            ("iban: DE89370400440532013000 EUR 500", "DE89370400440532013000"),
            ("iban CH93 0076 2011 6238 5295 7 CHF", "CH93 0076 2011 6238 5295 7"),
            ("iban DE88370400440532013000 EUR 500", None), (f"iban {account}X", None)]:
        got = [text[a:b] for a, b, k in scanned(text) if k in ("card", "account")]
        assert got == ([want] if want else []), text


def test_documents(spark, checkpoints):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    got = {r.doc_id: r for r in secret_scan.secret_digest(
        secret_scan.scan_secrets(docs)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = brute(text)
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [
            sum(k == kind for _, _, k in want) for kind in secret_scan.KINDS[:3]]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r.spans.split(",")) or not line
    assert any(r.n_hex for r in got.values())


def test_edges_and_masking(spark, edge_docs, no_docs):
    got = secret_scan.scan_secrets(edge_docs)
    assert got.count() == edge_docs.count() and not any(r.secrets for r in got.collect())
    assert rows(secret_scan.secret_digest(secret_scan.scan_secrets(no_docs))) == []
    same = secret_scan.mask_secrets(edge_docs)
    assert same.schema == edge_docs.schema and rows(same) == rows(edge_docs)
    text = 'é token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" end deadbeefdeadbeefdeadbeef'
    df = spark.createDataFrame([(1, text, 9)], "doc_id long, text string, n_chars long")
    assert secret_scan.mask_secrets(df).first().text == 'é [assign]" end [hex]'


def test_many_keywords_without_numbers():
    assert scanned("card " * 50_000) == []


def account_ok(digits):
    size = secret_scan.ACCOUNT_SIZES.get(digits[:2].encode())
    return size in (None, len(digits)) and secret_scan.mod97(digits)


def brute_numbers(text, kind):
    """Numbers by trying every start and end in every announced line."""
    word, out, above = ("card" if kind == "card" else "iban"), [], False
    at = 0
    for line in text.split("\n"):
        places = [m.end() for m in re.finditer(word, line.lower())]
        begin = 0 if above else min(places, default=None)
        got, last = [], 0
        for a in range(0 if begin is None else begin, len(line) if begin is not None else 0):
            if a < last or (a and line[a - 1].isalnum() and line[a - 1].isascii()):
                continue
            for b in range(len(line), a, -1):
                part = line[a:b]
                digits = re.sub("[ -]" if kind == "card" else " ", "", part)
                if kind == "card":
                    fits = (re.fullmatch("[0-9]([ -]?[0-9]){12,18}", part)
                            and not re.match("[0-9]", line[b:b + 1]) and secret_scan.luhn(digits))
                else:
                    fits = (re.fullmatch("[A-Z]{2}[0-9]{2}( ?[A-Z0-9])+", part)
                            and not re.match("[A-Za-z0-9]", line[b:b + 1]) and 15 <= len(digits) <= 34
                            and digits[:2].encode() in secret_scan.ACCOUNT_SIZES
                            and account_ok(digits))
                if fits:
                    got.append((at + a, at + b, kind))
                    last = b
                    break
        out += got
        above = bool(got) and begin is not None or bool(places)
        at += len(line) + 1
    return out


def test_every_announced_number_is_found():
    one, two = "4111111111111111", "5500000000000004"
    for text in (f"cards: {one} {two}", f"cards:\n{one}\n{two}\nno more\n{one}",
                 f"card {'x ' * 200}{one}, then {two}", f"card\ncard\n{one}",
                 f"{one} card {two} {one[:-1]}2 {one}", f"none\n{one}"):
        got = [s for s in scanned(text) if s[2] == "card"]
        assert got == brute_numbers(text, "card"), text
    text = f"cards: {one} {two}"
    assert [text[a:b] for a, b, _ in scanned(text)] == [one, two]
    ibans = "IBAN DE89 3704 0044 0532 0130 00 and GB82 WEST 1234 5698 7654 32\nCH9300762011623852957"
    assert [ibans[a:b] for a, b, _ in scanned(ibans)] == [
        "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "CH9300762011623852957"]


def test_announced_numbers_on_random_texts():
    rnd = random.Random(8)
    parts = ["card", "Card no.", "4111 1111 1111 1111", "5500000000000004", "4111111111111112",
             "12", " ", " ", "\n", "x", "-", "iban", "DE89370400440532013000",
             "CH93 0076 2011 6238 5295 7", "DE88370400440532013000", ",", "EUR", "é"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 16)))
        for kind in ("card", "account"):
            got = [s for s in scanned(text) if s[2] == kind]
            assert got == brute_numbers(text, kind), (kind, text)
