"""Secret scan: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton over the lower-cased bytes finds the keywords; the
patterns are matched at those places only.  Kinds that carry a checksum (forge
and registry tokens with a CRC-32, account numbers modulo 97, card numbers by
Luhn) count only if it holds.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.text import texts_of, worker_store

# Base kinds, in the order they are listed; the validated kinds follow.
KINDS = ["assign", "access", "hex", "forge", "registry", "account", "card"]

# Patterns matched on bytes from a keyword's first byte on.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    rb"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
HEX_RUN = re.compile(rb"[0-9a-f]{24}")
FORGE = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
REGISTRY = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
ACCOUNT = re.compile(rb"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])")
ACCOUNT_START = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
ACCOUNT_REST = re.compile(rb"(?:\x20?[A-Z0-9])*")
CARD_START = re.compile(rb"(?<![A-Za-z0-9])[0-9]")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9]){12,18}")

# Characters of an account number, by country (ISO 13616 registry).
ACCOUNT_SIZES = {country: size for size, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items()
    for country in countries.encode().split()}

# keyword -> kind; "iban" and "card" announce the numbers of their line, see _announced
KEYWORDS = {b"password": "assign", b"passwd": "assign", b"secret": "assign", b"token": "assign",
            b"apikey": "assign", b"api_key": "assign", b"akia": "access",
            b"ghp_": "forge", b"gho_": "forge", b"ghu_": "forge", b"ghs_": "forge",
            b"ghr_": "forge", b"npm_": "registry", b"iban": "account", b"card": "card"}

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62(body: bytes) -> bytes:
    """CRC-32 of a token's random part as six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.encode()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _automaton():
    store = worker_store("secrets")
    if "automaton" not in store:
        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word.decode(), (len(word), kind))
        a.make_automaton()
        store["automaton"] = a
    return store["automaton"]


def _account_ends(text: bytes, at: int):
    """Where an account number may end: at its country's length, or, of an
    unknown country, as far as groups go."""
    size = ACCOUNT_SIZES.get(text[at:at + 2])
    if size:
        rest = ACCOUNT_REST.match(text, at + 4, at + 2 * size)  # a space at most before each
        places = [p for p in range(at + 4, rest.end()) if text[p] != 32]
        if len(places) >= size - 4:
            end = places[size - 5] + 1
            if not text[end:end + 1].isalnum():
                yield end
    elif m := ACCOUNT.match(text, at):
        yield m.end()


def _card_ends(text: bytes, at: int):
    """Where a card number may end: after 19 to 13 digits, before no digit."""
    if m := CARD.match(text, at):
        places = [p for p in range(at, m.end()) if text[p] not in b" -"]
        for p in reversed(places[12:]):
            if not text[p + 1:p + 2].isdigit():
                yield p + 1


def _numbers(text: bytes, begin: int, stop: int, starts, ends, check):
    """The numbers between two places whose checksum holds, from left to right."""
    last = begin
    for m in starts.finditer(text, begin, stop):
        if m.start() < last:
            continue
        for end in ends(text, m.start()):
            if check(re.sub(rb"[\x20-]", b"", text[m.start():end]).decode()):
                last = end
                yield m.start(), end
                break


def _announced(text: bytes, at: int, starts, ends, check):
    """All numbers that a keyword before ``at`` announces, and the place up to
    which no other keyword has to be looked at.

    They stand in the rest of the keyword's line, and in the lines after it as
    long as each holds one: a list below its heading is announced too.
    """
    found, begin = [], at
    while True:
        stop = text.find(b"\n", begin)
        stop = len(text) if stop < 0 else stop
        own = list(_numbers(text, begin, stop, starts, ends, check))
        found += own
        if not own and begin != at:
            return found, begin  # a keyword in this line has its own next line
        if stop == len(text):
            return found, stop
        begin = stop + 1


def find_secrets(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, ordered by start, then by kind as listed."""
    found = []
    end = dict.fromkeys(KINDS, 0)  # where the kind's last match ends
    # one code point a byte, so the automaton's places are byte places
    for last, (size, kind) in _automaton().iter(text.lower().decode("latin-1")):
        at = last + 1 - size
        if at < end[kind]:
            continue  # inside the previous match of the kind, or announced already
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                end[kind] = m.end()
                if len(m[2]) >= 6:
                    found.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                end[kind] = m.end()
                if m.end() - at >= 20:
                    found.append((at, m.end(), kind))
        elif kind in ("forge", "registry"):
            m = (FORGE if kind == "forge" else REGISTRY).match(text, at)
            if m and crc62(m[1]) == m[2]:
                end[kind] = m.end()
                found.append((at, m.end(), kind))
        else:
            spans, end[kind] = (_announced(text, at + size, ACCOUNT_START, _account_ends, mod97)
                                if kind == "account" else
                                _announced(text, at + size, CARD_START, _card_ends, luhn))
            found += [(*span, kind) for span in spans]
    at = 0
    while m := HEX_RUN.search(text, at):  # a run of hex digits begins where its first 24 do
        at = HEX.match(text, m.start()).end()
        found.append((m.start(), at, "hex"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _code_points(text: bytes, spans):
    """Byte spans as code point spans."""
    places = sorted({p for s in spans for p in s[:2]})
    at, n, out = 0, 0, {}
    for p in places:
        n += len(text[at:p].decode())
        at = p
        out[p] = n
    return [(out[a], out[b], k) for a, b, k in spans]


def _scan(batches):
    kind = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        out = []
        for text in texts_of(batch.column("text")):
            spans = find_secrets(text) if text else []
            out.append([{"kind": k, "first": a, "end": b}
                        for a, b, k in _code_points(text, spans)] if spans else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(kind))],
                                         names=["doc_id", "secrets"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, secrets): the secrets of every whole text.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are not
    read.  ``secrets`` lists kind, first and end (code points, end exclusive)
    by first, then by kind in the order of KINDS.  Base kinds are leftmost and
    non-overlapping within their kind: ``assign`` (a keyword, ``:`` or ``=``
    and a value of 6 or more characters), ``access`` (``AKIA``, 20 or more),
    ``hex`` (24 or more digits).  The other kinds need their checksum; account
    and card numbers also a keyword before them in their line, or in a line
    above from which every line down to theirs holds such a number.

    Null and empty texts have no secrets; a null doc_id and repeated rows are
    each returned as they are; spans of several kinds may overlap; an empty
    table gives no rows.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(_scan, "doc_id long, "
                               "secrets array<struct<kind: string, first: long, end: long>>"))


def _mask(batches):
    for batch in batches:
        out = []
        for text in texts_of(batch.column("text")):
            spans, parts, at = (find_secrets(text) if text else []), [], 0
            for a, b, k in spans:
                if b > at:
                    if a >= at:
                        parts += [text[at:a], b"[" + k.encode() + b"]"]
                    at = b
            out.append(text if not spans else b"".join(parts) + text[at:])
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(out, pa.binary()).cast(pa.string()))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every secret replaced by its kind in brackets.

    Overlapping secrets are masked together under the first one's kind.  All
    columns stay; null texts stay null.
    """
    return docs.mapInArrow(_mask, docs.schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, base counts, SHA-256 of the base spans and all spans as text."""
    base = F.filter("secrets", lambda s: s["kind"].isin(KINDS[:3]))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count("assign").alias("n_assign"),
                        count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
                        line(F.col("secrets")).alias("spans"))
