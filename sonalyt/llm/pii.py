"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust a score.

The base kinds email, ip, card and phone are found leftmost and non-overlapping within a kind; what fails its check (parts of an
address above 255, Luhn, counts of digits) is dropped without another try. They always stay. The method adds two
kinds: iban (mod-97) and secret (a long hexadecimal string), whose score, moved by words nearby, must reach FLOOR.
All spans have a score; offsets are code points, ends are exclusive.

Nulls: a null text is empty and has no spans. Long runs of letters or digits cost no more than their length: candidates grow
from the rare character that they need ("@", "+", a digit), and repeated parts never give back what they took. Spans of different kinds may
overlap; within a kind the leftmost wins, so there are no ties. Repeated rows give repeated rows. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pieces, table, texts

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]
FLOOR = 0.6
#: score of a span whose check passed, without words nearby; words that raise it and words that lower it, within REACH characters on either side
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "secret": 0.4}
RAISE = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "client", "address"),
    "card": ("card", "visa", "credit", "payment", "debit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte"),
    "secret": ("token", "secret", "key", "password", "api"),
}
LOWER = {"ip": ("version", "release"), "card": ("order", "invoice", "isbn"), "secret": ("sha1", "md5", "commit", "checksum"), "iban": ("serial",)}
REACH, UP, DOWN = 40, 0.2, 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9]([\x20().0-9-]++)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])")
_DIGITS = re.compile(r"[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return sum(_DOUBLED[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at + 1)  # no later match can begin before an @ that it doesn't hold
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    if text.count(".") < 3:
        return []
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        end = at + 1
        if m:
            last = len(m[1].rstrip(" ().-"))  # the last digit ends the match; it needs one character before it
            if last >= 2:
                end = m.start(1) + last
                if 9 <= len(_DIGITS.findall(text, at, end)) <= 15:
                    out.append((at, end))
        at = text.find("+", end)
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """The longest run of whole groups that passes mod-97, so words in capitals or digits after a number don't spoil it."""
    out, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.start() + 2
        for end in [m.end(), *(m.start() + i for i in range(m.end() - m.start() - 1, 14, -1) if m[0][i] == " ")]:
            number = text[m.start() : end].replace(" ", "")
            if len(number) >= 15 and mod97(number):
                out.append((m.start(), end))
                at = end
                break
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _HEX.finditer(text)]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones, ibans, secrets), strict=True))


def score(kind: str, text: str, start: int, end: int) -> float:
    near = set(re.findall(r"[a-z0-9]+", f"{text[max(0, start - REACH) : start]}|{text[end : end + REACH]}".lower()))
    up = any(w in near for w in RAISE[kind])
    down = any(w in near for w in LOWER.get(kind, ()))
    return round(min(1.0, max(0.0, SCORES[kind] + UP * up - DOWN * down)), 3)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start."""
    out = []
    digit = _DIGITS.search(text) is not None
    for kind in KINDS:
        if digit or kind == "email" or kind == "secret":  # the other kinds need a digit
            for start, end in FINDERS[kind](text):
                s = score(kind, text, start, end)
                if kind in BASE or s >= FLOOR:
                    out.append((kind, start, end, s))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and its spans as an array of (kind, start, end, score)."""

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def one(c):
        found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t)] for _, part in pieces(c["text"]) for t in part]
        return {"doc_id": c["doc_id"], "found": pa.array(found, type=span)}

    return map_batches(texts(docs), one, "doc_id long, found array<struct<kind: string, start: long, end: long, score: double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans, all spans and the highest score, from personal_data()."""

    def count(kind):
        return F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(column):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    base = F.filter("found", lambda x: x.kind.isin(*BASE))
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.array_max(F.transform("found", lambda x: x.score)).alias("max_score"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(table(spark, sf_dir, "documents")))
