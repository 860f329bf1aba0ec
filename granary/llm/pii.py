"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, schemes (``://``) and identifier
cues (``iban``, ``ssn``, ...).  From each anchor a deterministic local parser expands to the boundaries of what stands there and
validates it.  Spans are in code points, end exclusive.

Base kinds, leftmost and non-overlapping within a kind, failing matches dropped without another try:

========  ======================================================================================================
email     ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
ip        ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of 255 at most
card      ``[0-9]([\\x20-]?[0-9])+`` with 12 to 19 digits that pass the Luhn check
phone     ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 9 to 15 digits
========  ======================================================================================================

Added kinds: ``url``, a web address with user information (``scheme://user:word@host``), and ``account``, an IBAN that passes
its mod-97 check or an identifier of at least 6 letters and digits, 4 of them digits, after a cue and a separator.

Null text is empty text; every row gives a row, also repeated ones and null doc_ids; other columns are ignored; an empty table
gives no rows.  Work is linear in the length of a text: each parser only reads on from its anchor or back to its last span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import column, lean, read_table, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
CUES = ("iban", "ssn", "social security number", "passport", "account", "acct", "customer id", "tax id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"]*)?")
_LABELLED = re.compile(r"(?:\s*(?:no\.?|number|#))?\s*[:=#]\s*([A-Za-z0-9](?:[A-Za-z0-9]|[ -](?=[A-Za-z0-9]*[0-9]))*)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}")


@lru_cache(1)
def _anchors() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, code in [("@", 0), ("+", 1), ("://", 2), *((str(d), 3) for d in range(10))]:
        made.add_word(word, (code, len(word)))
    for cue in CUES:
        for word in (cue, cue.upper(), cue.capitalize(), cue.title()):
            made.add_word(word, (4, len(word)))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i & 1:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends at `at`, if it holds what an identifier must."""
    got = _LABELLED.match(text, at)
    if not got:
        return None
    start = got.start(1)
    if (coded := _IBAN.match(text, start)) and iban(coded[0]):
        return start, coded.end()
    value = got[1]
    solid = sum(c.isalnum() for c in value)
    if 6 <= solid <= 34 and sum(c.isdigit() for c in value) >= 4:
        return start, got.end(1)
    return None


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by start, then by kind as listed."""
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = run_end = url_end = account_end = 0
    for last, (code, width) in _anchors().iter(text):
        at = last - width + 1
        if code == 3:
            if at < run_end:
                continue
            run_end = _DIGITS.match(text, at).end()
            if at >= ip_end and (got := _IP.match(text, at)):
                ip_end = got.end()
                if all(len(p := part.lstrip("0")) < 4 and int(p or "0") < 256 for part in got.groups()):
                    out.append((at, 1, ip_end))
            if at >= card_end and (got := _CARD.match(text, at)):
                card_end = got.end()
                digits = got[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, card_end))
        elif code == 0:
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (got := _DOMAIN.match(text, at + 1)):
                email_end = got.end()
                out.append((start, 0, email_end))
        elif code == 1:
            if at >= phone_end and (got := _PHONE.match(text, at)):
                phone_end = got.end()
                if 9 <= sum(c.isdigit() for c in got[0]) <= 15:
                    out.append((at, 3, phone_end))
        elif code == 2:
            start = at
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and text[start].isalpha() and (got := _URL.match(text, at + 3)):
                url_end = got.end()
                out.append((start, 4, url_end))
        elif at >= account_end and not (at and text[at - 1].isalnum()) and (got := _account(text, last + 1)):
            account_end = got[1]
            out.append((got[0], 5, account_end))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(out)]


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the spans of each whole text as an array of (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text"):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t or "")] for t in column(batch, "text").to_pylist()]
            yield pa.record_batch([column(batch, "doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(run), "doc_id long, spans array<struct<kind:string, start:long, `end`:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and the list of all spans."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in row] for row in column(batch, "spans").to_pylist()]
            counts = {k: pa.array([sum(kind == k for kind, _ in row) for row in rows], pa.int64()) for k in KINDS}
            sums = [hashlib.sha256(",".join(s for kind, s in row if kind in BASE).encode()).hexdigest() for row in rows]
            yield pa.record_batch([column(batch, "doc_id"), *(counts[k] for k in BASE), pa.array(sums), pa.array([",".join(s for _, s in row) for row in rows], pa.string()), counts["url"], counts["account"]], names=names)

    return found.mapInArrow(lean(run), FOUND)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one names the whole."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(read_table(spark, sf_dir, "documents")))
