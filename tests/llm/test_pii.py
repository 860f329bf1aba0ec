import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from granary.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType())])


def valid(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int("0" + p.lstrip("0")) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(k, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def base(text):
    return [s for s in pii.spans(text) if s[0] in pii.BASE]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="01259.-+ ()@aZ_%é\n:/", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.d", "@", "4539 1488 0343 6467", "378282246310005", "1.2.3.4", "256.1.1.1", "+1 (555) 123-4567", "+", "5", "-", " ", ".", "x", "://", "https://u:p@h.org/x", "IBAN: GB82 WEST 1234 5698 7654 32"]), max_size=12))
def test_base_spans_of_joined_parts(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["0", "7", "0.", "-7", " 1", "+1", "a", "a.", "@", "é"]), st.integers(1, 6000)), max_size=6))
def test_base_spans_of_long_runs(parts):
    text = "".join(c * n for c, n in parts)
    assert base(text) == [s for s in brute(text)]


def test_numbers_beyond_what_int_reads():
    assert pii.spans("0" * 5000 + ".0.0.0") == [("ip", 0, 5006)]
    assert base("9" * 5000 + ".0.0.0") == []


def test_added_kinds():
    text = "see ftp://joe:pw@files.example.org/a?b, IBAN: GB82 WEST 1234 5698 7654 32. SSN: 123-45-6789 and account holder, accounts: none"
    got = {(k, text[a:b]) for k, a, b in pii.spans(text) if k not in pii.BASE}
    assert got == {("url", "ftp://joe:pw@files.example.org/a?b,"), ("account", "GB82 WEST 1234 5698 7654 32"), ("account", "123-45-6789")}
    assert pii.spans("plain words, https://example.org/page and 12 apples + 3 pears") == []


def test_redact():
    text = "mail a@b.org or +1 (555) 123-4567!"
    assert pii.redact(text, pii.spans(text)) == "mail [email] or [phone]!"


def test_query(spark):
    path = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"select doc_id, text from '{path}/documents.parquet'").fetchall())
    rows = pii.query(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in PATTERNS)


def test_edges(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, "é a@b.org", "s"), (3, "7" * 100_000 + "@" * 1000, "s"), (3, "7" * 100_000 + "@" * 1000, "s")]
    out = pii.digest(pii.find(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.spans) for r in out) == [(0, 1, "email:2:9"), (1, 0, ""), (2, 0, ""), (3, 0, ""), (3, 0, "")]
    assert pii.digest(pii.find(spark.createDataFrame([], SCHEMA))).collect() == []
