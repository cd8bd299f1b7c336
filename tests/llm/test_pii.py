import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sonalyt.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-+ 0123456789()%_é\n", max_size=60))
def test_base_spans_are_those_of_the_expressions(text):
    assert [x[:3] for x in pii.find(text) if x[0] in pii.BASE] == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "x.y@z-1.com", ".@", "@", "1.2.3.4", "255.256.1.1", "4111111111111111", "4111 1111 1111 1111", "+1 (234) 555-6789", "+12", "+1 -. ", " ", "-", "."]), max_size=8))
def test_joined_examples(parts):
    assert [x[:3] for x in pii.find("".join(parts)) if x[0] in pii.BASE] == brute("".join(parts))


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [x[0] for x in pii.find(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    for tail in (" BIC COBADEFF", " I", " 12/05", ".", ""):
        text = f"to DE89 3704 0044 0532 0130 00{tail}"
        assert [text[a:b] for k, a, b, _ in pii.find(text) if k == "iban"] == ["DE89 3704 0044 0532 0130 00"], tail
    hexes = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert kinds(f'token = "{hexes}"') == ["secret"] and kinds(f"sha1 {hexes}") == [] and kinds(hexes) == []
    assert pii.score("card", "my card 4111", 8, 12) > pii.score("card", "order 4111", 6, 10) and pii.score("card", "4111 is my card", 0, 4) > pii.score("card", "4111 is mine", 0, 4)


def test_long_runs_are_linear():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000, "a@b." * 50_000, "A1" * 100_000):
        pii.find(text)


def test_query_columns(docs, rows):
    got = {str(r.doc_id): r for r in pii.digest(pii.personal_data(docs)).collect()}
    for doc, text, *_ in rows:
        if doc is not None:
            base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text or ""))
            assert got[str(doc)].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_empty(nothing):
    assert pii.digest(pii.personal_data(nothing)).count() == 0
