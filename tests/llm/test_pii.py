"""Base spans against the plain patterns; checks, context and masking on examples."""

import random
import re
from hashlib import sha256

from flowsieve.llm import pii

from .conftest import ODD, SF_DIR

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(digits[::-1]))
        out += [(m.start(), 2, m.end())] if 14 <= len(digits) <= 19 and total % 10 == 0 else []
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def base(text):
    return [(s.start, s.kind, s.end) for s in pii.find_spans(text) if s.kind < len(pii.BASE_KINDS)]


def test_random_texts():
    draw = random.Random(5)
    parts = ["@", ".", "1", "25", "a", "b-", " ", "+", "-", "(", "%", "4", "0", "9", "é", "3.4.5.6", "+12345678", "4111 1111 1111 1111"]
    for _ in range(20000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 40)))
        assert base(text) == brute(text), text


def test_checks_and_context():
    kinds = lambda t: [pii.KINDS[s.kind] for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00") == ["iban"] and kinds("DE88 3704 0044 0532 0130 00 x") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    near, far = (pii.find_spans(t)[0].score for t in ("card 4111111111111111", "x 4111111111111111"))
    assert near > far


def test_masking():
    text = "a x@y.zz, 1.2.3.4 and +1 (274) 555-9629!"
    assert pii.masked(text, pii.find_spans(text)) == "a <EMAIL>, <IP> and <PHONE>!"
    assert pii.masked(None, []) is None and pii.masked("", []) == ""


def test_long_runs_take_time_in_proportion():
    for part in ("a", "1", "1.", "+1", "a@", "1-"):
        assert pii.find_spans(part * 200_000) is not None


def test_query(spark, texts):
    for r in pii.op4_pii(spark, SF_DIR).collect():
        spans = brute(texts[r.doc_id] or "")
        joined = ",".join(f"{pii.BASE_KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_odd_rows(odd, clashing):
    assert pii.find(clashing).count() == pii.mask(clashing).count() == len(ODD)
    assert pii.mask(clashing).columns == clashing.columns
    assert sorted(map(str, pii.mask(odd).collect())) == sorted(map(str, odd.collect()))
    assert pii.find(odd.limit(0)).count() == 0
