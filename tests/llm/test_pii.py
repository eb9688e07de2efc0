"""Spans against the base patterns."""

import random
import re
import time

from framewright.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECES = ["@", "a.b", "-", "x", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (323) 555-9830", ".", " ", "+", "é",
          "12", "2.", "me@mail.com", "\n", "%", "5-", "http://a.b/c", "IBAN DE89370400440532013000", "account: 12345678", "+4", "٣", "(", ")"]


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:9] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c not in " -"]
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_base_spans_as_the_patterns_say():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == plain(text), text


def test_very_long_runs():
    for text in ("0" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" + "(" * 200_000, "4 " * 100_000, "@" * 100_000):
        assert {s[0] for s in pii.find_spans(text)} <= {"ip"}


def test_hostile_runs_take_linear_time():
    for piece in ("http://", "ACCT-", "ACCT-1", "http://a", "http://a.b,", "iban AB12 ", "a@", "a@b.", "+1(", "1.", "IBAN--", "account:"):
        begun = time.process_time()
        pii.find_spans(piece * (1_000_000 // len(piece)))
        assert time.process_time() - begun < 8, piece


def test_accounts_like_a_walk_from_every_cue():
    rng = random.Random(9)
    pieces = ["ACCT-", "acct ", "ACCT", "12", "345", "-", " ", ":", "AB", "x", "IBAN-", "678901", "."]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        want, done = [], 0
        for m in re.finditer(r"(?=(ACCT|acct|IBAN))", text):
            at = m.end(1)
            start = at + len(re.match(r"[ :#.=\-\t]{0,12}", text[at:])[0])
            if m.start() and text[m.start() - 1].isalpha() or start == at and text[start:start + 1].isalpha():
                continue
            word = re.match(r"[A-Z0-9-]*", text[start:])[0].rstrip("-")
            if 6 <= sum(c.isdigit() for c in word) <= 20 and start >= done:
                want.append(("account", start, start + len(word)))
                done = start + len(word)
        assert [s for s in pii.find_spans(text) if s[0] == "account"] == want, text


def test_added_spans_and_mask():
    text = "see http://a.example.com/x?y=1, IBAN DE89 3704 0044 0532 0130 00, account: 12345678, Mask@home"
    assert [s[0] for s in pii.find_spans(text)] == ["url", "iban", "account"]
    assert pii.mask(text, pii.find_spans(text)) == "see [URL], IBAN [IBAN], account: [ACCOUNT], Mask@home"
    assert pii.mask(None, []) is None and pii.find_spans(None) == []


def test_messy_rows(messy, none):
    got = {r.doc_id: r for r in pii.digest(pii.detect(messy)).collect() if r.doc_id != 3}
    assert (got[11].n_email, got[11].n_ip, got[11].n_card, got[11].n_phone) == (2, 1, 1, 1)
    assert got[0].spans == got[1].spans == "" and got[0].base_sha256 == got[1].base_sha256
    assert got[11].spans.startswith("email:5:19,email:23:37,ip:")
    masked = pii.mask_text(messy)
    assert masked.columns == messy.columns and masked.count() == messy.count()
    assert masked.where("doc_id = 11").first().text.count("[EMAIL]") == 2
    assert pii.detect(none).count() == 0
