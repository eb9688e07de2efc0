"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single pass: at-signs, URL
schemes, plus signs, digits and the cue words of identifiers.  A small local parser per
kind grows an anchor to the left and right and validates what it holds.

Base kinds (fixed by their patterns, leftmost and non-overlapping per kind): ``email``,
``ip`` (parts at most 255), ``card`` (16 to 19 digits with a valid Luhn sum) and ``phone``
(8 to 15 digits).  The method adds ``url`` (scheme, host and path), ``iban`` (mod-97) and
``account`` (6 to 20 digits or letters with digits after a cue).

Spans are code points, end exclusive.  Null texts count as empty and have no spans; rows
are handled one by one, so repeated rows and ids repeat; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import bound_text_batches

# The kinds in the order of the digest, base kinds first.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE = KINDS[:4]
# What opens a URL, and what announces an account.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "konto", "compte", "cuenta", "iban", "passport", "ssn")

_DIGITS = frozenset("0123456789")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _UPPER | frozenset("abcdefghijklmnopqrstuvwxyz")
_LABEL = _LETTERS | _DIGITS | {"-"}
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_DIALLED = _DIGITS | frozenset(" ().-")
_CODE = _UPPER | _DIGITS | {"-"}
_NOT_URL = frozenset(" \t\r\n\v\f<>\"'`{}|\\^[]")

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors of all kinds; upper-case cues are anchors of their own."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for d in _DIGITS:
        a.add_word(d, ("digit", 1))
    for s in SCHEMES:
        for spelt in (s, s.upper(), s.capitalize()):
            a.add_word(spelt, ("scheme", len(s)))
    for c in CUES:
        for spelt in (c, c.upper(), c.capitalize()):
            a.add_word(spelt, ("cue", len(c)))
    a.make_automaton()
    return a


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of ``allowed`` characters from ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Address around the sign at ``at``, not reaching before ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end = _run(text, at + 1, _LABEL)
    if end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        more = _run(text, end + 1, _LABEL)
        if more == end + 1:
            break
        end, labels = more, labels + 1
    return (start, end) if labels else None


def dotted_digits(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Groups of four dotted numbers from the digit at ``at`` on, and where to go on."""
    parts = []
    end = at
    while True:
        stop = _run(text, end, _DIGITS)
        parts.append((end, stop))
        if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in _DIGITS:
            end = stop + 1
        else:
            break
    return [(parts[k][0], parts[k + 3][1]) for k in range(0, len(parts) - 3, 4)], parts[-1][1]


def valid_address(address: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in address.split(".")))


def digit_chain(text: str, at: int) -> int:
    """End of digits with at most one blank or hyphen between two."""
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def phone_at(text: str, at: int) -> int | None:
    """End of the number that the plus at ``at`` opens."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _DIALLED)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end > at + 3 else None


def url_at(text: str, at: int, host: int) -> int | None:
    """End of the address whose host starts at ``host``; closing punctuation stays outside."""
    end, n = _run(text, host, _LABEL | {"."}), len(text)
    # Only what has a host is read on, so that a row of schemes is walked once.
    if "." not in text[host:end].strip("."):
        return None
    while end < n and text[end] not in _NOT_URL and text[end] > " ":
        end += 1
    while end > host and text[end - 1] in ".,;:!?)*&$%#":
        end -= 1
    return end


def iban(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[0] in _UPPER and code[1] in _UPPER and code[2] in _DIGITS and code[3] in _DIGITS):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


class Codes:
    """Words of capitals, digits and hyphens, asked for from left to right: one that holds many
    cues is walked once."""

    def __init__(self, text: str):
        self.text, self.at, self.end, self.stop, self.digits = text, 0, 0, 0, 0

    def word(self, start: int) -> tuple[int, int]:
        """End of the word from ``start`` on, hyphens at its end left out, and its digits."""
        if start >= self.end:
            self.end = self.stop = _run(self.text, start, _CODE)
            while self.stop > start and self.text[self.stop - 1] == "-":
                self.stop -= 1
            self.digits = sum(c in _DIGITS for c in self.text[start:self.stop])
        else:
            self.digits -= sum(c in _DIGITS for c in self.text[self.at:start])
        self.at = start
        return max(start, self.stop), self.digits


def account_after(text: str, at: int, codes: Codes) -> Span | None:
    """Identifier after a cue that ends at ``at``: a valid IBAN, or a word with 6 to 20 digits."""
    start, most = at, min(len(text), at + 12)
    while start < most and text[start] in " :#.=-\t":
        start += 1
    if start == at and start < len(text) and text[start] in _LETTERS:
        return None
    end, code = start, []
    while end < len(text) and len(code) < 34:
        c = text[end]
        if c in _UPPER or c in _DIGITS:
            code.append(c)
        elif not (c in " -" and code and end + 1 < len(text) and (text[end + 1] in _DIGITS or text[end + 1] in _UPPER)):
            break
        end += 1
    joined = "".join(code)
    if iban(joined):
        return "iban", start, end
    end, digits = codes.word(start)
    return ("account", start, end) if 6 <= digits <= 20 else None


def find_spans(text: str | None) -> list[Span]:
    """All spans by kind in the order of ``KINDS``, then start."""
    if not text:
        return []
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    codes = Codes(text)
    for last, (anchor, width) in automaton().iter(text):
        at = last - width + 1
        if anchor == "digit":
            if at >= done["ip"]:
                groups, done["ip"] = dotted_digits(text, at)
                found["ip"] += [("ip", a, b) for a, b in groups if valid_address(text[a:b])]
            if at >= done["card"]:
                done["card"] = end = digit_chain(text, at)
                if end - at >= 16:
                    digits = text[at:end].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(("card", at, end))
        elif anchor == "at":
            span = email_at(text, at, done["email"])
            if span:
                found["email"].append(("email", *span))
                done["email"] = span[1]
        elif anchor == "plus":
            if at >= done["phone"] and (end := phone_at(text, at)):
                done["phone"] = end
                if 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    found["phone"].append(("phone", at, end))
        elif anchor == "scheme":
            if at >= done["url"] and (end := url_at(text, at, last + 1)):
                done["url"] = end
                found["url"].append(("url", at, end))
        elif (at == 0 or text[at - 1] not in _LETTERS) and (span := account_after(text, last + 1, codes)):
            if span[1] >= done[span[0]]:
                done[span[0]] = span[2]
                found[span[0]].append(span)
    return [s for k in KINDS for s in found[k]]


def mask(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with every span replaced by ``[KIND]``; of overlapping spans the one that
    starts first counts, the longer one on ties."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


_FOUND = "key long, spans array<struct<kind:string,start:int,end:int>>, masked string"


def _spans(masked: bool):
    def kernel(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind),
                 pa.array([mask(t, s) for t, s in zip(texts, found)] if masked else [None] * len(texts), pa.string())],
                ["key", "spans", "masked"])
    return kernel


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", masked: bool = True) -> DataFrame:
    """(key, spans, masked) per row: spans with kind, start and end, and the masked text
    (null unless asked for)."""
    bound_text_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_spans(masked), _FOUND).withColumnRenamed("key", key)


def _spell(spans, kinds=None):
    """kind:start:end of spans, comma-joined."""
    rows = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their digest and all spans spelt, per row of :func:`detect`."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *[count(k) for k in BASE], F.sha2(_spell(F.col("spans"), BASE), 256).alias("base_sha256"),
                        _spell(F.col("spans")).alias("spans"))


def mask_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` masked, all other columns as they are."""
    bound_text_batches(docs.sparkSession)
    masked = F.pandas_udf(_mask_series, "string").asNondeterministic()  # once a row, however often it is used
    return docs.withColumn(text, masked(F.col(text).cast("string")))


def _mask_series(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: mask(t, find_spans(t)), na_action="ignore")
