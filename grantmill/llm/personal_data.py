"""Personal data in texts, found by expanding anchors.

*Anchors.* One Aho-Corasick automaton finds, in one pass over a text, the places where
something personal may be: at-signs, plus signs, digits, schemes (``://``, ``tel:``) and
words that announce an identifier (``IBAN``, ``account``, ...).

*Expansion.* A small deterministic parser for each kind starts at an anchor, walks to the
left and right as far as its grammar goes, and checks what it found:

* ``email``: local part and labels around an at-sign; besides, local parts and labels with
  letters beyond ASCII, and quoted local parts;
* ``ip``: four runs of digits, each at most 255; besides, IPv6 literals after a scheme;
* ``card``: 14 to 19 digits with single blanks or hyphens between, Luhn;
* ``phone``: a plus sign and 10 to 15 digits; besides, the number after ``tel:``;
* ``url``: an address with user data before its host;
* ``account``: after a cue an IBAN (mod 97), or a number of 6 to 20 digits.

The first sentence of email, ip, card and phone are the *base* spans: just what the regular
expressions in BASE match, leftmost first and without overlap, less those that fail the check.
A parser never backs up, as no match of these expressions can begin or end elsewhere within
the characters that it walks over. All other spans are added ones; they never change base spans.

Defined results: a null or empty text has no spans; repeated rows give equal rows; a text of
any length is read as a whole, in time linear in its length for all but crafted texts; an
empty table gives no rows. Other columns pass through; a column named ``spans`` or
``redacted`` is replaced.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

# The expressions of base spans, and the digits of a card and of a phone number.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

#: Kinds in the order in which spans with one start stand.
KINDS = [*BASE, "url", "account"]
#: Words that announce an account or identifier, as they are written in lower case.
CUES = "iban bic account acct konto kontonummer cuenta compte passport passeport pasaporte reisepass ssn".split()

_LOCAL, _LABEL, _DIGITS = re.compile(r"[A-Za-z0-9._%+-]*"), re.compile(r"[A-Za-z0-9-]+"), re.compile(r"[0-9]+")
_CARD, _PHONE_BODY = re.compile(r"[0-9](?:[ -]?[0-9])*"), re.compile(r"[ ().0-9-]*")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGIT_SET = frozenset("0123456789")
_WIDE_LABEL = re.compile(r"[^\W_](?:[\w-]*[^\W_])?")
_USER = re.compile(r"[^\s/?#@\[\]<>\"']+@(?:\[[0-9A-Fa-f:.]+\]|[^\W_](?:[\w.-]*[^\W_])?)(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_LITERAL = re.compile(r"(?:[^\s/?#@\[\]<>\"']*@)?\[([0-9A-Fa-f:.]+)\]")
_TEL = re.compile(r"[0-9][ ().0-9-]*[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_AFTER_CUE = re.compile(r"(?:[ \t]{1,2}(?:number|num|no|nr|nummer|id|is))?\.?[ \t]?[:=#]?[ \t]{0,2}", re.I)
_NUMBER = re.compile(r"[A-Za-z]{0,3}[0-9](?:[ -]?[0-9])+")
#: Letters, digits and marks before an at-sign that a local part may have at most.
_LONGEST_LOCAL = 64


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for scheme in ("://", "tel:", "TEL:", "Tel:"):
        found.add_word(scheme, (scheme.lower(), len(scheme)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def _labels(text: str, at: int, label: re.Pattern) -> int | None:
    """End of two labels or more with dots between, or None."""
    first = label.match(text, at)
    if not first:
        return None
    end, more = first.end(), 0
    while text[end : end + 1] == "." and (found := label.match(text, end + 1)):
        end, more = found.end(), more + 1
    return end if more else None


def _quads(text: str, at: int) -> tuple[int, list[str]] | None:
    """End and parts of four runs of digits with dots between, from ``at``, or None."""
    parts, end = [], at
    for k in range(4):
        if k:
            if text[end : end + 1] != ".":
                return None
            end += 1
        run = _DIGITS.match(text, end)
        if not run:
            return None
        parts.append(run[0])
        end = run.end()
    return end, parts


def _small(part: str) -> bool:
    plain = part.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def _phone(text: str, at: int) -> int | None:
    """End of a plus sign, a digit, one character or more of a number, and a digit; or None."""
    if text[at + 1 : at + 2] not in _DIGIT_SET or at + 1 >= len(text):
        return None
    end = _PHONE_BODY.match(text, at + 2).end()
    while end > at + 3 and text[end - 1] not in _DIGIT_SET:
        end -= 1
    return end if end > at + 3 else None


def _wide_email(text: str, at: int) -> tuple[int, int] | None:
    """An address with letters beyond ASCII or a quoted local part around the at-sign."""
    end = _labels(text, at + 1, _WIDE_LABEL)
    if end is None:
        return None
    if text[at - 1 : at] == '"' and at:
        start = text.rfind('"', max(0, at - 1 - _LONGEST_LOCAL), at - 1)
        return (start, end) if 0 <= start < at - 2 and "\n" not in text[start:at] else None
    start = at
    while start > 0 and at - start < _LONGEST_LOCAL and (text[start - 1] in _LOCAL_SET or (text[start - 1] > "\x7f" and text[start - 1].isalnum())):
        start -= 1
    while start < at and text[start] == ".":
        start += 1
    return (start, end) if start < at and not text[start:end].isascii() and text[start:at].strip("._%+-") else None


def _after_cue(text: str, start: int, end: int) -> tuple[int, int] | None:
    """What stands after the cue text[start:end] and is an IBAN or, but for the cue IBAN, a number of 6 to 20 digits."""
    if start and text[start - 1].isalnum() or text[end : end + 1].isalnum():
        return None
    at = _AFTER_CUE.match(text, end).end()
    if text[at - 1 : at].isalnum():
        return None
    found = _IBAN.match(text, at)
    if found:
        for last in range(found.end(), at + 14, -1):  # an upper-case word may follow
            if iban(text[at:last]) and text[last - 1] != " ":
                return at, last
    found = None if text[start:end].lower() == "iban" else _NUMBER.match(text, at)
    return (at, found.end()) if found and 6 <= sum(c in _DIGIT_SET for c in found[0]) <= 20 and not text[found.end() : found.end() + 1].isalnum() else None


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) in code points, end exclusive, by start, then as KINDS stand."""
    if not text:
        return []
    found: list[tuple[int, int, int, bool]] = []
    added: list[tuple[int, int, int]] = []
    # Ends of the last match of each kind, kept or dropped: the next one can't begin before.
    email = ip = card = phone = run = 0
    for last, (what, size) in _automaton().iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= card:
                card = _CARD.match(text, at).end()
                digits = "".join(c for c in text[at:card] if c in _DIGIT_SET)
                if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                    found.append((at, 2, card, True))
            if at >= run and at >= ip:
                run = _DIGITS.match(text, at).end()  # from within a run no match is possible either
                if text[run : run + 1] == "." and (quads := _quads(text, at)):
                    ip = quads[0]
                    if all(map(_small, quads[1])):
                        found.append((at, 1, ip, True))
        elif what == "at":
            start = at
            while start > email and text[start - 1] in _LOCAL_SET:
                start -= 1
            end = _labels(text, at + 1, _LABEL) if start < at else None
            if end is not None:
                found.append((start, 0, end, True))
                email = end
            wide = _wide_email(text, at)
            if wide:
                added.append((wide[0], 0, wide[1]))
        elif what == "plus":
            if at >= phone and (end := _phone(text, at)):
                phone = end
                if PHONE_DIGITS[0] <= sum(c in _DIGIT_SET for c in text[at:end]) <= PHONE_DIGITS[1]:
                    found.append((at, 3, end, True))
        elif what == "cue":
            value = _after_cue(text, at, last + 1)
            if value:
                added.append((value[0], 5, value[1]))
        elif what == "tel:":
            number = _TEL.match(text, last + 1)
            if number and 7 <= sum(c in _DIGIT_SET for c in number[0]) <= 15 and not (at and text[at - 1].isalnum()):
                added.append((number.start(), 3, number.end()))
        else:  # ://
            start = at
            while start > 0 and at - start < 16 and text[start - 1] in _SCHEME_SET:
                start -= 1
            user = _USER.match(text, last + 1)
            if start < at and user:
                added.append((start, 4, user.end()))
            literal = _LITERAL.match(text, last + 1)
            if literal and _is_ip6(literal[1]):
                added.append((literal.start(1), 1, literal.end(1)))
    base = {(kind, start, end) for start, kind, end, _ in found}
    found += [(start, kind, end, False) for start, kind, end in dict.fromkeys(added) if (kind, start, end) not in base]
    return [(KINDS[kind], start, end, own) for start, kind, end, own in sorted(found)]


def _is_ip6(text: str) -> bool:
    try:
        return ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


def mask(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """The text with ``[KIND]`` for each span; spans that overlap become one, of the first one's kind."""
    out, at, end = [], 0, 0
    for kind, a, b, _ in found:
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType())])
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _scan(docs: DataFrame, redact: bool) -> DataFrame:
    kept = docs.drop("spans", "redacted")
    fields = [StructField("spans", ArrayType(SPAN)), *([StructField("redacted", StringType())] if redact else [])]
    place, names = kept.columns.index("text"), [*kept.columns, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(place).to_pylist()
                found = [*map(spans, texts)]
                new = [pa.array([[dict(zip(SPAN.names, s)) for s in own] for own in found], _SPANS)]
                if redact:
                    new.append(pa.array([mask(t, own) if own else t for t, own in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *fields]))


def find(docs: DataFrame) -> DataFrame:
    """docs with spans, an array of (kind, start, end, base), ordered."""
    return _scan(docs, False)


def redact(docs: DataFrame) -> DataFrame:
    """docs with spans and redacted, the text with each span replaced by its kind; a null text stays null."""
    return _scan(docs, True)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return find(docs.select("doc_id", "text")).select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
