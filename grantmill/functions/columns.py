"""Scalar functions as column expressions: all of them stay inside generated code."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def process_year(value: Column | str) -> Column:
    """The first four characters as a year; null where they are no number."""
    return F.substring(_col(value).cast("string"), 1, 4).try_cast("int")


def consolidate_country(assignee: Column | str, applicant: Column | str, record: Column | str, default: str = "US") -> Column:
    """The first country known, assignee before applicant before record; codes of three letters lose the last."""
    first = F.coalesce(_col(assignee), _col(applicant), _col(record), F.lit(default))
    return F.when(F.char_length(first) == 3, F.substring(first, 1, 2)).otherwise(first)


def normalise_doc_id(value: Column | str) -> Column:
    """Without leading zeros and without a trailing '.0', on both sides of a join alike."""
    return F.regexp_replace(F.ltrim(_col(value).cast("string"), F.lit("0")), r"\.0$", "")


def first_token(value: Column | str, separator: str = "|") -> Column:
    """Text before the first separator; all of it if there is none."""
    return F.substring_index(_col(value), separator, 1)


def first_level(value: Column | str, separator: str = "||") -> Column:
    """Text before the first separator; empty if there is none."""
    c = _col(value)
    return F.when(F.contains(c, F.lit(separator)), F.substring_index(c, separator, 1)).otherwise(F.lit(""))


def date_gap(grant_year: Column | str, application_year: Column | str) -> Column:
    return _col(grant_year) - _col(application_year)


def hits_of(hits: Column | str, key: str) -> Column:
    """A key's count in a map of hits; 0 where it has none."""
    return F.coalesce(F.try_element_at(_col(hits), F.lit(key)), F.lit(0))


def without_key(total: Column | str, hits: Column | str, key: str) -> Column:
    """A total of hits less those of one key."""
    return _col(total) - hits_of(hits, key)


def level_of(topic: Column | str) -> Column:
    """Level of a topic: the number of its dots."""
    c = _col(topic)
    return F.char_length(c) - F.char_length(F.replace(c, F.lit("."), F.lit("")))


def topic_name(topic: Column | str) -> Column:
    return F.when(level_of(topic) == 0, _col(topic)).otherwise(F.trim(F.replace(_col(topic), F.lit("."), F.lit(""))))


def join_levels(levels: Sequence[Column | str], separator: str = "|") -> Column:
    """Levels joined; nulls count as empty, so the number of separators is fixed."""
    return F.concat_ws(separator, *(F.coalesce(_col(c), F.lit("")) for c in levels))


def size_in_kb(value: Column | str) -> Column:
    """Whole kilobytes of a text or binary value."""
    return F.floor(F.octet_length(_col(value)) / 1024).cast("int")


def flatten_all(value: Column, depth: int) -> Column:
    """A list of lists, nested so deep (1: a plain list), as one list in order; null lists count as empty."""
    for _ in range(depth - 1):
        value = F.flatten(F.filter(value, lambda x: x.isNotNull()))
    return value


def pad_left(value: Column, width: int, fill: str = "0") -> Column:
    """Like ``zfill``: never cuts."""
    return F.lpad(value, F.greatest(F.char_length(value), F.lit(width)), F.lit(fill))


def pad_right(value: Column, width: int, fill: str = "0") -> Column:
    return F.rpad(value, F.greatest(F.char_length(value), F.lit(width)), F.lit(fill))


def ipc_code(raw: Column | str) -> Column:
    """'H04L 9/20 [..];..' becomes 'H04L0009200000'; null where there is no such code."""
    code = F.substring_index(F.substring_index(_col(raw), ";", 1), " [", 1)
    parts = F.split(F.trim(F.regexp_replace(code, r"\s+", " ")), " ")
    group = F.split(F.get(parts, F.lit(1)), "/")
    good = (F.size(parts) == 2) & (F.size(group) == 2)
    return F.when(good, F.concat(F.get(parts, F.lit(0)), pad_left(F.get(group, F.lit(0)), 4), pad_right(F.get(group, F.lit(1)), 6)))


def uspc_candidates(raw: Column | str) -> Column:
    """Readings of a raw national code, best first: an array of (class, subclass)."""
    trimmed = F.trim(_col(raw))
    rest = F.substring(trimmed, F.lit(4), F.char_length(trimmed))
    parts = F.filter(F.split(rest, " "), lambda x: x != "")
    n = F.size(parts)

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("class"), b.alias("subclass"))

    at = lambda k: F.get(parts, F.lit(k))
    lettered = F.array(pair(F.replace(F.substring(rest, 1, 3), F.lit(" "), F.lit("0")), F.ltrim(F.substring(rest, F.lit(4), F.char_length(rest)))))
    two = F.array(pair(pad_left(at(0), 3), at(1)))
    one = F.array(*(pair(pad_left(F.substring(rest, 1, k), 3), F.substring(rest, F.lit(k + 1), F.char_length(rest))) for k in (1, 2, 3)))
    more = F.array(pair(pad_left(at(0), 3), F.btrim(at(1), F.lit("-"))), pair(pad_left(at(0), 3), F.concat(at(1), at(2))))
    known = F.when(~F.substring(rest, 1, 1).rlike(r"^\d$"), lettered).when(n == 2, two).when(n == 1, one).when(n > 2, more)
    return F.when(F.char_length(rest) > 0, known)


def candidate_code(candidate: Column) -> Column:
    """'class/subclass', or the class alone if the subclass is empty."""
    return F.when(candidate["subclass"] == "", candidate["class"]).otherwise(F.concat_ws("/", candidate["class"], candidate["subclass"]))


# Keywords


def clean_keywords(keywords: Sequence[str], compat: bool = False) -> list[str]:
    """Without what stands in parentheses. compat: also without the last character after them, a blank left behind."""
    out = []
    for key in keywords:
        head, opening, tail = key.partition("(")
        if opening:
            after = tail.partition(")")[2]
            key = f"{head.strip()} {after[:-1].strip()}" if compat else f"{head.strip()} {after.strip()}".strip()
        out.append(key)
    return out


def clean_keyword(text: Column | str) -> Column:
    """One keyword of a column, as ``clean_keywords`` cleans a list's: what stands in the first parentheses goes."""
    key = _col(text)
    after = F.regexp_extract(key, r"(?s)\(.*?\)(.*)", 1)
    cleaned = F.trim(F.concat(F.trim(F.substring_index(key, "(", 1)), F.lit(" "), F.trim(after)))
    return F.when(F.contains(key, F.lit("(")), cleaned).otherwise(key)


def keyword_pattern(keywords: Sequence[str]) -> str:
    r"""One alternation of whole words in the given order, without regard to case in any script.

    The word boundaries stand once around it: that is the same, and is tested once a place.
    """
    quoted = (r"\Q" + k.replace(r"\E", r"\E\\E\Q") + r"\E" for k in keywords)
    return rf"(?iu)\b(?:{'|'.join(quoted)})\b"


def glue_sections(*sections: Column | str, blank: bool = False) -> Column:
    """Paragraph lists as one text: newlines deleted (blank=True: replaced by a blank), sections abutted."""
    parts = [F.coalesce(F.array_join(_col(s), "\n"), F.lit("")) for s in sections]
    text = F.concat(*parts) if not blank else F.concat_ws("\n", *parts)
    return F.regexp_replace(text, r"[\r\n]", " " if blank else "")


def hits(text: Column | str, pattern: str) -> Column:
    """All hits in order, as they are written."""
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))


def hit_counts(found: Column) -> Column:
    """Array of hits to a map of written form to count."""
    return F.map_from_entries(F.transform(F.array_distinct(found), lambda k: F.struct(k.alias("key"), F.size(F.filter(found, lambda x: x == k)).alias("value"))))


# Company names. Ordered (pattern, replacement) pairs.

FIRST_RULES = [
    (" AND ", " & "), ("COMPANY", " "), ("HOLDINGS,", "HOLDING"), (r"B\.V\.", " "), ("SOLUTIONS,", "SOLUTION"), (r"S\.A\.", " "), (r"N\.A\.", " "), (r"L\.P\.", " "),
    ("AG & Co", " "), (r"\bNV\b", " "), (r"\bA/S\b", " "), (r"\([^()]*\)", " "), ("AS ADMINISTRATIVE AGENT", ""), ("AS COLLATERAL AGENT", ""), ("AS SUCCESSOR AGENT", ""),
    ("AS AGENT", ""), ("AS COLLATERAL TRUSTEE", ""), ("NETWORK ENTERTAINMENT PLATFORM", ""), ("  ", " "), (", ,", ", "),
]
#: Used where the first rules leave nothing: legal forms, then the first rules.
FALLBACK_RULES = [
    ("GMBH", " "), (r"INC\.,", " "), (r"INC\.", " "), ("INC", " "), ("LIMITED", " "), ("LTD", " "), (r"LTD\.", " "), ("CORPORATION", " "), ("CORP.", " "), (r"CO\.\,", " "),
    (r"LLC\.", " "), ("LLC", " "), ("LLC,", " "), *FIRST_RULES,
]
#: Words that say little, wherever they stand, also within other words.
GENERIC_RULES = [
    (w, "") for w in (
        "BANK", "OF", "GROUP", "SYSTEMS", "INTERNATIONAL", "TECHNOLOGIES", "TECHNOLOGY", "THERAPEUTICS", "LABORATORIES", "PHARMACEUTICALS", "HOLDING", "NATIONAL ASSOCIATION",
        "ASSOCIATION", "ASSOCIATES", "ELECTRONICS", "DEUTSCHLAND", "DEVICES", "AMERICA", "AMERICAN", "AUTOMOTIVE", "RESEARCH FOUNDATION", "INDUSTRIES", "UNIVERSITY", "SEMICONDUCTOR",
    )
]
#: Legal forms that end a name; longer ones first where one ends another.
LEGAL_FORMS = (
    "incorporated", "inc", "corporation", "corp", "limited liability company", "limited", "ltd", "llc", "l.l.c", "llp", "lp", "plc", "company", "co", "gmbh & co. kg", "gmbh & co kg", "gmbh", "ag", "kg", "kgaa", "ohg", "se",
    "s.a", "sa", "s.a.s", "sas", "sarl", "s.a.r.l", "s.p.a", "spa", "s.r.l", "srl", "b.v", "bv", "n.v", "nv", "a/s", "as", "ab", "oy", "oyj", "aps", "pty ltd", "pty", "pte ltd", "pte", "k.k", "kk", "co., ltd", "bhd", "sdn bhd", "ltda", "de c.v",
)


def fold_rules(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement.replace("$", r"\$"))
    return text


def trim_commas(text: Column) -> Column:
    """Blanks, commas, blanks, commas off both ends."""
    for _ in range(2):
        text = F.btrim(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(","))
    return text


def base_name(text: Column) -> Column:
    """A name without one legal form at its end."""
    forms = "|".join(re.sub(r"([.&/])", r"\\\1", f).replace(" ", r"\s+") for f in sorted(LEGAL_FORMS, key=lambda f: (-len(f), f)))
    return F.regexp_replace(F.regexp_replace(text, r"\s+$", ""), rf"(?iu)[\s,]+(?:{forms})\.?,?$", "")


def clean_name(text: Column | str, rules: Sequence[tuple[str, str]] = FIRST_RULES, strip: int = 2) -> Column:
    """Rules in order, then legal forms off the end ``strip`` times, then commas."""
    out = fold_rules(_col(text), rules)
    for _ in range(strip):
        out = base_name(out)
    return trim_commas(out)


def clean_name_with_fallback(text: Column | str) -> Column:
    """Cleaned; if nothing is left cleaned by the fallback rules; if again nothing, as it was."""
    first, second = clean_name(text), clean_name(text, FALLBACK_RULES, strip=0)
    return F.when(~first.isin("", " "), first).when(~second.isin("", " "), second).otherwise(_col(text))


def generic_free_name(text: Column | str) -> Column:
    return clean_name(text, GENERIC_RULES, strip=0)
