"""Thousands of keywords found in texts in one pass: an Aho-Corasick automaton as arrays.

Keywords are folded (see ``fold``), numbered by letter classes, and become a trie; failure
links, breadth-first, close it to a table ``next[state, class]``. The table is broadcast
once. A task cuts the texts of a batch into pieces of STRETCH characters, which begin with
as many characters of the piece before as the longest keyword has, and steps through all
pieces at once: one array look-up moves every piece by one character. So the time is that
of a few array operations for each STRETCH characters of many texts, whatever the number of
keywords, and no text is long. A table has at most MAX_STATES states; more keywords make
more automata, and the texts go through each.

What is found is what the alternation ``\\b(?:first|second|...)\\b`` finds without regard to
case: hits don't overlap, the leftmost comes first, and of keywords that begin at one place
and have word boundaries at both ends the one that stands first in the list. Letters, digits,
the underscore, and marks on a letter or digit make words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: States of a table at most, and cells (states by different letters): 64 MB.
MAX_STATES, MAX_CELLS = 100_000, 16 << 20
#: Characters that a piece of text is moved by in all.
STRETCH = 2048
#: Characters that are stepped through at once.
AT_ONCE = 4 << 20

HIT = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("keyword", IntegerType())])
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("keyword", pa.int32())]))


def fold(ch: str) -> str:
    """A character without regard to case: lower case of the upper case, each where it is one character."""
    if ch == "İ":
        return "i"
    up = ch.upper()
    up = up if len(up) == 1 else ch
    low = up.lower()
    return low if len(low) == 1 else up


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its folded one, and whether it is part of a word (1; 2: a mark, which is if what it stands on is)."""
    folded = np.arange(0x110000, dtype=np.uint32)
    word = np.zeros(0x110000, np.uint8)
    for k in range(0x20000):
        if 0xD800 <= k < 0xE000:
            continue
        ch = chr(k)
        if ch.isalpha() or k == 0x130:
            folded[k] = ord(fold(ch))
        kind = unicodedata.category(ch)
        word[k] = 1 if kind in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd") or ch == "_" else 2 if kind == "Mn" else 0
    word[0x20000:0x32000] = 1  # ideographs
    return folded, word


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass(frozen=True)
class Automaton:
    """``next``: state by state and class; ``ends``: keywords (numbers, lengths) that end in a state, one after another by ``at``."""

    classes: np.ndarray
    next: np.ndarray
    at: np.ndarray
    ends: np.ndarray
    lengths: np.ndarray
    longest: int


def build(keywords: Sequence[str], numbers: Sequence[int]) -> Automaton:
    """The automaton of folded keywords that bear these numbers."""
    folded = _tables()[0]
    coded = [folded[_codes(k)] for k in keywords]
    letters = np.unique(np.concatenate([np.zeros(0, np.uint32), *coded]))
    classes = np.zeros(0x110000, np.uint16)
    classes[letters] = np.arange(1, len(letters) + 1)
    steps: list[dict[int, int]] = [{}]
    own: list[list[int]] = [[]]
    for number, code in zip(numbers, coded):
        state = 0
        for c in classes[code].tolist():
            if c not in steps[state]:
                steps[state][c] = len(steps)
                steps.append({})
                own.append([])
            state = steps[state][c]
        own[state].append(number)
    table = np.zeros((len(steps), len(letters) + 1), np.int32)
    fail = np.zeros(len(steps), np.int64)
    layer = [0]
    while layer:
        below = []
        for state in layer:
            table[state] = table[fail[state]] if state else 0
            for c, to in steps[state].items():
                fail[to] = table[fail[state], c] if state else 0
                table[state, c] = to
                below.append(to)
        for state in below:
            own[state] = own[state] + own[fail[state]]
        layer = below
    sizes = np.array([*map(len, own)], np.int64)
    lengths = np.zeros(max(numbers, default=-1) + 1, np.int64)
    lengths[list(numbers)] = [*map(len, coded)]
    return Automaton(classes, table, np.concatenate([[0], np.cumsum(sizes)]), np.array([n for o in own for n in o], np.int64), lengths, max(map(len, coded), default=0))


def automata(keywords: Sequence[str], most: int = MAX_STATES) -> list[Automaton]:
    """As many automata as the keywords need; empty ones and those that a folded equal precedes are left out."""
    seen: set[str] = set()
    groups: list[tuple[list[str], list[int]]] = [([], [])]
    states, letters = 0, set()
    for number, k in enumerate(keywords):
        plain = "".join(map(fold, k))
        if not k or plain in seen:
            continue
        seen.add(plain)
        wider = letters | {*plain}
        if groups[-1][0] and (states + len(k) > most or (states + len(k) + 1) * (len(wider) + 1) > MAX_CELLS):
            groups.append(([], []))
            states, wider = 0, {*plain}
        states, letters = states + len(k), wider
        groups[-1][0].append(k)
        groups[-1][1].append(number)
    return [build(*g) for g in groups if g[0]]


def _occurrences(codes: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) and keywords of all occurrences in the codes of one text after another."""
    lead = automaton.longest
    n = len(codes)
    firsts = np.arange(0, n, STRETCH)
    classes = np.zeros((lead + STRETCH, len(firsts)), np.uint16)  # a column for each piece, with the characters before it
    padded = np.zeros(lead + len(firsts) * STRETCH, np.uint16)
    padded[lead : lead + n] = automaton.classes[codes]
    for k in range(lead + STRETCH):
        classes[k] = padded[firsts + k]
    state = np.zeros(len(firsts), np.int64)
    has = np.diff(automaton.at) > 0
    ends, states = [], []
    width, flat = automaton.next.shape[1], automaton.next.ravel()
    for k in range(lead + STRETCH):
        state = flat[state * width + classes[k]].astype(np.int64)
        if k >= lead:
            hit = np.flatnonzero(has[state])
            if len(hit):
                ends.append(firsts[hit] + (k - lead + 1))
                states.append(state[hit])
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, found = np.concatenate(ends), np.concatenate(states)
    counts = automaton.at[found + 1] - automaton.at[found]
    first = np.repeat(automaton.at[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.repeat(end, counts), automaton.ends[first + np.arange(counts.sum())]


def scan(texts: Sequence[str | None], tables: Sequence[Automaton]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, keyword) of all hits, in order."""
    folded, word = _tables()
    coded = [_codes(t or "") for t in texts]
    # One character that is no part of any word or keyword stands between texts.
    sizes = np.array([len(c) + 1 for c in coded], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.zeros(starts[-1], np.uint32)
    for c, s in zip(coded, starts):
        joined[s : s + len(c)] = c
    joined = np.where(joined < 0x110000, joined, 0)
    plain = folded[joined]
    separators = starts[1:] - 1
    plain[separators] = 0xFFFFF  # unassigned, so of no keyword's letters
    kinds = word[joined]
    base = np.maximum.accumulate(np.where(kinds != 2, np.arange(len(kinds)), 0)) if len(kinds) else np.zeros(0, np.int64)
    is_word = (kinds == 1) | ((kinds == 2) & (kinds[base] == 1))
    begins, ends, keys = [], [], []
    for automaton in tables:
        end, key = _occurrences(plain, automaton)
        begins.append(end - automaton.lengths[key])
        ends.append(end)
        keys.append(key)
    if not begins or not sum(map(len, begins)):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    begin, end, key = np.concatenate(begins), np.concatenate(ends), np.concatenate(keys)
    before = np.where(begin > 0, is_word[begin - 1], False)
    whole = (before != is_word[begin]) & (is_word[end - 1] != is_word[np.minimum(end, len(is_word) - 1)])
    begin, end, key = begin[whole], end[whole], key[whole]
    order = np.lexsort((key, begin))
    begin, end, key = begin[order], end[order], key[order]
    if len(begin) and (begin[1:] < end[:-1]).any():
        kept, last = [], -1
        for k, (b, e) in enumerate(zip(begin.tolist(), end.tolist())):
            if b >= last:
                kept.append(k)
                last = e
        begin, end, key = begin[kept], end[kept], key[kept]
    text = np.searchsorted(starts, begin, "right") - 1
    return text, begin - starts[text], end - starts[text], key


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of stretches of a batch that have about AT_ONCE characters."""
    at, size, held = 0, 0, []
    for k, t in enumerate(column):
        t = t.as_py()
        if held and size + len(t or "") > AT_ONCE:
            yield at, held
            at, size, held = k, 0, []
        held.append(t)
        size += len(t or "") + 1
    if held:
        yield at, held


def find(df: DataFrame, text: str, keywords: Sequence[str], name: str = "hits") -> DataFrame:
    """df with an array of (start, end, keyword) in code points, keyword being its place in the list; a null text has none."""
    tables = df.sparkSession.sparkContext.broadcast(automata(keywords))
    base = df.drop(name)
    place, names = base.columns.index(text), [*base.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _pieces(batch.column(place)):
                of, start, end, key = scan(texts, tables.value)
                offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(key.astype(np.int32))], names=HIT.names)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, pa.ListArray.from_arrays(pa.array(offsets), hits)], names=names)

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(name, ArrayType(HIT))]))


def surfaces(hits: str = "hits", text: str = "text"):
    """The hits as they are written in the text, in order."""
    return F.transform(F.col(hits), lambda h: F.substr(F.col(text), (h["start"] + 1).cast("int"), (h["end"] - h["start"]).cast("int")))


def keyword_counts(df: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """(keyword, n, texts): how often each keyword is hit, and in how many texts; combined map-side."""
    found = find(df.select(text), text, keywords)
    one = lambda k, n, texts: F.struct(k.alias("k"), F.lit(n).alias("n"), F.lit(texts).alias("texts"))
    own = F.transform("hits", lambda h: h["keyword"])
    each = found.select(F.explode(F.concat(F.transform(own, lambda k: one(k, 1, 0)), F.transform(F.array_distinct(own), lambda k: one(k, 0, 1)))).alias("x"))
    sums = each.groupBy("x.k").agg(F.sum("x.n").alias("n"), F.sum("x.texts").alias("texts"))
    names = df.sparkSession.createDataFrame([*enumerate(keywords)], "k int, keyword string")
    return sums.join(names, "k").select("keyword", "n", "texts")
