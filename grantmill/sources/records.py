"""Raw archives to one row for each record: three generations of formats, one schema.

A file is split at its record mark by the text reader, so large files are read by
many tasks; each record is then parsed on its own, and what fails is a row with
``parse_error`` instead of the end of the job.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PARSED, RECORD, STATUS

#: What begins a record.
XML_MARK, SGML_MARK, TEXT_MARK = "<?xml", "<!DOCTYPE PATDOC", "PATN"


def scan_records(spark: SparkSession, path: str | list[str], mark: str, glob: str | None = None) -> DataFrame:
    """file and record (with its mark) of every record in the files, also in folders below."""
    reader = spark.read.option("lineSep", mark).option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    cut = F.regexp_replace("value", r"(?<!\s)\s+$", "")  # from where a run of spaces begins, else each run costs its square
    # Most values need no expression: $ also stands before these terminators, and bytes that are no UTF-8 become U+FFFD.
    odd = ~F.is_valid_utf8("value") | F.endswith("value", F.lit("\x85")) | F.endswith("value", F.lit("\u2028")) | F.endswith("value", F.lit("\u2029"))
    body = F.when(odd, cut).otherwise(F.rtrim("value", F.lit(" \t\n\x0b\f\r")))
    return rows.where(F.col("value").rlike(r"\S")).select(F.col("_metadata.file_path").alias("file"), F.concat(F.lit(mark), body).alias("record"))


def scan_text_records(spark: SparkSession, path: str | list[str], glob: str | None = None, compat: bool = False) -> DataFrame:
    """file and record of prefix-coded text: its lines without empty ones, joined by newlines.

    A record begins with the mark on a line of its own (compat: with the mark
    anywhere, so that prose which holds it breaks a record). What stands before a
    file's first mark is dropped. Bytes that are no UTF-8 are removed.
    """
    reader = spark.read.option("lineSep", TEXT_MARK if compat else f"\n{TEXT_MARK}").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(path).select(F.col("_metadata.file_path").alias("file"), F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("value"))
    # Most values are a plain record: what a cheap test shows to need no replacement is spared it.
    rows = rows.where(F.col("value").rlike(rf"^(?:[ \t\r]*\n|{TEXT_MARK}\s*\n)"))
    starts = F.when(F.startswith("value", F.lit(TEXT_MARK)), F.regexp_replace("value", rf"^{TEXT_MARK}\s*\n", "\n")).otherwise(F.col("value"))
    rows = rows.withColumn("value", starts)
    # Ends of lines are cut as by \s+$ of each line, all at once; a terminator other than \n at a line's end stays.
    run, end = r"[ \t\x0B\f\r]", r"[\x{85}\x{2028}\x{2029}]?(?:\n|\z)"
    cut = F.when(F.col("value").rlike(run + end), F.regexp_replace("value", rf"(?<!{run}){run}++(?={end})", "")).otherwise(F.col("value"))
    rows = rows.withColumn("value", cut)
    rows = rows.withColumn("value", F.when(F.contains("value", F.lit("\n\n")), F.regexp_replace("value", r"\n{2,}", "\n")).otherwise(F.col("value")))
    body = F.regexp_replace("value", r"\A\n|\n\z", "")
    return rows.select("file", F.concat_ws("\n", F.lit(TEXT_MARK), body).alias("record"))


class Element:
    """A node of a lenient tree; tags are in lower case.

    Elements are numbered in document order, and the document lists its elements
    by tag, so a search within an element is a bisection.
    """

    __slots__ = ("tag", "children", "start", "end", "index")

    def __init__(self, tag: str, start: int = 0, index: dict[str, tuple[list[int], list[Element]]] | None = None):
        self.tag, self.children, self.start, self.end, self.index = tag, [], start, 1 << 60, {} if index is None else index

    def walk(self) -> Iterator[Element]:
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def find(self, *path: str) -> Element | None:
        """The first descendant of the first name, in it that of the second, and so on."""
        at = self
        for tag in path:
            starts, elements = at.index.get(tag, ((), ()))
            k = bisect.bisect_right(starts, at.start)
            if k == len(starts) or starts[k] >= at.end:
                return None
            at = elements[k]
        return at

    def find_all(self, tag: str) -> list[Element]:
        starts, elements = self.index.get(tag, ([], []))
        return elements[bisect.bisect_right(starts, self.start) : bisect.bisect_left(starts, self.end)]

    def firsts(self) -> dict[str, Element]:
        """The first descendant of each tag."""
        out: dict[str, Element] = {}
        for e in self.walk():
            out.setdefault(e.tag, e)
        return out

    def first_texts(self, tags: tuple[str, ...]) -> list[str]:
        """The stripped text of the first descendant of each tag, 'None' where there is none."""
        known = self.firsts()
        return [known[tag].text().strip() if tag in known else "None" for tag in tags]

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", -1)
        self.stack, self.n = [self.root], 0

    def _add(self, tag: str) -> Element:
        e = Element(tag, self.n, self.root.index)
        starts, elements = self.root.index.setdefault(tag, ([], []))
        starts.append(self.n)
        elements.append(e)
        self.stack[-1].children.append(e)
        self.n += 1
        return e

    def handle_starttag(self, tag, attrs):
        self.stack.append(self._add(tag))

    def handle_startendtag(self, tag, attrs):
        self._add(tag).end = self.n

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                for e in self.stack[k:]:
                    e.end = self.n
                del self.stack[k:]
                return

    def handle_data(self, data):
        if len(self.stack) > 1:  # text outside the root element is the rest of a document type
            self.stack[-1].children.append(data)

    def set_cdata_mode(self, *args, **kwargs):  # no element's content is raw here
        pass


def parse_well_formed(text: str) -> Element:
    """The tree of well-formed XML, several times faster; raises on anything else and on entities it does not know."""
    root = Element("#root", -1)
    index, n = root.index, 0

    def add(source: ElementTree.Element, parent: Element) -> Element:
        nonlocal n
        tag = source.tag.lower()
        e = Element(tag, n, index)
        if tag in index:
            index[tag][0].append(n)
            index[tag][1].append(e)
        else:
            index[tag] = [n], [e]
        n += 1
        if source.text:
            e.children.append(source.text)
        parent.children.append(e)
        return e

    top = ElementTree.fromstring(text)
    stack = [(add(top, root), iter(top))]
    while stack:
        parent, rest = stack[-1]
        for source in rest:
            e = add(source, parent)
            if source.tail:
                parent.children.append(source.tail)
            if len(source):
                stack.append((e, iter(source)))
                break
            e.end = n
        else:
            parent.end = n
            stack.pop()
    return root


class _Node:
    """An element of the standard library's tree with the searches of Element; queries are in lower case, its tags in one case."""

    __slots__ = ("of", "upper", "top", "known")

    def __init__(self, of: ElementTree.Element, upper: bool, top: bool = False):
        self.of, self.upper, self.top = of, upper, top
        self.known = _first_of_each(of, True) if top else None

    def find(self, *path: str) -> _Node | None:
        at = self.of
        for k, tag in enumerate(path):
            if self.upper:
                tag = tag.upper()
            if not k and self.top:
                e = self.known.get(tag)
            else:
                found = at.iter(tag)
                e = next(found, None)
                if e is at:  # the search begins with the element itself
                    e = next(found, None)
            if e is None:
                return None
            at = e
        return _Node(at, self.upper)

    def find_all(self, tag: str) -> list[_Node]:
        return [_Node(e, self.upper) for e in self.of.iter(tag.upper() if self.upper else tag) if self.top or e is not self.of]

    def firsts(self) -> dict[str, _Node]:
        out: dict[str, _Node] = {}
        for e in self.of.iter():
            if e.tag not in out and (self.top or e is not self.of):
                out[e.tag] = _Node(e, self.upper)
        return {tag.lower(): e for tag, e in out.items()} if self.upper else out

    def first_texts(self, tags: tuple[str, ...]) -> list[str]:
        known = self.known if self.top else _first_of_each(self.of, False)
        found = (known.get(tag.upper() if self.upper else tag) for tag in tags)
        return ["None" if e is None else _text(e).strip() for e in found]

    def text(self) -> str:
        return _text(self.of)


def _first_of_each(of: ElementTree.Element, itself: bool) -> dict[str, ElementTree.Element]:
    """The first element of each tag in an element."""
    found = [*of.iter()]
    if not itself:
        del found[0]
    found.reverse()
    return {e.tag: e for e in found}


def _text(of: ElementTree.Element) -> str:
    return "".join(of.itertext()) if len(of) else of.text or ""


#: A document type, left out with its declarations; and a tag that isn't plainly one in upper case.
_DOCUMENT_TYPE = re.compile(r"\s*<!DOCTYPE\b[^<>\[\]]*(?:\[(?:[^\[\]<]|<!)*\])?\s*>")
_NOT_UPPER = re.compile(r"<(?!/?[A-Z][A-Z0-9.-]*[ \t\n/>])")


def fast_xml(text: str) -> Element | _Node:
    """parse_well_formed, its elements being those of the standard library if all tags are in lower case."""
    top = ElementTree.fromstring(text)
    node = _Node(top, False, True)
    tags = "".join(node.known)
    return node if tags == tags.lower() else parse_well_formed(text)


def fast_sgml(text: str) -> Element | _Node:
    """parse_tree, by the standard library's parser where both must agree: well-formed, tags in upper case, no references by number, comments, name spaces or the like."""
    head = _DOCUMENT_TYPE.match(text)
    body = text[head.end() :] if head else text
    if "&#" not in body and "\r" not in body and "xmlns" not in body and not _NOT_UPPER.search(body):
        try:
            return _Node(ElementTree.fromstring(body), True, True)
        except (ElementTree.ParseError, ValueError):
            pass
    return parse_tree(text)


def parse_tree(text: str) -> Element:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    if not builder.n:
        raise ValueError("no element")
    return builder.root


def text_at(node: Element | None, *path: str) -> str | None:
    found = None if node is None else node.find(*path)
    return None if found is None else found.text().strip()


def _person(prefix: str, **fields: str | None) -> dict:
    return {f"bio_{prefix}_{k}": v for k, v in fields.items()}


def _paragraphs(node: Element | None, tag: str) -> tuple[list[str] | None, bool]:
    return (None, False) if node is None else ([e.text().strip() for e in node.find_all(tag)], True)


# XML


_SYMBOL_META = ("symbol-position", "classification-value", "action-date", "generating-office", "classification-status", "classification-data-source", "scheme-origination-code")


def _symbol(e: Element, version: str) -> str:
    part = e.first_texts(("section", "class", "subclass", "main-group", "subgroup", version, *_SYMBOL_META))
    return f"{part[0]}{part[1]}{part[2]} {part[3]}/{part[4]} [{'_'.join(part[5:])}]"


def parse_xml(record: str, compat: bool = False) -> dict:
    """A record of tagged XML. compat: CPC symbols are looked for where the IPC ones are."""
    try:
        root = fast_xml(record)
    except (ElementTree.ParseError, ValueError):
        root = parse_tree(record)
    publication, application = root.find("publication-reference"), root.find("application-reference")
    out = {
        "bio_doc-number": text_at(publication, "doc-number"), "bio_country": text_at(publication, "country"), "bio_date": text_at(publication, "date"),
        "bio_application_date": text_at(application, "date"),
    }
    out["bio_ok"] = publication is not None and application is not None and None not in out.values()

    def person(e: Element | None, prefix: str) -> dict:
        return {} if e is None else _person(prefix, first_name=text_at(e, "first-name"), last_name=text_at(e, "last-name"), organization_name=text_at(e, "orgname"), country=text_at(e, "country"), state=text_at(e, "state"), city=text_at(e, "city"))

    applicant = root.find("us-applicants", "us-applicant") or root.find("applicants", "applicant")
    inventor = root.find("inventors", "inventor") if root.find("inventors") is not None else root.find("applicants", "applicant")
    out |= person(applicant, "applicant") | person(inventor, "inventor")
    out["applicant_ok"] = applicant is not None
    address = root.find("assignees", "assignee", "addressbook", "address")
    if address is not None:
        out |= _person("assignee", name=text_at(root, "assignees", "assignee", "addressbook", "orgname"), city=text_at(address, "city"), state=text_at(address, "state"), country=text_at(address, "country"))
    ipc = root.find("classifications-ipcr")
    cpc = ipc if compat else root.find("classifications-cpc")
    out["bio_main-classification_ipc"] = ";".join(_symbol(e, "ipc-version-indicator") for e in ipc.find_all("classification-ipcr")) if ipc else ""
    out["bio_main-classification_cpc"] = ";".join(_symbol(e, "cpc-version-indicator") for e in cpc.find_all("classification-cpc")) if cpc else ""
    national, locarno = root.find("classification-national"), root.find("classification-locarno")
    out["bio_main-classification_national"] = f"{text_at(national, 'country')} {text_at(national, 'main-classification')}" if national else ""
    out["bio_main-classification_locarno"] = f"{text_at(locarno, 'main-classification')} [{text_at(locarno, 'edition')}]" if locarno else ""
    for column, ok, tag, item in (("abstract_paras", "abstract_ok", "abstract", "p"), ("description_paras", "description_ok", "description", "p"), ("claims_claims", "claims_ok", "claims", "claim")):
        out[column], out[ok] = _paragraphs(root.find(tag), item)
    return out


# SGML


def parse_sgml(record: str, compat: bool = False) -> dict:
    """A record of SGML with numbered tags. Priority data give the applicant's and assignee's country, else it is US."""
    root = fast_sgml(record)
    head = root.find("sdobi")
    b100, priority = (None, None) if head is None else (head.find("b100"), head.find("b300"))
    dated = priority.find("b320") if priority is not None else None if head is None else head.find("b200", "b220")
    out = {
        "bio_doc-number": text_at(b100, "b110", "pdat"), "bio_country": text_at(b100, "b190", "pdat"), "bio_date": text_at(b100, "b140", "date", "pdat"),
        "bio_application_date": text_at(dated, "date", "pdat"),
    }
    out["bio_ok"] = None not in out.values()
    code = text_at(root, "b500", "b520", "b521")
    out["bio_main-classification_national"] = f"US {code}" if code is not None else ""
    main, edition = root.find("b500", "b510", "b511"), root.find("b500", "b510", "b516")
    out["bio_main-classification_ipc"] = f"{main.text()} [{edition.text()}]" if main is not None and edition is not None else ""
    party = root.find("b720", "b721", "party-us")
    if party is not None:
        fields = {"first_name": text_at(party, "nam", "fnm"), "last_name": text_at(party, "nam", "snm"), "city": text_at(party, "adr", "city"), "state": text_at(party, "adr", "state")}
        out |= _person("applicant", **fields) | _person("inventor", **fields)
    out["applicant_ok"] = party is not None
    owner = root.find("b730")
    if owner is not None and owner.find("nam") is not None:
        out |= _person("assignee", name=text_at(owner, "nam"), state=text_at(owner, "adr", "state"), city=text_at(owner, "adr", "city"))
    for column, ok, tag in (("abstract_paras", "abstract_ok", "sdoab"), ("description_paras", "description_ok", "sdode"), ("claims_claims", "claims_ok", "sdocl")):
        out[column], out[ok] = _paragraphs(root.find(tag), "pdat")
    return _with_countries(out, priority is not None, text_at(priority, "b330", "ctry"))


def _with_countries(out: dict, has_priority: bool, country: str | None) -> dict:
    applicant, assignee = "bio_applicant_country", "bio_assignee_country"
    if has_priority:
        return out | {applicant: country, assignee: country}
    return out | {"bio_country": "US", applicant: out.get(applicant) or "US", assignee: out.get(assignee) or "US"}


# Prefix-coded text. Sections that are read; those that are prose; tags of paragraphs.

SECTIONS = frozenset("PATN ASSG INVT CLAS ABST PRIR GOVT PARN BSUM DRWD DETD DCLM CLMS".split())
PROSE = frozenset("GOVT PARN BSUM DRWD DETD DCLM CLMS ABST".split())
MAX_SECTIONS = 200


def next_name(name: str, taken) -> str:
    """name, name_i, name_ii, ...: the first that is not taken."""
    while name in taken:
        name += "i" if "_" in name else "_i"
    return name


def split_sections(lines: list[str], compat: bool = False) -> list[list[str]]:
    """Lines by section; a line of one word begins one. compat: the last section is lost."""
    out: list[list[str]] = []
    for line in lines:
        if " " not in line or not out:
            out.append([line])
        else:
            out[-1].append(line)
    return out[:-1] if compat else out


def read_section(lines: list[str]) -> dict[str, str | list[str]]:
    """Tag to value; paragraphs of all kinds under PAL, in order."""
    if lines[0].strip() in PROSE:
        return {"PAL": [line[3:].strip() for line in lines[1:]]} if len(lines) > 1 else {}
    out = {}
    for line in lines[1:]:
        tag, value = line[:3], line[3:].strip()
        if tag in ("   ", "TBL") or tag[:2] == "PA":
            out.setdefault("PAL", []).append(value)
        else:
            out[next_name(tag, out) if tag in out else tag] = value
    return out


def read_sections(lines: list[str], compat: bool = False) -> dict[str, dict]:
    found = [s for s in split_sections(lines, compat) if s[0].strip() in SECTIONS]
    if len(found) > MAX_SECTIONS:
        raise ValueError(f"{len(found)} sections")
    out: dict[str, dict] = {}
    for section in found:
        name = section[0].strip()
        out[next_name(name, out) if name in out else name] = read_section(section)
    return out


def flatten_values(section: dict | None) -> list[str]:
    """All values of a section as one list."""
    return [] if section is None else [v for value in section.values() for v in (value if isinstance(value, list) else [value])]


def parse_text(record: str, compat: bool = False) -> dict:
    """A record of prefix-coded text. The applicant is the first inventor; claims keep their numbers."""
    s = read_sections(record.split("\n"), compat)
    head, owner, person, codes = (s.get(k) for k in ("PATN", "ASSG", "INVT", "CLAS"))
    get = lambda section, tag: None if section is None else section.get(tag)
    country = get(owner, "CNT") or get(person, "CNT")
    out = {"bio_doc-number": get(head, "WKU"), "bio_date": get(head, "ISD"), "bio_application_date": get(head, "APD"), "bio_country": country, "bio_ok": head is not None and "WKU" in head and "ISD" in head}
    if person is not None:
        last, semicolon, first = (get(person, "NAM") or "").partition(";")
        out["bio_applicant_country"] = out["bio_inventor_country"] = person.get("CNT")
        out["bio_applicant_state"] = out["bio_inventor_state"] = person.get("STA")
        out["bio_applicant_city"] = out["bio_inventor_city"] = person.get("CTY")
        out["bio_applicant_zip"] = out["bio_inventor_zip"] = person.get("ZIP")
        if semicolon:
            out["bio_applicant_first_name"] = out["bio_inventor_first_name"] = first.split(";")[0].strip()
            out["bio_applicant_last_name"] = out["bio_inventor_last_name"] = last.strip()
    out["applicant_ok"] = person is not None and out.get("bio_applicant_first_name") is not None
    if owner is not None and get(owner, "NAM") is not None:
        out |= {"bio_assignee_name": owner["NAM"].strip(), "bio_assignee_country": owner.get("CNT"), "bio_assignee_state": owner.get("STA"), "bio_assignee_city": owner.get("CTY"), "bio_assignee_zip": owner.get("ZIP")}
    if get(codes, "OCL") is not None:
        out |= {"bio_main-classification_national": "US " + codes["OCL"].strip(), "bio_main-classification_ipc": get(codes, "ICL")}
    out["abstract_paras"] = flatten_values(s.get("ABST"))
    out["description_paras"] = [v for k in ("GOVT", "PARN", "BSUM", "DRWD", "DETD") if k in s for v in flatten_values(s[k])]
    out["claims_claims"] = [v for k in ("DCLM", "CLMS") if k in s for v in flatten_values(s[k])]
    out |= {"abstract_ok": "ABST" in s, "description_ok": bool(out["description_paras"]) and not compat, "claims_ok": bool(out["claims_claims"])}
    priority = s.get("PRIR")
    return _with_countries(out, priority is not None, get(priority, "CNT"))


PARSERS: dict[str, Callable[[str, bool], dict]] = {"xml": parse_xml, "sgml": parse_sgml, "text": parse_text}


def parse_records(records: DataFrame, kind: str, compat: bool = False) -> DataFrame:
    """file, record -> the flat record with its statuses; a record that can't be parsed has only parse_error."""
    parse = PARSERS[kind]
    names = PARSED.fieldNames()
    types = [pa.list_(pa.string()) if f.dataType.typeName() == "array" else pa.bool_() if f.dataType.typeName() == "boolean" else pa.string() for f in PARSED.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    row = dict.fromkeys(STATUS, False) | parse(record, compat)
                except Exception as e:  # the record is at fault, whatever it is
                    row = dict.fromkeys(STATUS, False) | {"parse_error": f"{type(e).__name__}: {e}"}
                rows.append(row | {"file": file})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    return records.select("file", "record").mapInArrow(run, PARSED)


def parse_log(parsed: DataFrame) -> DataFrame:
    """File, number and statuses of each record."""
    return parsed.select("file", F.col("`bio_doc-number`").alias("doc_number"), *STATUS, "parse_error")


def content(parsed: DataFrame) -> DataFrame:
    """The flat records themselves, with their year."""
    return parsed.where("parse_error IS NULL").select(*(F.col(f"`{c}`") for c in RECORD.fieldNames()), F.substring("bio_date", 1, 4).try_cast("int").alias("year"))


def find_record(records: DataFrame, doc_number: str, kind: str) -> DataFrame:
    """file and record of the raw records that bear a number; those that only cite it don't count.

    Records without the number anywhere are left out before any is parsed.
    """
    holding = records.where(F.contains("record", F.lit(doc_number))).select("file", "record")
    parse = PARSERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bears(x) for x in batch.column(1).to_pylist()], pa.bool_()))

    def bears(record: str) -> bool:
        try:
            return parse(record, False).get("bio_doc-number") == doc_number
        except Exception:  # a record that can't be parsed bears no number
            return False

    return holding.mapInArrow(run, holding.schema)


def pretty(record: Column | str) -> Column:
    """A record as indented XML, for reading; what is not well formed stays as it is."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(indented)

    return run(F.col(record) if isinstance(record, str) else record)


def indented(record: str | None) -> str | None:
    if record is None:
        return None
    try:
        tree = ElementTree.fromstring(record)
    except (ElementTree.ParseError, ValueError):
        return record
    ElementTree.indent(tree)
    return ElementTree.tostring(tree, encoding="unicode")


def write_records(records: DataFrame, path: str) -> None:
    """Raw records (file, record) as text, indented, one after another."""
    records.select(pretty("record").alias("value")).write.mode("overwrite").text(path)
