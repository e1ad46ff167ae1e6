"""The engine for users of SQL: scalar rules as SQL functions, record parsing as a table function.

``register(spark)`` adds them to a session:

* ``process_year(d)``, ``consolidate_country(assignee, applicant, record)``, ``normalise_doc_id(x)``,
  ``first_token(x)``, ``first_level(x)``, ``ipc_code(x)``, ``clean_keyword(x)``, ``clean_company(x)``: SQL
  functions, so the optimizer puts their bodies into the plan, as it does with column expressions;
* ``parse_records(TABLE(raw), kind)``: one flat row for each row of a table that has a column ``record``;
  the table's other columns come along, as the function finds out what they are when the query is analysed.
  A third argument, names with commas between them, says which parsed columns are wanted, as every other
  one costs its way from Python although nobody reads it.

Both give what the column functions and ``records.parse_records`` give.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import Row, StructType

from ..schema import PARSED, STATUS
from .columns import FALLBACK_RULES, FIRST_RULES, LEGAL_FORMS


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folded(value: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        value = f"regexp_replace({value}, {_quoted(pattern)}, {_quoted(replacement)})"
    return value


def _without_commas(value: str) -> str:
    for _ in range(2):
        value = f"btrim(regexp_replace({value}, r'^\\s+|\\s+$', ''), ',')"
    return value


def _without_forms(value: str) -> str:
    forms = "|".join(f.replace(".", r"\.").replace("&", r"\&").replace("/", r"\/").replace(" ", r"\s+") for f in sorted(LEGAL_FORMS, key=lambda f: (-len(f), f)))
    return f"regexp_replace(regexp_replace({value}, r'\\s+$', ''), r'(?iu)[\\s,]+(?:{forms})\\.?,?$', '')"


_IPC = "split(trim(regexp_replace(substring_index(substring_index(x, ';', 1), ' [', 1), r'\\s+', ' ')), ' ')"
_GROUP = f"split(get({_IPC}, 1), '/')"
_FIRST = _without_commas(_without_forms(_without_forms(_folded("x", FIRST_RULES))))
_SECOND = _without_commas(_folded("x", FALLBACK_RULES))

#: Name: parameters, type, body.
RULES = {
    "process_year": ("d STRING", "INT", "try_cast(substring(d, 1, 4) AS INT)"),
    "consolidate_country": (
        "assignee STRING, applicant STRING, record STRING", "STRING",
        "CASE WHEN char_length(coalesce(assignee, applicant, record, 'US')) = 3 THEN substring(coalesce(assignee, applicant, record, 'US'), 1, 2) ELSE coalesce(assignee, applicant, record, 'US') END",
    ),
    "normalise_doc_id": ("x STRING", "STRING", r"regexp_replace(ltrim('0', x), r'\.0$', '')"),
    "first_token": ("x STRING", "STRING", "substring_index(x, '|', 1)"),
    "first_level": ("x STRING", "STRING", "CASE WHEN contains(x, '||') THEN substring_index(x, '||', 1) ELSE '' END"),
    "ipc_code": (
        "x STRING", "STRING",
        f"CASE WHEN size({_IPC}) = 2 AND size({_GROUP}) = 2 THEN concat(get({_IPC}, 0), lpad(get({_GROUP}, 0), greatest(char_length(get({_GROUP}, 0)), 4), '0'), rpad(get({_GROUP}, 1), greatest(char_length(get({_GROUP}, 1)), 6), '0')) END",
    ),
    "clean_keyword": (
        "x STRING", "STRING",
        r"CASE WHEN contains(x, '(') THEN trim(concat(trim(substring_index(x, '(', 1)), ' ', trim(regexp_extract(x, r'(?s)\(.*?\)(.*)', 1)))) ELSE x END",
    ),
    "clean_company": ("x STRING", "STRING", f"CASE WHEN {_FIRST} NOT IN ('', ' ') THEN {_FIRST} WHEN {_SECOND} NOT IN ('', ' ') THEN {_SECOND} ELSE x END"),
}


class ParseRecords:
    """parse_records(TABLE(raw), kind[, columns]): raw has ``record`` and any other columns; kind is xml, sgml or text."""

    def __init__(self, analyze_result: AnalyzeResult):
        self.names = analyze_result.schema.fieldNames()
        self.parse = None

    @staticmethod
    def analyze(raw: AnalyzeArgument, kind: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        from ..sources.records import PARSERS

        if not raw.isTable or "record" not in raw.dataType.fieldNames():
            raise ValueError("parse_records needs TABLE(...) with a column named record")
        if not kind.isConstantExpression or kind.value not in PARSERS:
            raise ValueError(f"parse_records needs one of {sorted(PARSERS)} as its second argument")
        own = [f for f in raw.dataType.fields if f.name != "record"]
        found = {f.name: f for f in PARSED.fields}
        if columns is not None:
            wanted = [c.strip() for c in columns.value.split(",")] if columns.isConstantExpression and isinstance(columns.value, str) else [""]
            if not set(wanted) <= set(found) or len(set(wanted)) < len(wanted):
                raise ValueError(f"parse_records needs different names of {sorted(found)} as its third argument")
            found = {c: found[c] for c in wanted}
        return AnalyzeResult(StructType([*own, *(f for c, f in found.items() if c not in {o.name for o in own})]))

    def eval(self, raw: Row, kind: str, columns: str | None = None) -> Iterator[tuple]:
        if self.parse is None:
            from ..sources.records import PARSERS

            self.parse, self.at = PARSERS[kind], raw.__fields__.index("record")
            self.names = self.names[len(raw) - 1 :]
        found = dict.fromkeys(STATUS, False)
        try:
            found |= self.parse(raw[self.at], False)
        except Exception as e:  # the record is at fault, whatever it is
            found = dict.fromkeys(STATUS, False) | {"parse_error": f"{type(e).__name__}: {e}"}
        yield (*raw[: self.at], *raw[self.at + 1 :], *map(found.get, self.names))


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in RULES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    from pyspark.sql.functions import udtf

    spark.udtf.register("parse_records", udtf(ParseRecords))
