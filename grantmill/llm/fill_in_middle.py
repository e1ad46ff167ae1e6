"""Fill-in-middle documents, cut and rearranged by DuckDB within each Arrow batch.

``mapInArrow`` hands every batch to a DuckDB connection of the task: the batch is
registered as a table, and one SQL statement takes the text apart into code points
(``regexp_extract_all``), cuts prefix, middle and suffix out of that list
(``list_slice``, ``array_to_string``), draws cuts and form from the ``sha256`` of the
doc_id, and gives Arrow back. Python touches no row. A batch is registered in slices of
at most SLICE_ROWS rows and SLICE_BYTES bytes of text (or one longer text), as a list of
code points takes many times its text's size.

The draw depends on doc_id and text only, so any task that is run again gives the same.

Defined results: a null text counts as empty and gives form ``plain``; a null doc_id
draws as the empty string does; repeated rows give equal rows; very long texts are cut
like any other; an empty table gives no rows. Other columns pass through; columns that
have the names of new ones, or begin with ``_fim_``, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Documents in a hundred that are rearranged, and of these in a hundred those whose suffix stands first.
RATE, SUFFIX_FIRST = 90, 20
#: Rows and bytes of text that are registered at once.
SLICE_ROWS, SLICE_BYTES = 2048, 2 << 20

#: Columns that the cut adds.
CUT = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("fim_text", StringType())])

_P, _S, _M = MARKS
_HAS_MARK = " OR ".join(f"contains(text, '{m}')" for m in MARKS)
_CUT = rf"""
    WITH points AS (SELECT row, text, regexp_extract_all(text, '(?s).') AS points, sha256('1:' || coalesce(doc_id, '')) AS digest FROM batch),
    drawn AS (SELECT row, text, points, len(points) AS n, {", ".join(f"('0x' || substr(digest, {8 * k + 1}, 8))::UBIGINT AS h{k + 1}" for k in range(4))} FROM points),
    cuts AS (SELECT row, text, points, n, least(h1 % (n + 1), h2 % (n + 1)) AS first, greatest(h1 % (n + 1), h2 % (n + 1)) AS last,
        CASE WHEN n = 0 OR {_HAS_MARK} OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    parts AS (SELECT row, text, n, first, last, form, array_to_string(list_slice(points, 1, first), '') AS prefix,
        array_to_string(list_slice(points, first + 1, last), '') AS middle, array_to_string(list_slice(points, last + 1, n), '') AS suffix FROM cuts),
    formed AS (SELECT row, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN first::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (last - first)::BIGINT END AS middle_chars,
        CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{_P}' || prefix || '{_S}' || suffix || '{_M}' || middle ELSE '{_S}' || suffix || '{_P}' || prefix || '{_M}' || middle END AS fim_text FROM parts)"""

# Text and form are all that the way back needs: no part holds a mark, and a mark can't overlap itself or another.
_RESTORE = f"""
    restored AS (SELECT *, CASE form WHEN 'plain' THEN fim_text
        WHEN 'psm' THEN split_part(fim_text[4:], '{_S}', 1) || split_part(fim_text, '{_M}', 2) || split_part(split_part(fim_text, '{_S}', 2), '{_M}', 1)
        ELSE split_part(split_part(fim_text, '{_P}', 2), '{_M}', 1) || split_part(fim_text, '{_M}', 2) || split_part(fim_text[4:], '{_P}', 1) END AS restored FROM formed)"""


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces within SLICE_ROWS and SLICE_BYTES."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(text):
        before = ends[at - 1] if at else 0
        n = max(1, min(SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - at))
        yield at, n
        at += n


def _mapped(df: DataFrame, inputs: list[str], sql: str, added: StructType) -> DataFrame:
    """df with the columns that sql (over ``batch``: row and the inputs) selects, row by row."""
    base = df.drop(*(n for n in added.names if n not in inputs))
    schema = StructType([*(f for f in base.schema.fields), *(f for f in added.fields if f.name not in base.columns)])
    types = {f.name: {LongType(): pa.int64(), StringType(): pa.string()}[f.dataType] for f in added.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1}) as db:
            for whole in batches:
                places = [whole.schema.get_field_index(n) for n in inputs]
                for at, n in _slices(whole.column(places[0])):
                    part = whole.slice(at, n)
                    columns = {"row": pa.array(np.arange(n)), **{name: part.column(k) for name, k in zip(inputs, places)}}
                    db.register("batch", pa.table(columns))
                    found = db.sql(sql).to_arrow_table().combine_chunks()
                    db.unregister("batch")
                    new = {name: found.column(name).cast(t).combine_chunks() for name, t in types.items()}
                    new = {name: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for name, c in new.items()}
                    yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part.column(part.schema.get_field_index(f.name)) for f in schema.fields], names=schema.names)

    return base.mapInArrow(run, schema)


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_fim_text": F.coalesce(F.col("text").cast("string"), F.lit("")), "_fim_id": F.col("doc_id").cast("string")})


def _over(sql: str, columns: str) -> str:
    named = sql.replace("FROM batch", "FROM (SELECT row, _fim_text AS text, _fim_id AS doc_id FROM batch)")
    return f"{named} SELECT {columns} FROM {'restored' if 'restored AS' in sql else 'formed'} ORDER BY row"


def transform(docs: DataFrame) -> DataFrame:
    """docs with n (code points), form (psm, spm or plain), prefix_chars, middle_chars and fim_text."""
    return _mapped(_inputs(docs), ["_fim_text", "_fim_id"], _over(_CUT, ", ".join(CUT.names)), CUT).drop("_fim_text", "_fim_id")


def restore(formed: DataFrame, name: str = "restored") -> DataFrame:
    """The texts that ``transform`` was given, from fim_text and form alone, as a column of that name."""
    held = formed.withColumns({"_fim_text": F.col("fim_text"), "_fim_form": F.col("form")})
    sql = f"WITH formed AS (SELECT row, _fim_text AS fim_text, _fim_form AS form FROM batch), {_RESTORE} SELECT restored AS {name} FROM restored ORDER BY row"
    return _mapped(held, ["_fim_text", "_fim_form"], sql, StructType([StructField(name, StringType())])).drop("_fim_text", "_fim_form")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the formed and the restored text.

    Texts are formed, restored and digested in one statement, so none of them comes back from Python.
    """
    digests = StructType([*CUT.fields[:-1], StructField("output_sha256", StringType()), StructField("restored_sha256", StringType())])
    sql = _over(f"{_CUT}, {_RESTORE}", ", ".join([*CUT.names[:-1], "sha256(fim_text) AS output_sha256", "sha256(restored) AS restored_sha256"]))
    found = _mapped(_inputs(docs.select("doc_id", "text")), ["_fim_text", "_fim_id"], sql, digests)
    return found.select("doc_id", *digests.names)
