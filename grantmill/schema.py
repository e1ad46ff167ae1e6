"""Declared schemas. Nothing is inferred at a boundary, so ids keep their zeros and 'NA' stays a country."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

PERSON = ("first_name", "last_name", "organization_name", "country", "state", "city", "zip")
ASSIGNEE = ("name", "city", "state", "country", "zip")
CODES = ("ipc", "cpc", "national", "locarno")

#: The flat record of all three formats; where a format lacks a field (zip in XML and SGML), it is null.
RECORD_STRINGS = (
    ["bio_doc-number", "bio_country", "bio_date", "bio_application_date"]
    + [f"bio_applicant_{f}" for f in PERSON]
    + [f"bio_inventor_{f}" for f in PERSON]
    + [f"bio_assignee_{f}" for f in ASSIGNEE]
    + [f"bio_main-classification_{f}" for f in CODES]
)
RECORD_LISTS = ["abstract_paras", "description_paras", "claims_claims"]
#: What the log says of a record: whether each part was found, and what went wrong with the whole.
STATUS = ["bio_ok", "abstract_ok", "description_ok", "claims_ok", "applicant_ok"]

RECORD = StructType([StructField(c, StringType()) for c in RECORD_STRINGS] + [StructField(c, ArrayType(StringType())) for c in RECORD_LISTS])
PARSED = StructType([StructField("file", StringType()), *RECORD.fields, *(StructField(c, BooleanType()) for c in STATUS), StructField("parse_error", StringType())])
