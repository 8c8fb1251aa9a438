"""Column presets: the project record table and the tables of the registered queries."""

from __future__ import annotations

from pyspark.sql import types as T

from kinmatch import fixed_values as fixed
from kinmatch.operators.recommend import RecordColumns
from kinmatch.operators.upsert import UpsertSpec, castable, max_length, one_of

PROJECT_SCHEMA = T.StructType(
    [
        T.StructField("project_code", T.StringType(), False),
        T.StructField("project_name", T.StringType(), False),
        T.StructField("grade_code", T.StringType()),
        T.StructField("sap_phase", T.StringType()),
        T.StructField("sales_dept_code", T.StringType()),
        T.StructField("project_from_date", T.DateType()),
        T.StructField("contract_account", T.StringType()),
        T.StructField("industry_detail", T.StringType()),
        T.StructField("business_type", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("methodology_value", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
PROJECT_FIELDS = [
    "project_name", "grade_code", "sap_phase", "sales_dept_code", "project_from_date",
    "contract_account", "industry_detail", "business_type", "summary", "methodology_value",
]
PROJECT_EMBEDDING_TEXT = [
    "project_name", "sales_dept_code", "contract_account", "industry_detail", "business_type",
    "summary", "methodology_value",
]
PROJECT_SEARCH = [
    "project_name", "summary", "sales_dept_code", "industry_detail", "contract_account",
    "business_type",
]
# JSON names of the record columns
PROJECT_JSON = {
    "project_code": "projectCode",
    "project_name": "projectName",
    "grade_code": "gradeCode",
    "sap_phase": "sapPhase",
    "sales_dept_code": "salesDeptCode",
    "project_from_date": "projectFromDate",
    "contract_account": "contractAccount",
    "industry_detail": "industryDetail",
    "business_type": "businessType",
    "summary": "summary",
    "methodology_value": "methodologyValue",
}
PROJECT_SHORT_JSON = {
    name: PROJECT_JSON[name]
    for name in ("project_code", "project_name", "grade_code", "sales_dept_code", "industry_detail")
}
PROJECT_RESULT_JSON = {
    name: label for name, label in PROJECT_JSON.items()
    if name not in ("sap_phase", "project_from_date")
}
PROJECT_UPSERT = UpsertSpec(
    key_col="project_code",
    name_col="project_name",
    fields=PROJECT_FIELDS,
    date_cols=["project_from_date"],
    rules={
        "project_code": {"longer than 400": max_length(400)},
        "project_name": {"longer than 200": max_length(200)},
        "grade_code": {"longer than 10": max_length(10)},
        "sap_phase": {"longer than 100": max_length(100), "not a phase": one_of(fixed.PHASES)},
        "sales_dept_code": {"longer than 100": max_length(100)},
        "project_from_date": {"not a date": castable("date")},
        "contract_account": {"longer than 400": max_length(400)},
        "industry_detail": {"longer than 30": max_length(30)},
        "business_type": {
            "longer than 30": max_length(30), "not a business type": one_of(fixed.BUSINESS_TYPES)
        },
        "methodology_value": {"longer than 30": max_length(30)},
    },
)
PROJECT_COLUMNS = RecordColumns(
    key="project_code",
    title="project_name",
    match=["summary", "sales_dept_code", "industry_detail", "contract_account", "business_type"],
    score=[
        "project_name", "summary", "sales_dept_code", "industry_detail", "contract_account",
        "business_type", "methodology_value",
    ],
    newest="created_at",
    shown=PROJECT_RESULT_JSON,
    summary="summary",
)

# Tables of the registered queries
DOCUMENT_COLUMNS = RecordColumns(
    key="doc_id", title=None, match=["text", "source"], score=["text", "source"],
    newest="n_chars", shown={"doc_id": "docId", "lang": "lang", "source": "source"},
)
PART_COLUMNS = RecordColumns(
    key="p_partkey", title="p_name", match=["p_brand", "p_type"],
    score=["p_name", "p_brand", "p_type"], newest="p_retailprice",
    shown={"p_partkey": "partKey", "p_name": "partName"},
)
PART_UPSERT = UpsertSpec(
    key_col="p_partkey",
    name_col="p_name",
    fields=["p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    rules={
        "p_name": {"longer than 60": max_length(60)},
        "p_brand": {"longer than 10": max_length(10)},
        "p_type": {"not a type": lambda value: value.startswith("BAD")},
        "p_retailprice": {"not a number": castable("double")},
    },
)
