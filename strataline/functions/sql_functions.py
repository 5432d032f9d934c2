"""The scalar functions as SQL functions, expanded by Catalyst like built-in ones."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"

FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "vector_dot": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", _DOT.format(a="a", b="b")),
    "vector_norm": ("a ARRAY<FLOAT>", "DOUBLE", f"sqrt({_DOT.format(a='a', b='a')})"),
    "vector_cosine": (
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
        "DOUBLE",
        f"CASE WHEN size(a) = size(b) THEN {_DOT.format(a='a', b='b')} / nullif(sqrt({_DOT.format(a='a', b='a')}) * sqrt({_DOT.format(a='b', b='b')}), 0) END",
    ),
    "score_minmax": ("score DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN high = 0 THEN 0 WHEN high = low THEN 1 ELSE (score - low) / (high - low) END"),
    "serial_date": ("serial INT", "DATE", "date_add(DATE'1900-01-01', serial - 2)"),
    "column_number": ("letters STRING", "BIGINT", "aggregate(filter(split(upper(letters), ''), c -> c <> ''), CAST(0 AS BIGINT), (n, c) -> n * 26 + ascii(c) - 64)"),
    "quoted_phrases": ("text STRING", "ARRAY<STRING>", """filter(transform(regexp_extract_all(text, '"([^"]*)"', 1), p -> trim(p)), p -> p <> '')"""),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL in this session; their names."""
    for name, (parameters, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return sorted(FUNCTIONS)
