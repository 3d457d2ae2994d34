"""SQL names that Spark lacks, as SQL functions, which Catalyst inlines: nothing here runs Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

_EUCLID = "aggregate(sequence(1, 100), struct(abs(a) as x, abs(b) as y), (s, i) -> if(s.y = 0, s, struct(s.y as x, s.x % s.y as y)), s -> s.x)"
FUNCTIONS = {
    "strpos(s STRING, sub STRING) RETURNS BIGINT": "cast(instr(s, sub) as bigint)",
    "to_hex(x BIGINT) RETURNS STRING": "lower(hex(x))",
    "gcd(a BIGINT, b BIGINT) RETURNS BIGINT": _EUCLID,
    "lcm(a BIGINT, b BIGINT) RETURNS BIGINT": f"if(a = 0 or b = 0, 0, abs(a div {_EUCLID} * b))",
    "iszero(x DOUBLE) RETURNS BOOLEAN": "x = 0",
    "trunc_number(x DOUBLE) RETURNS DOUBLE": "if(x < 0, ceil(x), floor(x))",
    "starts_with(s STRING, p STRING) RETURNS BOOLEAN": "startswith(s, p)",
    "ends_with(s STRING, p STRING) RETURNS BOOLEAN": "endswith(s, p)",
    "to_timestamp_millis(x BIGINT) RETURNS TIMESTAMP_NTZ": "cast(timestamp_millis(x) as timestamp_ntz)",
    "to_timestamp_micros(x BIGINT) RETURNS TIMESTAMP_NTZ": "cast(timestamp_micros(x) as timestamp_ntz)",
    "to_timestamp_seconds(x BIGINT) RETURNS TIMESTAMP_NTZ": "cast(timestamp_seconds(x) as timestamp_ntz)",
    "tesserae_shard(c STRING, i INT, n INT) RETURNS BOOLEAN": "true",
}
#: Names that only need another spelling, whatever their arguments.
RENAMED = {
    "array_length": "array_size", "array_agg": "collect_list", "approx_distinct": "approx_count_distinct", "approx_percentile_cont": "approx_percentile", "quantile_cont": "percentile",
    "array_has": "array_contains", "generate_series": "sequence", "array_reverse": "reverse", "to_unixtime": "unix_timestamp",
    "random": "rand", "unnest": "explode", "list_contains": "array_contains", "var_population": "var_pop", "array_has_any": "arrays_overlap",
}


def register(spark: SparkSession) -> None:
    """Once a session."""
    if spark.catalog.functionExists("tesserae_shard"):
        return
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
