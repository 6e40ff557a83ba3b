"""Coordinate geometry as SQL functions, inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters and expression of each function.
FUNCTIONS = {
    "cogo_azimuth": ("a DOUBLE", "pmod(a, 2 * pi())"),
    "cogo_back_azimuth": ("a DOUBLE", "pmod(a + pi(), 2 * pi())"),
    "cogo_departure": ("az DOUBLE, d DOUBLE", "d * sin(az)"),
    "cogo_latitude": ("az DOUBLE, d DOUBLE", "d * cos(az)"),
    "cogo_distance": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "hypot(x2 - x1, y2 - y1)"),
    "cogo_inverse_azimuth": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "pmod(atan2(x2 - x1, y2 - y1), 2 * pi())"),
}


def register_functions(spark: SparkSession) -> None:
    """Makes the functions known to this session's SQL, replacing those of the same names."""
    for name, (parameters, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {expression}")
