"""The conforming functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .conform import VENUES

_NUMBERS = ", ".join(f"'{n}', '{i:02d}'" for i, n in enumerate(VENUES, 1))
_BARE = r"regexp_replace(stadium, '[\\s\\u3000]+', '')"
#: Name, parameters, result and body of each function.
FUNCTIONS = (
    ("official_venue_no", "stadium STRING", "STRING", f"coalesce(CASE WHEN {_BARE} RLIKE '^[0-9]{{1,2}}$' THEN lpad({_BARE}, 2, '0') END, try_element_at(map({_NUMBERS}), {_BARE}), {_BARE})"),
    ("race_key", "race_date DATE, race_no INT, stadium STRING", "STRING", "date_format(race_date, 'yyyy-MM-dd') || '-' || lpad(CAST(race_no AS STRING), 2, '0') || '-' || official_venue_no(stadium)"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, in place of earlier ones of their names; gives the names.

    Their bodies are SQL, so a query that calls them is optimised as if they were written out.
    """
    for name, takes, gives, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
