"""All registered queries. Dates are computed in UTC whatever the session was given."""

from __future__ import annotations

from functools import wraps

from tidemark.plans import intraday, macro, market


def _in_utc(query):
    @wraps(query)
    def run(spark, folder):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, folder)

    return run


ALL = {name: _in_utc(query) for name, query in {**market.QUERIES, **macro.QUERIES, **intraday.QUERIES}.items()}
