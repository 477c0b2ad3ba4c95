"""Request text, reply parsing and cleanup, the two-version table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (EXPLANATION_DELIMITER, NO_BUGS_SENTINEL, REQUEST_HEAD, REQUEST_TAIL,
                              clean_code_block)
from ..schemas import STATUS_NO_BUG, STATUS_NO_DELIMITER, STATUS_OK


def render_requests(sources: DataFrame, code: str = "source") -> DataFrame:
    """P5: adds ``request``, the instruction text wrapped around the code."""
    return sources.withColumn("request", F.concat(F.lit(REQUEST_HEAD), F.col(code), F.lit(REQUEST_TAIL)))


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds (fixed, explanation, status).

    * the whole reply equal to the sentinel (exact, untrimmed) -> empty fixed code, ``no_bug``;
    * otherwise split once on the delimiter; without one -> ``no_delimiter``, no code;
    * the code part goes through the three cleanup steps; the explanation half is kept.
    """
    r = F.col(reply)
    parts = F.split(r, _quote(EXPLANATION_DELIMITER), 2)
    sentinel = r == F.lit(NO_BUGS_SENTINEL)
    has_delim = F.size(parts) == 2
    status = (F.when(sentinel, F.lit(STATUS_NO_BUG))
              .when(has_delim, F.lit(STATUS_OK))
              .otherwise(F.lit(STATUS_NO_DELIMITER)))
    fixed = (F.when(sentinel, F.lit(""))
             .when(has_delim, clean_code_block(F.element_at(parts, 1))))
    explanation = F.when(~sentinel & has_delim, F.element_at(parts, 2))
    return replies.withColumn("fixed", fixed).withColumn("explanation", explanation).withColumn("status", status)


def _quote(s: str) -> str:
    """Regex that matches ``s`` literally."""
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def build_versions(buggy: DataFrame, fixed: DataFrame, key: str = "pair_id",
                   buggy_source: str = "source", fixed_source: str = "fixed") -> DataFrame:
    """K3: (pair_id, version, source) with 0 = buggy, 1 = fixed."""
    return (buggy.select(F.col(key).alias("pair_id"), F.lit(0).alias("version"), F.col(buggy_source).alias("source"))
            .unionByName(fixed.select(F.col(key).alias("pair_id"), F.lit(1).alias("version"),
                                      F.col(fixed_source).alias("source"))))
