"""Pieces of the SQL side that several queries use."""

from __future__ import annotations


def low(sql: str) -> str:
    return f"replace(lower({sql}), 'ß', 'ss')"


def flat(sql: str) -> str:
    return f"regexp_replace({low(sql)}, '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')"


def normal(sql: str) -> str:
    return "trim(regexp_replace(regexp_replace(regexp_replace(trim(" + sql + "), '[“”\"''`]+', ' ', 'g'), '[《》〈〉【】\\[\\]（）()]+', ' ', 'g'), '\\s+', ' ', 'g'))"
