"""Text rules: levels, literal search, visible text, message masks."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tidelog.functions import fixed
from tidelog.functions.values import col, contains_ci


def body_error(body: str | Column = "Body") -> Column:
    """The substring ERR in any case (which FERRY has too)."""
    return contains_ci(body, "err")


def body_warn(body: str | Column = "Body") -> Column:
    return contains_ci(body, "warn") | contains_ci(body, "wrn")


def severity_is(*names: str, severity: str | Column = "SeverityText") -> Column:
    return F.lower(col(severity)).isin(*names)


def level_predicate(level: str, severity: str = "SeverityText", body: str = "Body") -> Column:
    """Rows of a level as the search sees it: severity, or what the body says."""
    level = level.lower()
    error = severity_is("error", severity=severity) | body_error(body)
    if level == "error":
        return error
    if level in ("warn", "warning"):
        return (severity_is("warn", "warning", severity=severity) | body_warn(body)) & ~error
    if level in ("info", "debug"):
        return severity_is(level, severity=severity) & ~body_error(body) & ~body_warn(body)
    return severity_is(level, severity=severity)


def effective_level(severity: str | Column = "SeverityText", body: str | Column = "Body",
                    scan: int | None = 200) -> Column:
    """Severity, raised by the first `scan` body characters where it is info, debug or empty."""
    level = F.lower(F.coalesce(col(severity), F.lit("")))
    head = F.coalesce(col(body), F.lit(""))
    if scan is not None:
        head = F.substring(head, 1, scan)
    weak = level.isin("info", "debug", "", "—", "--")
    return (F.when(weak & body_error(head), "error")
            .when(weak & body_warn(head), "warn")
            .otherwise(level))


def text_match(c: str | Column, needle: str) -> Column:
    return contains_ci(c, needle)


def clean_text(c: str | Column) -> Column:
    """Visible text: junk prefixes, invisible characters and outer blanks removed."""
    prefixes = "".join(f"(?:{re.escape(p)})?" for p in fixed.JUNK_PREFIXES)
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), "^" + prefixes, "")
    text = F.regexp_replace(text, "[" + "".join(fixed.INVISIBLE) + "]", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def message_pattern(body: str | Column = "Body", literal: bool = False) -> Column:
    """Body without timestamps and IPv4 addresses, hex runs and digits masked.

    `literal=True` keeps the seven blanks that precede the alternation in the matched
    source, where they stop plain timestamps from being stripped.
    """
    stripped = fixed.TIMESTAMP_RE + (" " * 7 if literal else "") + "|" + fixed.IPV4_RE
    return F.ltrim(F.regexp_replace(F.regexp_replace(col(body), stripped, ""), fixed.MASK_RE, "?"))


def spam_group(body: str | Column = "Body") -> Column:
    return F.substring(F.regexp_replace(F.lower(col(body)), fixed.SPAM_STRIP, ""), 1, fixed.SPAM_GROUP_CHARS)


def critical_class(body: str | Column = "Body", rules=None) -> Column:
    """Type of the first critical class whose regex occurs in the body, else NULL."""
    chain = None
    for name, pattern, _ in rules or fixed.CRITICAL_CLASSES:
        hit = col(body).rlike("(?i)" + pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def critical_title(kind: str | Column, rules=None) -> Column:
    chain = None
    for name, _, title in rules or fixed.CRITICAL_CLASSES:
        chain = F.when(col(kind) == name, title) if chain is None else chain.when(col(kind) == name, title)
    return chain
