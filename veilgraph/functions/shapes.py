"""Shapes of identifiers, as Spark columns and, where Python needs them, as patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DASHED = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
SID = r"S-\d+-\d+(?:-\d+)+"
SID_ANY = rf"(?:.+-)?{SID}"
GUID = rf"(?:{DASHED}|\{{{DASHED}\}}|[0-9a-f]{{32}})"
OID = r"[0-9]+(?:\.[0-9]+){2,}"
DOMAIN_RID = r"S-1-5-21-[0-9]+-[0-9]+-[0-9]+-([0-9]+)"
PREFIXED = r"(.+)-(S-1-.+)"
DN_TYPES = ("c", "cn", "dc", "l", "o", "ou", "st", "street", "uid")
REDACTED = r"\[REDACTED(?::[a-z2-7]+)?\]"

sid_any, guid, oid = (re.compile(rf"(?i:{p})") for p in (SID_ANY, GUID, OID))
prefixed = re.compile(PREFIXED, re.I)
token_guid = re.compile(rf"(?i)\{{?{DASHED}\}}?")
token_sid = re.compile(r"S-1-5-21-\d+-\d+-\d+(?:-\d+)?")


def whole(col: Column, pattern: str) -> Column:
    """The whole value matches; Java's $ would also stop before a final newline."""
    return col.rlike(rf"(?i)\A(?:{pattern})\z")


def is_sid(col: Column) -> Column:
    return whole(col, SID)


def is_guid(col: Column) -> Column:
    return whole(col, GUID)


def is_oid(col: Column) -> Column:
    return col.rlike(rf"\A{OID}\z")


def inner_sid(col: Column) -> Column:
    """The SID behind a domain prefix; other values as they are."""
    inner = F.regexp_extract(col, rf"(?is)\A{PREFIXED}\z", 2)
    return F.when(inner != "", inner).otherwise(col)


def domain_rid(col: Column) -> Column:
    """The last arc of a domain principal's SID, null for anything else."""
    return F.nullif(F.regexp_extract(col, rf"(?i)\A{DOMAIN_RID}\z", 1), F.lit(""))


def dn_parses(col: Column) -> Column:
    """Every component has a standard attribute type and a value."""
    types = "|".join(DN_TYPES)
    plain = F.forall(F.flatten(F.transform(F.split(col, ","), lambda r: F.split(r, r"\+"))), lambda a: a.rlike(r"(?s)\A[^=]+=.+\z"))
    escaped = F.forall(
        F.flatten(F.transform(F.regexp_extract_all(F.concat(col, F.lit(",")), F.lit(r"(?s)((?:[^\\,]|\\.)*),"), F.lit(1)), lambda r: F.regexp_extract_all(F.concat(r, F.lit("+")), F.lit(r"(?s)((?:[^\\+]|\\.)*)\+"), F.lit(1)))),
        lambda a: a.rlike(rf"(?is)\A\s*(?:{types})\s*="),
    )
    return (col != "") & plain & escaped


def spn_parses(col: Column) -> Column:
    return col.rlike(r"(?s)\A[^/]+/[^/]+(?:/[^/]+)?\z")


def fold(col: Column) -> Column:
    """Full case folding: JVM-side for ASCII, Python for the rest."""
    plain = col.rlike(r"\A\p{ASCII}*\z")
    return F.when(plain, F.lower(col)).otherwise(_python_fold(F.when(~plain, col)))


@F.pandas_udf(T.StringType())
def _python_fold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")
