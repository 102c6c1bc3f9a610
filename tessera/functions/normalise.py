"""Text normalisation and key extraction as column expressions.

Three dialects: `sql` (punctuation to blanks, domains and legal forms taken off), `audit` (ASCII letters, digits and
single blanks; generic words taken off) and `py` (accents folded first; see clean_business_name and clean_address).
Patterns spell out ASCII classes, so they mean the same to Java and to RE2. Null inputs count as empty.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists and patterns that results depend on.
DOMAINS = "com|org|net|in|co|gov|edu|fr|io"
LEGAL_WORDS = "incorporated|corporation|enterprises|enterprise|associates|industries|industry|holdings|holding|services|service|company|limited|llc|inc|corp|ltd|llp|co|sarl|sas|sa|sci|eurl|sasu"
LEGAL_PAIRS = (("private", "limited"), ("pvt", "ltd"), ("pvt", "limited"))
AUDIT_LEGAL = "private limited|pvt ltd|pvt limited|incorporated|corporation|enterprises|enterprise|associates|industries|industry|company|limited|llc|inc|corp|ltd|llp|sarl|sas|sa|sci|eurl|the|ms|smt|shree|sri|dr|pvt"
AUDIT_STREET = "road|street|drive|avenue|lane|near|opp|opposite|floor|building|shop|plot|nagar|colony|block|west|east|north|south"
ABBREVIATIONS = (
    ("st", "street"), ("rd", "road"), ("dr", "drive"), ("ave", "avenue"), ("av", "avenue"), ("blvd", "boulevard"), ("bd", "boulevard"), ("ln", "lane"), ("ct", "court"),
    ("pl", "place"), ("pkwy", "parkway"), ("hwy", "highway"), ("apt", "unit"), ("ste", "unit"), ("suite", "unit"), ("opp", "near"), ("opposite", "near"),
)

SPACE = r"[\t\n\f\r ]"
NOT_WORD = r"[^A-Za-z0-9_\t\n\f\r ]"
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
LEGAL = "|".join([f"{a}{SPACE}+{b}" for a, b in LEGAL_PAIRS]) + "|" + LEGAL_WORDS


def _text(s: Column | str) -> Column:
    return F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit(""))


def _words(s: Column, words: str, by: str) -> Column:
    return F.regexp_replace(s, f"{BEFORE}(?:{words}){AFTER}", by)


def strip_domain(s: Column | str, dialect: str = "sql") -> Column:
    """Without web prefixes and domain endings (`sql`), or without the words that name them (`audit`)."""
    if dialect == "audit":
        return _words(norm_text(s, "audit"), DOMAINS, "")
    return F.regexp_replace(F.regexp_replace(_text(s), r"https?://(?:www\.)?|www\.", ""), rf"\.(?:{DOMAINS}){AFTER}", " ")


def norm_text(s: Column | str, dialect: str = "sql") -> Column:
    if dialect == "audit":
        return F.lower(F.regexp_replace(F.regexp_replace(_text(s), "[^a-zA-Z0-9 ]", " "), " +", " "))
    return F.lower(F.trim(F.regexp_replace(strip_domain(s), NOT_WORD, " ")))


def clean_legal(s: Column | str, dialect: str = "sql") -> Column:
    """norm_text without words for legal forms."""
    if dialect == "audit":
        return F.trim(_words(strip_domain(s, "audit"), AUDIT_LEGAL, ""))
    return F.trim(_words(norm_text(s), LEGAL, " "))


def compact_name(s: Column | str, dialect: str = "sql") -> Column:
    if dialect == "audit":
        return F.regexp_replace(clean_legal(s, "audit"), " ", "")
    return F.regexp_replace(norm_text(s), f"{SPACE}+", "")


def get_token(s: Column | str, n: int, dialect: str = "sql") -> Column:
    """The n-th (from 1) of the parts between single blanks; empty (`audit`: null) if there are fewer."""
    token = F.try_element_at(F.split(F.trim(_text(s)), " "), F.lit(n))
    return token if dialect == "audit" else F.coalesce(token, F.lit(""))


def clean_addr(s: Column | str, dialect: str = "sql") -> Column:
    if dialect == "audit":
        return F.trim(_words(norm_text(s, "audit"), AUDIT_STREET, ""))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_text(s), NOT_WORD, " "), f"{SPACE}+", " ")))


def postal(address: Column | str, dialect: str = "sql") -> Column:
    """The first number of 3 digits or more of the cleaned address, or (`audit`) of 5 or 6 of the raw one; else empty."""
    if dialect == "audit":
        return F.regexp_extract(_text(address), f"{BEFORE}[0-9]{{5,6}}{AFTER}", 0)
    return F.regexp_extract(clean_addr(address), f"{BEFORE}([0-9]{{3,}}){AFTER}", 1)


def door(address: Column | str, dialect: str = "sql") -> Column:
    """The number that the cleaned address begins with, or (`audit`) the first of up to 4 digits of the raw one."""
    if dialect == "audit":
        return F.regexp_extract(_text(address), f"{BEFORE}[0-9]{{1,4}}{AFTER}", 0)
    return F.regexp_extract(clean_addr(address), "^([0-9]+)", 1)


def digit_set(s: Column | str) -> Column:
    """The different whole-word numbers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(s), F.lit(f"{BEFORE}([0-9]+){AFTER}"), 1)))


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Letters without accents; what has no ASCII form is dropped. Java has no such function, hence Arrow."""
    return s.fillna("").map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"))


def clean_business_name(name: Column | str) -> tuple[Column, Column]:
    """(normalised name, name without legal forms or, if nothing is left, the normalised name) of the `py` dialect."""
    s = F.lower(fold_accents(_text(name)))
    s = F.regexp_replace(F.regexp_replace(s, r"https?://(?:www\.)?|www\.", ""), rf"\.(?:{DOMAINS}){AFTER}", " ")
    full = F.trim(F.regexp_replace(F.regexp_replace(s, NOT_WORD, " "), f"{SPACE}+", " "))
    core = F.trim(F.regexp_replace(_words(full, LEGAL, " "), f"{SPACE}+", " "))
    return full, F.when(core == "", full).otherwise(core)


def clean_address(address: Column | str) -> tuple[Column, Column]:
    """(normalised address with abbreviations written out, its numbers) of the `py` dialect."""
    s = F.lower(fold_accents(_text(address)))
    numbers = digit_set(s)
    for short, long in ABBREVIATIONS:
        s = _words(s, short, long)
    return F.trim(F.regexp_replace(F.regexp_replace(s, NOT_WORD, " "), f"{SPACE}+", " ")), numbers
