"""Year ranges in free text, normalised by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words of the rule "last <word> years".
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
LAST = r"(?:last|past|previous|recent)"
VALID = r"^(19|20)\d\d(-(19|20)\d\d)?$"


def normalise_year_range(raw: Column, study_year: Column) -> Column:
    """struct(range, rule); a study year of 0 counts as missing. The first rule that fits decides."""
    text = F.lower(F.trim(F.regexp_replace(raw, r"\s+", " ")))
    sy = F.when(study_year != 0, study_year.cast("int"))
    years = F.transform(F.regexp_extract_all(text, F.lit(r"((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    n, y1, y2 = F.size(years), F.get(years, F.lit(0)), F.get(years, F.lit(1))
    span = lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
    no = F.lit(None).cast("string")
    has = lambda p: F.coalesce(F.rlike(text, F.lit(p)), F.lit(False))
    grab = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    out = lambda value, rule: F.struct(value.alias("range"), rule.alias("rule"))

    def checked(value: Column, rule: str) -> Column:
        ok = F.rlike(value, F.lit(VALID))
        return out(F.when(ok, value), F.when(ok, F.lit(rule)).otherwise(F.lit(f"invalid_{rule}")))

    def back(years_back: Column, rule: str) -> Column:
        return checked(span(sy - years_back + 1, sy), rule)

    to_now = has(r"\b(present|current|to date|to-date|now|today)\b")
    since = has(r"\b(since|from)\b")
    digits = F.try_to_number(grab(rf"\b{LAST}\s+(\d{{1,3}})\s+years?\b"), F.lit("999")).cast("int")
    word = F.array_position(F.array(*map(F.lit, NUMBERS)), grab(rf"\b{LAST}\s+({'|'.join(NUMBERS)})\s+years?\b")).cast("int")
    decades = F.try_to_number(grab(rf"\b{LAST}\s+(\d{{1,3}})\s+decades?\b"), F.lit("999")).cast("int")
    empty = F.coalesce(text, F.lit("")) == ""
    known = sy.isNotNull()
    return (
        F.when(empty, out(sy.cast("string"), F.when(known, F.lit("fallback_study_year"))))
        .when(n >= 2, checked(span(F.least(y1, y2), F.greatest(y1, y2)), "two_years"))
        .when((n == 1) & to_now & known, checked(span(y1, sy), "year_to_present"))
        .when((n == 1) & to_now, out(no, F.lit("year_to_present_missing_study_year")))
        .when((n == 1) & since & known, checked(span(y1, sy), "since_year"))
        .when((n == 1) & since, out(no, F.lit("since_year_missing_study_year")))
        .when(known & digits.isNotNull(), back(digits, "last_n_years"))
        .when(known & (word > 0), back(word, "last_word_years"))
        .when(known & decades.isNotNull(), back(decades * 10, "last_n_decades"))
        .when(known & has(rf"\b{LAST}\s+decade\b"), back(F.lit(10), "last_decade"))
        .when(known & has(r"\b(last|past|recent)\s+few\s+years\b"), back(F.lit(5), "last_few_years"))
        .when(known, out(sy.cast("string"), F.lit("fallback_study_year")))
        .otherwise(out(no, F.lit("no_rule")))
    )
