"""Dates, file names, classes, tables and JSON in documents."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


#: fixed values: spellings of a day (year, month, day), the first that matches decides; and the century where the year has two digits
DAYS = (
    (r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일", ""),
    (r"(?<!\d)(\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})(?!\d)", "20"),
    (r"(?<!\d)(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?!\d)", ""),
    (r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)", ""),
    (r"(?<!\d)(\d{2})-(\d{1,2})-(\d{1,2})(?!\d)", "20"),
)


def normalize_date(text: Column) -> Column:
    """``YYYY-MM-DD`` from the usual spellings (of a range the first date); else the text as it is."""
    s = F.trim(F.regexp_replace(text, r"[(){}\[\]]", " "))
    s = F.regexp_replace(s, r"\s+\d{1,2}:\d{2}(:\d{2})?\s*(AM|PM|am|pm)?", "")
    out = text
    for pattern, century in reversed(DAYS):
        part = lambda g, p=pattern: F.regexp_extract(s, p, g)
        out = F.when(s.rlike(pattern), F.concat(F.lit(century), part(1), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0"))).otherwise(out)
    return out


def filename_date(filename: Column) -> Column:
    """The date that a file name holds, with ``-`` or ``_``."""
    p = r"(\d{4})[-_](\d{2})[-_](\d{2})"
    return F.when(filename.rlike(p), F.concat_ws("-", *[F.regexp_extract(filename, p, g) for g in (1, 2, 3)]))


def doctype_scores(text: Column, filename: Column, rules: dict[str, tuple[list[str], list[str], float]]) -> Column:
    """Array of struct score, name: for each kind (words, words against, weight) hits in the text, twice those in the name, less twice those against."""
    body, name = F.lower(text), F.lower(filename)
    hits = lambda where, words: sum((where.contains(w).cast("int") for w in words), F.lit(0))
    return F.array(*[F.struct(((hits(body, yes) + 2 * hits(name, yes)) * w - 2 * hits(body, no)).alias("score"), F.lit(kind).alias("name")) for kind, (yes, no, w) in rules.items()])


def doctype(scores: Column) -> Column:
    """struct name, score, confidence (score / (score + 1)); ``other`` without a score above 0, the first of equals."""
    best = F.array_max(F.transform(scores, lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("i"), s["name"].alias("name"))))
    score = F.greatest(best["score"], F.lit(0.0))
    return F.struct(F.when(score > 0, best["name"]).otherwise("other").alias("name"), score.alias("score"), F.round(score / (score + 1), 6).alias("confidence"))


def categories(text: Column, words: dict[str, list[str]], default: str = "other") -> Column:
    """All categories with a word in the text, in order, joined by `` / ``."""
    found = F.concat_ws(" / ", *[F.when(F.lower(text).rlike("|".join(w)), F.lit(c)) for c, w in words.items()])
    return F.when(found == "", F.lit(default)).otherwise(found)


def first_of(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that matches has in its group."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def contacts(text: Column) -> Column:
    """struct of distinct mobile numbers and lower-cased mail addresses."""
    phones = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(01[016789]-?\d{3,4}-?\d{4})"), F.lit(1)))
    mails = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1)), F.lower))
    return F.struct(phones.alias("phones"), mails.alias("mails"))


def preferred_ip(text: Column) -> Column:
    """The first private IPv4 address, else the first one."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d.])((?:\d{1,3}\.){3}\d{1,3})(?![\d.])"), F.lit(1))
    private = F.filter(found, lambda x: x.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"))
    return F.coalesce(F.try_element_at(private, F.lit(1)), F.try_element_at(found, F.lit(1)))


def model_code(text: Column) -> Column:
    """Upper-cased, with a hyphen between letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), r"[\s_]+", "-"), r"(?<=[A-Z])(?=\d)", "-")


def last_json(text: str) -> str | None:
    """The last balanced block of braces outside of strings that is JSON (commas before an end forgiven), compact."""
    found, depth, start, inside, escaped = None, 0, 0, False, False
    for k, c in enumerate(text):
        if inside:
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"' and depth:
            inside = True
        elif c == "{":
            start = k if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    found = json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", text[start : k + 1])), ensure_ascii=False, separators=(",", ":"))
                except ValueError:
                    pass
    return found


@pandas_udf(T.StringType())
def last_json_block(text: pd.Series) -> pd.Series:
    """``last_json`` of a column: braces in strings do not count, which no expression can say."""
    return text.map(lambda t: last_json(t if isinstance(t, str) else ""))


def audited(value: Column, source: Column) -> Column:
    """struct action, value: kept if the source has it, corrected to the nearest within a tenth, else removed."""
    near = F.array_min(F.transform(source, lambda s: F.struct(F.abs(s - value).alias("d"), s.alias("s"))))
    close = near["d"] <= F.abs(value) * 0.1
    action = F.when(value.isNull(), None).when(F.array_contains(source, value), "keep").when(close, "correct").otherwise("remove")
    return F.struct(action.alias("action"), F.when(action == "keep", value).when(action == "correct", near["s"]).alias("value"))
