"""Answers and predictions that come as text around JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import strip

ROLES = ("system", "user", "assistant", "tool")


def json_candidate(text: Column) -> Column:
    """What a fence holds, else from the first brace or bracket to the last; null without one."""
    fenced = F.nullif(strip(F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(text, "(?s)(\\{.*\\}|\\[.*\\])", 1), F.lit("")))


def parse_answer(text: Column) -> Column:
    """(answer, reason): the answer as a list, from an object, a list, or the text itself."""
    body = json_candidate(text)
    listed = F.from_json(body, "struct<answer:array<string>,reason:string>")
    single = F.from_json(body, "struct<answer:string,reason:string>")
    bare = F.from_json(body, "array<string>")
    answer = F.when(body.startswith("{"), F.coalesce(listed.getField("answer"), F.array(single.getField("answer")))).when(body.startswith("["), bare)
    return F.struct(F.coalesce(answer, F.array(strip(text))).alias("answer"), F.when(body.startswith("{"), single.getField("reason")).alias("reason"))


def parse_ranking(text: Column) -> Column:
    """A list of whole numbers: the text as JSON, else its first bracket."""
    return F.coalesce(F.from_json(text, "array<int>"), F.from_json(F.regexp_extract(text, "(?s)\\[.*?\\]", 0), "array<int>"))


def grading_status(prediction: Column, truth: Column) -> Column:
    parsed = parse_ranking(prediction)
    return F.when(prediction.isNull() | truth.isNull(), "MISSING_DATA").when(parsed.isNull(), "PARSE_FAIL").when(F.size(parsed) != F.size(truth), "LENGTH_MISMATCH").otherwise("VALID")


def role(name: Column, default: str = "user") -> Column:
    low = F.lower(strip(name))
    return F.when(low.isin(*ROLES), low).otherwise(default)
