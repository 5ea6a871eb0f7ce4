"""Strings: normal forms, composite ids, templates, sections and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import strip


def squeeze(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return strip(F.regexp_replace(text, "\\s+", " "))


def fold(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def similar_names(a: Column, b: Column) -> Column:
    """Equal, or one within the other, after folding; an empty name is like no other."""
    x, y = fold(a), fold(b)
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def title(text: Column) -> Column:
    """A capital after every character that is no letter (initcap knows blanks alone)."""
    parts = F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def unit(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(" / "), F.lit("/")), F.lit(" "), F.lit(""))


def indicator_key(name: Column, fluid: Column, measure: Column) -> Column:
    """``name||Fluid||unit``, NA without a unit."""
    return F.concat_ws("||", squeeze(name), title(squeeze(fluid)), F.coalesce(F.nullif(unit(measure), F.lit("")), F.lit("NA")))


def amount(value: Column, measure: Column) -> Column:
    """``5 mg``; null without a value, the value alone without a unit."""
    return F.when(value.isNotNull(), F.trim(F.concat_ws(" ", value.cast("string"), measure)))


def entity_id(n: Column, prefix: str = "P", width: int = 6) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)


def visit_id(entity: Column, n: Column) -> Column:
    return F.concat(entity, F.lit("-V"), n.cast("string"))


def suffix_number(text: Column, letter: str) -> Column:
    """The number in ``V12``; null without one."""
    return F.regexp_extract(text, f"^{letter}(\\d+)$", 1).try_cast("int")


def parse_qid(qid: Column) -> Column:
    """``{entity}-V{n}-T{t}-{kind}-{i}`` as a struct; the kind may hold a dash, null where the form doesn't fit."""
    form = "^([^-]+)-V(\\d+)-T(\\d+)-(.+)-(\\d+)$"
    get = lambda i: F.regexp_extract(qid, form, i)
    return F.when(qid.rlike(form), F.struct(get(1).alias("entity"), get(2).cast("int").alias("visit"), get(3).cast("int").alias("t"), get(4).alias("kind"), get(5).cast("int").alias("i")))


def entity_of(qid: Column) -> Column:
    """What stands before ``-V``, or else before the first dash; the whole without one."""
    return F.when(qid.contains("-V"), F.substring_index(qid, "-V", 1)).otherwise(F.substring_index(qid, "-", 1))


def as_text(content: Column) -> Column:
    """A variant as text: a text as it is, nothing as an empty text, everything else as JSON."""
    return F.coalesce(F.try_variant_get(F.when(F.schema_of_variant(content) == "STRING", content), "$", "string"), F.to_json(content), F.lit(""))


def event_ordinal(event: Column) -> Column:
    """-V0 and -adm come first (0), -E{n} by its number, -dis and all else last (1e9)."""
    n = F.regexp_extract(event, "-E(\\d+)$", 1)
    return F.when(event.rlike("-(V0|adm)$"), 0).when(n != "", n.try_cast("int")).otherwise(1_000_000_000)


def chunks(text: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Pieces of ``size`` characters; each repeats the last ``overlap`` of the one before."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def shorten(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def lines(items: Column, start: int = 0) -> Column:
    """``0. a`` lines of an array."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + start).cast("string"), F.lit(". "), x)), "\n")


def map_lines(fields: Column) -> Column:
    """``k: v`` lines of a map, blank values left out."""
    kept = F.filter(F.map_entries(fields), lambda e: F.coalesce(strip(e.value) != "", F.lit(False)))
    return F.array_join(F.transform(kept, lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")


def sections(text: Column, headings: Sequence[str]) -> Column:
    """A map from heading to the text up to the next one; headings are looked for in order, whatever their case."""
    low = F.lower(text)
    names = F.array(*[F.lit(h) for h in headings])
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<h:string,from:int,body:int>>").alias("found"))

    def step(s: Column, h: Column) -> Column:
        at = F.locate  # noqa: F841  (locate takes a literal only; call_function takes columns)
        p = F.call_function("locate", F.lower(h), low, s.at)
        hit = F.struct(h.alias("h"), p.alias("from"), (p + F.length(h)).alias("body"))
        return F.when(p > 0, F.struct((p + F.length(h)).alias("at"), F.concat(s.found, F.array(hit)).alias("found"))).otherwise(s)

    found = F.aggregate(names, start, step).getField("found")
    ends = F.transform(found, lambda x, i: F.coalesce(F.get(found, i + 1).getField("from"), F.length(text) + 1))
    bodies = F.zip_with(found, ends, lambda x, e: F.struct(x.h, strip(F.regexp_replace(F.substring(text, x.body, e - x.body), "^\\s*:", ""))))
    return F.map_from_entries(bodies)


def template(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


#: Words and characters that make a message a question.
QUESTION_CUES = "what why how when where which who 什么 为啥 为什么 怎么 如何 是否 吗 几 多少 哪 哪种 哪位 多大 多久 何时 请问".split()


def is_question(text: Column, cues: Sequence[str] = QUESTION_CUES) -> Column:
    """Holds a question mark, or a cue, whatever its case."""
    return F.coalesce(text.rlike("[?？]") | F.lower(text).rlike("(" + "|".join(cues) + ")"), F.lit(False))


def parameters(text: Column) -> Column:
    """``name = value; name = value`` as a map of trimmed text; parts without a name or an equals sign are left out, and the first of a name counts."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x.rlike("^[^=]*[^= ][^=]*="))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v"))
    named = F.transform(pairs, entry)
    first = F.filter(named, lambda e, i: F.array_position(F.transform(named, lambda o: o.k), e.k) == i + 1)
    return F.map_from_entries(first)


def prompt(text: str, **places: Column) -> Column:
    """A prompt whose ``{name}`` places are filled from columns; without arguments it is the text itself, and a place that isn't given stays."""
    out = F.lit(text)
    for name, value in places.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def safe_length(x: Column, array: bool = False) -> Column:
    """Characters of a text, or items of a list; 0 for null."""
    return F.coalesce(F.size(F.coalesce(x, F.array())) if array else F.length(x), F.lit(0))
