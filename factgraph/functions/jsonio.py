"""JSON in and out: answers of language models, provider envelopes, templates, attributes and tolerant events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "array<struct<subject_text:string,predicate:string,object_text:string,raw_text:string,normalized_text:string,attributes:map<string,string>>>"
#: Where each provider's answer lies.
PROVIDERS = {"openai": "$.choices[0].message.content", "gemini": "$.candidates[0].content.parts[0].text", "ollama": "$.response"}


def extract_array(body: Column) -> Column:
    """The JSON array in free text: from the first ``[`` to the last ``]``; null if there is none."""
    found = F.regexp_extract(body, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def records(body: Column) -> Column:
    """Extraction records of an answer: none where it is JSON without an array, null where it is malformed."""
    array = extract_array(body)
    valid = F.try_parse_json(F.coalesce(array, body)).isNotNull()
    return F.when(valid, F.coalesce(F.from_json(array, RECORD), F.from_json(F.lit("[]"), RECORD)))


def malformed(body: Column) -> Column:
    """Whether an answer cannot be read: neither JSON nor text around a JSON array."""
    return F.try_parse_json(F.coalesce(extract_array(body), body, F.lit(""))).isNull()


def json_text(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)


def parsed(rows: DataFrame, body: str, name: str = "json") -> DataFrame:
    """``rows`` with column ``body`` parsed into the variant ``name``, null where it is no JSON or an object has a key twice.

    It is parsed in a projection of its own, which stays apart in the plan where several paths are read from it: once a row.
    """
    return rows.withColumn(name, F.try_parse_json(F.col(body)))


def at(json: Column | str, path: str, kind: str = "string") -> Column:
    """What a variant has at ``path``, null where that leads nowhere, to a JSON null or to something that is no ``kind``."""
    return F.try_variant_get(json, path, kind)


def unwrap_parsed(json: Column | str, path: str | None = None) -> Column:
    """``unwrap`` of a variant."""
    return F.coalesce(*(at(json, p) for p in ([path] if path else []) + list(PROVIDERS.values())))


def unwrap(body: Column, path: str | None = None) -> Column:
    """The answer inside a provider's envelope, whichever it is; at ``path`` where that leads somewhere."""
    return F.coalesce(*(F.get_json_object(body, p) for p in ([path] if path else []) + list(PROVIDERS.values())))


def escape(c: Column) -> Column:
    """A text as it stands inside a JSON string."""
    quoted = F.to_json(F.struct(c.alias("v")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def render(template: Column, model: Column, prompt: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{{model}}"), escape(model)), F.lit("{{prompt}}"), escape(prompt))


def attributes_to_json(c: Column) -> Column:
    return F.to_json(c)


def attributes_from_json(c: Column) -> Column:
    return F.from_json(c, "map<string,string>")


def csv_to_set(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.coalesce(c, F.lit("")), ",")), lambda x: F.trim(x) != "")


def set_to_csv(c: Column) -> Column:
    return F.array_join(c, ",")


def tolerant_event_parsed(json: Column | str, event_types: list[str], now: Column) -> Column:
    """``tolerant_event`` of a variant: numbers and texts of numbers are versions, what cannot be read is null or ``now``."""
    kind = at(json, "$.eventType")
    return F.struct(
        F.when(kind.isin(*event_types), kind).alias("event_type"),
        at(json, "$.version").try_cast("double").cast("int").alias("version"),
        F.coalesce(F.try_to_timestamp(at(json, "$.timestamp")), now).alias("ts"),
    )


def tolerant_event(body: Column, event_types: list[str], now: Column) -> Column:
    """Type by name or null, version through double, ISO time or ``now``."""
    kind = F.get_json_object(body, "$.eventType")
    return F.struct(
        F.when(kind.isin(*event_types), kind).alias("event_type"),
        F.get_json_object(body, "$.version").try_cast("double").cast("int").alias("version"),
        F.coalesce(F.try_to_timestamp(F.get_json_object(body, "$.timestamp")), now).alias("ts"),
    )
