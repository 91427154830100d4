"""Extractors: from chunks to records. ``replay`` reads recorded answers, ``rules`` finds plain sentences, ``http`` asks a model."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonio, text

#: Where the providers' interfaces are.
BASES = {"ollama": "http://localhost:11434", "groq": "https://api.groq.com/openai/v1", "gemini": "https://generativelanguage.googleapis.com", "openai": "https://api.openai.com/v1"}
FIELDS = ("subject_text", "predicate", "object_text", "raw_text", "normalized_text", "attributes")


def replay(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Records of recorded answers (chunk_id, body); ``unreadable`` has the malformed ones."""
    rows = chunks.join(answers, "chunk_id").withColumn("r", F.explode(jsonio.records(F.col("body"))))
    return rows.select(*chunks.columns, *(F.col(f"r.{f}").alias(f) for f in FIELDS))


def unreadable(answers: DataFrame) -> DataFrame:
    """The answers that are neither JSON nor text around a JSON array: to be asked for again, or looked at."""
    return answers.where(jsonio.malformed(F.col("body")))


def rules(chunks: DataFrame, verbs: list[str], content: str = "content") -> DataFrame:
    """Records of sentences ``Subject verb object`` with one of ``verbs`` (lower case), natively."""
    pattern = rf"(?i)^\s*(.+?)\s+({'|'.join(verbs)})\s+(.+?)\s*$"
    rows = chunks.withColumn("s", F.explode(F.split(content, r"[.\n]+"))).where(F.regexp_like("s", F.lit(pattern)))
    part = lambda k: F.regexp_extract("s", pattern, k)
    return rows.select(*chunks.columns, part(1).alias("subject_text"), F.upper(part(2)).alias("predicate"), part(3).alias("object_text"), F.trim("s").alias("raw_text"), F.lower(F.trim("s")).alias("normalized_text"), F.create_map().cast("map<string,string>").alias("attributes"))


def post(url: str, body: str, headers: dict[str, str], timeout: float) -> str:
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read().decode()


@dataclass(frozen=True)
class Provider:
    """How a model is asked: where, with what body and headers, and where its answer lies (any provider's envelope otherwise)."""

    url: str
    template: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    response_path: str | None = None


def provider(name: str, model: str, key: str | None = None, url: str | None = None, template: str | None = None, response_path: str | None = None) -> Provider:
    """A known provider, or a custom one that speaks like OpenAI's. A custom template or path takes the place of the provider's own."""
    base = (url or BASES.get(name, "")).rstrip("/")
    if not base:
        raise ValueError(f"no address for {name}")
    if name != "ollama" and not key:
        raise ValueError(f"no key for {name}")
    place = {"ollama": "/api/generate", "gemini": f"/v1beta/models/{model}:generateContent"}.get(name, "/chat/completions")
    headers = {} if name == "ollama" else {"x-goog-api-key": key} if name == "gemini" else {"Authorization": f"Bearer {key}"}
    own = template if template and template.strip() else request_template(name if name in ("ollama", "gemini") else "openai")
    return Provider(base + place, own, model, headers, response_path)


def answers(chunks: DataFrame, to: Provider, predicates: list[str], **options) -> DataFrame:
    """``chunk_id``, ``body`` (the answer without its envelope), ``error`` of a provider; options are those of ``http``."""
    asked = http(chunks, to.url, to.template, predicates, to.model, headers=to.headers, **options)
    return jsonio.parsed(asked, "body", "_json").withColumn("body", F.coalesce(jsonio.unwrap_parsed("_json", to.response_path), F.col("body"))).drop("_json")


def told_wait(headers, body: str) -> float | None:
    """The seconds that a refusal asks for, in a header or in its text; None if in neither."""
    told = headers.get("Retry-After") if headers else None
    if told and told.replace(".", "", 1).isdigit():
        return float(told)
    found = re.search(r"(?i)try again in ([0-9.]+)\s*(ms|s)", body)
    if not found or found[1].count(".") > 1 or found[1] == ".":
        return None
    return float(found[1]) / (1000 if found[2].lower() == "ms" else 1) + 0.5


def http(chunks: DataFrame, url: str, template: str, predicates: list[str], model: str, tasks: int = 8, per_minute: int | None = 15, attempts: int = 5, timeout: float = 120, headers: dict[str, str] | None = None, send: Callable[[str, str, dict, float], str] = post) -> DataFrame:
    """``chunk_id``, ``body`` or ``error`` from a model behind HTTP; at most ``tasks`` requests at once and ``per_minute`` in all.

    A refused call waits as long as the provider says, else two seconds, doubling up to thirty.
    """
    tasks = min(tasks, per_minute) if per_minute else tasks
    names = F.lit(list(predicates)) if predicates else F.array().cast("array<string>")
    asked = chunks.select("chunk_id", jsonio.render(F.lit(template), F.lit(model), text.prompt(F.col("section_path"), F.col("content"), names)).alias("request"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls: list[float] = []
        share = None
        if per_minute:  # what does not divide goes to the first tasks
            share = per_minute // tasks + (TaskContext.get().partitionId() < per_minute % tasks)
        for frame in frames:
            out = []
            for chunk, request in zip(frame["chunk_id"], frame["request"]):
                body, error, wait = None, None, 2.0
                for attempt in range(attempts):
                    if share:
                        calls = [c for c in calls if c > time.time() - 60]
                        if len(calls) >= share:
                            time.sleep(max(0.0, 60 - (time.time() - calls[0])))
                        calls.append(time.time())
                    try:
                        body, error = send(url, request, headers or {}, timeout), None
                        break
                    except urllib.error.HTTPError as e:
                        said = e.read()[:2000].decode("utf-8", "replace")
                        error, told = f"{e.code}: {said}", told_wait(e.headers, said)
                        pause = wait if told is None else told
                    except OSError as e:
                        error, pause = str(e), wait
                    if attempt + 1 < attempts:
                        time.sleep(pause)
                        wait = min(wait * 2, 30.0)
                out.append((chunk, body, error))
            yield pd.DataFrame(out, columns=["chunk_id", "body", "error"])

    return asked.repartition(tasks, "chunk_id").mapInPandas(ask, "chunk_id string, body string, error string")


def request_template(provider: str) -> str:
    """A request body for a provider, with ``{{model}}`` and ``{{prompt}}``."""
    # The providers' published formats.
    message = {"openai": {"model": "{{model}}", "messages": [{"role": "user", "content": "{{prompt}}"}], "temperature": 0.0, "response_format": {"type": "json_object"}}, "gemini": {"contents": [{"parts": [{"text": "{{prompt}}"}]}]}, "ollama": {"model": "{{model}}", "prompt": "{{prompt}}", "stream": False}}
    return json.dumps(message[provider])
