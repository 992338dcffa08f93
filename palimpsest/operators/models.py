"""Findings of a language model: prompts, calls through a provider of one's own, and what its answers say.

A provider is a function from (system, user) to the answer's text, made once in each task by `make_provider`. A call
that fails, or an answer that can't be read, is no finding; the row says so.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.detect import loosely_rematched
from palimpsest.operators.specs import Field

FINDINGS = "array<struct<field_type:string,value:string>>"
Provider = Callable[[str, str], str]

SYSTEM = (
    "Find sensitive values in the user's text. Answer with JSON alone, in the form "
    '{"findings": [{"field_type": "...", "value": "..."}]}.\n'
    "Copy each value exactly as it stands in the text, in one piece. Leave out what you are unsure of; without any "
    "value the list is empty. Field types:\n"
)


def system_prompt(fields: Iterable[Field], requirements: str = "") -> str:
    """The instructions, with a line for each field, and further requirements where there are any."""
    lines = "\n".join(f"- {f.name}: {f.label or f.name}" for f in fields)
    return SYSTEM + lines + (f"\nFurther requirements:\n{requirements.strip()}" if requirements.strip() else "")


def user_prompt(chunk: Column, template: str = "Text:\n\n{chunk}") -> Column:
    """The template with the chunk in it, whatever signs the chunk holds."""
    return F.replace(F.lit(template), F.lit("{chunk}"), chunk)


def _read(text: str):
    """JSON, with what answers often add or lack: fences, text around it, commas before a bracket, missing ends."""
    text = re.sub(r"^\s*```\w*|```\s*$", "", text.strip())
    begin = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    body = text[begin:]
    for tried in (body, body[: max(body.rfind("}"), body.rfind("]")) + 1], re.sub(r",\s*([}\]])", r"\1", body)):
        for end in ("", "]}", "}]}", '"}]}'):
            try:
                return json.loads(tried + end)
            except ValueError:
                continue
    return None


def parse(answer: str | None) -> list[dict]:
    """The findings of an answer: those of findings, items or results, or of a list."""
    data = _read(answer) if answer else None
    if isinstance(data, dict):
        data = next((data[k] for k in ("findings", "items", "results") if k in data), [])
    rows = data if isinstance(data, list) else []
    return [{"field_type": str(x["field_type"]), "value": str(x["value"])} for x in rows if isinstance(x, dict) and x.get("field_type") and x.get("value")]


def chat(url: str, model: str, key: str = "", timeout: float = 180.0, tries: int = 3, **settings) -> Callable[[], Provider]:
    """Makes providers for a service with the usual chat interface: POST <url>/chat/completions, with further settings of a request.

    A call is repeated where the service is busy or out of reach, with a longer wait each time; what it refuses is an
    error at once. The key is sent to the service alone and is in no error.
    """

    def make() -> Provider:
        def call(system: str, user: str) -> str:
            messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
            body = json.dumps({"model": model, "messages": messages, "temperature": 0, **settings}).encode()
            headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})}
            for left in range(tries - 1, -1, -1):
                try:
                    asked = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", body, headers)
                    with urllib.request.urlopen(asked, timeout=timeout) as answer:
                        return json.loads(answer.read())["choices"][0]["message"]["content"] or ""
                except urllib.error.HTTPError as e:
                    if not left or e.code not in (408, 409, 429) and e.code < 500:
                        raise RuntimeError(f"the service answered {e.code}") from None
                except (urllib.error.URLError, TimeoutError):
                    if not left:
                        raise
                time.sleep(2.0 ** (tries - left - 1) / 4)
            raise AssertionError("not reached")

        return call

    return make


def text_chunks(docs: DataFrame, size: int = 6000) -> DataFrame:
    """doc_id, base, chunk of texts (doc_id, text): pieces of about `size` characters, cut at good places."""
    from palimpsest.operators.documents import cuts

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(d, a, t[a:b]) for d, t in zip(pdf["doc_id"], pdf["text"]) if t for a, b in cuts(t, size) if t[a:b].strip()]
            yield pd.DataFrame(rows, columns=["doc_id", "base", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, base int, chunk string")


def ask(chunks: DataFrame, make_provider: Callable[[], Provider], fields: Iterable[Field], requirements: str = "") -> DataFrame:
    """chunks (doc_id, base, chunk) with findings and error: one call for each chunk."""
    system = system_prompt(fields, requirements)
    kind = chunks.schema["doc_id"].dataType.simpleString()
    rows = chunks.select("doc_id", "base", "chunk", user_prompt(F.col("chunk")).alias("user"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for pdf in frames:
            found, errors = [], []
            for user in pdf["user"]:
                try:
                    found.append(parse(provider(system, user)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one call's failure is no job's
                    found.append([])
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pdf[["doc_id", "base", "chunk"]].assign(findings=found, error=errors)

    return rows.mapInPandas(run, f"doc_id {kind}, base int, chunk string, findings {FINDINGS}, error string")


def spans(asked: DataFrame, fields: Iterable[Field]) -> DataFrame:
    """doc_id and the spans, in the document, of what the findings name and the chunk really holds."""
    found = asked.withColumn("s", F.explode(loosely_rematched(fields)(F.col("chunk"), F.col("findings"))))
    s = F.col("s")
    moved = F.struct(s["field_type"].alias("field_type"), s["value"].alias("value"), (s["start"] + F.col("base")).alias("start"), (s["end"] + F.col("base")).alias("end"), s["source"].alias("source"), s["confidence"].alias("confidence"))
    return found.select("doc_id", moved.alias("span"))


def hybrid(docs: DataFrame, asked: DataFrame, fields: Iterable[Field]) -> DataFrame:
    """docs (doc_id, text, ...) with `findings`, the model's spans of each document, for detect(findings=...)."""
    from palimpsest.operators.detect import SPANS

    grouped = spans(asked, fields).groupBy("doc_id").agg(F.array_sort(F.collect_list("span"), lambda a, b: a["start"] - b["start"]).alias("findings"))
    return docs.join(grouped, "doc_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast(SPANS)))
