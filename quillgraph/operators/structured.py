"""Structured answers of a chat model: prompts with examples, answers checked against a schema, repair rounds, and a cache.

A model is a callable from a prompt to a text. Equal texts are asked once: answers are kept in a table of the
shared folder under the hash of everything that makes the prompt, and later runs ask only for what is not there.
Tasks ask, so the driver sees no text. A model that fails or never gives a valid answer leaves null and the problems.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.snapshots import path, reserve, versions

Model = Callable[[str], str]
ANSWER = "key string, answer string, problems array<string>, asked int"

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


def problems(value, schema: dict, at: str = "answer") -> list[str]:
    """What is wrong with a value: type, required, properties, additionalProperties: false, enum, items, minimum and maximum are held to."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    fits = lambda k: isinstance(value, _KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number"))
    if kinds and not any(fits(k) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    out = [f"{at}: not one of {schema['enum']}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [f"{at}.{k}: not known" for k in value if k not in known and schema.get("additionalProperties") is False]
        out += [p for k, v in value.items() if k in known for p in problems(v, known[k], f"{at}.{k}")]
    elif isinstance(value, list) and "items" in schema:
        out += [p for n, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{n}]")]
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        out += [f"{at}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    return out


@dataclass(frozen=True)
class Request:
    """What is asked of every text: a task, the schema of the answer, and examples (text, answer) that are shown first."""

    task: str
    schema: dict
    examples: list[tuple[str, dict]] = field(default_factory=list)
    rounds: int = 3

    def prompt(self, text: str) -> str:
        shown = "".join(f"\nText: {json.dumps(t)}\nAnswer: {json.dumps(a, sort_keys=True)}" for t, a in self.examples)
        return f"{self.task}\nAnswer with JSON of this schema only: {json.dumps(self.schema, sort_keys=True)}{shown}\nText: {json.dumps(text)}\nAnswer:"

    def name(self) -> str:
        """Of all that the answer hangs on but the text."""
        return hashlib.sha256(f"{self.rounds}\n{self.prompt('')}".encode()).hexdigest()

    def ask(self, model: Model, text: str) -> tuple[str | None, list[str], int]:
        """(valid JSON or null, problems of the last answer, times asked); an invalid answer is sent back with what is wrong."""
        prompt, wrong = self.prompt(text), []
        for k in range(1, self.rounds + 1):
            said = model(prompt)
            try:
                value = json.loads(re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", said or ""))
                wrong = problems(value, self.schema)
            except ValueError:
                wrong = ["answer: no JSON"]
            if not wrong:
                return json.dumps(value, sort_keys=True), [], k
            prompt = f"{self.prompt(text)} {said}\nProblems: {'; '.join(wrong)}\nAnswer again:"
        return None, wrong, self.rounds


def answers(df: DataFrame, text: str, request: Request, model: Model, cache: str) -> DataFrame:
    """df with answer (JSON, null without a valid one), problems and asked; a null text is not asked and has nulls.

    cache: a folder; each run adds its new answers there as a numbered table. What a failing model left open is asked again in the next run.
    """
    spark = df.sparkSession
    key = F.sha2(F.concat_ws("\n", F.lit(request.name()), F.col(text)).cast("binary"), 256)
    keyed = df.withColumn("key", F.when(F.col(text).isNotNull(), key))
    there = versions(spark, cache)
    known = spark.read.schema(ANSWER).parquet(*[path(cache, v) for v in there]).where("asked > 0") if there else spark.createDataFrame([], ANSWER)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                try:
                    out.append(request.ask(model, t))
                except Exception as e:  # a failing service must not fail the job; the row says so and is asked again next time
                    out.append((None, [f"model: {type(e).__name__}"], 0))
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string())), pa.array([x[2] for x in out], pa.int32())], ["key", "answer", "problems", "asked"])

    new = keyed.where("key is not null").select("key", F.col(text).alias("text")).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    number = reserve(spark, cache)
    new.mapInArrow(ask, ANSWER).write.mode("overwrite").parquet(path(cache, number))
    own = spark.read.schema(ANSWER).parquet(path(cache, number))
    found = known.unionByName(own).groupBy("key").agg(F.max_by(F.struct("answer", "problems", "asked"), "asked").alias("x"))
    return keyed.join(found, "key", "left").select(*[F.col(f"`{c}`") for c in df.columns], "x.answer", "x.problems", "x.asked")
