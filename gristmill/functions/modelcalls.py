"""Typed calls of language models: a prompt for each row, a struct of a given schema or an error back.

A provider is a function without arguments that makes a client once in a worker and
returns a function from a list of `Ask` to as many `Reply`. A reply that is no JSON of
the schema is asked for once more, with a stricter instruction; a truncated reply never
is, as it would be cut again, and neither is a failed transport. Nothing raises: what
went wrong is in the column error, so that one row does not end a job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.jsontext import repaired

#: What is added to a prompt at the first and at the last attempt.
INSTRUCTIONS = ("\n\nAnswer with one JSON object and nothing else.", "\n\nYour last answer was not a valid JSON object of the form asked for. Answer with that object alone, from { to }.")
#: Prompts that a provider gets at once.
BATCH = 16


@dataclass(frozen=True)
class Ask:
    prompt: str
    system: str
    attempt: int


@dataclass(frozen=True)
class Reply:
    text: str | None
    truncated: bool = False
    error: str | None = None


Provider = Callable[[], Callable[[list[Ask]], Sequence[Reply]]]


def choice(name: str, values: Sequence[str], default: str) -> T.StructField:
    """A text field that holds one of the values; others become the default."""
    return T.StructField(name, T.StringType(), True, {"choices": list(values), "default": default})


def required(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, False)


def coerced(value, kind: T.DataType, about: dict | None = None):
    """A JSON value as one of `kind`, or a ValueError.

    Missing and null: "" of a text, [] of an array, an object of such of an object, null
    of a number or boolean, an error of a required field. A bare text where an object
    belongs is its first text field; what is not an array where one belongs is its only element.
    """
    if isinstance(kind, T.StringType):
        text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if about and "choices" in about:
            found = [c for c in about["choices"] if c.casefold() == text.strip().casefold()]
            return found[0] if found else about["default"]
        return text
    if isinstance(kind, T.ArrayType):
        if value is None or value == "":
            return []
        return [coerced(v, kind.elementType) for v in (value if isinstance(value, list) else [value])]
    if isinstance(kind, T.StructType):
        if isinstance(value, str) and value:
            first = next((f.name for f in kind if isinstance(f.dataType, T.StringType)), None)
            if first is None:
                raise ValueError("a text where an object belongs")
            value = {first: value}
        if value is None or value == "":
            value = {}
        if not isinstance(value, dict):
            raise ValueError(f"{type(value).__name__} where an object belongs")
        for f in kind:
            if not f.nullable and value.get(f.name) in (None, "", []):
                raise ValueError(f"no {f.name}")
        return {f.name: coerced(value.get(f.name), f.dataType, f.metadata) for f in kind}
    if value is None or value == "":
        return None
    if isinstance(kind, T.BooleanType):
        if isinstance(value, bool):
            return value
        if str(value).strip().casefold() in ("true", "false"):
            return str(value).strip().casefold() == "true"
        raise ValueError(f"{value!r} is not true or false")
    if isinstance(kind, (T.IntegerType, T.LongType)):
        if float(value) != int(float(value)):
            raise ValueError(f"{value!r} is not whole")
        return int(float(value))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    raise ValueError(f"no replies of type {kind.simpleString()}")


def _answers(asked: list[tuple[str, str]], client: Callable[[list[Ask]], Sequence[Reply]], schema: T.StructType) -> list[tuple[dict | None, str | None, int, bool]]:
    """reply, error, attempts, truncated of each prompt and system text."""
    out: list = [None] * len(asked)
    open_ = list(range(len(asked)))
    for attempt, instruction in enumerate(INSTRUCTIONS, 1):
        asks = [Ask(asked[i][0] + instruction, asked[i][1], attempt) for i in open_]
        try:
            replies = list(client(asks))
            if len(replies) != len(asks):
                raise ValueError(f"{len(replies)} replies to {len(asks)} prompts")
        except Exception as e:  # noqa: BLE001  whatever a client raises is these rows' error
            replies = [Reply(None, error=f"{type(e).__name__}: {e}")] * len(asks)
        again = []
        for i, reply in zip(open_, replies, strict=True):
            if reply.error is not None:
                out[i] = (None, f"request failed: {reply.error}", attempt, False)
            elif reply.truncated:
                out[i] = (None, "truncated reply", attempt, True)
            else:
                try:
                    text = repaired(reply.text)
                    if text is None:
                        raise ValueError("no JSON object")
                    out[i] = (coerced(json.loads(text), schema), None, attempt, False)
                except (ValueError, TypeError, OverflowError) as e:
                    out[i] = (None, f"no valid reply after {attempt} attempts: {e}", attempt, False)
                    again.append(i)
        open_ = again
        if not open_:
            break
    return out


def call(rows: DataFrame, prompt: Column, provider: Provider, schema: T.StructType, system: Column | None = None, batch: int = BATCH) -> DataFrame:
    """rows with reply (a struct, null where it failed), error, attempts and truncated; columns of these names give way.

    A null prompt is not asked: reply and error are null, attempts 0.
    """
    new = ["reply", "error", "attempts", "truncated"]
    kept = [c for c in rows.columns if c not in new]
    inside = rows.select(*[F.col(f"`{c}`") for c in kept], prompt.cast("string").alias("\u0001prompt"), F.coalesce(system if system is not None else F.lit(""), F.lit("")).alias("\u0001system"))
    plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    out = T.StructType([*[rows.schema[c] for c in kept], T.StructField("reply", plain), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("truncated", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(out).field("reply").type

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = provider()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                prompts, systems = part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist()
                some = [i for i, p in enumerate(prompts) if p is not None]
                got = dict(zip(some, _answers([(prompts[i], systems[i]) for i in some], client, schema) if some else [], strict=True))
                rest = [got.get(i, (None, None, 0, False)) for i in range(part.num_rows)]
                columns = [pa.array([r[0] for r in rest], kind), pa.array([r[1] for r in rest], pa.string()), pa.array([r[2] for r in rest], pa.int32()), pa.array([r[3] for r in rest], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], names=[*kept, *new])

    return inside.mapInArrow(run, out)


def or_else(wanted: Column, otherwise: Column) -> Column:
    """A reply's array where it has elements, else what was there before: how a rewriter and the like degrade."""
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, wanted).otherwise(otherwise)


def rewritten(rows: DataFrame, provider: Provider, prompt: Column, fields: Sequence[str] = ("norm_queries", "case_queries")) -> DataFrame:
    """rows with the arrays of queries in `fields` as the model words them; one that it leaves out or gets wrong, and all of a failed call, stay.

    Rows without any query are not asked.
    """
    none = sum((F.greatest(F.coalesce(F.size(f), F.lit(0)), F.lit(0)) for f in fields), F.lit(0)) == 0
    schema = T.StructType([T.StructField(f, T.ArrayType(T.StringType())) for f in fields])
    done = call(rows, F.when(~none, prompt), provider, schema)
    return done.withColumns({f: or_else(F.col(f"reply.{f}"), F.col(f)) for f in fields}).drop("reply", "attempts", "truncated")
