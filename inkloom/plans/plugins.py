"""Recognition and translation models as plug-ins: Arrow functions of declared schemas, checked when they are registered.

A plug-in is a function from an iterator of Arrow record batches to an iterator
of batches, run by ``mapInArrow`` where the rows are: models load once a task,
and images travel as bytes. What goes in and comes out is declared by its kind.
Registering calls the function once with an empty batch and once with a sample,
so a plug-in that answers with other columns, types or keys is refused before
any corpus is read; the same test is made on every batch later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import squeeze

Batches = Iterator[pa.RecordBatch]
Model = Callable[[Batches], Batches]


@dataclass(frozen=True)
class Kind:
    """What a plug-in gets and gives; ``key`` columns of its answers must be among those it was asked, ``each``: exactly one answer each."""

    gets: str
    gives: str
    key: str
    each: bool
    sample: dict = field(hash=False, default_factory=dict)


KINDS = {
    "recognizer": Kind(
        "page string, lang string, image binary", "page string, ord int, polygon array<array<double>>, text string, confidence double", "page", False,
        {"page": ["p0", "p1"], "lang": ["en", "ja"], "image": [b"\x89PNG", b""]},
    ),
    "translator": Kind("key string, text string, lang string", "key string, translation string", "key", True, {"key": ["a", "b"], "text": ["Hello there.", "はい"], "lang": ["en", "ja"]}),
    "scorer": Kind("key string, image binary", "key string, score double", "key", True, {"key": ["a"], "image": [b""]}),
}


class PluginError(ValueError):
    pass


TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}


def _arrow(columns: str) -> pa.Schema:
    """The Arrow schema of a kind's columns; needs no session."""
    return pa.schema([(name, TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _problem(kind: Kind, asked: pa.RecordBatch | None, answer: pa.RecordBatch) -> str | None:
    """What is wrong with an answer, or nothing."""
    want = _arrow(kind.gives)
    if answer.schema.names != want.names:
        return f"columns {answer.schema.names} instead of {want.names}"
    for f in want:
        if answer.schema.field(f.name).type != f.type:
            return f"{f.name} is {answer.schema.field(f.name).type} instead of {f.type}"
    if answer.column(kind.key).null_count:
        return f"null in {kind.key}"
    return None


def checked(model: Model, kind: Kind) -> Model:
    """The model, one batch asked at a time, with every answer tested; raises ``PluginError``."""

    def run(batches: Batches) -> Batches:
        for asked in batches:
            open_keys: dict[str, int] = {}
            for k in asked.column(kind.key).to_pylist():
                open_keys[k] = open_keys.get(k, 0) + 1
            for answer in model(iter((asked,))):
                if problem := _problem(kind, asked, answer):
                    raise PluginError(problem)
                for k in answer.column(kind.key).to_pylist():
                    if k not in open_keys:
                        raise PluginError(f"an answer for {k!r}, which wasn't asked or was answered before" if kind.each else f"an answer for {k!r}, which wasn't asked")
                    if kind.each:
                        open_keys[k] -= 1
                        if not open_keys[k]:
                            del open_keys[k]
                yield answer
            if kind.each and open_keys:
                raise PluginError(f"no answer for {next(iter(open_keys))!r}")

    return run


class Registry:
    """Named plug-ins of each kind."""

    def __init__(self):
        self._known: dict[tuple[str, str], Model] = {}

    def register(self, kind: str, name: str, model: Model, *, replace: bool = False) -> None:
        """Add a plug-in after a trial; a name is taken once, unless it is replaced."""
        if kind not in KINDS:
            raise PluginError(f"no kind {kind!r}: {', '.join(KINDS)}")
        if (kind, name) in self._known and not replace:
            raise PluginError(f"a {kind} named {name!r} is known")
        k = KINDS[kind]
        gets = _arrow(k.gets)
        for trial in ({n: [] for n in gets.names}, k.sample):
            batch = pa.RecordBatch.from_pydict(trial, gets)
            try:
                list(checked(model, k)(iter((batch,))))
            except PluginError:
                raise
            except Exception as e:
                raise PluginError(f"{name}: {type(e).__name__}: {e}") from e
        self._known[kind, name] = model

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._known if k == kind)

    def get(self, kind: str, name: str) -> Model:
        if (kind, name) not in self._known:
            raise PluginError(f"no {kind} named {name!r}: {', '.join(self.names(kind)) or 'none is registered'}")
        return self._known[kind, name]

    def run(self, kind: str, name: str, rows: DataFrame) -> DataFrame:
        """Answers of a plug-in to ``rows`` (the columns that its kind gets, in any order)."""
        k, model = KINDS[kind], self.get(kind, name)
        x = rows.select(*(F.col(n).cast(t).alias(n) for n, t in (c.split() for c in k.gets.split(", "))))
        gets = _arrow(k.gets)

        def task(batches: Batches) -> Batches:
            return checked(model, k)(b.cast(gets) if b.schema != gets else b for b in batches)

        return x.mapInArrow(task, k.gives)


def by_row(kind: str, answer: Callable[[dict], list[dict]]) -> Model:
    """A plug-in from a function of one row (a dict) to rows; for simple models and stand-ins."""
    gives = _arrow(KINDS[kind].gives)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([out for row in batch.to_pylist() for out in answer(row)], gives)

    return run


def recognise(registry: Registry, name: str, pages: DataFrame) -> DataFrame:
    """Fragments (project_id, page_index, source_lang, raw_order, polygon, text, confidence) of ``pages`` (project_id, page_index, source_lang, image).

    A page is asked once, however often it is listed, with the greatest of its
    images; pages without one are left out. ``blocks_of_fragments`` goes on from here.
    """
    key = F.to_json(F.array(F.col("project_id"), F.col("page_index").cast("string")))
    asked = pages.where("image is not null and project_id is not null and page_index is not null")
    asked = asked.groupBy("project_id", "page_index").agg(F.max(F.struct("source_lang", "image")).alias("i")).select("project_id", "page_index", F.col("i.source_lang").alias("lang"), F.col("i.image").alias("image"))
    found = registry.run("recognizer", name, asked.withColumn("page", key))
    at = F.from_json("page", "array<string>")
    x = found.select(at[0].alias("project_id"), at[1].cast("int").alias("page_index"), F.col("ord").alias("raw_order"), "polygon", "text", "confidence")
    return x.join(asked.select("project_id", "page_index", F.col("lang").alias("source_lang")), ["project_id", "page_index"])


def translations(registry: Registry, name: str, texts: DataFrame) -> DataFrame:
    """text, lang, translation for the distinct ``texts`` (text, lang) that aren't blank."""
    asked = texts.select("text", "lang").where(squeeze(F.coalesce("text", F.lit(""))) != "").distinct()
    asked = asked.withColumn("key", F.sha2(F.concat_ws("\0", F.coalesce("lang", F.lit("")), F.col("lang").isNull().cast("string"), "text"), 256))
    return registry.run("translator", name, asked).join(asked, "key").select("text", "lang", "translation")
