"""Describing navigation groups through an outside model: batches, requests, schemas, validation, results."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.operators.numbering import batched

GROUP_LIMITS, SECTION_LIMITS = (20, 75_000), (25, 60_000)
FIELDS = ("description", "keywords", "evidence_methods", "confidence")


def unknown(evidence: DataFrame, allowed: DataFrame, *key: str) -> DataFrame:
    """Evidence that isn't among what is allowed."""
    return evidence.join(allowed.select(*key), list(key), "left_anti")


def _limited(name: str, kind: T.DataType, **limits) -> T.StructField:
    return T.StructField(name, kind, False, limits)


#: What a model says of a group: a column type whose fields' metadata are the limits of JSON Schema (``each``: those of an array's items).
DESCRIBED = [
    _limited("description", T.StringType(), minLength=20, maxLength=180),
    _limited("keywords", T.ArrayType(T.StringType()), minItems=3, maxItems=7, each={"minLength": 2, "maxLength": 60}),
]
CARD = T.StructType([_limited("id", T.StringType()), *DESCRIBED, _limited("evidence_methods", T.ArrayType(T.StringType()), minItems=1, maxItems=8), _limited("confidence", T.StringType(), enum=["high", "medium", "low"])])
SECTION_CARD = T.StructType([_limited("name", T.StringType()), *DESCRIBED])


def json_schema(kind: T.DataType, **limits) -> dict:
    """The JSON Schema of values of a Spark type."""
    if isinstance(kind, T.StructType):
        fields = {f.name: json_schema(f.dataType, **f.metadata) for f in kind}
        return {"type": "object", "additionalProperties": False, "required": kind.fieldNames(), "properties": fields, **limits}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, **limits.pop("each", {})), **limits}
    return limits if "enum" in limits else {"type": "string", **limits}


def schema(key: str, count: int, section: bool = False) -> dict:
    """The JSON schema of a batch's answer."""
    answer = T.StructType([_limited(key, T.ArrayType(SECTION_CARD if section else CARD), minItems=count, maxItems=count)])
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **json_schema(answer)}


def requests(groups: DataFrame, methods: DataFrame, limits: tuple[int, int] = GROUP_LIMITS) -> DataFrame:
    """Per batch: batch, group_ids and the payload with short ids g01, g02 and so on. A row has the groups of one batch at most."""
    named = methods.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "method", "purpose"))), lambda m: F.array(m["method"], m["purpose"])).alias("methods"))
    item = F.struct("id", "subsystem", F.col("interface_kind").alias("kind"), "name", "methods")
    items = groups.join(named, groups["id"] == named["group_id"]).select("id", item.alias("item")).withColumn("size", F.length(F.to_json("item")))
    each = batched(items, ["id"], "size", *limits).groupBy("batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "item"))), lambda x: x["item"]).alias("items"))
    short = F.transform("items", lambda x, i: F.struct(F.format_string("g%02d", i + 1).alias("id"), x["subsystem"].alias("subsystem"), x["kind"].alias("kind"), x["name"].alias("name"), x["methods"].alias("methods")))
    return each.select("batch", F.transform("items", lambda x: x["id"]).alias("group_ids"), F.to_json(F.struct(short.alias("groups"))).alias("payload"))


def answered(found: DataFrame, ask: Callable[[dict, dict], dict], known: dict[int, dict] | None = None, folder: str | None = None) -> list[dict]:
    """The cards of all batches by full id; ``known`` answers, and those that ``folder`` has, aren't asked for again.

    With ``folder``, each batch's request, schema and answer are files there, written as they come.
    """
    cards = []
    for row in found.orderBy("batch").collect():
        form, kept = schema("cards", len(row["group_ids"])), f"{folder}/batch-{row['batch']:03d}"
        answer = (known or {}).get(row["batch"])
        if answer is None and folder and os.path.isfile(f"{kept}.answer.json"):
            with open(f"{kept}.answer.json", encoding="utf-8") as f:
                answer = json.load(f)
        if answer is None:
            request = json.loads(row["payload"])
            for name, value in (("request", request), ("schema", form)) if folder else ():
                _save(f"{kept}.{name}.json", value)
            answer = ask(request, form)
            if folder:
                _save(f"{kept}.answer.json", answer)
        by_short = {f"g{i + 1:02d}": g for i, g in enumerate(row["group_ids"])}
        for card in answer["cards"]:
            full = by_short.get(card["id"], card["id"])
            if full not in row["group_ids"]:
                raise ValueError(f"no such group: {card['id']}")
            cards.append(card | {"id": full})
    return cards


def _save(path: str, value: dict) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.tmp", path)


def enriched(groups: DataFrame, methods: DataFrame, cards: DataFrame) -> DataFrame:
    """``groups`` with the cards' fields; errors if cards are missing or name methods that a group hasn't."""
    claims = cards.select(F.col("id").alias("group_id"), F.explode("evidence_methods").alias("method"))
    bad = unknown(claims, methods, "group_id", "method").limit(5).collect()
    if bad:
        raise ValueError(f"unknown evidence: {[tuple(r) for r in bad]}")
    missing = groups.join(cards, "id", "left_anti").select("id").limit(5).collect() + cards.join(groups, "id", "left_anti").select("id").limit(5).collect()
    if missing:
        raise ValueError(f"cards and groups don't agree: {[r['id'] for r in missing]}")
    return groups.drop(*FIELDS).join(cards.select("id", *FIELDS), "id")
