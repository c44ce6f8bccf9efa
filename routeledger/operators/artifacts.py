"""Read-back of artifacts: differences of nested documents by path, checks of declared fields, and hashes of what documents say.

Documents are JSON texts. Each becomes its leaves, by path: keys joined by dots (a dot or backslash of a key after a backslash), places of a
list as numbers; an empty list or object is a leaf. Two tables of documents then meet by name and path, so a large document costs its own leaves only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeledger.functions.names import canonical_json

LEAVES = "name string, state string, hash string, leaves array<struct<path: string, value: string>>"
LEAF = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
KEYED = {"\\": "\\\\", ".": "\\."}


def ignored(path: list[str], patterns: list[list[str]]) -> bool:
    """Whether a path is at one of the patterns, in which * is any one step."""
    return any(len(p) == len(path) and all(a in ("*", b) for a, b in zip(p, path, strict=True)) for p in patterns)


def leaves(value, patterns: list[list[str]]) -> Iterator[tuple[str, str]]:
    """Path and JSON text of every leaf that is not at or below an ignored path."""
    todo = [((), value)]
    while todo:
        path, at = todo.pop()
        if path and ignored(list(path), patterns):
            continue
        inner = list(at.items()) if isinstance(at, dict) else [(str(i), x) for i, x in enumerate(at)] if isinstance(at, list) else []
        if inner:
            todo += [((*path, "".join(KEYED.get(c, c) for c in k)), x) for k, x in inner]
        elif path:
            yield ".".join(path), canonical_json(at)


def flattened(docs: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """LEAVES of documents (name, document). state is `invalid` for a null, for no JSON, and for what is no object or an empty one; it has no leaves.

    hash is the SHA-256 of the document's canonical JSON, ignored paths included, so that equal documents have one whatever their keys' order.
    """
    patterns = [p.split(".") for p in ignore]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, said, own = [], [], []
            for text in batch["document"].to_pylist():
                try:
                    value = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    value = None
                good = isinstance(value, dict) and bool(value)
                state.append("read" if good else "invalid")
                said.append(hashlib.sha256(canonical_json(value).encode("utf-8", "surrogatepass")).hexdigest() if good else None)
                own.append([{"path": p, "value": v} for p, v in leaves(value, patterns)] if good else [])
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array(state, pa.string()), pa.array(said, pa.string()), pa.array(own, LEAF)], ["name", "state", "hash", "leaves"])

    return docs.select(F.col("name").cast("string").alias("name"), F.col("document").cast("string").alias("document")).mapInArrow(run, LEAVES)


def drift(desired: DataFrame, found: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """name, path, kind, wanted and found of every difference between documents of one name (name, document; names are unique on each side).

    kind: changed; lacking, where only the desired document has the path; surplus, where only the other one has it. A desired document whose
    counterpart is `absent` or `invalid` has one row of that kind without a path; documents that are not desired are left out.
    """
    mine, theirs = flattened(desired, ignore), flattened(found, ignore)
    there = theirs.select(F.col("name").alias("_name"), F.col("state").alias("_state"))
    met = mine.join(there, F.col("name") == F.col("_name"), "left")
    whole = met.where("_state IS NULL OR _state = 'invalid'").select("name", F.lit(None).cast("string").alias("path"), F.coalesce(F.col("_state"), F.lit("absent")).alias("kind"), F.lit(None).cast("string").alias("wanted"), F.lit(None).cast("string").alias("found"))
    left = met.where("_state = 'read'").select("name", F.explode("leaves").alias("x")).select("name", "x.path", F.col("x.value").alias("wanted"))
    right = theirs.where("state = 'read'").join(mine.select("name"), "name", "left_semi").select("name", F.explode("leaves").alias("x")).select("name", "x.path", F.col("x.value").alias("found"))
    kind = F.when(F.col("found").isNull(), "lacking").when(F.col("wanted").isNull(), "surplus").otherwise("changed")
    differing = left.join(right, ["name", "path"], "full_outer").where(~F.col("wanted").eqNullSafe(F.col("found")))
    return differing.select("name", "path", kind.alias("kind"), "wanted", "found").unionByName(whole)


def verified(fields: DataFrame, found: DataFrame) -> DataFrame:
    """name, status and mismatched (sorted fields) of read-backs. fields: name, field (a path) and expected (JSON text), the fields that matter.

    A field matches if what the document has at its path, leaf or not, is equal. status: verified, mismatched, invalid_response, or absent.
    """
    wanted = fields.groupBy("name").agg(F.collect_list(F.struct("field", "expected")).alias("fields"))
    there = found.select(F.col("name").alias("_name"), "document", F.lit(True).alias("there"))
    met = wanted.join(there, F.col("name") == F.col("_name"), "left").select("name", "fields", "document", "there")

    def at(value, path: str):
        for step in path.split("."):
            if isinstance(value, dict) and step in value:
                value = value[step]
            elif isinstance(value, list) and (step == "length" or step.isdecimal() and int(step) < len(value)):
                value = len(value) if step == "length" else value[int(step)]
            else:
                return None
        return canonical_json(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, missed = [], []
            for own, text, there in zip(*(batch[c].to_pylist() for c in ("fields", "document", "there")), strict=True):
                try:
                    value = json.loads(text or "null")
                except (ValueError, RecursionError):
                    value = None
                good = isinstance(value, dict) and bool(value)
                wrong = sorted(f["field"] for f in own if at(value, f["field"]) != canonical_json(json.loads(f["expected"]))) if good else []
                status.append("absent" if not there else "invalid_response" if not good else "mismatched" if wrong else "verified")
                missed.append(wrong)
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array(status, pa.string()), pa.array(missed, pa.list_(pa.string()))], ["name", "status", "mismatched"])

    return met.mapInArrow(run, "name string, status string, mismatched array<string>")
