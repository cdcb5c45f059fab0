"""Documents to objects to leaves, and back."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext, paths, pseudonyms

OBJECTS = "member string, part int, idx long, key string, meta_type string, declared string, items long, object_identifier string, wkguid string, templatename string, name string, body string"
CONTEXT = "member string, part int, idx long, node_type string, object_identifier string, privacy string, catalog_rule_id string"
LEAVES = f"{CONTEXT}, ord long, kind string, token string, path string, canonical string, record string, steps string, ref_type string"
#: A row with part REFUSED says in ``name`` why its member can't be taken; the driver raises it.
REFUSED, META, DATA, REST = -1, 0, 1, 2


def document(raw: bytes) -> dict | None:
    """A member as a document; None if it isn't one (no ``data`` array, ``meta`` object or ``meta.type``)."""
    try:
        doc = jsontext.parse(bytes(raw))
    except (ValueError, RecursionError):
        return None
    if not isinstance(doc, dict) or not isinstance(doc.get("data"), list) or not isinstance(doc.get("meta"), dict):
        return None
    kind = doc["meta"].get("type")
    return doc if isinstance(kind, str) and not isinstance(kind, jsontext.Number) and kind else None


def _text(value: Any) -> str | None:
    return value if isinstance(value, str) and not isinstance(value, jsontext.Number) else None


def _rows(member: str, doc: dict) -> Iterator[tuple]:
    """A document's rows; one that says why, where an item is no object."""
    kind, count, items = doc["meta"]["type"], doc["meta"].get("count"), len(doc["data"])
    declared = None if count is None else f"{jsontext.kind(count)}:{count}"
    yield member, META, 0, "meta", kind, declared, items, None, None, None, None, jsontext.dumps(doc["meta"])
    for k, item in enumerate(doc["data"]):
        if not isinstance(item, dict):
            yield member, REFUSED, k, None, kind, None, 0, None, None, None, f"data item {k} is not an object", "null"
            return
        own = item.get("Properties")
        own = own if isinstance(own, dict) else {}
        yield member, DATA, k, None, kind, None, 0, _text(item.get("ObjectIdentifier")), _text(own.get("wkguid")), _text(own.get("templatename")), _text(own.get("name")), jsontext.dumps(item)
    for k, (key, v) in enumerate((k, v) for k, v in doc.items() if k not in ("meta", "data")):
        yield member, REST, k, key, kind, None, 0, None, None, None, None, jsontext.dumps(v)


def _objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in OBJECTS.split(", ")]
    rows: list[tuple] = []
    for batch in batches:
        for member, raw in zip(batch.member, batch.raw):
            doc = document(raw)
            for row in _rows(member, doc) if doc is not None else ():
                rows.append(row)
                if len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def objects(members: DataFrame) -> DataFrame:
    """A row for each object, the meta block and each further root key of every accepted member."""
    return members.select("member", "raw").mapInPandas(_objects, OBJECTS)


class Walk:
    """The nodes of one object, with source and projected paths."""

    def __init__(self, rename, known: dict[str, set[str]]):
        self.rename, self.known = rename, known

    def rows(self, node_type: str, body: Any, path: str, record: str) -> list[tuple]:
        self.out: list[tuple] = []
        self.declared = self.known.get(node_type, set()) | self.known.get("*", set())
        self._visit(body, path, paths.schema(path), record, [], None)
        return self.out

    def key(self, schema: str, key: str) -> str:
        return key if self.rename is None or schema in self.declared else self.rename(key)

    def _emit(self, kind: str, token, path: str, record: str, steps: list, ref: str | None) -> None:
        self.out.append((len(self.out), kind, token, path, paths.canonical(path), record, json.dumps(steps), ref))

    def _visit(self, value: Any, path: str, schema: str, record: str, steps: list, ref: str | None) -> None:
        kind = jsontext.kind(value)
        if kind == "mapping":
            folded = {k.casefold(): _text(v) for k, v in value.items() if _text(v) is not None}
            ref = folded.get("principaltype") or folded.get("objecttype")
            names = [self.key(paths.key_step(schema, k), k) for k in value]
            self._emit("mapping", json.dumps(sorted(names)), path, record, steps, None)
            if len(set(names)) < len(names):
                self._emit("collision", None, path, record, steps, None)
            for name, (k, v) in zip(names, value.items()):
                at = paths.key_step(record, name)
                if name != k:
                    self._emit("key", k, paths.key_step(path, k), at, [*steps, name], None)
                self._visit(v, paths.key_step(path, k), paths.key_step(schema, k), at, [*steps, name], ref)
        elif kind == "list":
            self._emit("list", str(len(value)), path, record, steps, None)
            for n, v in enumerate(value):
                self._visit(v, paths.index_step(path, n), f"{schema}[]", paths.index_step(record, n), [*steps, n], None)
        else:
            self._emit(kind, value if kind == "string" else jsontext.dumps(value), path, record, steps, ref)


def leaves(objects_: DataFrame, known: dict[str, set[str]], salt: str | None, owned: dict[str, str] | None = None) -> DataFrame:
    """A row for each node of each object. ``salt`` None: keys are taken as they are (an output is read).

    ``owned``: pseudonyms that a reused map has for keys. Objects are dealt anew first, as one member may hold most of them.
    """
    names = [f.split()[0] for f in LEAVES.split(", ")]
    context = [f.split()[0] for f in CONTEXT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rename = None if salt is None else lambda k: (owned or {}).get(k) or pseudonyms.pseudonym(salt, "opaque", k)
        walk = Walk(rename, known)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                body, key = jsontext.parse(r.body), r.key
                if r.part == DATA:
                    own = walk.rows(r.node_type, body, "", f"data[{r.idx}]")
                else:
                    walk.declared = known.get(r.node_type, set()) | known.get("*", set())
                    source = paths.key_step("", key)
                    name = key if r.part == META else walk.key(source, key)
                    own = walk.rows(r.node_type, body, source, paths.key_step("", name))
                    if name != key:
                        own.append((-1, "key", key, source, paths.canonical(source), paths.key_step("", name), "[]", None))
                rows += [(*(getattr(r, c) for c in context), *x) for x in own]
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return objects_.select(*context, "key", "body").repartition(F.xxhash64("member", "part", "idx")).mapInPandas(run, LEAVES)


def _put(root: list, steps: list, value: Any) -> None:
    node, at = root, 0
    for nxt in steps:
        node = node[at]
        at = nxt
        if isinstance(node, list):
            node.extend([None] * (at + 1 - len(node)))
    node[at] = value


def rebuild(rows: list[tuple[int, str, str, str | None]]) -> Any:
    """(ord, steps, kind, token) of an object's nodes to its JSON value."""
    root: list = [None]
    for _, steps, kind, token in sorted(rows):
        value = {} if kind == "mapping" else [] if kind == "list" else token if kind == "string" else None if kind == "null" else token == "true" if kind == "bool" else jsontext.Number(token)
        _put(root, json.loads(steps), value)
    return root[0]


def implode(nodes: DataFrame) -> DataFrame:
    """(member, part, idx, key, body): objects from their output nodes (member, part, idx, record, ord, steps, kind, token)."""
    own = nodes.where("kind not in ('key', 'collision')")

    @F.pandas_udf("string")
    def build(rows: pd.Series) -> pd.Series:
        return pd.Series([jsontext.dumps(rebuild([(r["ord"], r["steps"], r["kind"], r["token"]) for r in x])) for x in rows])

    grouped = own.groupBy("member", "part", "idx").agg(F.collect_list(F.struct("ord", "steps", "kind", "token")).alias("rows"), F.min_by("record", "ord").alias("record"))
    return grouped.select("member", "part", "idx", "record", build("rows").alias("body"))


#: Objects that are put together at a time.
CHUNK = 1000


def documents(objects_: DataFrame) -> DataFrame:
    """(member, body): whole members; the meta block first, then data, then the other root keys. Ranges of objects are put together first, so a
    member's objects are sorted in many tasks and only its text ends in one row."""

    @F.pandas_udf("string")
    def root_key(records: pd.Series) -> pd.Series:
        return records.map(lambda r: json.dumps(paths.steps(r)[0]))

    def joined(rows):
        return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["text"]), ", ")

    part = F.col("part")
    data = objects_.where(part == DATA).groupBy("member", (F.col("idx") / CHUNK).cast("long").alias("k")).agg(joined(F.struct("idx", F.col("body").alias("text"))).alias("text"))
    rest = objects_.where(part == REST).select("member", F.col("idx").alias("k"), F.concat(root_key("record"), F.lit(": "), "body").alias("text"))
    each = data.withColumn("part", F.lit(DATA)).unionByName(rest.withColumn("part", F.lit(REST)))
    own = each.groupBy("member").agg(*[joined(F.when(part == p, F.struct("k", "text"))).alias(name) for p, name in ((DATA, "data"), (REST, "rest"))])
    tail = F.when(F.col("rest") != "", F.concat(F.lit(", "), "rest")).otherwise("")
    got = objects_.where(part == META).select("member", "body").join(own, "member", "left")
    return got.select("member", F.concat(F.lit('{"meta": '), "body", F.lit(', "data": ['), F.coalesce("data", F.lit("")), F.lit("]"), tail, F.lit("}")).alias("body"))
