"""Trees in JSON texts: every leaf with its path, however deep."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(true|false|null)(?!\w)|([{}\[\],:]))', re.A)
REST = re.compile(r"[ \t\r\n]*\Z")
STRING, NUMBER, WORD, MARK = 1, 2, 3, 4


def leaves(text: str, exempt: frozenset[str] = frozenset()) -> list[tuple[str, str, str | None]] | None:
    """(path, kind, value) of each scalar in order: kind is string, number, boolean or null, a number's value as it stands there.
    None if the text is no JSON. What stands under a name in `exempt`, at any depth, is left out. The open objects and
    arrays are a list, so depth has no bound."""
    out: list[tuple[str, str, str | None]] = []
    path: list[str] = []  # of each open container: the step that leads to its present child
    kinds: list[str] = []  # { or [
    places: list[int] = []
    hidden = 0  # how many open containers are, or stand under, an exempt name
    veiled: list[bool] = []
    at, expect = 0, "value"  # value, first (value or ]), name, name1 (name or }), colon, after (, or an end), done
    while expect != "done":
        m = TOKEN.match(text, at)
        if m is None:
            return None
        at, which = m.end(), m.lastindex
        token = m.group(which)
        if expect in ("name", "name1") and which == STRING:
            name = json.loads(token) if "\\" in token else token[1:-1]
            path[-1] = f".{name}"
            now = name in exempt
            hidden += now - veiled[-1]
            veiled[-1] = now
            expect = "colon"
        elif expect == "colon" and token == ":" and which == MARK:
            expect = "value"
        elif which == MARK and token in "{[" and expect in ("value", "first"):
            kinds.append(token)
            places.append(0)
            veiled.append(False)
            path.append("" if token == "{" else "[0]")
            expect = "name1" if token == "{" else "first"
        elif which == MARK and token in "}]" and kinds and kinds[-1] == ("{" if token == "}" else "[") and expect in ("after", "name1" if token == "}" else "first"):
            kinds.pop()
            places.pop()
            path.pop()
            hidden -= veiled.pop()
            expect = "after" if kinds else "done"
        elif which == MARK and token == "," and expect == "after" and kinds:
            if kinds[-1] == "[":
                places[-1] += 1
                path[-1] = f"[{places[-1]}]"
                expect = "value"
            else:
                expect = "name"
        elif which != MARK and expect in ("value", "first"):
            if not hidden:
                where = "$" + "".join(path)
                if which == STRING:
                    out.append((where, "string", json.loads(token) if "\\" in token else token[1:-1]))
                elif which == NUMBER:
                    out.append((where, "number", token))
                else:
                    out.append((where, "null", None) if token == "null" else (where, "boolean", token))
            expect = "after" if kinds else "done"
        else:
            return None
    return out if REST.match(text, at) else None


_LEAF = pa.struct([("path", pa.string()), ("kind", pa.string()), ("value", pa.string())])


def tree_leaves(df: DataFrame, keys: list[str], payload: str, exempt: list[str] | None = None) -> DataFrame:
    """Keys, path, kind and value of every scalar in a JSON text, of any depth; null leaves stay, invalid and null texts have none;
    names in exempt hide what stands under them. Each text is read once, without a shuffle. A surrogate without its pair,
    which no column can hold, becomes a question mark."""
    hidden = frozenset(exempt or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda s: s if s is None or s.isascii() else s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace").encode("utf-8", "replace").decode()
        for batch in batches:
            found = [[{"path": whole(p), "kind": k, "value": whole(v)} for p, k, v in leaves(t.as_py() or "", hidden) or ()] for t in batch.column("__text")]
            columns = [batch.column(f"__k{i}") for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(_LEAF))], names=[*(f"__k{i}" for i in range(len(keys))), "__leaves"])

    schema = ", ".join(f"__k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(payload).alias("__text"))
    out = rows.mapInArrow(run, f"{schema}, __leaves array<struct<path:string,kind:string,value:string>>")
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], F.inline("__leaves"))


def bare_numbers(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Objects that state a number and cite nothing: keys, path, how many number leaves they hold themselves, and their names. An
    object cites if it has an own leaf, or a list, named citation, citations, source, source_id, source_ids or evidence_ids that isn't empty."""
    cites = r"\.(?:citations?|source|source_ids?|evidence_ids)(?:\[\d+\])?$"
    own = F.regexp_extract("path", r"^(.*?)(?:\.[^.\[\]]+)?(?:\[\d+\])*$", 1)
    x = tree.withColumn("__object", own).withColumn("__cites", F.col("path").rlike(cites) & F.col("value").isNotNull() & (F.col("value") != ""))
    number = (F.col("kind") == "number") & ~F.col("path").rlike(cites)
    name = F.regexp_extract("path", r"\.([^.\[\]]+)(?:\[\d+\])*$", 1)
    g = x.groupBy(*keys, "__object").agg(F.bool_or("__cites").alias("cited"), F.count_if(number).alias("numbers"), F.array_join(F.array_sort(F.collect_set(F.when(number, name))), ",").alias("names"))
    return g.filter("numbers > 0 AND NOT cited").select(*keys, F.col("__object").alias("path"), "numbers", "names")
