"""Schemas that drift between files: one consistent table of all lines, and the list of changes between files.

The header of a file is what its readable lines show of each field: the names it goes by and the JSON type of its
values. Headers are read in parallel (each task folds its own lines) and combined by a join in the promotion lattice

    null < boolean < string,   null < integer < number < string,   null < array < json,   null < object < json,   string < json

Each file is compared with the file before it in its feed; the fold over all files gives the union schema, to which every line
is cast. Every cast goes upwards in the lattice, so no value is lost: numbers become text as they are written in the file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocked import blocked_lag

#: Bits of the JSON types; a file's type is the fold of the bits of its lines.
TYPE_BITS = {"string": 1, "integer": 2, "number": 4, "array": 8, "object": 16, "boolean": 32}

#: Further bits: a whole number that a double does not hold exactly, and one of more than 63 bits.
WIDE, HUGE = 64, 128
_NUMBERS, _SCALARS = 2 | 4, 1 | 2 | 4 | 32


def promote(bits: int) -> str | None:
    """Least upper bound of the types in bits; null for none. Whole numbers that no number column would hold make it text."""
    kinds = bits & 63
    if kinds == 0:
        return None
    if kinds & ~_SCALARS:
        return next((k for k, v in TYPE_BITS.items() if v == kinds), "json")
    if kinds & ~_NUMBERS:
        return next((k for k, v in TYPE_BITS.items() if v == kinds), "string")
    if bits & HUGE or (kinds & 4 and bits & WIDE):
        return "string"
    return "integer" if kinds == 2 else "number"


#: Column types of the union schema. Arrays, objects and json are kept as JSON text.
COLUMN_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean"}


class Whole(str):
    """A whole number as it is written, of any number of digits."""


class Fraction(str):
    """A number with a fraction or an exponent, as it is written."""


_KINDS = ((bool, 32), (Whole, 2), (Fraction, 4), (str, 1), (list, 8), (dict, 16))


def _reject(text: str):
    raise ValueError(text)


def read_line(payload: str | None) -> dict | None:
    """The object of a line; null for a line that is no JSON, an empty object for JSON that is none."""
    if not payload:
        return None
    try:
        o = json.loads(payload, parse_constant=_reject, parse_int=Whole, parse_float=Fraction)
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else {}


def find(o: dict, path: tuple[str, ...]) -> tuple[bool, object]:
    for p in path:
        if not isinstance(o, dict) or p not in o:
            return False, None
        o = o[p]
    return True, o


def _bits(v: object) -> int:
    if v is None:
        return 0
    b = next(b for t, b in _KINDS if isinstance(v, t))
    if b == 2 and len(v) > 15:
        digits = v.lstrip("-")
        b |= (WIDE if len(digits) > 16 or int(digits) > 1 << 53 else 0) | (HUGE if len(digits) > 19 or not -(1 << 63) <= int(v) < 1 << 63 else 0)
    return b


def _headers(alias: list[tuple[str, tuple[str, ...], str]], fold_rows: int):
    """Map side: (feed, file, field, name, type bits) of the task's lines; field null says that the file is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}

        def flush() -> pa.RecordBatch:
            feed, file, field, name = zip(*seen)
            r = pa.RecordBatch.from_arrays([pa.array(feed, pa.int64()), pa.array(file, pa.int64()), pa.array(field, pa.string()), pa.array(name, pa.string()), pa.array(seen.values(), pa.int32())], names=["feed", "file", "field", "name", "bits"])
            seen.clear()
            return r

        for b in batches:
            for feed, file, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                seen.setdefault((feed, file, None, None), 0)
                o = read_line(payload)
                for name, path, field in alias if o else ():
                    there, v = find(o, path)
                    if there:
                        k = (feed, file, field, name)
                        seen[k] = seen.get(k, 0) | _bits(v)
            if len(seen) > fold_rows:
                yield flush()
        if seen:
            yield flush()

    return run


def _aliases(field_alias: DataFrame) -> list[tuple[str, tuple[str, ...], str]]:
    rows = sorted((r[0], r[1]) for r in field_alias.where("alias_path is not null and field_name is not null").distinct().collect())
    return [(a, tuple(a.split(".")), f) for a, f in rows]


def file_schemas(lines: DataFrame, field_alias: DataFrame, feed: str = "feed_id", file: str = "file_no", payload: str = "payload", fold_rows: int = 200_000) -> DataFrame:
    """feed, file, fields: a map from field to (names, bits), one row per file of a feed. field_alias is a fixed table."""
    alias = _aliases(field_alias)
    narrow = lines.select(F.col(feed).cast("long").alias("feed"), F.col(file).cast("long").alias("file"), F.col(payload).cast("string").alias("payload")).where("feed is not null and file is not null")
    seen = narrow.mapInArrow(_headers(alias, fold_rows), "feed long, file long, field string, name string, bits int")
    fields = seen.groupBy("feed", "file", "field").agg(F.array_sort(F.collect_set("name")).alias("names"), F.bit_or("bits").alias("bits"))
    return fields.groupBy("feed", "file").agg(F.map_from_entries(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", F.struct("names", "bits"))))).alias("fields"))


def schema_changes(lines: DataFrame, field_alias: DataFrame) -> DataFrame:
    """feed_id, file_no, field_name, change_kind (added, removed, renamed, retyped), old and new name and type.

    Files follow each other by file_no within a feed, numbers may be skipped, a file sent twice is one file; first files
    have no changes. Lines that are no JSON are passed over, a file of nothing else has no fields. Null feed or file
    numbers are left out. A type is compared only where both files have values that are not null.
    """
    files = file_schemas(lines, field_alias)
    names = sorted({f for _, _, f in _aliases(field_alias)})
    both = blocked_lag(files, ["feed"], "file", ["fields"], "before").where("before is not null")
    one = F.explode(F.array(*(F.lit(n) for n in names))).alias("field_name") if names else F.lit(None).cast("string").alias("field_name")
    each = both.select("feed", "file", "fields", F.col("before.fields").alias("old_fields"), one)
    each = each.select("feed", "file", "field_name", F.col("fields")[F.col("field_name")].alias("n"), F.col("old_fields")[F.col("field_name")].alias("o"))
    kind = F.array_compact(
        F.array(
            F.when(F.col("o").isNull() & F.col("n").isNotNull(), "added"),
            F.when(F.col("o").isNotNull() & F.col("n").isNull(), "removed"),
            F.when(F.col("o.names") != F.col("n.names"), "renamed"),
            F.when((F.col("o.bits") != 0) & (F.col("n.bits") != 0) & (_file_type("o.bits") != _file_type("n.bits")), "retyped"),
        )
    )
    rows = each.withColumn("change_kind", F.explode(kind))
    text = lambda c: F.array_join(f"{c}.names", ",")
    return rows.select(F.col("feed").alias("feed_id"), F.col("file").cast("int").alias("file_no"), "field_name", "change_kind", text("o").alias("old_name"), text("n").alias("new_name"), _file_type("o.bits").alias("old_type"), _file_type("n.bits").alias("new_type"))


def _file_type(bits: str) -> Column:
    """The type of a field in one file, for comparing files: number above integer, mixed for any other two."""
    kinds = F.col(bits).bitwiseAND(63)
    one = F.when(kinds.isin(4, 6), "number")
    for kind, bit in TYPE_BITS.items():
        if kind != "number":
            one = one.when(kinds == bit, kind)
    return one.when(kinds != 0, "mixed")


def promoted(bits: str) -> Column:
    """`promote` as a column."""
    c, kinds = F.col(bits), F.col(bits).bitwiseAND(63)
    text = (kinds.bitwiseAND(~_NUMBERS) == 0) & (kinds != 0) & ((c.bitwiseAND(HUGE) != 0) | ((kinds.bitwiseAND(4) != 0) & (c.bitwiseAND(WIDE) != 0)))
    one = F.when(text, "string").when(kinds.isin(4, 6), "number")
    for kind, bit in TYPE_BITS.items():
        if kind != "number":
            one = one.when(kinds == bit, kind)
    return one.when((kinds != 0) & (kinds.bitwiseAND(~_SCALARS) == 0), "string").when(kinds != 0, "json")


def union_schema(lines: DataFrame, field_alias: DataFrame) -> DataFrame:
    """field_name, n_files, n_names, union_type: the fold of all headers, one row per field of field_alias. union_type is null for a field without values."""
    names = sorted({f for _, _, f in _aliases(field_alias)})
    known = field_alias.where("alias_path is not null and field_name is not null").select("field_name").distinct()
    seen = file_schemas(lines, field_alias).select(F.explode("fields").alias("field_name", "h")) if names else None
    if seen is None:
        return known.select("field_name", F.lit(0).cast("long").alias("n_files"), F.lit(0).cast("long").alias("n_names"), F.lit(None).cast("string").alias("union_type"))
    folded = seen.groupBy("field_name").agg(F.count(F.lit(1)).alias("n_files"), F.bit_or("h.bits").alias("bits"))
    each = seen.select("field_name", F.explode("h.names").alias("name")).groupBy("field_name").agg(F.count_distinct("name").alias("n_names"))
    x = known.join(folded, "field_name", "left").join(each, "field_name", "left")
    return x.select("field_name", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.coalesce("n_names", F.lit(0)).cast("long").alias("n_names"), promoted("bits").alias("union_type"))


def as_type(v: object, kind: str | None) -> object:
    """A value of any JSON type in a type at or above its own: null stays null, scalars become text as written, the rest JSON text."""
    if v is None or kind is None:
        return None
    if kind == "boolean":
        return v
    if kind == "integer":
        return int(v)
    if kind == "number":
        return float(v)
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str) and (kind == "string" or isinstance(v, (Whole, Fraction))):
        return str(v)
    return _json(v) if kind != "json" or not isinstance(v, str) else str(v)


def _json(v: object) -> str:
    """JSON text without blanks, numbers as they were written."""
    if isinstance(v, (Whole, Fraction)):
        return str(v)
    if isinstance(v, list):
        return "[" + ",".join(map(_json, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(x)}" for k, x in v.items()) + "}"
    return json.dumps(v, ensure_ascii=False)


def _cast(alias: list[tuple[str, tuple[str, ...], str]], kinds: dict[str, str | None], types: dict[str, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {f: [] for f in kinds}
            ok = []
            for payload in b.column("__payload").to_pylist():
                o = read_line(payload)
                ok.append(o is not None)
                got: dict[str, object] = {}
                for _, path, field in alias if o else ():
                    if got.get(field) is None:
                        there, v = find(o, path)
                        if there:
                            got[field] = v
                for f, kind in kinds.items():
                    cols[f].append(as_type(got.get(f), kind))
            kept = [n for n in b.schema.names if n != "__payload"]
            arrays = [b.column(n) for n in kept] + [pa.array(ok, pa.bool_())] + [pa.array(cols[f], types[f]) for f in kinds]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "readable", *kinds])

    return run


def consistent_table(lines: DataFrame, field_alias: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """Every line in the union schema: the `keep` columns, readable (whether the line is JSON) and one column per field of
    field_alias, of the type the fold over all headers gives it (text for a field without values). Two passes: headers, then casts.

    No line is dropped: unreadable, empty and null lines have null fields, and lines without feed or file number count in the union schema
    too. A field under several names takes the first by name that is not null.
    """
    alias = _aliases(field_alias)
    fields = sorted({f for _, _, f in alias})
    narrow = lines.select(*keep, F.col(payload).cast("string").alias("__payload"))
    every = lines.select(F.lit(0).cast("long").alias("feed_id"), F.lit(0).alias("file_no"), F.col(payload).alias("payload"))
    kinds: dict[str, str | None] = {f: None for f in fields}
    for r in union_schema(every, field_alias).collect():  # one row per field of the fixed table
        kinds[r["field_name"]] = r["union_type"]
    columns = {f: COLUMN_TYPES.get(k or "", "string") for f, k in kinds.items()}
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "__payload")
    return narrow.mapInArrow(_cast(alias, kinds, {f: arrow[c] for f, c in columns.items()}), schema + ", readable boolean" + "".join(f", `{f}` {c}" for f, c in columns.items()))
