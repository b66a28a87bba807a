"""Chat formatting: linking of tool calls and their results, with DataFrame functions alone.

Calls and results meet in a hash join by identifier. Calls form a forest (`after_id`: the call whose result a call
needs), ordered topologically by depth; depths are found by pointer doubling, so a chain of n calls takes about
log2 n rounds and no window or group holds a conversation. Arguments are parsed to VARIANT, checked against the
tool's schema by type, length, range, pattern, listed values, elements, inner and unknown fields, and written as canonical JSON:
sorted keys, no white space, one form for each number.

Defined results: calls without an id are dropped from links and get the status `no_id`; of several results of an id the
smallest (turn, content) is linked and n_results counts them all; of several calls of an id the earliest (turn,
name, arguments) is the call and n_calls counts them all; `after_id` of a call that doesn't exist counts as none;
calls on a cycle have depth -1; null or unreadable arguments, and ones with a number beyond doubles, have the error `not_json` and are written as null; tools without a schema
`unknown_tool`; results without a call are orphans; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool

#: Variant type names by schema type.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def argument_errors(arguments: Column, name: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """Sorted names of the failed checks of a call, comma-joined, '' if none.

    schemas: by tool and field: type, and optionally required, min_length, max_length, minimum, maximum, enum (of strings, or of
    numbers and booleans as canonical JSON), pattern (found anywhere in a string), items (the type of an array's elements) and
    fields (of an object, named `field.inner` in errors). A tool's or object's `"*": False` takes no field beside those named.
    """
    value = F.try_parse_json(arguments)
    none = F.lit(None).cast("string")
    kind_of = lambda part: F.regexp_extract(F.schema_of_variant(part), "^[A-Z]+", 0)
    types = lambda name: [*TYPES[name], *(["DECIMAL"] if name == "number" else [])]

    def checks(fields: dict, path: str, label: str) -> list[Column]:
        out = []
        if fields.get("*") is False:
            keys = F.map_keys(F.try_variant_get(value, path, "map<string,variant>"))
            named = F.array(*[F.lit(x) for x in fields if x != "*"]).cast("array<string>")
            out.append(F.when(F.size(F.array_except(keys, named)) > 0, F.lit(f"{label}*:unknown")))
        for field, rule in sorted(fields.items()):
            if field == "*":
                continue
            at, name = f"{path}['{field}']", f"{label}{field}"
            part = F.try_variant_get(value, at, "variant")
            there = F.coalesce(part.isNotNull() & (F.schema_of_variant(part) != "VOID"), F.lit(False))
            right = F.coalesce(there & kind_of(part).isin(types(rule["type"])), F.lit(False))
            if rule.get("required"):
                out.append(F.when(there, none).otherwise(F.lit(f"{name}:missing")))
            out.append(F.when(there & ~right, F.lit(f"{name}:type")))
            text = F.try_variant_get(value, at, "string")
            length, number = F.length(text), F.try_variant_get(value, at, "double")
            for key, bad in (("min_length", lambda x: length < x), ("max_length", lambda x: length > x), ("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("enum", lambda x: ~text.isin(x)), ("pattern", lambda x: ~text.rlike(x))):
                if key in rule:
                    out.append(F.when(right & bad(rule[key]), F.lit(f"{name}:{key}")))
            if "items" in rule:
                other = F.exists(F.try_variant_get(value, at, "array<variant>"), lambda x: F.coalesce(~kind_of(x).isin(types(rule["items"])), F.lit(True)))
                out.append(F.when(right & other, F.lit(f"{name}:items")))
            if "fields" in rule:
                out += [F.when(right, c) for c in checks(rule["fields"], at, f"{name}.")]
        return out

    def joined(fields: dict) -> Column:
        out = checks(fields, "$", "")
        return F.concat_ws(",", *out) if out else F.lit("")

    known = reduce(lambda other, tool: F.when(name == tool, joined(schemas[tool])).otherwise(other), sorted(schemas), F.lit("unknown_tool"))
    return F.when(value.isNull() | ~finite(arguments), F.lit("not_json")).otherwise(known)


#: JSON in parts: strings, and what stands between them; and there, numbers and the rest.
PARTS = r'"(?:[^"\\]|\\.)*+"|[^"]++'
NUMBER = r"-?[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"


def finite(json: Column) -> Column:
    """Whether all numbers outside strings fit into doubles."""
    plain = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', "")
    return ~F.exists(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0)), lambda x: F.abs(x.try_cast("double")) == F.lit(float("inf")))


def canonical_number(text: Column) -> Column:
    """One form for each value: whole numbers below 2^53 in digits alone, others as the shortest digits of their double, with the
    exponent after `e`. Whole numbers beyond, if written as digits alone, keep their digits."""
    d = text.try_cast("double")
    short = F.regexp_replace(F.regexp_replace(d.cast("string"), r"\.0(?=E|$)", ""), "E", "e")
    return F.when((F.abs(d) < F.lit(2.0**53)) & (d == F.floor(d)), d.cast("bigint").cast("string")).when(text.rlike(r"^-?[0-9]+$"), text).otherwise(short)


def canonical_json(json: Column) -> Column:
    """Canonical JSON of a text, null where it isn't JSON: keys sorted, no white space, numbers in one form."""
    plain = F.regexp_extract_all(F.to_json(F.try_parse_json(json)), F.lit(PARTS), F.lit(0))
    inner = lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"{NUMBER}|[^-0-9]++"), F.lit(0)), lambda y: F.when(y.rlike("^[-0-9]"), canonical_number(y)).otherwise(y))
    return F.when(finite(json), F.array_join(F.transform(plain, lambda x: F.when(x.startswith('"'), x).otherwise(F.array_join(inner(x), ""))), ""))


def depths(calls: DataFrame) -> DataFrame:
    """(id, depth) for calls (id, after_id) with distinct ids: 0 for the first of a chain, -1 on or after a cycle."""
    known = spool(calls.select("id", "after_id"), "calls")
    parents = known.select(F.col("id").alias("after_id"), F.lit(True).alias("known"))
    # up: the ancestor 2^k steps up, or null past the root; depth: steps counted so far
    now = known.join(parents, "after_id", "left").select("id", F.when(F.col("known"), F.col("after_id")).alias("up")).withColumn("depth", F.col("up").isNotNull().cast("long"))
    now = spool(now, "depth")
    for _ in range(max(1, known.count()).bit_length() + 1):  # those on a cycle never end
        if not now.where(F.col("up").isNotNull()).count():
            break
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        now = spool(now.join(above, "up", "left").select("id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depth")
    return now.select("id", F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.lit(-1)).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """One row per distinct call id, and per call without one: conv_id, call_id, name, depth, n_calls, n_results, errors,
    status and line, the canonical JSON of call and result.

    calls: conv_id, turn, id, after_id, name, arguments; results: turn, id, content.
    """
    call = F.struct("turn", "name", "arguments", "conv_id", "after_id")
    one = calls.where("id is not null").groupBy("id").agg(F.min(call).alias("c"), F.count("*").alias("n_calls")).select("id", "c.*", "n_calls")
    one = spool(one, "linked")
    answer = results.where("id is not null").groupBy("id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    lost = calls.where("id is null").select("id", "turn", "name", "arguments", "conv_id", "after_id", F.lit(1).cast("long").alias("n_calls"))
    whole = one.join(depths(one), "id", "left").join(answer, "id", "left").unionByName(lost, allowMissingColumns=True)
    errors = argument_errors(F.col("arguments"), F.col("name"), schemas)
    checked = whole.withColumn("errors", errors).withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("long")).withColumn("depth", F.coalesce("depth", F.lit(-1)).cast("long"))
    status = F.when(F.col("id").isNull(), "no_id").when(F.col("errors") != "", "invalid").when(F.col("n_results") == 0, "unanswered").when(F.col("depth") < 0, "cyclic").otherwise("ok")
    quote = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("arguments")), F.lit("null")), F.lit(',"id":'), quote(F.col("id")),
        F.lit(',"name":'), quote(F.col("name")), F.lit(',"result":'), F.when(F.col("n_results") > 0, quote(F.col("r.content"))).otherwise(F.lit("null")), F.lit("}"),
    )
    return checked.select("conv_id", "turn", F.col("id").alias("call_id"), "name", "depth", "n_calls", "n_results", "errors", status.alias("status"), line.alias("line"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call doesn't exist, or that name none."""
    return results.join(calls.where("id is not null").select("id").distinct(), "id", "left_anti")
