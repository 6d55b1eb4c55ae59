"""Chat formatting with tool-call linking, in DataFrame operations only.

Messages have conv_id, turn, role, text. A call is a message of role ``tool_call`` whose
text is JSON with id, name, arguments and, if it builds on others, ``after``: the id of a call or
a list of ids. A result is one of role ``tool`` with id and content. Calls and results are
joined by (conv_id, id); the level of a call is the longest way up through ``after``; arguments
are checked against schemas; every message becomes canonical JSON: keys in order at every
depth, no white space.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.registry import cut

KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
KEY = ["conv_id", "call_id"]


def schema_table(spark: SparkSession, schemas: Mapping[str, Mapping[str, tuple]]) -> DataFrame:
    """schemas: tool -> field -> (type, required) or (type, required, rules). Types: string, integer, number,
    boolean, object, array, and array of one of the first four, as ``array<integer>``. Rules: ``enum``
    (a list of texts, the values as texts), ``minimum`` and ``maximum`` (of numbers)."""
    rows = []
    for tool, fields in schemas.items():
        rules = {f: dict(r[0]) if r else {} for f, (_, _, *r) in fields.items()}
        rows.append((
            tool, {f: kind for f, (kind, *_) in fields.items()}, [f for f, (_, need, *_) in fields.items() if need],
            {f: [str(x) for x in r["enum"]] for f, r in rules.items() if "enum" in r},
            {f: float(r["minimum"]) for f, r in rules.items() if "minimum" in r}, {f: float(r["maximum"]) for f, r in rules.items() if "maximum" in r},
        ))
    return spark.createDataFrame(rows, "tool string, types map<string,string>, required array<string>, enums map<string,array<string>>, least map<string,double>, most map<string,double>")


def _plain_fits(own: Column, kind: Column) -> Column:
    """Whether the name of a variant's type is that of a schema's type without parts."""
    number = own.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    whole = (own == "BIGINT") | own.rlike(r"^DECIMAL\(\d+,0\)")
    names = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return F.when(kind == "number", number).when(kind == "integer", whole).otherwise(F.split(own, "[<(]")[0] == names[kind])


def _fits(value: Column, kind: Column) -> Column:
    """Whether a variant's own type is the named one. An empty array fits arrays of anything."""
    own = F.schema_of_variant(value)
    inner = lambda c: F.regexp_extract(c, "^(?i:array)<(.*)>$", 1)
    of_kind = own.startswith("ARRAY<") & ((inner(own) == "VOID") | _plain_fits(inner(own), inner(kind)))
    return F.when(kind.startswith("array<"), of_kind).otherwise(_plain_fits(own, kind))


def _allowed(value: Column, enum: Column, least: Column, most: Column) -> Column:
    """Whether a value is one of the enumeration and inside the range, as far as they are given."""
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    return (enum.isNull() | F.array_contains(enum, text)) & (least.isNull() | (number >= least)) & (most.isNull() | (number <= most))


def _chains(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, top, steps of calls (conv_id, call_id, up): where a chain of ups ends and how far that
    is. Each round doubles the stretch that is known; calls of a cycle are not in the result."""
    now = cut(calls.select(*KEY, "up", F.coalesce("up", "call_id").alias("top"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("steps")))
    open_ = now.where("up is not null").count()
    for _ in range(max(1, open_).bit_length() + 1):
        if not open_:
            break
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("top").alias("end"), F.col("steps").alias("more"))
        moving = now.where("up is not null").join(above, ["conv_id", "up"])
        now = cut(now.where("up is null").union(moving.select(*KEY, F.col("next").alias("up"), F.col("end").alias("top"), F.col("steps") + F.col("more"))))
        open_ = now.where("up is not null").count()
    return now.where("up is null").select(*KEY, "top", "steps")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls (conv_id, call_id, after: a list of ids): 0 where ``after`` names no
    call, else one more than the highest of those it names; null in a cycle and behind one.

    Calls that build on one call form chains, which pointer doubling follows to their ends at once. What
    is left are the calls that build on several: they are settled round by round, those whose
    calls are all known first, so the rounds are as many as such calls follow each other.
    """
    ids = calls.select("conv_id", F.col("call_id").alias("before"))
    edges = calls.select(*KEY, F.explode(F.array_distinct("after")).alias("before")).where("before is not null").join(ids, ["conv_id", "before"])
    edges = cut(edges)
    fan = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("before").alias("one"))
    shaped = cut(calls.select(*KEY).join(fan, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("one")).alias("up")))
    chains = cut(_chains(shaped))
    # Of the calls with several: each call before, by the end of its chain and the way down from it.
    several = shaped.where("n > 1").select(*KEY, "n")
    above = chains.select("conv_id", F.col("call_id").alias("before"), "top", "steps")
    links = cut(several.join(edges, KEY).join(above, ["conv_id", "before"]).select(*KEY, "n", "top", (F.col("steps") + 1).alias("steps")))
    known = cut(shaped.where("n = 0").select("conv_id", F.col("call_id").alias("top"), F.lit(0).cast("long").alias("level")))
    while True:
        reached = links.join(known, ["conv_id", "top"]).groupBy(*KEY, "n").agg(F.count("*").alias("there"), F.max(F.col("level") + F.col("steps")).alias("level")).where("there = n")
        new = cut(reached.select("conv_id", F.col("call_id").alias("top"), "level").join(known.select("conv_id", "top"), ["conv_id", "top"], "left_anti"))
        if new.isEmpty():
            break
        known = cut(known.union(new))
    settled = chains.join(known, ["conv_id", "top"]).select(*KEY, (F.col("level") + F.col("steps")).alias("level"))
    return calls.select(*KEY).join(settled, KEY, "left")


def format_chat(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, call_id, level, status, json.

    Sorted by (conv_id, level, turn) calls stand after the calls they build on, and
    results after their calls (they share a level, and results carry the half step).
    Status: ok; bad json; no id; duplicate id (a later call of the same id; the first
    counts, by turn, then text); unknown tool; missing field; unexpected field; wrong type; value not allowed;
    unknown dependency (of any call named); cycle (or behind one); no result; orphan result. The first that applies, in this order. Other
    messages are ok and have no level. A null text is written as null; null roles and
    turns stay null; repeated rows stay, repeated calls being duplicates. Messages of a
    null conversation are not linked: calls have no result, results are orphans.
    """
    m = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    is_call, is_result = (F.coalesce(F.col("role") == r, F.lit(False)) for r in ("tool_call", "tool"))
    m = m.withColumn("v", F.when(is_call | is_result, F.try_parse_json("text")))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    m = m.withColumn("call_id", get("$.id", "string"))
    m = m.withColumn("kind", F.when(is_call, "call").when(is_result, "result"))

    c = m.where("kind = 'call'").select(
        "conv_id", "turn", "role", "text", "call_id", F.col("v").isNotNull().alias("parsed"), get("$.name", "string").alias("name"), F.coalesce(get("$.after", "array<string>"), F.array_compact(F.array(get("$.after", "string")))).alias("after"), get("$.arguments", "variant").alias("arguments"),
    )
    c = cut(c.withColumn("copy", F.monotonically_increasing_id()).withColumn("arguments", F.to_json("arguments")))
    rank = F.struct("turn", "text", "copy")
    first = c.where("call_id is not null and conv_id is not null").groupBy(*KEY).agg(F.min(rank).alias("f"), F.min_by("after", rank).alias("after"))
    first = cut(first.select(*KEY, F.col("f.copy").alias("copy"), "after"))
    answered = m.where("kind = 'result' and conv_id is not null and call_id is not null").select(*KEY).distinct().withColumn("answered", F.lit(True))
    linked = first.join(levels(first), KEY).join(answered, KEY, "left")
    named = first.select(*KEY, F.explode("after").alias("before")).where("before is not null")
    loose = named.join(first.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_anti").select(*KEY).distinct().withColumn("loose", F.lit(True))
    linked = cut(linked.join(loose, KEY, "left").select("copy", "level", "answered", F.coalesce("loose", F.lit(False)).alias("loose"), *KEY))

    c = c.join(linked.drop(*KEY).withColumn("counts", F.lit(True)), "copy", "left").join(schemas, F.col("name") == F.col("tool"), "left")
    fields = F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>")
    c = c.withColumn("fields", fields)
    names = F.map_keys("fields")
    wrong = F.exists(names, lambda k: F.element_at("types", k).isNotNull() & F.element_at("fields", k).isNotNull() & ~F.coalesce(_fits(F.element_at("fields", k), F.element_at("types", k)), F.lit(False)))
    own = lambda column, k: F.element_at(column, k)
    outside = F.exists(names, lambda k: own("fields", k).isNotNull() & ~F.coalesce(_allowed(own("fields", k), own("enums", k), own("least", k), own("most", k)), F.lit(False)))
    status = (
        F.when(~F.col("parsed") | (F.col("arguments").isNotNull() & F.col("fields").isNull()), "bad json").when(F.col("call_id").isNull(), "no id")
        .when(F.col("counts").isNull() & F.col("conv_id").isNotNull(), "duplicate id").when(F.col("tool").isNull(), "unknown tool")
        .when(F.coalesce(F.size(F.array_except("required", F.coalesce(names, F.array().cast("array<string>")))), F.lit(0)) > 0, "missing field")
        .when(F.size(F.array_except(names, F.map_keys("types"))) > 0, "unexpected field").when(wrong, "wrong type").when(outside, "value not allowed")
        .when(F.col("loose"), "unknown dependency").when(F.col("counts") & F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "no result").otherwise("ok")
    )
    text = lambda col: F.to_json(F.struct(F.col(col).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(col).alias("x")))) - 6)
    quoted = lambda col: F.when(F.col(col).isNull(), F.lit("null")).otherwise(text(col))
    arguments = F.coalesce(F.col("arguments"), F.lit("{}"))
    call_json = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"role":"tool_call"}'))
    calls = c.select("conv_id", "turn", "role", "call_id", F.col("level").cast("double"), status.alias("status"), F.when(F.col("parsed"), call_json).otherwise(F.concat(F.lit('{"content":'), quoted("text"), F.lit(',"role":"tool_call"}'))).alias("json"))

    r = m.where("kind = 'result'").withColumn("content", F.to_json(get("$.content", "variant"))).withColumn("parsed", F.col("v").isNotNull()).drop("v", "kind")
    r = r.join(linked.select(*KEY, F.col("level"), F.lit(True).alias("called")), KEY, "left")
    r_status = F.when(~F.col("parsed"), "bad json").when(F.col("call_id").isNull(), "no id").when(F.col("called").isNull(), "orphan result").when(F.col("level").isNull(), "cycle").otherwise("ok")
    r_json = F.when(F.col("parsed"), F.concat(F.lit('{"content":'), F.coalesce("content", F.lit("null")), F.lit(',"id":'), quoted("call_id"), F.lit(',"role":"tool"}'))).otherwise(F.concat(F.lit('{"content":'), quoted("text"), F.lit(',"role":"tool"}')))
    results = r.select("conv_id", "turn", "role", "call_id", (F.col("level") + 0.5).alias("level"), r_status.alias("status"), r_json.alias("json"))

    other_json = F.concat(F.lit('{"content":'), quoted("text"), F.lit(',"role":'), quoted("role"), F.lit("}"))
    others = m.where("kind is null").select("conv_id", "turn", "role", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("double").alias("level"), F.lit("ok").alias("status"), other_json.alias("json"))
    return others.unionByName(calls).unionByName(results)
