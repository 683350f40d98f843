"""Tool calls of conversations, linked, ordered, validated and serialised.

Calls and results meet in a hash join on (conversation, call id). A call may
name one earlier call whose result it needs; its level is its distance from a
call that needs none, found by pointer doubling, so a chain of any length takes
logarithmically many rounds. Arguments are checked against the schema of their
tool, and each link becomes one canonical JSON object: keys sorted at every
depth, no white space.

Nulls: a null conversation or id links with nothing and is left out. Of calls
that share an id the one with the smallest (name, arguments) counts, of results
the smallest content; n_calls and n_results tell how many there were. A result
without a call is an orphan, a needed call that is absent counts as none, and
calls that need each other in a circle get no level. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import stage

#: tool: {argument: (type, required, least, most)}; least and most bound a string's length or a number.
Schemas = dict[str, dict[str, tuple[str, bool, int | None, int | None]]]

#: What the turns of a conversation are checked against.
TURN_SCHEMA: Schemas = {"reply": {"prompt": ("string", True, 1, 400), "turn": ("integer", True, 0, None)}}

_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL"}
_KEY = ["conv_id", "call_id"]


def errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted messages of what is wrong with a call's arguments (a JSON string)."""
    value = F.try_parse_json(arguments)
    empty = F.expr("cast(array() as array<string>)")
    cases = F.when(~name.isin(*schemas), F.array(F.lit("unknown tool")))
    cases = cases.when(value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT"), F.array(F.lit("arguments are no object")))
    for tool, fields in schemas.items():
        found: list[Column] = []
        for field, (kind, required, least, most) in fields.items():
            part = F.try_variant_get(value, f"$.{field}", "variant")
            missing = part.isNull() | F.is_variant_null(part)
            if required:
                found.append(F.when(missing, F.lit(f"{field}: missing")))
            typed = F.schema_of_variant(part).rlike(f"^({_KINDS[kind]})")
            found.append(F.when(~missing & ~typed, F.lit(f"{field}: not of type {kind}")))
            if kind in ("string", "integer", "number"):
                amount = F.length(F.try_variant_get(value, f"$.{field}", "string")) if kind == "string" else F.try_variant_get(value, f"$.{field}", "double")
                if least is not None:
                    found.append(F.when(typed & (amount < least), F.lit(f"{field}: below {least}")))
                if most is not None:
                    found.append(F.when(typed & (amount > most), F.lit(f"{field}: above {most}")))
        extra = F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, fields)))
        more = F.transform(F.coalesce(extra, empty), lambda k: F.concat(k, F.lit(": not in the schema")))
        cases = cases.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*found)), more)))
    return F.coalesce(cases, empty)


def levels(calls: DataFrame) -> DataFrame:
    """calls: conv_id, call_id, after. conv_id, call_id, level (null in a circle)."""
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    state = calls.join(known, ["conv_id", "after"], "left").select(*_KEY, F.when(F.col("known"), F.col("after")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("level"))
    state = stage(state, "levels")
    open_before = None
    while (still := state.where("up is not null").count()) and still != open_before:
        open_before = still
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        state = state.join(above, ["conv_id", "up"], "left").select(*_KEY, F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        state = stage(state, "levels")
    return state.select(*_KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls: conv_id, call_id, after, name, arguments; results: conv_id, call_id,
    content. One row per id: status (linked, unanswered or orphan), level,
    n_calls, n_results, n_errors, errors, and canonical, the JSON object."""
    calls = calls.where("conv_id is not null and call_id is not null")
    calls = calls.groupBy(*_KEY).agg(F.min(F.struct("name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls"))
    calls = stage(calls.select(*_KEY, "c.name", "c.arguments", "c.after", "n_calls"), "calls")
    results = results.where("conv_id is not null and call_id is not null")
    results = results.groupBy(*_KEY).agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    rows = calls.join(levels(calls.select(*_KEY, "after")), _KEY).join(results.hint("shuffle_hash"), _KEY, "full")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    found = F.when(F.col("n_calls").isNotNull(), errors(F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")), schemas)).otherwise(F.expr("cast(array() as array<string>)"))
    rows = rows.select(*_KEY, status.alias("status"), "level", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), found.alias("errors"), "name", "arguments", "content")
    whole = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result"), "status", (F.size("errors") == 0).alias("valid"))
    return rows.select(*_KEY, "status", "level", "n_calls", "n_results", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", "; ").alias("errors"), F.to_json(whole).alias("canonical"))


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A user's turn as a call of the tool reply, which needs the one two turns
    before; an assistant's turn as the result of the turn before it."""
    name = lambda back: F.format_string("call_%d_%d", "conv_id", F.col("turn") - back)
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").where("turn is not null and conv_id is not null")
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn"))
    calls = turns.where("role = 'user'").select("conv_id", name(0).alias("call_id"), name(2).alias("after"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


ORACLE = """
with recursive t as (select conv_id, turn, role, coalesce(text, '') as text from conversations where turn is not null and conv_id is not null),
c as (select conv_id, turn, min(text) as text, count(*) as n_calls from t where role = 'user' group by all),
r as (select conv_id, turn - 1 as turn, min(text) as content, count(*) as n_results from t where role = 'assistant' group by all),
l as (select conv_id, turn, cast(0 as bigint) as level from c where not exists (select 1 from c p where p.conv_id = c.conv_id and p.turn = c.turn - 2)
      union all select c.conv_id, c.turn, l.level + 1 from l join c on c.conv_id = l.conv_id and c.turn = l.turn + 2),
j as (select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.turn, r.turn) as turn, l.level, c.n_calls, r.n_results, c.text, r.content,
             case when c.n_calls is null then 'orphan' when r.n_results is null then 'unanswered' else 'linked' end as status,
             case when c.n_calls is null then '' when length(c.text) < 1 then 'prompt: below 1' when length(c.text) > 400 then 'prompt: above 400' else '' end as errors
      from c join l using (conv_id, turn) full join r using (conv_id, turn))
select conv_id, 'call_' || conv_id || '_' || turn as call_id, status, level, coalesce(n_calls, 0) as n_calls, coalesce(n_results, 0) as n_results,
       cast(errors <> '' as bigint) as n_errors, errors,
       '{' || case when n_calls is null then '' else '"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},' end
       || '"id":"call_' || conv_id || '_' || turn || '"' || case when n_calls is null then '' else ',"level":' || level || ',"name":"reply"' end
       || case when content is null then '' else ',"result":' || to_json(content) end
       || ',"status":"' || status || '","valid":' || case when errors = '' then 'true' else 'false' end || '}' as canonical
from j
"""
