"""Tool calls linked with their results, ordered, validated and serialised; DataFrame functions only.

Calls and results are joined on (conversation, call id) by an equi-join. A call may depend on calls of its
conversation; ``level`` is the length of its longest chain of dependencies, so the order by (level,
turn, call id) is topological. Levels are found round by round over the calls still open; calls on or
behind a cycle have none. Arguments are checked against the tool's schema: an object, all required
names, no unknown names, the JSON type of each. JSON is canonical: no white space, names of objects sorted
at every depth, numbers as Spark's variant type writes them.

Nulls: a call or result without conversation or id links with nothing and keeps a row of its own (unlinked). Null or broken arguments are an error of the
call, not of the run. Repeated calls of an id count as one, the first by turn and arguments, and ``n_calls`` tells how many;
of repeated results the first by turn is linked. A dependency that is no call of the conversation is an error and
does not delay the call. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import words
from panelloom.session import checkpointed

KEY = ("conv_id", "call_id")
#: Levels that are kept apart before they are written together.
APART = 16


def json_type(value: Column) -> Column:
    """The JSON type of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("null")
    )


def argument_errors(arguments: Column, types: Column, required: Column) -> Column:
    """The errors of parsed ``arguments`` (a variant) against ``types`` (name to JSON type) and ``required`` names, in order of names."""
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    fields = F.when(is_object, F.try_variant_get(arguments, "$", "map<string,variant>"))
    entries = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("name"), json_type(e["value"]).alias("kind"))))

    def wrong(e: Column) -> Column:
        wanted = F.try_element_at(types, e["name"])
        fits = (e["kind"] == wanted) | ((wanted == "number") & (e["kind"] == "integer"))
        return F.when(wanted.isNull(), F.concat(F.lit("unknown argument "), e["name"])).when(~fits, F.concat(F.lit("wrong type "), e["name"]))

    names = F.transform(entries, lambda e: e["name"])
    missing = F.transform(F.array_sort(F.array_except(required, names)), lambda r: F.concat(F.lit("missing argument "), r))
    found = F.concat(missing, F.filter(F.transform(entries, wrong), lambda x: x.isNotNull()))
    return F.when(types.isNull(), F.array(F.lit("unknown tool"))).when(~is_object, F.array(F.lit("arguments are no object"))).otherwise(found)


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``level`` for calls with ``depends_on``; calls on or behind a cycle are left out."""
    nodes = calls.select(*KEY)
    edges = calls.select(*KEY, F.explode("depends_on").alias("dep")).distinct()
    real = edges.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi")
    open_ = checkpointed(real)
    done = nodes.join(open_, list(KEY), "left_anti").withColumn("level", F.lit(0))
    parts, now = [checkpointed(done)], 0
    last = parts[0]
    left = open_.count()
    while left:
        settled = last.select("conv_id", F.col("call_id").alias("dep"))
        rest = checkpointed(open_.join(settled, ["conv_id", "dep"], "left_anti"))
        remaining = rest.count()
        if remaining == left:
            break  # a cycle
        now += 1
        last = checkpointed(open_.select(*KEY).distinct().join(rest.select(*KEY), list(KEY), "left_anti").withColumn("level", F.lit(now)))
        parts.append(last)
        if len(parts) > APART:
            parts = [checkpointed(functools.reduce(DataFrame.unionByName, parts))]
        open_, left = rest, remaining
    return functools.reduce(DataFrame.unionByName, parts)


def quoted(name: str) -> Column:
    """A column of texts as canonical JSON strings."""
    whole = F.to_json(F.to_variant_object(F.struct(F.col(name).alias("x"))))
    return F.coalesce(whole.substr(F.lit(6), F.length(whole) - 6), F.lit("null"))


def link_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per call, and per result without a call. Calls and results without conversation or id have a row each.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids). ``results``: conv_id,
    turn, call_id, content. ``tools``: name, types (map), required (array). Columns: conv_id, call_id, turn, name,
    n_calls, level, errors, valid, result_turn, n_results, status (answered, unanswered, orphan, unlinked), json.
    """
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    whole = calls.filter(keyed)
    fields = [*KEY, "turn", "arguments", "name", "depends_on"]
    first = F.min(F.struct("turn", "arguments", "name", "depends_on"))
    one = whole.groupBy(*KEY).agg(first.alias("c"), F.count("*").alias("n_calls")).select(*KEY, "c.*", "n_calls")
    one = one.unionByName(calls.filter(~keyed).select(*fields, F.lit(1).cast("long").alias("n_calls")))
    one = checkpointed(one.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>"))))
    answers = (
        results.filter(keyed)
        .groupBy(*KEY)
        .agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
        .select(*KEY, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    )
    loose = results.filter(~keyed).select(*KEY, F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("n_results"))
    answers = answers.unionByName(loose)
    kinds = tools.groupBy("name").agg(F.any_value("types").alias("types"), F.any_value("required").alias("required"))
    parsed = F.try_parse_json("arguments")
    checked = one.join(kinds, "name", "left").withColumn("parsed", parsed)
    checked = checked.withColumn("errors", argument_errors(F.col("parsed"), F.col("types"), F.coalesce("required", F.array().cast("array<string>"))))
    known = one.select("conv_id", F.col("call_id").alias("dep"))
    lost = one.filter(keyed).select(*KEY, F.explode("depends_on").alias("dep")).distinct().join(known, ["conv_id", "dep"], "left_anti")
    lost = lost.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.concat(F.lit("unknown dependency "), "dep"))).alias("lost"))
    leveled = checked.join(levels(one.filter(keyed)), list(KEY), "left").join(lost, list(KEY), "left")
    cycle = F.when(F.col("level").isNull() & keyed, F.array(F.lit("cyclic dependency"))).otherwise(F.array().cast("array<string>"))
    leveled = leveled.withColumn("errors", F.concat("errors", F.coalesce("lost", F.array().cast("array<string>")), cycle))
    both = leveled.join(answers, list(KEY), "full")
    status = F.when(~keyed, "unlinked").when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("answered")
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), F.lit("null")),
        F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"result":'), quoted("content"), F.lit("}"),
    )
    return both.select(
        *KEY, "turn", "name", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), "level", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
        (F.col("n_calls").isNotNull() & (F.size("errors") == 0)).alias("valid"), "result_turn", F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"), json.alias("json"),
    )


#: The tools that conversations without calls of their own are taken to use.
TOOLS = (
    ("search", {"query": "string", "top_k": "integer"}, ("query",)),
    ("summarise", {"text": "string", "ratio": "number", "keep_names": "boolean"}, ("text", "ratio")),
    ("schedule", {"title": "string", "minutes": "integer", "with": "array", "notes": "string"}, ("title", "minutes")),
)


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from plain conversations: every assistant turn calls a tool, the next user turn is its result.

    Tool and arguments follow the turn's words, and the arguments hold the whole text; every second call builds on the turn two before it.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn("w", words(F.col("text"))).withColumn("n", F.size("w").cast("long"))
    ident = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    text = F.coalesce("text", F.lit(""))
    opening = F.concat_ws(" ", F.slice("w", 1, 6))
    search = F.to_json(F.struct((F.col("n") % 10 + 1).alias("top_k"), text.alias("query")))
    summary = F.to_json(F.struct(text.alias("text"), (F.col("n") % 2 == 1).alias("keep_names"), ((F.col("n") % 8) / 8.0).alias("ratio")))
    late = F.to_json(F.struct(opening.alias("title"), F.when(F.col("n") % 11 != 0, F.col("n") % 60).alias("minutes"), F.slice("w", 7, 2).alias("with"), text.alias("notes")))
    kind = F.col("n") % 3
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", ident(F.col("turn")).alias("call_id"),
        F.when(kind == 0, "search").when(kind == 1, "summarise").otherwise("schedule").alias("name"),
        F.when(kind == 0, search).when(kind == 1, summary).otherwise(late).alias("arguments"),
        F.when((F.col("n") % 2 == 0) & (F.col("turn") >= 2), F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = turns.filter("role = 'user' AND turn > 0").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def messages_of_turns(conversations: DataFrame) -> DataFrame:
    """The turns that are neither calls nor results (of the system, opening ones, of unknown roles), with the columns of :func:`link_calls`."""
    taken = (F.col("role") == "assistant") | ((F.col("role") == "user") & (F.col("turn") > 0))
    rest = conversations.select("conv_id", "turn", "role", "text").filter(~F.coalesce(taken, F.lit(False)))
    none = F.array().cast("array<string>")
    json = F.concat(F.lit('{"content":'), quoted("text"), F.lit(',"role":'), quoted("role"), F.lit("}"))
    return rest.select(
        "conv_id", F.lit(None).cast("string").alias("call_id"), "turn", F.col("role").alias("name"), F.lit(0).cast("long").alias("n_calls"), F.lit(None).cast("int").alias("level"), none.alias("errors"),
        F.lit(True).alias("valid"), F.lit(None).cast("long").alias("result_turn"), F.lit(0).cast("long").alias("n_results"), F.lit("message").alias("status"), json.alias("json"),
    )


def link_conversations(conversations: DataFrame) -> DataFrame:
    """Calls and results of plain conversations, linked, and all other turns as rows with status ``message``: every turn's text is in the JSON."""
    calls, results = calls_of_turns(conversations)
    tools = conversations.sparkSession.createDataFrame([(n, t, list(r)) for n, t, r in TOOLS], "name string, types map<string,string>, required array<string>")
    linked = link_calls(calls, results, tools)
    return linked.unionByName(messages_of_turns(conversations))
