"""Linking tool calls and results (operator 4), in DataFrame operations alone.

Calls and results are hash-joined by conversation and identifier.  Each call may
name a parent, the call whose result it uses; levels (0 for a call without
parent) order calls topologically and are found by pointer doubling, in a number
of rounds that grows with the logarithm of the longest chain.  Arguments are
parsed to variants, checked against the tool's schema, and written as canonical
JSON: keys sorted at every depth, no white space, one spelling for each value.

Numbers are spelled from their digits, never through floating point: no leading
or trailing zeros, no minus zero, plain up to 21 digits before the point and 6
zeros after it, else one digit before the point and an exponent.  So 1, 1.0, 1e0
and 100e-2 are all ``1``, and 1E400 is ``1e+400``.  To keep the digits, each
string of the text is marked s and each number becomes a string marked n before
the text is parsed; the marks go again when it has been written.

No step brings a conversation's rows together: identifiers are the only keys,
and repeated ones are aggregated first, so both sides of each hash join have a
row for each identifier and spread evenly.

Defined results: of repeated calls (or results) with one identifier the first by
position stands, ties by content, and their number is reported; an unanswered
call, or a result without call, is one row with its status; a call without
identifier is one row of status ``unidentified``, and so is a result; a parent
that doesn't exist is an error and the call counts as level 0; calls on a cycle,
or below one, have no level; arguments that are no JSON object are an error and
canonical_json has none (an object with a repeated key isn't one, nor is a number
whose exponent has more than nine digits); numbers of whole value are integers,
however they are spelled; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: What a marked variant's value looks like, by name of a JSON type: the type
#: that Spark names, and a pattern of the value where that is a string.
KINDS = {
    "integer": ("STRING", r"^n-?[0-9]+(\.[0-9]+)?(e\+[0-9]+)?$"),
    "number": ("STRING", "^n"),
    "string": ("STRING", "^s"),
    "boolean": ("BOOLEAN", ""),
    "array": ("ARRAY<", ""),
    "object": ("OBJECT<", ""),
    "null": ("VOID", ""),
}
#: Strings, numbers and what is between them, of a valid JSON text.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'

Schema = Mapping[str, tuple[str, bool]]


def canonical_number(token: Column) -> Column:
    """A JSON number's only spelling; null for an exponent out of bounds."""
    whole = F.regexp_extract(token, "^-?([0-9]+)", 1)
    part = F.regexp_extract(token, r"\.([0-9]+)", 1)
    power = F.regexp_extract(token, "[eE]([+-]?[0-9]+)$", 1)
    power = F.when(power == "", F.lit(0)).when(F.length(power) <= 10, F.try_to_number(power, F.lit("S9999999999")).cast("long"))
    lead = F.regexp_replace(F.concat(whole, part), "^0+", "")
    digits = F.regexp_replace(lead, "0+$", "")
    # the value is 0.lead * 10 ** point, and so is 0.digits * 10 ** point
    point = F.length(lead).cast("long") - F.length(part) + power
    many = F.length(digits).cast("long")
    at = point.cast("int")
    plain = (
        F.when(
            (point > 21) | (point < -5),
            F.concat(
                F.substring(digits, 1, 1),
                F.when(many > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
                F.lit("e"),
                F.when(point > 0, "+").otherwise(""),
                (point - 1).cast("string"),
            ),
        )
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), digits))
        .when(many <= point, F.rpad(digits, at, "0"))
        .otherwise(F.concat(F.substr(digits, F.lit(1), at), F.lit("."), F.substr(digits, at + 1)))
    )
    return F.when(digits == "", F.lit("0")).when(power.isNotNull(), F.concat(F.when(F.startswith(token, F.lit("-")), "-").otherwise(""), plain))


def marked(arguments: Column) -> Column:
    """A JSON text as a variant whose strings and keys begin with s, and whose
    numbers are strings that begin with n; null if it is no JSON."""

    def mark(token: Column) -> Column:
        return (
            F.when(F.startswith(token, F.lit('"')), F.concat(F.lit('"s'), F.substr(token, F.lit(2))))
            .when(F.regexp_like(token, F.lit("^-?[0-9]")), F.concat(F.lit('"n'), canonical_number(token), F.lit('"')))
            .otherwise(token)
        )

    tokens = F.transform(F.regexp_extract_all(arguments, F.lit(TOKEN), F.lit(0)), mark)
    whole = F.when(~F.exists(tokens, lambda t: t.isNull()), F.array_join(tokens, ""))
    return F.when(F.try_parse_json(arguments).isNotNull(), F.try_parse_json(whole))


def unmarked(text: Column) -> Column:
    """The JSON text of a marked variant: an opening quote, unlike one inside a
    string, is never after a backslash."""
    return F.regexp_replace(F.regexp_replace(text, r'(?<!\\)"n([^"]*)"', "$1"), r'(?<!\\)"s', '"')


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, known_parent) of calls with distinct
    identifiers and a parent_id."""
    ids = calls.select("conv_id", F.col("call_id").alias("_id"))
    start = calls.select("conv_id", "call_id", "parent_id").join(
        ids.withColumnRenamed("_id", "parent_id").withColumn("_known", F.lit(True)).hint("shuffle_hash"),
        ["conv_id", "parent_id"],
        "left",
    )
    state = materialise(
        start.select(
            "conv_id",
            "call_id",
            F.when(F.col("_known"), F.col("parent_id")).alias("up"),
            F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("level"),
            (F.col("parent_id").isNull() | F.coalesce("_known", F.lit(False))).alias("known_parent"),
        ),
        "levels-0",
    )
    bound = max(1, state.where("up IS NOT NULL").count())
    reach, number = 1, 0
    while reach <= 2 * bound and not (open_ := state.where("up IS NOT NULL")).isEmpty():
        there = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        moved = open_.join(there.hint("shuffle_hash"), ["conv_id", "up"]).select(
            "conv_id",
            "call_id",
            F.col("_up").alias("up"),
            (F.col("level") + F.col("_level")).alias("level"),
            "known_parent",
        )
        number += 1
        state = materialise(state.where("up IS NULL").unionByName(moved), f"levels-{number}")
        reach *= 2
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"), "known_parent")


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Schema]) -> Column:
    """Sorted array of what is wrong with a call's arguments (a marked variant)."""
    kinds = F.create_map(*[x for k, (v, p) in KINDS.items() for x in (F.lit(k), F.struct(F.lit(v).alias("type"), F.lit(p).alias("pattern")))])
    shape = "array<struct<field:string,kind:string,required:boolean>>"
    fields = {
        t: F.array(*[
            F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.lit(r).alias("required")) for f,
            (k, r) in sorted(s.items())
        ]).cast(shape) for t,
        s in schemas.items()
    }
    table = F.create_map(*[x for t, v in fields.items() for x in (F.lit(t), v)]).cast(f"map<string,{shape}>")
    own = F.try_element_at(table, name)
    values = F.try_variant_get(arguments, "$", "map<string,variant>")

    def check(f: Column) -> Column:
        value = F.try_element_at(values, F.concat(F.lit("s"), f["field"]))
        kind = F.element_at(kinds, f["kind"])
        string = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
        # no more digits after the point than its exponent takes
        whole = F.length(F.regexp_extract(string, r"\.([0-9]+)", 1)) <= F.coalesce(
            F.try_to_number(F.regexp_extract(string, r"e\+([0-9]+)$", 1), F.lit("9999999999")),
            F.lit(0),
        )
        fits = F.startswith(F.schema_of_variant(value), kind["type"]) & ((kind["pattern"] == "") | F.regexp_like(string, kind["pattern"])) & ((f["kind"] != "integer") | whole)
        return (
            F.when(value.isNull() & f["required"], F.concat(F.lit("missing "), f["field"]))
            .when(value.isNotNull() & ~F.coalesce(fits, F.lit(False)), F.concat(F.lit("not "), f["kind"], F.lit(": "), f["field"]))
        )

    stray = F.transform(
        F.array_except(F.transform(F.map_keys(values), lambda k: F.substr(k, F.lit(2))), F.transform(own, lambda f: f["field"])),
        lambda k: F.concat(F.lit("unexpected "), k),
    )
    errors = F.concat(F.filter(F.transform(own, check), lambda e: e.isNotNull()), stray)
    return (
        F.when(values.isNull(), F.array(F.lit("arguments are no object")))
        .when(own.isNull(), F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("")))))
        .otherwise(F.array_sort(errors))
    )


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Schema]) -> DataFrame:
    """calls: conv_id, call_id, position, name, arguments (JSON), parent_id;
    results: conv_id, call_id, position, content.  One row for each identifier
    of a conversation: conv_id, call_id, status, level, n_calls, n_results,
    valid, errors, canonical_json."""
    identified = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    call = F.struct("position", "name", "arguments", "parent_id")
    answer = F.struct("position", "content")
    own = materialise(
        calls.where(identified).groupBy("conv_id", "call_id").agg(F.min(call).alias("call"), F.count(F.lit(1)).alias("n_calls")),
        "calls",
    )
    answers = results.where(identified).groupBy("conv_id", "call_id").agg(F.min(answer).alias("answer"), F.count(F.lit(1)).alias("n_results"))
    ordered = levels(own.select("conv_id", "call_id", F.col("call.parent_id").alias("parent_id")))
    both = own.join(ordered.hint("shuffle_hash"), ["conv_id", "call_id"]).join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("answer").isNull(), "unanswered").otherwise("linked")
    linked = both.withColumn("status", status)
    nameless = F.lit("unidentified").alias("status")
    none = [F.lit(None).cast("long").alias("level"), F.lit(True).alias("known_parent")]
    loose = calls.where(~identified).select(
        "conv_id",
        "call_id",
        call.alias("call"),
        F.lit(1).cast("long").alias("n_calls"),
        *none,
        F.lit(None).cast(answers.schema["answer"].dataType).alias("answer"),
        F.lit(0).cast("long").alias("n_results"),
        nameless,
    )
    lost = results.where(~identified).select(
        "conv_id",
        "call_id",
        F.lit(None).cast(own.schema["call"].dataType).alias("call"),
        F.lit(0).cast("long").alias("n_calls"),
        *none,
        answer.alias("answer"),
        F.lit(1).cast("long").alias("n_results"),
        nameless,
    )
    rows = linked.select(*loose.columns).unionByName(loose).unionByName(lost)
    rows = rows.withColumn("_v", marked(F.col("call.arguments")))
    wrong = F.when(F.col("call").isNull(), F.array().cast("array<string>")).otherwise(
        F.concat(
            argument_errors(F.col("call.name"), F.col("_v"), schemas),
            F.when(~F.coalesce("known_parent", F.lit(True)), F.array(F.lit("unknown parent"))).otherwise(F.array().cast("array<string>")),
            F.when(
                F.col("level").isNull() & (F.col("status") != "unidentified"),
                F.array(F.lit("cyclic parents")),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    rows = rows.withColumn("errors", wrong)
    text = lambda c: F.concat(F.lit("s"), c)  # noqa: E731  a concatenation with null is null
    canonical = unmarked(
        F.to_json(
            F.struct(
                F.col("_v").alias("sarguments"),
                text(F.col("call_id")).alias("sid"),
                text(F.col("call.name")).alias("sname"),
                text(F.col("call.parent_id")).alias("sparent"),
                text(F.col("answer.content")).alias("sresult"),
            )
        )
    )
    return rows.select(
        "conv_id",
        "call_id",
        "status",
        "level",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        (F.col("call").isNotNull() & (F.size("errors") == 0)).alias("valid"),
        "errors",
        canonical.alias("canonical_json"),
    )


#: The tool that a user's turn is taken to call.
REPLY: Schema = {"n_chars": ("integer", True), "text": ("string", True), "turn": ("integer", True), "urgent": ("boolean", False)}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text): each
    user turn calls ``reply``, the next assistant turn answers it, and a call's
    parent is the user turn two turns before, if there is one.  As callers do,
    they spell one number in several ways (12, 12.0, 120e-1), and those with an
    exclamation mark say how urgent they are in words, where the schema has a
    boolean."""
    turn = F.col("turn").cast("long")
    name = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    asked = conversations.where("role = 'user'")
    size = F.length("text").cast("string")
    spelled = F.when(turn % 3 == 0, size).when(turn % 3 == 1, F.concat(size, F.lit(".0"))).otherwise(F.concat(size, F.lit("0e-1")))
    quoted = F.to_json(F.struct(F.col("text").alias("text")))
    said = F.concat(F.lit(","), F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.lit(', "n_chars" : '), spelled)
    urgent = F.when(F.contains("text", F.lit("!")), F.lit(',"urgent":"yes"'))
    arguments = F.concat(F.lit('{"turn":'), turn.cast("string"), F.coalesce(said, F.lit("")), F.coalesce(urgent, F.lit("")), F.lit("}"))
    calls = asked.select("conv_id", name(turn).alias("call_id"), turn.alias("position"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    before = asked.select("conv_id", (turn + 2).alias("position"), name(turn).alias("parent_id")).distinct()
    calls = calls.join(before, ["conv_id", "position"], "left")
    results = conversations.where("role = 'assistant'").select(
        "conv_id",
        name(turn - 1).alias("call_id"),
        turn.alias("position"),
        F.col("text").alias("content"),
    )
    return calls, results


ORACLE_SQL = """
WITH RECURSIVE
u AS (SELECT conv_id, turn, min({'t': coalesce(text, chr(1114111)), 'v': text}).v AS text, count(*) AS n FROM conversations
      WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
a AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n FROM conversations
      WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
lv AS (SELECT u.conv_id, u.turn, 0 AS level FROM u LEFT JOIN u p ON p.conv_id = u.conv_id AND p.turn = u.turn - 2 WHERE p.turn IS NULL
       UNION ALL SELECT u.conv_id, u.turn, lv.level + 1 FROM lv JOIN u ON u.conv_id = lv.conv_id AND u.turn = lv.turn + 2),
j AS (SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.turn) AS turn, u.turn IS NOT NULL AS called, u.text, lv.level, u.n AS nu, a.n AS na, a.content, a.turn IS NOT NULL AS answered
      FROM u JOIN lv USING (conv_id, turn) FULL JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn)
SELECT conv_id, 'turn-' || turn AS call_id,
       CASE WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status,
       level, coalesce(nu, 0) AS n_calls, coalesce(na, 0) AS n_results,
       called AND text IS NOT NULL AND NOT contains(text, '!') AS valid,
       CASE WHEN called AND text IS NULL THEN 'missing n_chars; missing text' WHEN called AND contains(text, '!') THEN 'not boolean: urgent' ELSE '' END AS errors,
       sha256('{' || CASE WHEN called THEN '"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"n_chars":' || length(text) || ',"text":' || to_json(text) || ',' END || '"turn":' || turn || CASE WHEN contains(text, '!') THEN ',"urgent":"yes"' ELSE '' END || '},' ELSE '' END
              || '"id":"turn-' || turn || '"' || CASE WHEN called THEN ',"name":"reply"' ELSE '' END
              || CASE WHEN level > 0 THEN ',"parent":"turn-' || (turn - 2) || '"' ELSE '' END
              || CASE WHEN content IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END || '}') AS canonical_sha256
FROM j
"""
