"""Chat formatting: heterogeneous JSON records to canonical turns and one template, in DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template; fixed values.
TURN_START, TURN_END, CONTROL, ESCAPE = "<|im_start|>", "<|im_end|>", "<|", "\\"
TURNS_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How records of one schema become turns.

    ``samples`` are records in JSON that have the schema; ``turns`` is a Spark SQL expression over the variant ``v`` that
    gives array<struct<role,text>>. ``renamed`` says that the layout has names of its own for the roles.
    """

    name: str
    samples: tuple[str, ...]
    turns: str
    renamed: bool = False


def _messages(path: str, role: str, text: str) -> str:
    shape = f"array<struct<{role}:string,{text}:string>>"
    turns = f"transform(variant_get(v, '$.{path}', '{shape}'), m -> struct(m.{role} as role, coalesce(m.{text}, '') as text))"
    return f"coalesce({turns}, cast(array() as {TURNS_TYPE}))"


def _lists(path: str, role: str, text: str) -> tuple[str, ...]:
    return (f'{{"{path}":[{{"{role}":"","{text}":""}}]}}', f'{{"{path}":[]}}', f'{{"{path}":null}}')


def _pair(user: str, assistant: str) -> str:
    return (
        f"array(struct('user' as role, {user} as text), "
        f"struct('assistant' as role, coalesce(variant_get(v, '$.{assistant}', 'string'), '') as text))"
    )


def _text(path: str) -> str:
    return f"coalesce(variant_get(v, '$.{path}', 'string'), '')"


LAYOUTS = (
    Layout("messages", _lists("messages", "role", "content"), _messages("messages", "role", "content")),
    Layout("conversations", _lists("conversations", "from", "value"), _messages("conversations", "from", "value"), True),
    Layout("prompt_completion", ('{"prompt":"","completion":""}',), _pair(_text("prompt"), "completion")),
    Layout("prompt_response", ('{"prompt":"","response":""}',), _pair(_text("prompt"), "response")),
    Layout("question_answer", ('{"question":"","answer":""}',), _pair(_text("question"), "answer")),
    Layout("instruction", ('{"instruction":"","output":""}',), _pair(_text("instruction"), "output")),
    Layout(
        "instruction_input",
        ('{"instruction":"","input":"","output":""}',),
        _pair(f"rtrim('\\n', concat({_text('instruction')}, '\\n\\n', {_text('input')}))", "output"),
    ),
)

#: Names that other layouts give to the three roles; fixed values.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(variant: Column, known: tuple[str, ...] = ()) -> Column:
    """Sorted nested field paths of a record, array elements included, without the types of the leaves.

    The types go, so a null or a number in place of a string leaves the fingerprint as it is. Leaves that are not ``known``
    go too, where any are: a field that no layout has makes no difference.
    """
    described = F.schema_of_variant(variant)
    paths = F.regexp_replace(described, r": (?!OBJECT|ARRAY)[A-Z]+(\([0-9,]*\))?", ":")
    if known:
        other = rf"(?<=[<,])(?!(?:{'|'.join(known)}):)(?:`(?:[^`]|``)*`|[^`<>,:]+):(?=[,>])"
        paths = F.regexp_replace(F.replace(paths, F.lit(", "), F.lit(",")), other, "")
        paths = F.regexp_replace(paths, "(?<=<),+|,+(?=>)|,(?=,)", "")
    return paths


def fingerprint(variant: Column, known: tuple[str, ...] = ()) -> Column:
    return F.xxhash64(field_paths(variant, known))


def canonical_turns(records: DataFrame, id_col: str, payload_col: str, layouts=LAYOUTS) -> DataFrame:
    """(id_col, layout, turns): records in JSON mapped to turns by the layout whose fingerprint they share.

    Records that are null, are not JSON or fit no layout keep a null layout and null turns. A null role counts as empty,
    a null text as empty, a null or empty list of messages gives no turns. Fields of a simple type that no layout has
    are ignored. Roles are kept as they are, but for layouts with names of their own for them (``ROLE_NAMES``). Records
    repeated, or of equal id, are mapped each; an empty table gives an empty result; other columns are not read. A record
    is one row and must fit, several times over, in a task's memory: turns of tens of megabytes do in a few gigabytes.
    """
    spark = records.sparkSession
    known = tuple(sorted({name for x in layouts for sample in x.samples for name in re.findall(r'"(\w+)":', sample)}))
    prints = spark.range(1).select(
        *(F.array(*(fingerprint(F.try_parse_json(F.lit(s)), known) for s in x.samples)).alias(x.name) for x in layouts)
    ).first()
    parsed = records.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(payload_col)).alias("v")).withColumn(
        "print", fingerprint(F.col("v"), known)
    )
    name = turns = renamed = None
    for layout in layouts:
        here = F.col("print").isin(list(prints[layout.name]))
        name = F.when(here, layout.name) if name is None else name.when(here, layout.name)
        mapped = F.expr(layout.turns).cast(TURNS_TYPE)
        turns = F.when(here, mapped) if turns is None else turns.when(here, mapped)
        renamed = F.when(here, layout.renamed) if renamed is None else renamed.when(here, layout.renamed)
    roles = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    tidy = F.transform(
        "turns",
        lambda t: F.struct(
            F.coalesce(F.when(F.col("renamed"), roles[t["role"]]), t["role"], F.lit("")).alias("role"),
            F.coalesce(t["text"], F.lit("")).alias("text"),
        ),
    )
    return parsed.select("id", name.alias("layout"), turns.alias("turns"), renamed.alias("renamed")).select(
        F.col("id").alias(id_col), "layout", tidy.alias("turns")
    )


def escape(text: Column) -> Column:
    """Doubles backslashes and parts every ``<|`` with one, so no control string is left in a text."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit(CONTROL), F.lit(f"<{ESCAPE}|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"<{ESCAPE}|"), F.lit(CONTROL)), F.lit(ESCAPE * 2), F.lit(ESCAPE))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(f"{ESCAPE}n"))


def _unescape_role(role: Column) -> Column:
    """Sets doubled backslashes and parted openings aside as marks that no escaped role holds, then puts all back."""
    marked = F.replace(F.replace(role, F.lit(ESCAPE * 2), F.lit(f"{CONTROL}b")), F.lit(f"<{ESCAPE}|"), F.lit(f"{CONTROL}c"))
    lines = F.replace(marked, F.lit(f"{ESCAPE}n"), F.lit("\n"))
    return F.replace(F.replace(lines, F.lit(f"{CONTROL}b"), F.lit(ESCAPE)), F.lit(f"{CONTROL}c"), F.lit(CONTROL))


def format_turns(turns: DataFrame, id_col: str, assistant: str = "assistant") -> DataFrame:
    """(id_col, formatted, spans): each turn as ``<|im_start|>role\\ntext<|im_end|>\\n`` and the loss mask.

    ``spans`` lists start and length, in code points of ``formatted``, of the escaped assistant texts.
    Null turns give null; no turns give an empty string.
    """
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN_START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == assistant).alias("learn"),
        ),
    )
    tail = f"{TURN_END}\n"
    nothing = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>))")

    def step(acc: Column, p: Column) -> Column:
        start, length = acc["at"] + F.char_length(p["head"]), F.char_length(p["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct(
            (start + length + len(tail)).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return turns.withColumn("pieces", pieces).select(
        F.col(id_col),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("pieces", nothing, step)["spans"].alias("spans"),
    )


def read_back(formatted: DataFrame, id_col: str) -> DataFrame:
    """(id_col, formatted, turns, loss_text): turns and masked text recovered from the formatted string alone."""
    chunks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda c: F.char_length(c) > 0)
    turns = F.transform(
        chunks,
        lambda c: F.struct(
            _unescape_role(F.substring_index(c, "\n", 1)).alias("role"),
            unescape(_between(c)).alias("text"),
        ),
    )
    masked = F.transform(
        "spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return formatted.select(
        F.col(id_col), "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text")
    )


def _between(chunk: Column) -> Column:
    first = F.char_length(F.substring_index(chunk, "\n", 1)) + 2
    return F.substr(chunk, first, F.char_length(chunk) - first + 1 - len(TURN_END) - 1)


def gather_messages(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id_col, payload): one record in the ``messages`` layout per conversation from a table with a row per turn.

    Turns are ordered by turn, then role, then text; a null text counts as empty. A conversation is one output string, so
    its turns meet in one row.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("content"),
    )
    grouped = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return grouped.select(F.col("id").alias(id_col), F.to_json(F.struct(messages.alias("messages"))).alias("payload"))
