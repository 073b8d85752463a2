"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

The nested field paths of a frame, sorted and hashed, are its fingerprint. A
mapping is registered under the fingerprint of the layout it reads, and says
with column expressions how that layout becomes rows (conv_id, turn, role,
text). Extra columns are no part of a layout: the mapping whose paths are all
there and that uses the most of them is chosen.

The template marks each turn ``<|im_start|>role<|im_sep|>text<|im_end|>``. What
looks like a control string inside a text gets a backslash behind its first
letter, one more than it had, so reading back can take exactly one away.

Cases: null text is empty, null role is empty; turns of one number are ordered
by role and text; rows without conv_id form one conversation; an empty table
gives no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import table

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that are never left as they are inside a text: our marks and those of common templates.
CONTROLS = (START, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = "|".join(sorted({re.escape(c[1:]).replace("/", r"/") for c in CONTROLS}))
#: A control string, or one that was escaped before: first letter, backslashes, rest.
ESCAPE = rf"([<\[])(\\*)({_TAILS})"
UNESCAPE = rf"([<\[])\\(\\*)({_TAILS})"


def field_paths(schema: T.DataType, top: str = "") -> set[str]:
    """All nested field paths; list elements are written ``[]``."""
    if isinstance(schema, T.StructType):
        return {p for f in schema.fields for p in field_paths(f.dataType, f"{top}.{f.name}" if top else f.name)}
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, top + "[]")
    return {top}


def fingerprint(paths: set[str]) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes canonical turns."""

    name: str
    paths: frozenset[str]
    turns: Callable[[DataFrame], DataFrame]


def _lists(id_: str, turns: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    """A mapping for rows that hold a whole conversation as a list of (role, text)."""

    def apply(frame: DataFrame) -> DataFrame:
        rows = frame.select(F.col(id_).alias("conv_id"), F.posexplode(turns()).alias("turn", "t"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))

    return apply


def _turn(role: str | Column, text: str | Column) -> Column:
    """A turn of a fixed role or one from a column, with the text of a column."""
    role = F.lit(role) if isinstance(role, str) else role
    text = F.col(text) if isinstance(text, str) else text
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _joined(*parts: str) -> Column:
    """Instruction and input, with a blank line between them if both say something."""
    return F.array_join(F.filter(F.array(*[F.col(p) for p in parts]), lambda x: F.length(x) > 0), "\n\n")


#: Other names that sources give to roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(column: Column) -> Column:
    known = F.lit(None).cast("string")
    for theirs, ours in ROLES.items():
        known = F.when(column == theirs, ours).otherwise(known)
    return F.coalesce(known, column)


MAPPINGS = {
    fingerprint(m.paths): m
    for m in (
        Mapping(
            "turn rows",
            frozenset({"conv_id", "turn", "role", "text"}),
            lambda f: f.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"),
        ),
        Mapping(
            "messages",
            frozenset({"conv_id", "messages[].role", "messages[].content"}),
            _lists("conv_id", lambda: F.transform("messages", lambda m: _turn(_role(m["role"]), m["content"]))),
        ),
        Mapping(
            "conversations",
            frozenset({"id", "conversations[].from", "conversations[].value"}),
            _lists("id", lambda: F.transform("conversations", lambda m: _turn(_role(m["from"]), m["value"]))),
        ),
        Mapping(
            "instruction",
            frozenset({"id", "instruction", "input", "output"}),
            _lists("id", lambda: F.array(_turn("user", _joined("instruction", "input")), _turn("assistant", "output"))),
        ),
        Mapping(
            "prompt",
            frozenset({"id", "prompt", "completion"}),
            _lists("id", lambda: F.array(_turn("user", "prompt"), _turn("assistant", "completion"))),
        ),
    )
}


def canonical_turns(frame: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a frame in any known layout."""
    paths = field_paths(frame.schema)
    known = MAPPINGS.get(fingerprint(paths))
    if known is None:
        fitting = [m for m in MAPPINGS.values() if m.paths <= paths]
        if not fitting:
            raise ValueError(f"no mapping reads the fields {sorted(paths)}")
        known = max(fitting, key=lambda m: (len(m.paths), m.name))
    return known.turns(frame)


def escape(text: Column) -> Column:
    """``text`` without control strings, reversibly."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def format_chat(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, and the loss mask.

    The mask is a list of (start, length) in code points over ``formatted``; it
    covers the escaped texts of the role ``learn``.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), escape(role), F.lit(MIDDLE))
    cut = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body")
    ).withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumns(
        {
            "number": F.row_number().over(order),
            "begin": F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)),
        }
    )
    span = F.when(
        F.col("role") == learn,
        F.struct((F.col("begin") + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length")),
    )
    listed = cut.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("number", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(span)).alias("loss_mask"),
    )
    return listed.select("conv_id", "n_turns", F.array_join("pieces.piece", "").alias("formatted"), "loss_mask")


_MARKED = re.compile(UNESCAPE)


def unescape(text: str) -> str:
    """What :func:`escape` got."""
    return _MARKED.sub(r"\1\2\3", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    pairs = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece.removeprefix(START).partition(MIDDLE)
        pairs.append((unescape(role), unescape(text)))
    return pairs


READ = T.StructType(
    [
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
    ]
)


def read_digests(formatted: pd.Series, mask: pd.Series) -> pd.DataFrame:
    """Digests of the turns and of the learned text, read from formatted conversations alone."""
    rows = []
    for text, spans in zip(formatted, mask, strict=True):
        said = hashlib.sha256()
        for role, words in read_turns(text):
            said.update(f"{role}\n{words}\n".encode())
        learned = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
        rows.append((said.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return pd.DataFrame(rows, columns=READ.names)


def read_back(formatted: str, mask: str) -> Column:
    """:func:`read_digests` as a column."""
    return F.pandas_udf(read_digests, READ)(formatted, mask)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = canonical_turns(table(spark, sf_dir, "conversations")).unionByName(canonical_turns(extra))
    made = format_chat(turns).withColumn("read", read_back("formatted", "loss_mask"))
    return made.select(
        "conv_id",
        "n_turns",
        "read.turns_sha256",
        "read.loss_chars",
        "read.loss_sha256",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_ESCAPE = ESCAPE.replace("'", "''")

OP1_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), parts AS (
  SELECT *, length('{START}{MIDDLE}{END}') + length(regexp_replace(role, '{_SQL_ESCAPE}', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '{_SQL_ESCAPE}', '\1\\\2\3', 'g')) AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id
"""
