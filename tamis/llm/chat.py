"""Chat formatting from a declarative template, with a loss flag for every emitted segment.

A finite-state machine over roles checks the order of turns: MOVES[state] names the roles that may follow. The
template says what opens and closes a turn, which roles carry loss and which strings are control strings. Control
strings and the escape character inside texts and roles are escaped, so parse() gives back the very turns.

Cases: a null text is empty; a null role is the empty role. Turns sort by turn, then role, then text, nulls first;
repeated rows are repeated turns. Rows with a null conv_id form one conversation without a name. A conversation in an
order that the machine refuses is formatted all the same; its turns from the first bad one on aren't accepted. An empty
table gives no rows. A conversation's turns pass through one task in order, as its digests demand, but as a stream:
sorting may spill, and no more than a batch of turns is in memory.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.shared import partitions, read


@dataclass(frozen=True)
class Template:
    open: str = "### {role}: "
    close: str = " </turn>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    controls: tuple = ("###", "</turn>")
    escape: str = "\\"
    role_end: str = ":"
    moves: dict = field(default_factory=lambda: {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    final: frozenset = frozenset({"assistant"})

    def escaped(self, text: str, role: bool = False) -> str:
        """Marks every escape and every control string with the escape; a single leading escape undoes it."""
        for x in (self.escape, *self.controls, *([self.role_end] if role else [])):
            text = text.replace(x, self.escape + x)
        return text

    def unescaped(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}({'|'.join(map(re.escape, (self.escape, *self.controls, self.role_end)))})", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn as (text, loss) pieces; only the content of a loss role carries loss."""
        before, after = self.open.split("{role}")
        return [(before + self.escaped(role, True) + after, False), (self.escaped(text), role in self.loss_roles), (self.close, False)]


def parse(text: str, template: Template) -> list[tuple[str, str]]:
    """(role, text) of every turn of formatted text, unescaped. Control strings count where no escape stands before them."""
    before, after = template.open.split("{role}")
    plain = f"(?:{re.escape(template.escape)}.|[^{re.escape(template.escape)}])*?"
    turn = re.compile(f"{re.escape(before)}({plain}){re.escape(after)}({plain}){re.escape(template.close)}", re.S)
    out, at = [], 0
    while at < len(text):
        m = turn.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((template.unescaped(m[1]), template.unescaped(m[2])))
        at = m.end()
    return out


def format_chat(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text. One row a turn, each conversation's rows together and in order.

    Returns conv_id, place (0, 1, ...), role, formatted, segments (text, loss), accepted (the machine allows the turn
    after those before it) and complete (the conversation may end here). A conversation's text is what its rows hold
    one after another.
    """
    template = template or Template()
    turns = turns.select("conv_id", "turn", "role", "text").repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("accepted", pa.bool_()), ("complete", pa.bool_())])

    def run(batches):
        now, place, state = None, 0, "start"
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if now != (conv,):
                    now, place, state = (conv,), 0, "start"
                role = role or ""
                # After a refused turn nothing is accepted any more.
                state = role if role in template.moves.get(state, ()) else None
                parts = template.segments(role, text or "")
                rows.append({"conv_id": conv, "place": place, "role": role, "formatted": "".join(t for t, _ in parts), "segments": [{"text": t, "loss": x} for t, x in parts], "accepted": state is not None, "complete": state in template.final})
                place += 1
            yield pa.RecordBatch.from_pylist(rows, schema)

    return turns.mapInArrow(run, "conv_id long, place long, role string, formatted string, segments array<struct<text:string,loss:boolean>>, accepted boolean, complete boolean")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation: digests of what its formatted text and segments say, without a look at the turns.

    formatted: the rows of format_chat(), a conversation's together and in order. Only digests under way are held.
    """
    template = template or Template()
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def run(batches):
        now, whole = None, None

        def done():
            conv, n, turns, chars, loss, size, valid = whole
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, valid

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            rows = []
            for conv, text, parts, complete in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "segments", "complete"))):
                if now != (conv,):
                    if whole is not None:
                        rows.append(done())
                    now, whole = (conv,), [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                if "".join(p["text"] for p in parts) != text:
                    raise ValueError("segments and text differ")
                for role, said in parse(text, template):
                    whole[1] += 1
                    whole[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for p in parts:
                    if p["loss"]:
                        plain = template.unescaped(p["text"])
                        whole[3] += len(plain)
                        whole[4].update(plain.encode("utf-8", "surrogatepass"))
                whole[5] += len(text)
                whole[6] = complete
            if rows:
                yield table(rows)
        if whole is not None:
            yield table([done()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(turns.union(extra)))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS escaped,
    length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) AS role_chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + role_chars + 2 + escaped + 9) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM sized GROUP BY conv_id"""
