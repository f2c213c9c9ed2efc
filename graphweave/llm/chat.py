"""Chat formatting: typed content parts, a template with escapes, and its reader.

Conversations are formatted turn by turn, so a conversation of any length is a
stream of segments; joined in order they are the formatted text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.  Inside texts each gets a backslash before it; so does a backslash.
OPEN, CLOSE, HEAD = "<turn>", "</turn>", "### "
_CONTROL = re.compile(r"\\|</?turn>|### |<\|(?:image|audio|document)\|>")
_ESCAPED = re.compile(r"\\(\\|</?turn>|### |<\|(?:image|audio|document)\|>)")
_ESCAPED_ROLE = re.compile(_ESCAPED.pattern.replace("(", "(n|", 1))
_MARK = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    """As escape(), on one line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


# ---------------------------------------------------------------- parts


@dataclass
class Flat:
    """What a visitor has made of the parts of one turn."""

    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded: int = 0


class PartVisitor:
    """Flattens typed parts in order: text is escaped, every other kind becomes a placeholder and an attachment.

    A placeholder stands for as many tokens as its part needs: an image one per
    14 x 14 patch of its size (256 if unknown), audio 25 a second (at least 1),
    a document 500 a page (at least 1 page).  Unknown kinds are text.
    """

    def __init__(self):
        self.out = Flat()

    def visit(self, part: dict) -> None:
        getattr(self, "visit_" + (part.get("type") or "text"), self.visit_text)(part)

    def visit_text(self, part):
        self.out.text.append(escape(part.get("text") or ""))

    def _attach(self, kind, part, tokens):
        self.out.attachments.append({"position": len(self.out.attachments), "kind": kind, "ref": part.get("ref") or "", "tokens": int(tokens)})
        self.out.expanded += int(tokens)
        self.out.text.append(_MARK[kind])

    def visit_image(self, part):
        w, h = part.get("width") or 0, part.get("height") or 0
        self._attach("image", part, -(-w // 14) * -(-h // 14) if w > 0 and h > 0 else 256)

    def visit_audio(self, part):
        self._attach("audio", part, max(1, round(25 * (part.get("seconds") or 0))))

    def visit_document(self, part):
        self._attach("document", part, 500 * max(1, part.get("pages") or 0))


def flatten(parts: list[dict] | None) -> Flat:
    visitor = PartVisitor()
    for part in parts or []:
        visitor.visit(part or {})
    return visitor.out


PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def text_parts(col):
    """A text column as a list of one text part; null text is empty."""
    null = lambda kind: F.lit(None).cast(kind)
    one = F.struct(F.lit("text").alias("type"), F.coalesce(col, F.lit("")).alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))
    return F.array(one)


# ---------------------------------------------------------------- the template


def segment(role: str, body: str) -> str:
    """One turn: the head line with its escaped role, the body, the end mark."""
    return f"{OPEN}{HEAD}{escape_role(role)}:\n{body}{CLOSE}\n"


class Reader:
    """Reads formatted text back, in pieces of any size: (role, text as unescaped) of every closed turn."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str):
        self.rest += piece
        while True:
            end = self._close(self.rest)
            if end is None:
                return
            turn, self.rest = self.rest[:end].removeprefix("\n"), self.rest[end + len(CLOSE) :]
            head, _, body = turn.partition("\n")
            if not head.startswith(OPEN + HEAD) or not head.endswith(":"):
                raise ValueError("not a turn")
            yield unescape_role(head[len(OPEN + HEAD) : -1]), unescape(body)

    @staticmethod
    def _close(text: str) -> int | None:
        """Where the first end mark without a backslash of its own stands."""
        at = 0
        while (at := text.find(CLOSE, at)) >= 0:
            slashes = at
            while slashes and text[slashes - 1] == "\\":
                slashes -= 1
            if (at - slashes) % 2 == 0:
                return at
            at += 1
        return None


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """(conv_id, turn, role, segment, loss_from, loss_to, attachments, expanded_tokens), a row per turn.

    ``loss_from`` and ``loss_to`` bound the text under the loss mask, in code
    points of the segment: the body of assistant turns, nothing of others.  A null
    role is an empty one, a null text an empty text; rows with one conversation
    and turn are turns of their own.  A text is never split.
    """
    parts = F.col(parts_col) if parts_col else text_parts(F.col(text_col))
    given = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist()):
                flat = flatten(parts)
                body = "".join(flat.text)
                made = segment(role, body)
                start = len(made) - len(body) - len(CLOSE) - 1
                for x, y in zip(out, (made, start if role == "assistant" else 0, start + len(body) if role == "assistant" else 0, flat.attachments, flat.expanded)):
                    x.append(y)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])), pa.int64()]
            cols = [batch.column("conv_id"), batch.column("turn"), batch.column("role"), *[pa.array(x, k) for x, k in zip(out, kinds)]]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn", "role", "segment", "loss_from", "loss_to", "attachments", "expanded_tokens"])

    schema = "conv_id long, turn long, role string, segment string, loss_from long, loss_to long, attachments array<struct<position:int,kind:string,ref:string,tokens:bigint>>, expanded_tokens long"
    return given.mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, expanded_tokens), read back from segments.

    A conversation's segments come sorted by turn, then segment (ties), and are
    read as a stream: a task holds one turn at a time, however long a
    conversation is.  Turns without a number come first; rows without conv_id are
    one conversation.
    """
    kept = turns.select("conv_id", "turn", "segment", "loss_from", "loss_to", "expanded_tokens")
    rows = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")

    def run(batches):
        state = None

        def fresh(conv):
            return {"conv": conv, "reader": Reader(), "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "tokens": 0}

        def row(s):
            if s["reader"].rest not in ("", "\n"):
                raise ValueError("a turn is not closed")
            return (s["conv"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"], s["tokens"])

        def made(out):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            out = []
            for conv, _, piece, a, z, tokens in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or state["conv"] != conv:
                    if state:
                        out.append(row(state))
                    state = fresh(conv)
                for role, text in state["reader"].feed(piece):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                masked = unescape(piece[a:z])
                state["loss"].update(masked.encode())
                state["chars"] += len(masked)
                state["all"] += len(piece)
                state["tokens"] += tokens
            if out:
                yield made(out)
        if state:
            yield made([row(state)])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"
    return rows.mapInArrow(run, schema)


def assemble(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole formatted texts, for conversations that fit in a row."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "segment")))
    return turns.groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda x: x.segment)).alias("formatted"))
