"""Chat formatting by prefix trees.

Conversations are sorted by the hashes of their turns, over the whole table by ranges, so that those that share
initial turns follow each other: this order is the depth-first order of their prefix tree. A pack is a stretch of
it with a bounded number of tokens: each node (a turn below its ancestors) is emitted once, with the positions that
its tokens have in their conversations and the intervals of the pack that they attend to, their ancestors' and
their own up to themselves. A first turn that a third of all conversations have is spread over ranges like any
other.

The template writes a turn as `### role: text</turn>` and a new line. In texts a backslash goes before every
backslash, before a # that two more follow, and before the < of </turn>; in roles before backslash, colon, #, <
and new line. So no mark can be in a text, and undoing it gives the text back.

Tokens are the UTF-8 bytes of the template, or those of a byte-level vocabulary file, whose path is a parameter.

Defined results: a null text is empty, a null role is the role null; turns with equal numbers are in the order of
role and text; a null conv_id is one conversation; repeated rows are repeated turns; other columns are ignored; an
empty table gives an empty table. A conversation longer than a pack has a pack of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import NULL_ID, column

PACK = 32_768
CLOSE = "</turn>\n"
_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
PACKS = (
    "tokens array<int>, positions array<int>, "
    "nodes array<struct<begin: int, end: int, parent: int, attend: array<struct<begin: int, end: int>>, loss: array<struct<begin: int, end: int>>>>, "
    "convs array<struct<conv_id: bigint, node: int>>"
)


def escape(text: str) -> str:
    return re.sub(r"\\|#(?=##)|<(?=/turn>)", r"\\\g<0>", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\:#<\n]", r"\\\g<0>", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation. Raises ValueError if it isn't one."""
    out, at = [], 0
    turn = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.S)
    while at < len(formatted):
        found = turn.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


class Coder:
    """Tokens of a string and back: bytes, or a vocabulary of base64 tokens and ranks with the pattern that splits texts."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        self.path = path
        if path:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.known.encode_ordinary(text) if self.path else list(text.encode())

    def decode(self, tokens: list[int]) -> str:
        return self.known.decode_bytes(tokens).decode() if self.path else bytes(tokens).decode()


def conversations_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns, path): turns in order, and their hashes."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("null")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    convs = rows.groupBy(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return convs.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))


class Pack:
    def __init__(self):
        self.tokens: list[int] = []
        self.positions: list[int] = []
        self.nodes: list[dict] = []
        self.convs: list[dict] = []
        self.kids: dict[tuple, int] = {}

    def add(self, conv_id: int, turns: list[tuple[str, str]], coder: Coder) -> None:
        at, depth, parent = -1, 0, -1
        for role, text in turns:
            at = self.kids.get((parent, role, text), -1)
            if at < 0:
                parts = [coder.encode(f"### {escape_role(role)}: "), coder.encode(escape(text)), coder.encode(CLOSE)]
                begin = len(self.tokens)
                for p in parts:
                    self.tokens += p
                end = len(self.tokens)
                self.positions += range(depth, depth + end - begin)
                seen = [dict(s) for s in self.nodes[parent]["attend"]] if parent >= 0 else []
                if seen and seen[-1]["end"] == begin:
                    seen[-1]["end"] = end
                else:
                    seen.append({"begin": begin, "end": end})
                loss = [{"begin": begin + len(parts[0]), "end": end - len(parts[2])}] if role == "assistant" else []
                at = len(self.nodes)
                self.nodes.append({"begin": begin, "end": end, "parent": parent, "attend": seen, "loss": loss})
                self.kids[parent, role, text] = at
            depth = self.positions[self.nodes[at]["end"] - 1] + 1
            parent = at
        self.convs.append({"conv_id": None if conv_id == NULL_ID else conv_id, "node": at})


_NODES = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("attend", pa.list_(_SPAN)), ("loss", pa.list_(_SPAN))]))
_CONVS = pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())]))


def format_chats(rows: DataFrame, pack: int = PACK, vocabulary: str | None = None, pattern: str | None = None, **columns: str) -> DataFrame:
    """Packs (PACKS) of all conversations; a row's nodes are in depth-first order, convs names each conversation's last node."""
    convs = conversations_of(rows, **columns)

    def run(batches):
        coder, own = Coder(vocabulary, pattern), Pack()

        def packed(p):
            return pa.RecordBatch.from_arrays(
                [pa.array([p.tokens], pa.list_(pa.int32())), pa.array([p.positions], pa.list_(pa.int32())), pa.array([p.nodes], _NODES), pa.array([p.convs], _CONVS)], ["tokens", "positions", "nodes", "convs"]
            )

        for batch in batches:
            for conv_id, turns in zip(column(batch, "conv_id").to_pylist(), column(batch, "turns").to_pylist(), strict=True):
                own.add(conv_id, [(t["role"], t["text"]) for t in turns], coder)
                if len(own.tokens) >= pack or len(own.convs) >= pack:
                    yield packed(own)
                    own = Pack()
        if own.convs:
            yield packed(own)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = convs.repartitionByRange(tasks, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.select("conv_id", "turns").mapInArrow(run, PACKS)


def read_back(packs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every conversation as the packs have it: (conv_id, turns, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    A conversation's tokens are those that its last node's last token attends to; their positions must be 0, 1, 2 and
    so on. The texts under the loss mask are unescaped one by one.
    """

    def run(batches):
        coder = Coder(vocabulary, pattern)
        for batch in batches:
            for j in range(batch.num_rows):
                tokens, positions = (column(batch, c)[j].values.to_numpy() for c in ("tokens", "positions"))
                nodes, out = column(batch, "nodes")[j].as_py(), []
                for conv in column(batch, "convs")[j].as_py():
                    path, at = [], conv["node"]
                    while at >= 0:
                        path.append(nodes[at])
                        at = nodes[at]["parent"]
                    spans = path[0]["attend"] if path else []
                    seen = np.concatenate([np.arange(s["begin"], s["end"]) for s in spans]) if spans else np.zeros(0, np.int64)
                    if (positions[seen] != np.arange(len(seen))).any():
                        raise ValueError("positions and intervals of a pack don't agree")
                    text = coder.decode(tokens[seen].tolist())
                    turns = parse(text)
                    learned = [unescape(coder.decode(tokens[s["begin"] : s["end"]].tolist())) for node in reversed(path) for s in node["loss"]]
                    loss = "".join(learned)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    out.append((conv["conv_id"], [{"role": r, "text": t} for r, t in turns], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
                kinds = [pa.int64(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = ["conv_id", "turns", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], names)

    return packs.mapInArrow(run, "conv_id long, turns array<struct<role: string, text: string>>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: op5's digests in DuckDB SQL, over the view conversations.
SQL = r"""
with told as (
  select conv_id, turn, coalesce(role, 'null') as role, coalesce(text, '') as text from conversations
  union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) as v(t, r)),
sized as (
  select *, length('### ') + length(role) + length(regexp_replace(role, '[^\\:#<\n]', '', 'g')) + length(': ') + length('</turn>') + 1
    + length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '</turn>'))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) as chars from told)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(length(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant')), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""
