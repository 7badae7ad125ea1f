"""Operator 13: conversations formatted as prefix trees, shared turns emitted once, depth first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.bpe import encoder, in_chunks
from siftwork.llm.common import checkpointed, small_batches, table

#: Bytes of new turns in one pack, about: a pack is a sequence of its own, which attention does not leave.
PACK_BYTES = 2**20
#: Bytes of a turn's digest.
DIGEST = 16
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Where a conversation ends; no turn has this place.
END = 2**31 - 1


def escaped(text: str) -> str:
    """A backslash before each backslash and each control string, so that none stands in a text bare."""
    return text.replace("\\", "\\\\").replace("### ", "\\### ").replace("</turn>", "\\</turn>")


def plain(text: str) -> str:
    """The text that was ``escaped``."""
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def turn_pieces(role: str, text: str) -> tuple[str, str, str]:
    """A formatted turn as its head, its text and its end."""
    return OPEN + escaped(role).replace(":", "\\:") + MIDDLE, escaped(text), CLOSE


def parse_turn(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _TURN.fullmatch(turn)
    if not found or not found[2].endswith(" "):
        raise ValueError(f"not a formatted turn: {turn[:80]!r}")
    return plain(found[1]), plain(found[2][:-1])


def _key(conv: Column) -> Column:
    """A key without null for each conversation, so that rows without an id are one conversation."""
    return F.coalesce(F.concat(F.lit("i"), conv.cast("string")), F.lit("n"))


def _lines(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    lines = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return lines.withColumns({"key": _key(F.col("conv")), "digest": F.substring(F.sha2(whole, 256), 1, 2 * DIGEST)})


def _placed(lines: DataFrame, pack_bytes: int) -> DataFrame:
    """Pack and place of each conversation, and how many initial turns it shares with the one before it in the pack.

    Conversations are sorted by the digests of their turns, which is the order of a depth-first walk through the tree of
    their prefixes: a conversation shares with all before it no more than with its neighbour. Only digests are moved here. Equal conversations are
    told apart by their keys, so a large group of copies is spread over ranges.
    """
    size = F.octet_length("text") + F.octet_length("role") + len(OPEN + MIDDLE + CLOSE)
    listed = lines.select("key", "conv", "turn", "digest", size.cast("long").alias("size")).groupBy("key").agg(
        F.min("conv").alias("conv"), F.array_sort(F.collect_list(F.struct("turn", "digest", "size"))).alias("t")
    )
    paths = listed.select(
        "key", "conv", F.unhex(F.array_join(F.transform("t", lambda x: x["digest"]), "")).alias("path"), F.transform("t", lambda x: x["size"]).alias("sizes")
    )
    conv_kind = paths.schema["conv"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = (TaskContext.get().partitionId() << 32) - 1
        before, used, at = b"", None, 0
        for batch in batches:
            packs, places, shares, counts = [], [], [], []
            for path, sizes in zip(batch.column("path").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                shared = _common(before, path) // DIGEST
                new = sum(sizes[shared:])
                if used is None or (used and used + new > pack_bytes):
                    pack, at, used, shared, new = pack + 1, 0, 0, 0, sum(sizes)
                packs.append(pack)
                places.append(at)
                shares.append(shared)
                counts.append(len(sizes))
                before, used, at = path, used + new, at + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("conv"), pa.array(packs, pa.int64()), pa.array(places, pa.int32()), pa.array(shares, pa.int32()), pa.array(counts, pa.int32())],
                ["key", "conv", "pack", "place", "shared", "n"],
            )

    ordered = paths.repartitionByRange("path", "key").sortWithinPartitions("path", "key").select("key", "conv", "path", "sizes")
    return checkpointed(ordered.mapInArrow(place, f"key string, conv {conv_kind}, pack long, place int, shared int, n int"))


def _common(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Walk:
    """The turns on the path from the root to where the walk through a pack's tree is now."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.positions: list[int] = []
        self.merged: list[list[int]] = []
        self.at = 0

    def back_to(self, depth: int) -> None:
        """Leave the turns below the first ``depth`` ones."""
        del self.spans[depth:], self.positions[depth:]
        self.merged = []
        for lo, hi in self.spans:
            self._join(lo, hi)

    def _join(self, lo: int, hi: int) -> None:
        if self.merged and self.merged[-1][1] == lo:
            self.merged[-1][1] = hi
        else:
            self.merged.append([lo, hi])

    def position(self) -> int:
        """The position id of the next id on the path."""
        return self.positions[-1] if self.positions else 0

    def intervals(self) -> list[dict]:
        return [{"start": lo, "end": hi} for lo, hi in self.merged if hi > lo]

    def emit(self, ids: int) -> None:
        self.positions.append(self.position() + ids)
        self.spans.append((self.at, self.at + ids))
        self._join(self.at, self.at + ids)
        self.at += ids


_FORMATTED = "pack long, place int, idx int, conv {kind}, depth int, start long, ids array<int>, position long, attends array<struct<start: bigint, end: bigint>>, loss_from int, loss_to int"


def format_chats(
    turns: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    learnt_role: str = "assistant", pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """All conversations as ids of a byte-level vocabulary, turns that conversations share at their beginning emitted once.

    A turn reads ``### role: text </turn>`` and a line end; a backslash stands before each backslash and control string in a text (and
    each colon in a role), so texts can be read back. Head, text and end of a turn are encoded each by itself.

    Conversations are sorted as a depth-first walk through the tree of their prefixes meets them and cut into packs of about ``pack_bytes``
    bytes of new turns. A pack is a sequence of its own: in it every distinct prefix is emitted once, and a
    turn that a pack begins with is emitted again if the one before had it. A conversation adds the turns that follow what it shares
    with its neighbour. One shuffle puts turns into their order in a conversation, another puts new ones into packs; no task holds
    more than the path it is on.

    One row for each emitted turn, in order of (``pack``, ``place``, ``idx``): ``conv``, ``depth`` (turns before it in its conversation), ``start`` (its first id's place in
    the pack), ``ids``, ``position`` (position id of its first id: ids before it in its conversation), ``attends`` (intervals of the pack that hold
    its ancestors, neighbours merged; its own ids see these and each other causally), and ``loss_from``, ``loss_to`` (ids of the turn under the loss mask: the
    text alone, where the role is ``learnt_role``; otherwise an empty range). One more row for each conversation, without ids, marks where it ends: ``depth`` is its number of turns, ``attends`` covers
    all its ids, ``idx`` is END.

    Rows of a conversation are sorted by turn, equal turns by a digest of role and text, null turns first; repeated rows are repeated turns. Rows without
    a conversation's id are one conversation. A null role or text counts as empty. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(turns.sparkSession)
    lines = _lines(turns, conv_col, turn_col, role_col, text_col)
    placed = _placed(lines, pack_bytes)
    order = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "digest")
    numbered = lines.withColumn("idx", F.row_number().over(order) - 1)
    where = placed.select(F.col("key").alias("of"), "pack", "place", "shared")
    new = numbered.join(where, F.col("key") == F.col("of")).where(F.col("idx") >= F.col("shared")).select(
        "pack", "place", "idx", "conv", "shared", "role", "text"
    )
    ends = placed.select("pack", "place", F.lit(END).alias("idx"), "conv", "shared", F.lit("").alias("role"), F.lit("").alias("text"))
    walked = new.union(ends).repartition("pack").sortWithinPartitions("pack", "place", "idx")
    kind = placed.schema["conv"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, walk, now, here = encoder(path, pattern), Walk(), None, None
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for lo, hi in in_chunks(texts):
                batch = whole.slice(lo, hi - lo)
                packs, places, idx, shared, roles = (batch.column(c).to_pylist() for c in ("pack", "place", "idx", "shared", "role"))
                pieces = [turn_pieces(r, t) if i != END else ("", "", "") for r, t, i in zip(roles, texts[lo:hi], idx, strict=True)]
                ids, counts = codec.encode([x for p in pieces for x in p])
                counts = counts.reshape(-1, 3)
                sizes = counts.sum(1).tolist()
                depth, start, position, attends, loss = [], [], [], [], []
                for i, size in enumerate(sizes):
                    if packs[i] != now:
                        walk, now, here = Walk(), packs[i], None
                    if places[i] != here:
                        walk.back_to(shared[i])
                        here = places[i]
                    depth.append(len(walk.spans))
                    start.append(walk.at)
                    position.append(walk.position())
                    attends.append(walk.intervals())
                    under = roles[i] == learnt_role and idx[i] != END
                    loss.append((int(counts[i, 0]), int(counts[i, 0] + counts[i, 1])) if under else (0, 0))
                    if idx[i] != END:
                        walk.emit(size)
                offsets = pa.array([0, *counts.sum(1).cumsum().tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("pack"), batch.column("place"), batch.column("idx"), batch.column("conv"), pa.array(depth, pa.int32()), pa.array(start, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(position, pa.int64()),
                        pa.array(attends, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([a for a, _ in loss], pa.int32()), pa.array([b for _, b in loss], pa.int32()),
                    ],
                    ["pack", "place", "idx", "conv", "depth", "start", "ids", "position", "attends", "loss_from", "loss_to"],
                )

    return walked.mapInArrow(build, _FORMATTED.format(kind=kind))


def read_back(formatted: DataFrame, path: str, pattern: str, walked: bool = False) -> DataFrame:
    """What each conversation says, read from the ids that ``format_chats`` emitted.

    Ids are decoded and parsed turn by turn along the walk; the state of a turn's digests goes on from its parent's, so shared
    turns are read once and no text is held. ``walked`` tells that the rows still are in the order in which ``format_chats`` gave them;
    otherwise packs are brought together and sorted first. Returns ``conv``, ``n_turns``, ``turns_sha256`` (role, line end, text, line
    end of each turn), ``loss_chars`` and ``loss_sha256`` (all text under the loss mask) and ``formatted_chars``.
    """
    rows = formatted if walked else formatted.repartition("pack").sortWithinPartitions("pack", "place", "idx")
    kind = formatted.schema["conv"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path, pattern).vocabulary
        now, stack = None, []
        for batch in batches:
            packs, idx, depth, lo, hi = (batch.column(c).to_pylist() for c in ("pack", "idx", "depth", "loss_from", "loss_to"))
            found, rows = [], []
            for i, listed in enumerate(batch.column("ids")):
                if packs[i] != now:
                    now, stack = packs[i], []
                del stack[depth[i] :]
                said, learnt, chars, total = stack[-1] if stack else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                if idx[i] == END:
                    rows.append(i)
                    found.append((depth[i], said.hexdigest(), chars, learnt.hexdigest(), total))
                    continue
                ids = listed.values.to_numpy()
                turn = vocabulary.decode(ids).decode()
                role, text = parse_turn(turn)
                said, learnt = said.copy(), learnt.copy()
                said.update(f"{role}\n{text}\n".encode())
                masked = plain(vocabulary.decode(ids[lo[i] : hi[i]]).decode())
                learnt.update(masked.encode())
                stack.append((said, learnt, chars + len(masked), total + len(turn)))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv").take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return rows.mapInArrow(read, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one numbered -7 whose texts are full of control strings."""
    turns = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for n, r in enumerate(("user", "assistant"))])
    probe = conversations.sparkSession.range(1).select(F.inline(turns))
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path, pattern = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    formatted = format_chats(with_probe(table(spark, sf_dir, "conversations")), path, pattern)
    return read_back(formatted, path, pattern, walked=True).withColumnRenamed("conv", "conv_id")


OP13_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped as (
  select *, replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') as r,
         replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') as t
  from said
), ordered as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
         coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '') as learnt,
         sum(4 + length(replace(r, ':', '\:')) + 2 + length(t) + 9) as formatted_chars
  from escaped group by conv_id
)
select conv_id, n_turns, turns_sha256, cast(length(learnt) as bigint) as loss_chars, sha256(learnt) as loss_sha256,
       cast(formatted_chars as bigint) as formatted_chars
from ordered
"""
