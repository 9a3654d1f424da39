"""Chat formatting: columnar byte assembly.

A conversation becomes one string. Each turn is `[INST]role[/INST]\\n`, its text and
`</s>\\n`; a control string inside a role or text gets a backslash after its first
character (one more for each there is), so a marker in the output is always a real one
and the text can be read back. Segment lengths give cumulative offsets; headers and
contents are copied into one preallocated Arrow buffer by numpy; escaping is one Arrow pass over a column.

Rows of a conversation need not be adjacent: they are dealt out by conv_id and sorted by
(turn, role, text), nulls first, which also fixes ties and repeated rows. A null role or
text counts as empty, a null conv_id is a conversation of its own, an empty table gives
no rows, other columns are ignored. One conversation is one output row and must fit a
worker; nothing else is held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import data_of, large, map_arrow, offsets_of, shuffle_partitions

CONTROL = r"/?INST\]|/?s>"
_ESCAPE = re.compile(rf"([\[<])(\\*)({CONTROL})")
_UNESCAPE = re.compile(rf"([\[<])\\(\\*)({CONTROL})")
#: What conversations are assembled at once, in bytes of text; a longer one comes alone.
ASSEMBLE_BYTES = 8 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=_ESCAPE.pattern, replacement=r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def assemble(headers: pa.Array, contents: pa.Array, footer: bytes) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """One buffer of header, content and footer for each turn; with each turn's start and content start."""
    parts = [(data_of(c), offsets_of(c)) for c in (headers, contents)]
    sizes = [np.diff(o) for _, o in parts]
    turn = sizes[0] + sizes[1] + len(footer)
    starts = np.concatenate([[0], np.cumsum(turn)]).astype(np.int64)
    buffer = pa.allocate_buffer(int(starts[-1]))
    out = np.frombuffer(buffer, dtype=np.uint8)
    at = starts[:-1]
    for (data, offsets), size in zip(parts, sizes, strict=True):
        source = data[offsets[0] : offsets[-1]]
        # scatter index: place in the output of each source byte
        out[np.arange(len(source)) + np.repeat(at - (offsets[:-1] - offsets[0]), size)] = source
        at = at + size
    out[(at[:, None] + np.arange(len(footer))).ravel()] = np.tile(np.frombuffer(footer, np.uint8), len(at))
    return buffer, starts, starts[:-1] + sizes[0]


def _formatted(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Output rows for a table of whole conversations, sorted."""
    conv = table.column("conv_id").combine_chunks()
    roles, texts = (large(table.column(c)) for c in ("role", "text"))
    said = lambda x: pa.scalar(x, pa.large_string())
    headers = pc.binary_join_element_wise(said("[INST]"), escaped(roles), said("[/INST]\n"), said(""))
    buffer, starts, content = assemble(headers, escaped(texts), b"</s>\n")
    ids = conv.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    valid = conv.is_valid().to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])])
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(ids))
    offsets = np.append(starts[first], starts[-1]).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), buffer])
    mine = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)
    conversation = np.cumsum(new) - 1
    begin = starts[first][conversation]
    spans = np.stack([content - begin, starts[1:] - 5 - begin], axis=1)[mine]
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(spans) + 1, dtype=np.int32) * 2), pa.array(spans.ravel()))
    counts = np.bincount(conversation[mine], minlength=len(first))
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pairs)
    yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), formatted.cast(pa.string()), loss], names=["conv_id", "formatted", "loss_spans"])


def _assemble_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.nbytes < ASSEMBLE_BYTES:
            continue
        conv = held.column("conv_id").combine_chunks()
        last, n = conv[-1].as_py(), held.num_rows
        ids = conv.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        cut = n - int(np.argmax(np.append((ids != (last if last is not None else -(2**63)))[::-1], True)))
        if cut:
            yield from _formatted(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from _formatted(held)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_spans: byte ranges of the assistants' texts in it."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").transform(map_arrow, _assemble_sorted, "conv_id long, formatted string, loss_spans array<array<long>>")


_TURN = re.compile(r"\[INST\](.*?)\[/INST\]\n(.*?)</s>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns, raw = read_back(text), text.encode()
            loss = [unescape(raw[a:b].decode()) for a, b in spans]
            row = (
                len(turns),
                hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                sum(map(len, loss)),
                hashlib.sha256("".join(loss).encode()).hexdigest(),
                len(text),
            )
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what can be read back from the formatted strings."""
    return formatted.transform(map_arrow, _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    from docloom.llm.common import table

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(format_conversations(rows))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
    sum(length(regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g')) + 19)::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
