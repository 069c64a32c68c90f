"""Chat formatting: roles of the turns of a transcript by a hidden Markov model, and canonical turns.

A row's text is cut into segments at lines that begin with a known speaker marker (User:, <|assistant|>, [SYSTEM], Q: ...);
a text without one is a segment. Each segment is observed by its marker and line features (length, number of lines, a
question mark at the end); hidden are the roles. Counts over all conversations with known roles give emissions and
transitions (those of held-out conversations, whose crc32 of the id is 0 modulo 5, are left out); pseudo-counts stand for
what a marker means until the data say more. Viterbi gives the likeliest roles, and each segment is rendered without its marker.

A conversation may be of any size. Segments are sorted by conversation, turn and place over all partitions and cut into
chunks of at most CHUNK segments of one conversation. A chunk becomes the matrix of the best scores from any role before
it to any role at its end; Viterbi over a conversation's matrices fixes the roles at the chunks' ends; and between those
each chunk is decoded by itself. Only the matrices of a conversation, one for each CHUNK segments, meet in a task.

Defined results: a null text counts as empty and is one empty segment. A null conv_id is a conversation of its own. Null
turns come last; equal turns are ordered by a hash of text and role, so the order doesn't depend on how rows are read;
repeated rows are turns like others. A role outside ROLES isn't learned from. Ties go to the role first in ROLES. Markup of
the canonical form that stands in a text is broken up by a space. An empty table gives an empty result. A text may be of
any length. Only the four named columns are read; others, whatever their names, don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import bounded_batches, materialize, quoted

ROLES = ("system", "user", "assistant")
CHUNK = 4096
MARKED = 60.0
# Words that name a speaker, by role.
SPEAKERS = {"system": "system sys instruction instructions", "user": "user human customer client question q prompter me", "assistant": "assistant ai bot agent model answer a gpt support chatbot"}
_BY_WORD = {w: k + 1 for k, r in enumerate(ROLES) for w in SPEAKERS[r].split()}
_WORD = "|".join(sorted(_BY_WORD, key=len, reverse=True))
_MARKER = re.compile(rf"^[ \t]*(?:<\|(?:im_start\|>)?\s*({_WORD})\s*(?:\|>|\n)|\[\s*({_WORD})\s*\]:?|(?:#+\s*|\*\*|>\s*)?({_WORD})(?:\s+\d+)?\s*(?:\*\*)?\s*:(?:\*\*)?)[ \t]*", re.I | re.M)
#: Observations and how many values each takes.
OBSERVED = {"marker": 4, "length": 12, "lines": 6, "asks": 2}


def segments(text: str | None) -> list[tuple[int, str]]:
    """(marker, text) of each segment; marker 0: none, else 1 + the role's place in ROLES."""
    t = text or ""
    found = list(_MARKER.finditer(t))
    if not found:
        return [(0, t)]
    out = []
    if t[: found[0].start()].strip():
        out.append((0, t[: found[0].start()]))
    for m, end in zip(found, [*(x.start() for x in found[1:]), len(t)], strict=True):
        word = next(g for g in m.groups() if g)
        out.append((_BY_WORD[word.lower()], t[m.end() : end]))
    return out


def observed(marker: int, text: str) -> tuple[int, int, int, int]:
    t = text.strip()
    return marker, min(11, (len(t) + 1).bit_length()), min(5, t.count("\n")), int(t.endswith(("?", "？")))


def rendered(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip().replace('<|', '< |')}\n<|end|>\n"


_NAMES = ["conv_id", "turn", "place", "segment", "role", "marker", "length", "lines", "asks", "text"]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            part = whole.slice(at, 1024)
            from_, rows = [], []
            for i, text in enumerate(part.column(4).to_pylist()):
                for k, (marker, t) in enumerate(segments(text)):
                    from_.append(i)
                    rows.append((k, *observed(marker, t), t))
            take = pa.array(from_, pa.int64())
            k, marker, length, lines, asks, text = zip(*rows, strict=True) if rows else [()] * 6
            arrays = [part.column(c).take(take) for c in range(3)] + [pa.array(k, pa.int32()), part.column(3).take(take)] + [pa.array(c, pa.int32()) for c in (marker, length, lines, asks)] + [pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the chunk, the place in it, and the role before (of the same conversation, in this partition)."""
    k, seq, conv, last, began = 0, 0, None, None, False
    for batch in batches:
        chunk, place, prior, first = [], [], [], []
        for c, role in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
            same = began and c == conv
            if began and (not same or seq == CHUNK):
                k, seq = k + 1, 0
            chunk.append(k)
            place.append(seq)
            prior.append(last if same else None)
            first.append(not same)
            seq, conv, last, began = seq + 1, c, role, True
        arrays = [*batch.columns, pa.array(chunk, pa.int64()), pa.array(place, pa.int64()), pa.array(prior, pa.string()), pa.array(first, pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "chunk", "seq", "prior", "first"])


def ordered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """All segments in order, with their chunks, written to the shared folder."""
    given = turns[quoted(role)].cast("string") if role in turns.columns else F.lit(None).cast("string")
    named = turns.select(turns[quoted(conv_id)].alias("conv_id"), turns[quoted(turn)].alias("turn"), F.xxhash64(turns[quoted(text)].cast("string"), given).alias("place"), given.alias("role"), turns[quoted(text)].cast("string").alias("text"))
    kind = {f.name: f.dataType.simpleString() for f in named.schema}
    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, place long, segment int, role string, marker int, length int, lines int, asks int, text string"
    cut = named.mapInArrow(_cut, schema)
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("place"), F.col("segment")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cut.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    chunked = sorted_.mapInArrow(_chunked, schema + ", chunk long, seq long, prior string, first boolean")
    return materialize(chunked.withColumn("part", F.spark_partition_id()))


def fit(rows: DataFrame) -> dict:
    """Log probabilities: start, step and one emission table for each observation. From counts over all rows."""
    seen = rows.filter(F.col("role").isin(*ROLES) & (F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(1)) % 5 != 0))
    place = {r: k for k, r in enumerate(ROLES)}
    emit = {o: np.full((len(ROLES), n), 0.5) for o, n in OBSERVED.items()}
    for k in range(len(ROLES)):
        emit["marker"][k, 0] = MARKED
        emit["marker"][k, k + 1] = MARKED
    counts = seen.groupBy("role", *OBSERVED).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 * 576 rows
    for r in counts:
        for o in OBSERVED:
            emit[o][place[r["role"]], min(r[o], OBSERVED[o] - 1)] += r["n"]
    step, start = np.full((len(ROLES), len(ROLES)), 0.5), np.full(len(ROLES), 0.5)
    pairs = seen.filter("first OR prior IS NOT NULL").groupBy("first", "prior", "role").agg(F.count(F.lit(1)).alias("n")).collect()  # a few rows
    for r in pairs:
        if r["first"]:
            start[place[r["role"]]] += r["n"]
        elif r["prior"] in place:
            step[place[r["prior"]], place[r["role"]]] += r["n"]
    # conversations that go on over a partition's edge were counted as begun there: a row or two for each partition tell
    edge = rows.groupBy("part").agg(F.min(F.struct("chunk", "seq", "conv_id", "role")).alias("low"), F.max(F.struct("chunk", "seq", "conv_id", "role")).alias("high"))
    edge = edge.withColumn("learn", F.coalesce(F.crc32(F.col("low.conv_id").cast("string").cast("binary")), F.lit(1)) % 5 != 0)
    last = None
    for r in sorted(edge.collect()):
        if last is not None and last["conv_id"] == r["low"]["conv_id"] and r["learn"] and r["low"]["role"] in place:
            start[place[r["low"]["role"]]] -= 1
            if last["role"] in place:
                step[place[last["role"]], place[r["low"]["role"]]] += 1
        last = r["high"]
    log = lambda m: np.log(m / m.sum(axis=-1, keepdims=True))
    return {"start": log(start), "step": log(step), "emit": {o: log(emit[o]) for o in OBSERVED}}


def emissions(model: dict, codes: np.ndarray) -> np.ndarray:
    """codes: a row of observations for each segment."""
    return sum(model["emit"][o][:, codes[:, i]].T for i, o in enumerate(OBSERVED))


def chunk_matrix(model: dict, e: np.ndarray, first: bool) -> np.ndarray:
    """Best scores from a role before the chunk (row; row 0 if the conversation starts here) to a role at its end."""
    n = len(ROLES)
    if first:
        m = np.full((n, n), -np.inf)
        m[0] = model["start"] + e[0]
    else:
        m = model["step"] + e[0]
    for row in e[1:]:
        m = (m[:, :, None] + model["step"][None]).max(axis=1) + row
    return m


def decode(model: dict, e: np.ndarray, before: int, end: int) -> list[int]:
    """Roles of a chunk, given those before it (-1: the conversation starts here) and at its end (-1: free)."""
    score = (model["start"] if before < 0 else model["step"][before]) + e[0]
    back = []
    for row in e[1:]:
        way = score[:, None] + model["step"]
        back.append(way.argmax(axis=0))
        score = way.max(axis=0) + row
    at = int(score.argmax()) if end < 0 else end
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def _chunks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def recover(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, segment, role (recovered), given (the role in the table, null if there is none) and rendered."""
    spark = turns.sparkSession
    bounded_batches(spark)
    rows = ordered(turns, conv_id, turn, role, text)
    shared = spark.sparkContext.broadcast(fit(rows))  # some dozen numbers
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    codes = list(OBSERVED)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.float64()))], names=["part", "chunk", "m"])

        for (part, chunk), held in _chunks(batches, 2):
            e = emissions(model, np.array([h[1:] for h in held]))
            out.append((part, chunk, [*chunk_matrix(model, e, False).ravel().tolist(), *chunk_matrix(model, e, True)[0].tolist()]))
            if len(out) >= 1000:
                yield flush()
        yield flush()

    narrow = rows.select("part", "chunk", "seq", *codes).repartition(parts, "part", "chunk").sortWithinPartitions("part", "chunk", "seq")
    made = narrow.mapInArrow(matrices, "part int, chunk long, m array<double>")
    heads = rows.filter("seq = 0").select("part", "chunk", "conv_id")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(ROLES)
        out: list[tuple] = []
        for _, held in _chunks(batches, 1):
            scores, back = None, []
            for k, (_, _, m) in enumerate(held):
                full = np.array(m[: n * n]).reshape(n, n)
                if k == 0:
                    scores = np.array(m[n * n :])
                else:
                    way = scores[:, None] + full
                    back.append(way.argmax(axis=0))
                    scores = way.max(axis=0)
            at = int(scores.argmax())
            states = [at]
            for b in reversed(back):
                at = int(b[at])
                states.append(at)
            states.reverse()
            out += [(p, c, states[k - 1] if k else -1, states[k]) for k, (p, c, _) in enumerate(held)]
            if len(out) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["part", "chunk", "before", "end"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["part", "chunk", "before", "end"])

    linked = made.join(heads, ["part", "chunk"]).select("conv_id", "part", "chunk", "m").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    fixed = materialize(linked.mapInArrow(ends, "part int, chunk long, before int, end int"))

    def roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for _, held in _chunks(batches, 2):
            e = emissions(model, np.array([h[3:7] for h in held]))
            found = [ROLES[k] for k in decode(model, e, held[0][1], held[0][2])]
            columns = list(zip(*[(h[7], h[8], h[9], r, h[10], rendered(r, h[11])) for h, r in zip(held, found, strict=True)], strict=True))
            kinds = [batch_types[0], batch_types[1], pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "segment", "role", "given", "rendered"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_types = [to_arrow_type(rows.schema["conv_id"].dataType), to_arrow_type(rows.schema["turn"].dataType)]
    full = rows.join(fixed, ["part", "chunk"]).select("part", "chunk", "seq", "before", "end", *codes, "conv_id", "turn", "segment", "role", "text")
    full = full.repartition(parts, "part", "chunk").sortWithinPartitions("part", "chunk", "seq")
    return full.mapInArrow(roles, f"conv_id {kind['conv_id']}, turn {kind['turn']}, segment int, role string, given string, rendered string")
