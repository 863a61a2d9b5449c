"""Units of several lines, put together across the splits of a file.

Lines are read by as many tasks as a file has splits. Inside a split the lines of a unit (a
paragraph, a CSV record) are joined in one narrow pass over Arrow batches. Only what touches
the edge of a split is put together afterwards: the first unit of every split, which may go
on from the split before, and the last one where it is still open. Units are numbered per
file by running sums over one row per split, so pieces of one unit have one number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiframe.session import materialize

# The first unit of a split is handed on in pieces of about so many characters.
PIECE_CHARS = 8_000_000

UNIT, PIECE, SPLIT = 0, 1, 2

# From the lines of one split and whether a unit is open before them (None at the start of
# the split) to: which lines belong to a unit, which begin one, whether one is open
# afterwards, and whether the lines break the format.
Marks = tuple[np.ndarray, np.ndarray, bool, bool]
Mark = Callable[[pa.RecordBatch, "bool | None"], Marks]


@dataclass
class _State:
    """What is known of a split after some of its lines."""

    begins: int = 0
    first: bool | None = None
    opened: bool | None = None
    head: bool = True  # no unit has been closed yet
    number: int = 0
    held: list[str] = field(default_factory=list)
    chars: int = 0
    pieces: int = 0
    broken: bool = False


class _Rows:
    """Result rows of a chunk, in order."""

    def __init__(self):
        self.columns: list[tuple] = []

    def add(self, kind: int, number, order: int, text: pa.Array, **flags: bool) -> None:
        n = len(text)
        numbers = number if isinstance(number, np.ndarray) else np.full(n, number)
        self.columns.append((np.full(n, kind), numbers, np.full(n, order), text, [
            np.full(n, flags.get(name, False)) for name in ("head", "first", "open", "broken")
        ]))

    def batch(self, constants: dict[str, pa.Array]) -> pa.RecordBatch:
        kinds, numbers, orders, texts, flags = zip(*self.columns)
        n = sum(len(t) for t in texts)
        same = {name: value.take(pa.array(np.zeros(n, np.int32))) for name, value in constants.items()}
        made = {
            "_kind": pa.array(np.concatenate(kinds), pa.int32()),
            "_number": pa.array(np.concatenate(numbers), pa.int64()),
            "_order": pa.array(np.concatenate(orders), pa.int64()),
            "value": pa.concat_arrays(texts),
        }
        for i, name in enumerate(("_head", "_first", "_open", "_broken")):
            made[name] = pa.array(np.concatenate([f[i] for f in flags]), pa.bool_())
        return pa.RecordBatch.from_pydict({**same, **made})


MADE = "_kind int, _number long, _order long, value string, _head boolean, _first boolean, _open boolean, _broken boolean"


def _close(state: _State, out: _Rows, last: bool = False) -> None:
    """Hand on what is held: a whole unit, or a piece of the first or the last one."""
    text = pa.array(["\n".join(state.held)], pa.string())
    if state.head or last:
        out.add(PIECE, state.number, state.pieces, text, head=state.head)
    else:
        out.add(UNIT, state.number, 0, text)
    state.held, state.chars = [], 0


def _feed(state: _State, lines: pa.RecordBatch, mark: Mark, out: _Rows, piece_chars: int) -> None:
    member, begins, opened, broken = mark(lines, state.opened)
    start = state.opened is None
    if start:
        state.first = bool(member[0])
    state.broken |= broken
    inside = np.flatnonzero(member)
    goes_on = bool(state.opened) and len(inside) > 0 and inside[0] == 0 and not begins[0]
    if state.opened and not goes_on:
        _close(state, out)
        state.head = False
    state.opened = opened
    if not len(inside):
        return
    new = begins[inside]
    # At the start of a split a unit may have begun before: it has the number 0.
    new[0] = not goes_on and not (start and inside[0] == 0)
    cuts = np.flatnonzero(new)
    if not len(cuts) or cuts[0] != 0:
        cuts = np.concatenate([[0], cuts])
    values = lines.column(lines.schema.get_field_index("value")).take(pa.array(inside))
    ends = np.append(cuts, len(inside))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), "\n")
    numbers = state.begins + np.cumsum(new[cuts])
    state.begins = int(numbers[-1])

    at, n = 0, len(texts)
    if goes_on or state.head:
        if not goes_on:
            state.number = int(numbers[0])
        state.held.append(texts[0].as_py())
        state.chars += len(state.held[-1])
        if n > 1 or not opened:
            _close(state, out)
            state.head = False
        elif state.head and state.chars >= piece_chars:
            _close(state, out)
            state.pieces += 1
        at = 1
    whole = n if not opened else n - 1
    if whole > at:
        out.add(UNIT, numbers[at:whole], 0, texts[at:whole])
    if opened and n - 1 >= at:
        state.number, state.held = int(numbers[-1]), [texts[n - 1].as_py()]
        state.chars, state.pieces = len(state.held[0]), 0


def _finish(state: _State, out: _Rows) -> None:
    if state.opened and state.held:
        _close(state, out, last=True)
    none = pa.array([None], pa.string())
    out.add(SPLIT, state.begins, 0, none, first=state.first, open=state.opened, broken=state.broken)


def assemble(lines: DataFrame, extra: Sequence[str], mark: Mark, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Whole units, pieces and one row per split, in the order of ``lines(file, _split, *extra, value, ...)``.

    ``lines`` must come from a scan in its order. What a task holds is one Arrow batch and
    one open unit, the first unit of a split no more than ``piece_chars`` of it.
    """
    keys = ["file", "_split", *extra]
    schema = lines.select(*[f"`{k}`" for k in keys]).schema
    for made in StructType.fromDDL(MADE):
        schema = schema.add(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, here, constants = None, None, {}
        for batch in batches:
            if not len(batch):
                continue
            files = batch.column(batch.schema.get_field_index("file"))
            splits = batch.column(batch.schema.get_field_index("_split")).to_numpy()
            codes = files.dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(splits) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                out = _Rows()
                key = (files[a].as_py(), int(splits[a]))
                if key != here:
                    if state is not None:
                        last = _Rows()
                        _finish(state, last)
                        yield last.batch(constants)
                    state, here = _State(), key
                    constants = {k: batch.column(batch.schema.get_field_index(k)).slice(a, 1) for k in keys}
                _feed(state, batch.slice(a, b - a), mark, out, piece_chars)
                if out.columns:
                    yield out.batch(constants)
        if state is not None:
            out = _Rows()
            _finish(state, out)
            yield out.batch(constants)

    return lines.mapInArrow(run, schema)


@dataclass(frozen=True)
class Units:
    """Units of a set of files.

    ``whole(file, _split, *extra, text, _local)``: units inside a split that are kept, with their
    place among these. ``pieces``: the others' pieces with the ``_unit`` they belong to.
    ``edges``: one row per unit in pieces, without its text. ``splits``: one row per split.
    """

    whole: DataFrame
    pieces: DataFrame
    edges: DataFrame
    splits: DataFrame
    extra: Sequence[str]


def units(assembled: DataFrame, extra: Sequence[str], finish: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Units:
    """Number units and find out what belongs together; ``finish`` and ``keep`` make and choose the texts.

    The assembled rows are written once. The windows run over one row per split.
    """
    whole = F.col("_kind") == UNIT
    rows = assembled.withColumn("text", F.when(whole, finish(F.col("value"))))
    rows = rows.where(~whole | F.coalesce(keep(F.col("text")), F.lit(False)))
    rows = rows.withColumn("value", F.when(~whole, F.col("value"))).withColumn("_seq", F.monotonically_increasing_id())
    rows = materialize(rows, "units")

    found = rows.where(whole).groupBy("file", "_split").agg(F.min("_seq").alias("_from"), F.count(F.lit(1)).alias("_n"))
    splits = rows.where(F.col("_kind") == SPLIT).select("file", "_split", "_number", "_first", "_open", "_broken")
    order = W.partitionBy("file").orderBy("_split")
    before = F.coalesce(F.lag("_open").over(order), F.lit(False))
    splits = splits.join(found, ["file", "_split"], "left").withColumn("_own", (F.col("_first") & ~before).cast("long"))
    sums = F.coalesce(F.sum(F.col("_number") + F.col("_own")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = materialize(
        splits.select("file", "_split", "_broken", "_from", F.coalesce("_n", F.lit(0)).alias("_n"), (sums + F.col("_own")).alias("_base")),
        "splits",
    )
    pieces = rows.where(F.col("_kind") == PIECE).join(splits.select("file", "_split", "_base"), ["file", "_split"])
    pieces = pieces.withColumn("_unit", F.col("_base") + F.col("_number"))
    place = F.struct("_split", "_order")
    edges = pieces.groupBy("file", "_unit").agg(
        F.min("_split").alias("_split"), F.min_by("_head", place).alias("_head"), F.count(F.lit(1)).alias("_pieces")
    )
    inside = rows.where(whole).join(splits.select("file", "_split", "_from"), ["file", "_split"])
    inside = inside.select("file", "_split", *extra, "text", (F.col("_seq") - F.col("_from")).alias("_local"))
    return Units(inside, pieces, edges, splits, extra)


def joined_pieces(pieces: DataFrame, extra: Sequence[str], finish: Callable[[Column], Column]) -> DataFrame:
    """(file, _unit, *extra, text): units in pieces, put together; one row holds one unit."""
    parts = F.sort_array(F.collect_list(F.struct("_split", "_order", "value")))
    whole = pieces.groupBy("file", "_unit", *extra).agg(parts.alias("_parts"))
    return whole.select("file", "_unit", *extra, finish(F.array_join(F.col("_parts.value"), "\n")).alias("text"))


def local_places(kept_edges: DataFrame, found: Units) -> tuple[DataFrame, DataFrame]:
    """Places in their split of the kept units in pieces, and ``(file, _split, _n, _heads)`` of every split.

    A split's first unit, where it begins there, comes first; one still open at its end comes last.
    """
    counts = kept_edges.groupBy("file", "_split").agg(
        F.count(F.when(F.col("_head"), 1)).alias("_heads"), F.count(F.when(~F.col("_head"), 1)).alias("_tails")
    )
    sizes = found.splits.join(counts, ["file", "_split"], "left").select(
        "file", "_split", F.col("_n").alias("_whole"), F.coalesce("_heads", F.lit(0)).alias("_heads"),
        (F.col("_n") + F.coalesce("_heads", F.lit(0)) + F.coalesce("_tails", F.lit(0))).alias("_n"),
    )
    sizes = materialize(sizes, "sizes")
    placed = kept_edges.join(sizes.select("file", "_split", "_whole", "_heads"), ["file", "_split"])
    local = F.when(F.col("_head"), F.lit(0)).otherwise(F.col("_heads") + F.col("_whole"))
    return placed.withColumn("_local", local.cast("long")).drop("_whole", "_heads"), sizes.drop("_whole")
