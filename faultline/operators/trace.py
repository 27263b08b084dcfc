"""Stack traces take the level of the error above them.

Only positions and levels travel.  A cell holds 64 neighbouring positions of a
log as bit masks (lines with a level of their own, errors, critical ones, lines
of a trace), combined inside each task before they are shuffled.  The result is
a short table of the lines that change; text stays where it was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.levels import LEVELS, is_continuation
from faultline.session import fits_broadcast, write_once

CHUNK_LINES = 1 << 17
CELL_BITS = 6
CHUNK_CELLS = CHUNK_LINES >> CELL_BITS
_ERROR, _CRITICAL = (LEVELS.index(name) + 1 for name in ("ERROR", "CRITICAL"))


def continues_trace(level: Column, raw: Column) -> Column:
    """Whether a line may belong to the trace of the line above."""
    return F.coalesce((level == "INFO") & is_continuation(raw), F.lit(False))


def _mask(condition: Column) -> Column:
    bit = F.expr(f"shiftleft(1L, cast(pos & {(1 << CELL_BITS) - 1} as int))")
    return F.coalesce(F.bit_or(F.when(condition, bit)), F.lit(0).cast("bigint"))


def _top_code(mask: str) -> str:
    """Code of the highest line of ``mask``, which is not 0: an error level's, else 0."""
    top = f"length(bin({mask})) - 1"
    return (
        f"case when shiftright(critical, {top}) & 1 = 1 then {_CRITICAL} "
        f"when shiftright(error, {top}) & 1 = 1 then {_ERROR} else 0 end"
    )


def trace_levels(lines: DataFrame, chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """``log_id, pos, level`` of the trace lines that take the level of an error above them.

    ``lines`` needs ``log_id, pos, level, continuation``.  A line takes the
    level of the last line above it that is no continuation.  Cells are scanned
    in chunks, so no task holds a whole log; a chunk needs one number from the
    chunks before it.
    """
    own = ~F.col("continuation")
    cells = (
        lines.groupBy("log_id", F.expr(f"shiftright(pos, {CELL_BITS})").alias("cell"))
        .agg(
            _mask(own).alias("own"),
            _mask(own & (F.col("level") == "ERROR")).alias("error"),
            _mask(own & (F.col("level") == "CRITICAL")).alias("critical"),
            _mask(F.col("continuation")).alias("trace"),
        )
        .withColumns(
            {
                "chunk": F.expr(f"floor(cell / {chunk_cells})"),
                "last": F.expr(f"case when own <> 0 then cell * 8 + {_top_code('own')} end"),
            }
        )
    )
    earlier = Window.partitionBy("log_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cells.groupBy("log_id", "chunk")
        .agg(F.max("last").alias("last"))
        .select("log_id", "chunk", F.max("last").over(earlier).alias("carried"))
        .where("carried IS NOT NULL")
    )
    above = Window.partitionBy("log_id", "chunk").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    seen = cells.withColumn("above", F.max("last").over(above)).where("trace <> 0")
    below = "case when i = 0 then 0 else own & shiftrightunsigned(-1L, 64 - i) end"
    return (
        seen.join(carried, ["log_id", "chunk"], "left")
        .withColumn("i", F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(trace, i) & 1 = 1)")))
        .withColumn("below", F.expr(below))
        .withColumn("code", F.expr(f"case when below <> 0 then {_top_code('below')} else pmod(coalesce(above, carried), 8) end"))
        .where(F.col("code") >= _ERROR)
        .select(
            "log_id",
            F.expr(f"cell * {1 << CELL_BITS} + i").alias("pos"),
            F.get(F.array(*map(F.lit, LEVELS)), (F.col("code") - 1).cast("int")).alias("level"),
        )
    )


def inherit_trace_level(lines: DataFrame, chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """Stored parsed lines with the levels of ``trace_levels``; drops ``continuation``.

    The changed levels are looked up where the lines are read, if they fit
    in memory.  Beyond that only continuation lines are shuffled to them; all
    others pass.
    """
    narrow = lines.select("log_id", "pos", "level", "continuation")
    changes = write_once(trace_levels(narrow, chunk_cells), "levels").toDF("_log", "_pos", "_level")
    same = (F.col("log_id") == F.col("_log")) & (F.col("pos") == F.col("_pos"))
    changed = F.coalesce("_level", "level")
    kept = [c for c in lines.columns if c != "continuation"]
    if fits_broadcast(changes):
        return lines.join(F.broadcast(changes), same, "left").withColumn("level", changed).select(*kept)
    traced = lines.where("continuation").join(changes, same, "left").withColumn("level", changed)
    return lines.where("NOT continuation").select(*kept).unionByName(traced.select(*kept))
