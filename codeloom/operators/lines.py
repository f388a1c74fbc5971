"""Files as lines, and markers in comments: ignored regions and suppressions, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.markers import LOWER, UPPER, WHITE, ascii_lower

_TRIM = f"^[{WHITE}]+|[{WHITE}]+$"
#: Whole-line comment: line prefix, and opener and closer of a block on one line.
COMMENTS = {"Default": ("//", "/*", "*/"), "Python": ("#", None, None), "Ada": ("--", None, None), "Fortran": ("!", None, None), "Lua": ("--", "--[[", "]]")}


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trim(c: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(c, _TRIM, "")


def line_table(files: DataFrame, key: str = "file_id", source: str = "source", *keep: str) -> DataFrame:
    """``key, *keep, line_no`` (from 1)``, text, byte_start, byte_end`` (without the newline)``, n_lines, n_bytes``.

    What follows a final newline is no line. Byte offsets are running sums of
    octets over the file's lines.
    """
    parts = F.split(F.col(source), "\n", -1)
    n = F.size(parts) - F.when(F.endswith(F.col(source), F.lit("\n")) | (F.col(source) == ""), 1).otherwise(0)
    rows = files.select(key, *keep, F.octet_length(source).cast("long").alias("n_bytes"), n.cast("long").alias("n_lines"), F.posexplode(parts).alias("pos", "text"))
    rows = rows.where(F.col("pos") < F.col("n_lines"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("text") + 1).over(w), F.lit(0)).cast("long")
    return rows.select(key, *keep, (F.col("pos") + 1).cast("long").alias("line_no"), "text", start.alias("byte_start"), (start + F.octet_length("text")).cast("long").alias("byte_end"), "n_lines", "n_bytes")


def marker_text(text: Column, mode: Column) -> Column:
    """The trimmed inside of a line that is one whole comment, else NULL. The line prefix is tried before the block form."""
    t = trim(text)
    out = F.lit(None).cast("string")
    for name, (prefix, opener, closer) in COMMENTS.items():
        inner = F.when(F.startswith(t, F.lit(prefix)), trim(F.substr(t, F.lit(len(prefix) + 1))))
        if opener:
            inside = F.startswith(t, F.lit(opener)) & F.endswith(t, F.lit(closer)) & (F.length(t) >= len(opener) + len(closer))
            inner = inner.when(inside, trim(F.substr(t, F.lit(len(opener) + 1), F.length(t) - len(opener) - len(closer))))
        out = F.when(mode == name, inner).otherwise(out)
    return out


def _region_markers(text: Column) -> tuple[Column, Column]:
    """(is it ``on`` or ``off``, tools of an ``off`` with a list)."""
    listed = F.filter(F.transform(F.split(F.substr(text, F.lit(11)), ","), trim), lambda x: x != "")
    scoped = F.startswith(text, F.lit("tools:off ")) & (F.size(listed) > 0)
    kind = F.when(text == "tools:on", "on").when((text == "tools:off") | scoped, "off")
    return kind, F.when(scoped, listed)


def ignored_regions(files: DataFrame, key: str = "file_id", source: str = "source", mode: str = "sloc_mode") -> DataFrame:
    """``key, byte_start, byte_end, line_start, line_end, tools``: from an ``off`` marker through the next ``on``, or the file's end.

    An ``off`` opens a region unless one is open: the marker before it is absent
    or ``on``.  Lines are counted from 1, both ends included; ``tools`` is NULL
    for all tools.
    """
    lines = line_table(files.where(F.contains(F.col(source), F.lit("tools:o"))), key, source, mode)
    kind, tools = _region_markers(marker_text(F.col("text"), F.col(mode)))
    marks = lines.select("*", kind.alias("kind"), tools.alias("tools")).where("kind is not null")
    w = Window.partitionBy(key).orderBy("line_no")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    close = F.first(F.when(F.col("kind") == "on", F.struct("line_no", "byte_end")), ignorenulls=True).over(after)
    opened = marks.withColumn("before", F.lag("kind").over(w)).withColumn("close", close).where("kind = 'off' and (before is null or before = 'on')")
    return opened.select(
        key,
        "byte_start",
        F.coalesce("close.byte_end", "n_bytes").alias("byte_end"),
        F.col("line_no").alias("line_start"),
        F.coalesce("close.line_no", "n_lines").alias("line_end"),
        "tools",
    )


def region_applies_to(tools: Column, tool: str) -> Column:
    """No list: every tool; else ASCII case-insensitive."""
    return tools.isNull() | F.exists(tools, lambda t: _ascii_lower(t) == ascii_lower(tool))


def suppressions(files: DataFrame, key: str = "file_id", source: str = "source", mode: str = "sloc_mode") -> DataFrame:
    """``key, comment_line, target_line, tool, rule, hash, justification`` of every ``tools:suppress tool:rule ...`` comment.

    The target is the next non-blank line, NULL at the end of the file.
    """
    lines = line_table(files.where(F.contains(F.col(source), F.lit("tools:suppress "))), key, source, mode).withColumn("text", F.regexp_replace("text", r"\r$", ""))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    target = F.first(F.when(trim(F.col("text")) != "", F.col("line_no")), ignorenulls=True).over(w)
    marks = lines.select(key, "line_no", marker_text(F.col("text"), F.col(mode)).alias("m"), target.alias("target_line")).where(F.startswith("m", F.lit("tools:suppress ")))
    tokens = F.regexp_extract_all(F.substr("m", F.lit(16)), F.lit(f'(?:"[^"]*"?|[^{WHITE}"])+'), F.lit(0))
    head = F.get("tok", F.lit(0))

    def last(prefix: str) -> Column:
        return F.substr(F.try_element_at(F.filter(F.slice("tok", 2, F.greatest(F.size("tok") - 1, F.lit(0))), lambda t: F.startswith(t, F.lit(prefix))), F.lit(-1)), F.lit(len(prefix) + 1))

    cut = F.instr(head, ":")
    out = marks.withColumn("tok", tokens).where(F.size("tok") > 0)
    out = out.select(
        key,
        F.col("line_no").alias("comment_line"),
        "target_line",
        F.when(cut > 1, F.substr(head, F.lit(1), cut - 1)).alias("tool"),
        F.when(cut > 1, F.substr(head, cut + 1)).alias("rule"),
        last("HASH:").alias("hash"),
        F.regexp_replace(last("JUSTIFICATION:"), r'^"+|"+$', "").alias("justification"),
    )
    return out.where("tool is not null and rule <> ''")


def suppression_applies_to(tool: Column, rule: Column, wanted_tool: str, wanted_rule: str) -> Column:
    """ASCII case does not count in tools, every case does in rules."""
    return (_ascii_lower(tool) == ascii_lower(wanted_tool)) & (rule == wanted_rule)
