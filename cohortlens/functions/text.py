"""Text column functions (survey C14, C16), native expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as ``str.strip`` understands it, derived by rule from Unicode,
# written as literal characters so any regex engine reads the same class.
WS_CLASS = "[" + "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace()) + "]"
WS_CHARS = WS_CLASS[1:-1]


def strip_ws(c: Column) -> Column:
    """Trim all leading/trailing whitespace (Spark's trim removes spaces only), in one pass."""
    return F.btrim(c, F.lit(WS_CHARS))


def is_report_header_line(line: Column) -> Column:
    """A leading line to drop: blank, '---', a report title, or a level/index
    summary line ('pedra:' with 'inde:', '**pedra', '> **pedra')."""
    t = strip_ws(line)
    low = F.lower(t)
    return ((t == "") | (t == "---")
            | low.startswith("# relatório") | low.startswith("## relatório")
            | (low.startswith("pedra:") & low.contains("inde:"))
            | low.startswith("**pedra") | low.startswith("> **pedra"))


def strip_report_header(text: Column) -> Column:
    """Drop leading header lines of a report, keep everything from the
    first content line on.  The position of that line comes from one pass over
    the lines, so time is linear in the text and no regex recurses."""
    lines = F.split(strip_ws(text), "\n", -1)
    first = F.array_position(F.transform(lines, lambda line: ~is_report_header_line(line)), True)
    return F.when(text.isNotNull(), F.when(first == 0, F.lit("")).otherwise(
        F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "\n")))


_PLACEHOLDER = re.compile(r"\{(\w+)(?::\.(\d+)f)?\}")


def render_template(template: str, missing: str = "N/A") -> Column:
    """C14: fill ``{field}`` / ``{field:.Nf}`` placeholders from columns.

    The template is split once on the driver into literal pieces and
    placeholders; each row is a single ``concat``.  A NULL field renders
    as ``missing`` instead of failing.
    """
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        field, digits = m.group(1), m.group(2)
        col = F.col(field)
        val = F.format_string(f"%.{digits}f", col) if digits else col.cast("string")
        parts.append(F.coalesce(val, F.lit(missing)))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit(template)
