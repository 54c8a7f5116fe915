"""The whole impact analysis as one job: diffs and a catalogue in, affected endpoints and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.operators import diffs as D
from rippletrace.operators import impact as I
from rippletrace.operators import report as R
from rippletrace.sources.tables import save_step


@dataclass
class Impact:
    """``affected`` is the flat main table, ``lines`` what is displayed of it; ``summary`` has a row for every change, hit or not."""

    affected: DataFrame
    summary: DataFrame
    files: DataFrame
    errors: DataFrame
    lines: DataFrame


def analyse(diffs: DataFrame, endpoints: DataFrame, references: DataFrame, threshold: float = 0.5, compat: bool = False) -> Impact:
    """Affected endpoints of each change in ``diffs`` (repo, change_id, diff_text).

    ``endpoints`` and ``references`` are as in ``operators.impact``. The order
    of steps matters: first hits win, then the threshold applies. A change whose
    diff can't be parsed has no files and one error, and still a summary.
    """
    parsed = save_step(D.parse_diffs(diffs, "error", "files", "touched"), "parsed-diffs")
    files = D.diff_files(parsed, compat)
    changed = save_step(I.touched(D.touched_in_python(parsed, compat)), "changed")
    hits = I.above_threshold(I.all_hits(changed, endpoints, references), threshold)
    lines = save_step(I.display_lines(changed, references), "display-lines")
    affected = save_step(I.with_reasons(hits, lines, endpoints), "affected")
    return Impact(affected, R.summary(diffs, files, affected, endpoints), files, D.diff_errors(parsed), lines)


@dataclass
class Reports:
    """``affected`` with call stacks and the endpoints' columns; a JSON and a Markdown document per change."""

    affected: DataFrame
    json: DataFrame
    markdown: DataFrame


def reports(
    impact: Impact, endpoints: DataFrame, symbols: DataFrame, stacks: DataFrame, sources: DataFrame, unreadable: DataFrame | None = None, app_path: str = "", **how: object
) -> Reports:
    """The documents of an analysis.

    ``symbols`` and ``stacks`` say what endpoints reach and how, ``sources`` are
    source files (repo, file_path, content), ``unreadable`` files (repo,
    file_path, error) that couldn't be scanned.
    """
    medium = impact.affected.where("confidence = 'medium'").select(*I.FILE, "path", "endpoint_id")
    groups = I.line_groups(impact.lines.join(medium, [*I.FILE, "path", "endpoint_id"]))
    rows = I.with_call_stacks(impact.affected, stacks, I.frames(groups, symbols, sources))
    first = endpoints.groupBy("repo", "endpoint_id").agg(F.min_by(F.struct(F.col("path").alias("endpoint_path"), "methods", "name", "module", "file_path", "start_line", "end_line", "tags", "dependencies"), "reg_order").alias("e"))
    rows = save_step(rows.drop("reg_order").join(first.select("repo", "endpoint_id", "e.*"), ["repo", "endpoint_id"]), "reported")
    warnings = None if unreadable is None else R.warnings_of(impact.files, unreadable)
    made = R.report_json(impact.summary, rows, impact.errors, warnings, app_path, **{k: v for k, v in how.items() if k in ("at", "duration_ms")})
    text = R.report_markdown(impact.summary, R.endpoint_block(rows), impact.errors, warnings, app_path, **{k: v for k, v in how.items() if k in ("title", "duration_ms")})
    return Reports(rows, made, text)
