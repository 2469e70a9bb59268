"""Reports as tables of lines, made on the executors; text of them is put together on the driver line by line, or written from the executors (save)."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import diff, ranking, scoring, sinks

DIFF_MARK = "<!-- tessera: points -->"
SURFACE_MARK = "<!-- tessera: surface -->"
CAUTION = "These are call sites worth a look, not vulnerabilities."


def cells(*xs: Column) -> Column:
    """A table's row; bars in a cell are escaped, nulls are empty."""
    shown = [F.coalesce(F.regexp_replace(x.cast("string"), "\\|", "\\\\\\\\|"), F.lit("")) for x in xs]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def head(*names: str) -> str:
    row = lambda xs: "| " + " | ".join(xs) + " |"
    return row(names) + "\n" + row("---" for _ in names)


def text_of(lines: DataFrame, *order: Column | str) -> str:
    """The lines in order; the driver reads one part at a time."""
    return "\n".join(r.line for r in lines.orderBy(*order).select("line").toLocalIterator())


def save(lines: DataFrame, path: str, *order: Column | str) -> None:
    """The lines in order as a folder of text files, written by the executors."""
    lines.orderBy(*order).select("line").write.text(path)


# --- points ---
def detect_lines(points: DataFrame, limit: int) -> DataFrame:
    """(rank, line) of the first points to implement."""
    shown = ranking.numbered(ranking.top(ranking.split_points(points)[0], limit))
    return shown.select("rank", cells(F.col("rank"), F.concat("module", F.lit(":"), "name"), F.col("category"), F.format_string("%.2f", "score"), F.array_join("signals", "; ")).alias("line"))


def loader_lines(points: DataFrame) -> DataFrame:
    """(first_ord, line) of each loader once."""
    sites = F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" sites)"))).otherwise("")
    return ranking.collapse_registrations(points).select("first_ord", F.concat(F.lit("- "), "module", F.lit(":"), "name", sites).alias("line"))


def tie_lines(points: DataFrame, limit: int) -> DataFrame:
    """(line) about the last band in view; none if it is one point."""
    rest = F.col("band") - F.col("in_view")
    said = F.when(rest > 0, F.concat(rest.cast("string"), F.lit(" of them aren't shown, and by name only."))).otherwise("their order is that of their names.")
    return ranking.tie_note(ranking.split_points(points)[0], limit).select(F.concat(F.col("band").cast("string"), F.lit(" points score "), F.format_string("%.2f", "cutoff"), F.lit("; "), said).alias("line"))


def detect_markdown(points: DataFrame, limit: int) -> str:
    """The first points to implement, a note on ties at the cut, and each loader once."""
    out = [head("rank", "point", "category", "score", "why") + "\n" + text_of(detect_lines(points, limit), "rank")]
    note = text_of(tie_lines(points, limit), "line")
    loaders = text_of(loader_lines(points), "first_ord")
    return "\n\n".join([out[0].rstrip("\n"), *([note] if note else []), *(["Loaders:\n" + loaders] if loaders else [])]) + "\n"


def detect_entries(points: DataFrame, limit: int | None = None, label: str = "") -> DataFrame:
    """(later, score, module, lineno, seam_ord, line): a JSON object per point to implement, with its ties counted before the limit, then (later) per loader."""
    implement, loaders = ranking.split_points(points)
    tied = ranking.tied_with(implement)
    both = (ranking.top(tied, limit) if limit is not None else tied).withColumn("later", F.lit(0)).unionByName(loaders.withColumn("tied_with", F.lit(0).cast("long")).withColumn("later", F.lit(1)), allowMissingColumns=True)
    named = F.when(F.col("module") != "", F.col("module"))
    entry = F.struct(F.concat(F.coalesce(named, F.lit(label)), F.lit(":"), "name").alias("id"), named.alias("module"), "category", F.round("score", 4).alias("score"), F.col("tied_with").cast("long").alias("tied_with"), "kind", "signals")
    return both.select("later", "score", "module", "lineno", "seam_ord", F.to_json(entry, {"ignoreNullFields": "false"}).alias("line"))


def detect_json(points: DataFrame, limit: int | None = None, label: str = "") -> str:
    """The entries as one indented list."""
    lines = detect_entries(points, limit, label).orderBy("later", *scoring.order()).select("line").toLocalIterator()
    return json.dumps([json.loads(r.line) for r in lines], indent=2, ensure_ascii=False)


# --- risk findings ---
def audit_lines(found: DataFrame) -> DataFrame:
    """findings with line."""
    return found.withColumn("line", cells(F.col("severity"), F.col("confidence"), F.col("id"), F.concat("module", F.lit(":"), F.col("lineno").cast("string"))))


def count_lines(found: DataFrame) -> DataFrame:
    """(line), one row: how many findings of each severity, the worst first; empty where there are none."""
    counts = sinks.severity_counts(found).filter(F.col("severity").isin(*sinks.SEVERITY_RANK)).select(F.struct(sinks.rank_of(F.col("severity")).alias("r"), F.concat(F.col("n").cast("string"), F.lit(" "), "severity").alias("t")).alias("x"))
    return counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ", ").alias("line"))


def audit_markdown(found: DataFrame) -> str:
    body = text_of(audit_lines(found), *sinks.order(), *sinks.place(found))
    return (CAUTION + "\n\n" + text_of(count_lines(found), "line")).strip() + "\n\n" + head("severity", "confidence", "id", "place") + ("\n" + body if body else "") + "\n"


def audit_entries(found: DataFrame) -> DataFrame:
    """findings with line: a JSON object of each."""
    call = next((c for c in ("call", "dotted") if c in found.columns), None)
    entry = F.struct("id", "category", "severity", "confidence", "module", (F.col(call) if call else F.lit(None).cast("string")).alias("call"), "lineno")
    return found.withColumn("line", F.to_json(entry, {"ignoreNullFields": "false"}))


def audit_json(found: DataFrame, target: str, limit: int | None = None) -> str:
    """What is counted is all; what is listed is the first of them, if there is a limit."""
    ordered = audit_entries(found).orderBy(*sinks.order(), *sinks.place(found)).select("line")
    rows = [json.loads(r.line) for r in (ordered if limit is None else ordered.limit(limit)).toLocalIterator()]
    return json.dumps({"target": target, "note": CAUTION, "count": len(rows) if limit is None else found.count(), "sinks": rows}, indent=2, sort_keys=True)


# --- changes ---
def change_lines(changes: DataFrame) -> DataFrame:
    """changes with line."""
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    what = F.when(F.col("field").isNotNull(), F.concat(F.lit(": "), "field", F.lit(" "), quoted(F.col("old")), F.lit(" -> "), quoted(F.col("new")))).otherwise("")
    return changes.withColumn("line", F.concat(F.lit("- "), F.col("id").cast("string"), what))


def manifest_markdown(changes: DataFrame) -> str:
    lines = change_lines(changes)
    out = [DIFF_MARK]
    for kind in ("removed", "added", "changed"):
        body = text_of(lines.filter(F.col("change") == kind), "id", "field")
        if body:
            out.append(f"{kind.capitalize()}:\n{body}")
    return "\n\n".join(out if len(out) > 1 else [*out, "No change."]) + "\n"


def breaking(changes: DataFrame) -> bool:
    """Whether a point was removed or one of its fields changed."""
    return bool(changes.filter("change IN ('removed', 'changed')").head(1))


def surface_lines(changes: DataFrame) -> DataFrame:
    """changes with line."""
    return changes.withColumn("line", cells(*(F.col(c) for c in ("direction", "severity", "id", "module", "call", "count"))))


def verdict_lines(changes: DataFrame) -> DataFrame:
    """(line), one row: how many findings came and went."""
    n = lambda way: F.coalesce(F.sum(F.when(F.col("direction") == way, F.col("count"))), F.lit(0)).cast("string")
    return changes.agg(F.concat(n("introduced"), F.lit(" introduced, "), n("removed"), F.lit(" removed")).alias("line"))


def surface_markdown(changes: DataFrame) -> str:
    body = text_of(surface_lines(changes), sinks.rank_of(F.col("severity")), "module", "call", "id", "direction")
    return f"{SURFACE_MARK}\n\n{CAUTION}\n\n{text_of(verdict_lines(changes), 'line')}\n\n" + head("direction", "severity", "id", "module", "call", "count") + ("\n" + body if body else "") + "\n"


def gate(changes: DataFrame, threshold: str) -> bool:
    return bool(diff.at_or_above(changes, threshold).head(1))


def sticky(comments: Iterable[tuple[str, str]], body: str) -> tuple[str | None, str]:
    """(id of the comment to replace, or None to add one, and its text): the last comment (id, text) that begins with the same mark as the report."""
    mark = body.split("\n", 1)[0]
    last = None
    for i, text in comments:
        if mark.startswith("<!--") and mark in text:
            last = i
    return last, body


# --- configuration, evaluation ---
def config_lines(points: DataFrame) -> DataFrame:
    return points.withColumn("line", cells(F.col("kind"), F.col("path")))


def config_markdown(points: DataFrame) -> str:
    body = text_of(config_lines(points), "kind", "path")
    return head("kind", "path") + ("\n" + body if body else "") + "\n"


def score_lines(scores: DataFrame) -> DataFrame:
    """scores (of evaluate.scores) with line: candidates, labels, ranks, hits with their bounds where ties matter, and the median rank."""
    span = F.concat(F.col("hits").cast("string"), F.lit("/"), F.col("n_labels").cast("string"))
    bounds = F.when(F.col("worst_hits") != F.col("best_hits"), F.concat(F.lit(" ("), F.col("worst_hits").cast("string"), F.lit(".."), F.col("best_hits").cast("string"), F.lit(")"))).otherwise("")
    return scores.withColumn("line", cells(F.col("target"), F.col("n_candidates"), F.col("n_labels"), F.array_join(F.col("ranks").cast("array<string>"), ", "), F.concat(span, bounds), F.format_string("%.1f", "median_rank")))


def score_markdown(scores: DataFrame, k: int) -> str:
    """The table, the labels that weren't found, and the sums."""
    total = scores.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "n_labels", "worst_hits", "best_hits"))).first()
    absent = text_of(scores.select(F.explode("absent").alias("a")).select(F.concat(F.lit("not found: "), "a").alias("line")), "line")
    out = [head("target", "candidates", "labels", "ranks", f"hits at {k} (bounds)", "median rank") + "\n" + text_of(score_lines(scores), "target")]
    out += [absent] if absent else []
    out.append(f"{total.hits}/{total.n_labels} at {k}" + (f"; ties may make it {total.worst_hits} to {total.best_hits}" if total.worst_hits != total.best_hits else ""))
    return "\n\n".join(out) + "\n"
