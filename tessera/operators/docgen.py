"""The documentation run as tables: attempts, response cache, call budget, drop reasons, totals. No model is called from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import slug

OK = ("verified", "executed", "compiled")


def first_success(attempts: DataFrame, retries: int) -> DataFrame:
    """(point, attempt, ok): the first good one of the first attempts, else the last of them. attempts: (point, n, ok), n from 1."""
    tries = attempts.filter(F.col("n") <= retries)
    return tries.groupBy("point").agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("n"))), F.max("n")).alias("attempt"), F.max("ok").alias("ok"))


def retries(asked: Column) -> Column:
    """Attempts allowed: 3 to 5."""
    return F.greatest(F.lit(3), F.least(F.lit(5), asked))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between them."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def cached(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """prompts (key) with the cached response where there is one; of several the largest, so that it is always the same."""
    return prompts.join(cache.groupBy("key").agg(F.max("response").alias("response")), "key", "left")


def within_budget(calls: DataFrame, most: int, by: str, order: str) -> DataFrame:
    """The calls that a hard cap lets through, per run, in order. Each task keeps its first few before the shuffle."""
    return calls.withColumn("call_no", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("call_no") <= most)


def worst_case_calls(points: Column, tries: Column) -> Column:
    return F.lit(1) + points * (F.lit(1) + tries)


def drop_reason(detail: Column) -> Column:
    return F.when(detail.startswith("import failed"), "import_failed").otherwise("validation_failed")


def extract_code(text: Column) -> Column:
    """The body of the first fenced block, without a python or py tag; the whole text where there is no fence."""
    body = F.split(text, "```")
    code = F.when(F.size(body) > 1, F.regexp_replace(body[1], "^(python|py)[ \\t]*\\n", "")).otherwise(text)
    return F.regexp_replace(code, "^\\s+|\\s+$", "")


def totals(results: DataFrame) -> DataFrame:
    """(status, n) of generated and dropped points."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- prompts ---
def guide_prompt(fact: Column) -> Column:
    return F.concat(F.lit("How is this point extended? Say what it is, when it is used, and the steps, by these facts only.\n\n"), fact)


def example_prompt(fact: Column, module: Column) -> Column:
    ask = F.concat(F.lit("Write the smallest plugin for this point, as one Python code block and nothing else. Import from "), module, F.lit("; subclass a class, and give each abstract method a body. Use names of these facts only."))
    return F.concat(ask, F.lit("\n\n"), fact)


def overview_prompt(facts: Column, modules: Column, edges: Column) -> Column:
    """facts: an array of fact blocks, in order."""
    summary = F.concat(modules.cast("string"), F.lit(" modules, "), edges.cast("string"), F.lit(" dependencies"))
    return F.concat(F.lit("How can this codebase be extended? Group its points by kind, by these facts only.\n\n"), summary, F.lit("\n\n"), F.array_join(facts, "\n---\n"))


def remedy(reason: Column, missing: Column) -> Column:
    """What to do about a failed preflight; nothing where it passed."""
    install = F.concat(missing, F.lit(" isn't installed: pip install "), F.substring_index(missing, ".", 1), F.lit(", then run again."))
    return F.when(reason == "missing_dependency", install).when(reason == "not_found", "The package can't be imported: pip install -e . in its folder, then run again.").when(reason == "import_error", "Mend the error above, then run again.").otherwise("")


# --- files ---
ENDINGS = {"java": "java", "javascript": "js", "typescript": "ts"}


def example_path(point: Column, language: Column | str = "python") -> Column:
    """Where a point's example lies; the ending is its language's, py where there is none."""
    of = F.lit(language) if isinstance(language, str) else language
    ending = F.lit("py")
    for name, e in ENDINGS.items():
        ending = F.when(of == name, e).otherwise(ending)
    return F.concat(F.lit("examples/"), slug(point), F.lit("."), ending)


def index_line(point: Column, category: Column, module: Column, status: Column) -> Column:
    """A point's row in the index; one whose example no check has passed is marked."""
    return F.concat(F.lit("| ["), point, F.lit("](guide.md) | "), category, F.lit(" | "), module, F.lit(" | "), F.when(status == "unverified", "UNVERIFIED").otherwise(status), F.lit(" |"))
