"""Configuration points of a table of paths: manifest-like files and drop-in folders, by name alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEMS = "addons config extensions manifest mod mods modules plugin plugins registry settings".split()
ENDINGS = "cfg ini json toml yaml yml".split()
FOLDERS = "addons content data extensions mods plugins".split()
SKIPPED = ".eggs .git .hg .mypy_cache .next .pytest_cache .ruff_cache .svn .tox .venv __pycache__ build dist node_modules venv".split()


def config_points(paths: DataFrame) -> DataFrame:
    """(path, kind) of relative file paths (path): files whose stem and ending fit, and folders above files whose name fits; case doesn't matter.

    Anything below a skipped folder is left out.
    """
    parts = F.split("path", "/")
    seen = paths.select("path").distinct().filter(~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(SKIPPED)))
    name = F.lower(F.element_at(parts, -1))
    files = seen.filter(F.regexp_extract(name, "^(.*)\\.[^.]*$", 1).isin(STEMS) & F.regexp_extract(name, "\\.([^.]*)$", 1).isin(ENDINGS)).select("path", F.lit("manifest_file").alias("kind"))
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.slice(parts, 1, k - 1)), lambda p: (F.size(p) > 0) & F.lower(F.element_at(p, -1)).isin(FOLDERS))
    folders = seen.filter(F.size(parts) > 1).select(F.explode(F.transform(above, lambda p: F.array_join(p, "/"))).alias("path")).distinct().select("path", F.lit("data_dir").alias("kind"))
    return files.unionByName(folders)
