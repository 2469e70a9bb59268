"""Views that give the operators something to work on in the driver's tables. Each is one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # part as seams: classes, abstract classes, functions and run-time imports
    "v_seams": """
      SELECT lower(replace(p_brand, '#', '_')) AS module, p_partkey AS seam_ord, p_size AS lineno,
        CASE WHEN p_partkey % 11 = 0 THEN 'dynamic_import' WHEN p_size % 3 = 0 THEN 'class' WHEN p_size % 3 = 1 THEN 'abstract_class' ELSE 'function' END AS kind,
        CASE WHEN p_partkey % 11 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN '__import__' WHEN 1 THEN 'entry_points' WHEN 2 THEN 'import_module' ELSE 'find_spec' END
             WHEN p_size % 3 = 2 THEN CASE p_partkey % 6 WHEN 0 THEN 'on_' WHEN 1 THEN 'register_' WHEN 2 THEN 'Add_' ELSE '' END || replace(p_name, ' ', '_')
             ELSE replace(p_name, ' ', '_') || CASE p_type WHEN 'ECONOMY' THEN 'Plugin' WHEN 'PROMO' THEN 'Handler' WHEN 'STANDARD' THEN 'Base' ELSE '' END END AS name,
        CASE WHEN p_partkey % 11 = 0 THEN ''
             WHEN p_size % 3 = 2 THEN CASE p_partkey % 5 WHEN 0 THEN 'app.route' WHEN 1 THEN 'staticmethod, Command' ELSE '' END
             ELSE CASE p_partkey % 4 WHEN 0 THEN 'abc.ABC' WHEN 1 THEN 'Mixin, core.BaseHandler' WHEN 2 THEN 'object' ELSE '' END END AS detail,
        p_partkey % 7 = 0 AS reexported, p_partkey % 5 = 0 AS has_override_point
      FROM part""",
    # lineitem as seams of many modules; lines that are equal in the ordinal, their module and their number are equal in all
    "v_seams_big": """
      SELECT 'm' || CAST(l_orderkey % 5000 AS STRING) AS module, l_partkey * 100000 + l_suppkey AS seam_ord, l_linenumber AS lineno,
        CASE WHEN l_suppkey % 4 = 0 THEN 'class' WHEN l_suppkey % 4 = 1 THEN 'abstract_class' ELSE 'function' END AS kind,
        CASE WHEN l_partkey % 3 = 0 THEN 'on_event' WHEN l_partkey % 3 = 1 THEN 'JobHandler' ELSE 'plain' END AS name,
        CASE WHEN l_partkey % 5 = 0 THEN 'core.Base' ELSE '' END AS detail, l_suppkey % 7 = 0 AS reexported, l_suppkey % 5 = 0 AS has_override_point
      FROM lineitem""",
    "v_sinks": """
      SELECT event_type AS id, 'u' || CAST(user_id % 20 AS STRING) AS module, props AS call, event_id AS ord, CAST(user_id % 50 AS INT) AS lineno,
        CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS severity,
        CASE WHEN user_id % 3 = 0 THEN 'high' WHEN user_id % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence,
        CASE event_type WHEN 'error' THEN 'process' WHEN 'view' THEN 'dynamic_load' ELSE 'code_exec' END AS category,
        CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 1 END AS side
      FROM events""",
    "v_points": """
      SELECT l_orderkey AS id, 1 + (l_linenumber + 1) % 2 AS side, l_partkey * 100000 + l_suppkey AS ord, l_returnflag AS kind, l_linestatus AS category,
        CASE WHEN l_quantity < 10 THEN NULL ELSE 'def f(' || CAST(l_suppkey % 3 AS STRING) || ')' END AS signature,
        CASE WHEN l_tax > 0.05 THEN 'a, b' ELSE 'a' END AS implement
      FROM lineitem""",
    "v_candidates": """
      SELECT lang AS target, CAST(doc_id AS STRING) AS id, CAST((n_chars - n_chars % 500) / 500 AS BIGINT) AS score, source AS module, 1 AS lineno, doc_id AS seam_ord
      FROM documents""",
    # labels of good documents; those of toxic ones name something that is no candidate
    "v_labels": """
      SELECT d.lang AS target, CASE WHEN l.toxic = 1 THEN 'not ' ELSE '' END || CAST(l.doc_id AS STRING) AS id FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality = 1 OR l.toxic = 1""",
    "v_uses": "SELECT l_suppkey AS package, l_partkey AS symbol FROM lineitem",
    "v_symbol_labels": "SELECT p_partkey AS symbol FROM part WHERE p_size <= 25 UNION ALL SELECT -1 - s_suppkey AS symbol FROM supplier",
    "v_findings": """
      SELECT 'src/f' || CAST(l_orderkey AS STRING) || CASE WHEN l_partkey % 2 = 0 THEN '.ts' ELSE '.js' END AS path, 3 * l_linenumber AS line, CASE l_returnflag WHEN 'R' THEN 'R' ELSE 'A' END AS tool
      FROM lineitem""",
    "v_hosts": "SELECT split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS dir, page_id FROM pages",
    "v_imports": """
      SELECT split_part(url, '/', 3) AS src, CASE page_id % 4 WHEN 0 THEN '..' || replace(split_part(url, '/', 3), split_part(split_part(url, '/', 3), '.', 1) || '.', '')
        WHEN 1 THEN split_part(split_part(url, '/', 3), '.', 1) WHEN 2 THEN 'not.there' ELSE split_part(url, '/', 3) END AS import
      FROM pages""",
    "v_calls": """
      SELECT event_id AS ord, CAST(user_id % 9 AS INT) AS lineno, 'mod' || CAST(user_id % 30 AS STRING) AS module, user_id % 2 = 0 AS shell_true,
        CASE event_type WHEN 'view' THEN 'a.b.subprocess.run' WHEN 'click' THEN 'eval' WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'x.eval' WHEN 1 THEN 'os.system' ELSE 'my.yaml.load' END
          WHEN 'purchase' THEN 'importlib.import_module' ELSE 'json.loads' END AS dotted
      FROM events""",
    "v_modules": """
      SELECT c_custkey AS ord, CASE c_custkey % 3 WHEN 0 THEN 'pkg' || CAST(c_nationkey AS STRING) || '/__init__.py'
        WHEN 1 THEN 'pkg' || CAST(c_nationkey AS STRING) || '/sub' || CAST(c_custkey % 50 AS STRING) || '/__init__.py' ELSE 'lib' || CAST(c_custkey AS STRING) || '/core/__init__.py' END AS path
      FROM customer""",
    "v_functions": """
      SELECT 'm' || CAST(o_custkey % 500 AS STRING) AS module, 'f' || CAST(o_orderkey % 7 AS STRING) AS name, o_orderkey AS ord, o_orderstatus = 'F' AS is_stub, o_orderpriority AS body
      FROM orders""",
    "v_attempts": """
      SELECT conv_id AS point, CAST(turn + 1 AS INT) AS n, length(text) >= 80 AND role = 'assistant' AS ok FROM conversations""",
    "v_paths": """
      SELECT split_part(url, '/', 4) || '/' || CASE page_id % 5 WHEN 0 THEN 'plugins' WHEN 1 THEN 'src' WHEN 2 THEN 'Data' WHEN 3 THEN 'node_modules' ELSE 'lib' END || '/' ||
        CASE page_id % 3 WHEN 0 THEN 'config' WHEN 1 THEN 'Settings' ELSE 'main' END || '.' || CASE page_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'YAML' WHEN 2 THEN 'py' ELSE 'toml' END AS path
      FROM pages""",
    "v_prompts": "SELECT doc_id, source, coalesce(text, '') AS prompt FROM documents",
    "v_scaffolds": """
      SELECT p_partkey AS ord, lower(replace(p_brand, '#', '_')) || ':' || replace(p_name, ' ', '') AS id, lower(replace(p_brand, '#', '_')) AS module, replace(p_name, ' ', '') AS symbol,
        CASE WHEN p_size % 3 = 0 THEN 'class' WHEN p_size % 3 = 1 THEN 'abstract_class' ELSE 'function' END AS kind, lower(p_type) AS category,
        CASE WHEN p_partkey % 2 = 0 THEN 'def f(a, b)' ELSE '' END AS signature,
        CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'def run(self)' ELSE 'def load(self, path);def save(self)' END AS methods
      FROM part""",
    "v_names": "SELECT p_partkey AS ord, p_name, p_brand, p_type FROM part",
}

TABLES = "part lineitem events documents labels pages customer orders conversations supplier".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql}
    for t in names:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **names)


def ctes(*names: str) -> str:
    """The WITH clause that gives the same views to SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
