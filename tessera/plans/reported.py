"""Queries over the lines of reports; SQL puts the same lines together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.functions import render
from tessera.operators import docgen, evaluate, ranking
from tessera.sources import config_scan

from .adapters import ctes, view
from .catalogue import _EVAL, _POINTS, _SEV, _SIGNALS, K, QUERIES, TOP, _points, query

_bar = lambda *xs: "'| ' || " + " || ' | ' || ".join(f"replace(CAST({x} AS STRING), '|', '\\|')" for x in xs) + " || ' |'"
_2 = lambda x: f"printf('%.2f', {x})"


@query("detect_report", f"""{_POINTS}, s AS (SELECT *, {_SIGNALS} AS why FROM points WHERE category <> 'plugin_loader'), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, module, lineno, seam_ord) AS rank FROM s),
  c AS (SELECT score AS cutoff FROM t WHERE rank = {TOP}), n AS (SELECT cutoff, count(*) FILTER (score = cutoff) AS band, count(*) FILTER (score > cutoff) AS above FROM t, c GROUP BY 1)
  SELECT 'point' AS part, {_bar('rank', "module || ':' || name", 'category', _2('score'), 'why')} AS line FROM t WHERE rank <= {TOP}
  UNION ALL SELECT 'tie', CAST(band AS STRING) || ' points score ' || {_2('cutoff')} || '; ' || CASE WHEN band + above > {TOP} THEN CAST(band + above - {TOP} AS STRING) || ' of them aren''t shown, and by name only.' ELSE 'their order is that of their names.' END FROM n WHERE band >= 2
  UNION ALL SELECT 'loader', '- ' || module || ':' || name || CASE WHEN count(*) > 1 THEN ' (' || CAST(count(*) AS STRING) || ' sites)' ELSE '' END FROM points WHERE category = 'plugin_loader' GROUP BY module, name""")
def _(spark, d):
    p = _points(spark, d)
    of = lambda part, lines: lines.select(F.lit(part).alias("part"), "line")
    return of("point", render.detect_lines(p, TOP)).unionByName(of("tie", render.tie_lines(p, TOP))).unionByName(of("loader", render.loader_lines(p)))


@query("detect_entries", f"""{_POINTS}, s AS (SELECT *, {_SIGNALS} AS why, count(*) OVER (PARTITION BY score, category = 'plugin_loader') - 1 AS tied FROM points)
  SELECT seam_ord, '{{"id":"' || module || ':' || name || '","module":"' || module || '","category":"' || category || '","score":' || CAST(round(score, 4) AS STRING) || ',"tied_with":' || CASE WHEN category = 'plugin_loader' THEN '0' ELSE CAST(tied AS STRING) END
    || ',"kind":"' || kind || '","signals":["' || replace(why, '; ', '","') || '"]}}' AS line FROM s""")
def _(spark, d):
    return render.detect_entries(_points(spark, d)).select("seam_ord", "line")


@query("audit_report", f"""{ctes('v_sinks')} SELECT ord, {_bar('severity', 'confidence', 'id', "module || ':' || CAST(lineno AS STRING)")} AS line FROM v_sinks
  UNION ALL SELECT -1, string_agg(CAST(n AS STRING) || ' ' || severity, ', ' ORDER BY {_SEV('severity')}) FROM (SELECT severity, count(*) AS n FROM v_sinks GROUP BY 1) c""")
def _(spark, d):
    found = view(spark, d, "v_sinks")
    return render.audit_lines(found).select("ord", "line").unionByName(render.count_lines(found).select(F.lit(-1).cast("long").alias("ord"), "line"))


@query("audit_entries", f"""{ctes('v_sinks')} SELECT ord, '{{"id":"' || id || '","category":"' || category || '","severity":"' || severity || '","confidence":"' || confidence || '","module":"' || module || '","call":"' || replace(call, '"', '\\"') || '","lineno":' || CAST(lineno AS STRING) || '}}' AS line FROM v_sinks""")
def _(spark, d):
    return render.audit_entries(view(spark, d, "v_sinks")).select("ord", "line")


def _from(name: str) -> str:
    from .catalogue import ORACLE_SQL

    return ORACLE_SQL[name]


@query("manifest_report", f"""SELECT change, '- ' || CAST(id AS STRING) || CASE WHEN field IS NOT NULL THEN ': ' || field || ' ' || coalesce('''' || old || '''', 'None') || ' -> ' || coalesce('''' || new || '''', 'None') ELSE '' END AS line FROM ({_from('manifest_diff')}) x""")
def _(spark, d):
    return render.change_lines(QUERIES["manifest_diff"](spark, d)).select("change", "line")


@query("surface_report", f"""WITH x AS ({_from('surface_diff')}) SELECT {_bar('direction', 'severity', 'id', 'module', 'call', '"count"')} AS line FROM x
  UNION ALL SELECT CAST(coalesce(sum("count") FILTER (direction = 'introduced'), 0) AS STRING) || ' introduced, ' || CAST(coalesce(sum("count") FILTER (direction = 'removed'), 0) AS STRING) || ' removed' FROM x""")
def _(spark, d):
    changes = QUERIES["surface_diff"](spark, d)
    return render.surface_lines(changes).select("line").unionByName(render.verdict_lines(changes))


@query("surface_verdict", f"""WITH x AS ({_from('surface_diff')}) SELECT t.threshold, count(*) FILTER (x.direction = 'introduced' AND {_SEV('x.severity')} <= t.r) > 0 AS failed FROM x, (VALUES ('high', 0), ('medium', 1), ('low', 2)) t(threshold, r) GROUP BY 1""")
def _(spark, d):
    changes = QUERIES["surface_diff"](spark, d)
    each = [changes.agg(F.count_if((F.col("direction") == "introduced") & (render.sinks.rank_of(F.col("severity")) <= r)).alias("n")).select(F.lit(t).alias("threshold"), (F.col("n") > 0).alias("failed")) for t, r in render.sinks.SEVERITY_RANK.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("config_report", f"SELECT {_bar('kind', 'path')} AS line FROM ({_from('config_points')}) x")
def _(spark, d):
    return render.config_lines(config_scan.config_points(view(spark, d, "v_paths"))).select("line")


@query("score_report", f"""{_EVAL}, n AS (SELECT target, n FROM size), s AS (SELECT lr.target, any_value(coalesce(n.n, 0)) AS nc, count(*) AS nl, string_agg(CAST(rank AS STRING), ', ' ORDER BY rank) AS ranks, count(*) FILTER (rank <= {K}) AS hits,
    count(*) FILTER (worst <= {K}) AS w, count(*) FILTER (best <= {K}) AS b, median(CAST(rank AS DOUBLE)) AS m FROM lr LEFT JOIN n ON n.target = lr.target GROUP BY 1)
  SELECT target, {_bar('target', 'nc', 'nl', 'ranks', "CAST(hits AS STRING) || '/' || CAST(nl AS STRING) || CASE WHEN w <> b THEN ' (' || CAST(w AS STRING) || '..' || CAST(b AS STRING) || ')' ELSE '' END", "printf('%.1f', m)")} AS line FROM s""")
def _(spark, d):
    ranked = ranking.ranked(view(spark, d, "v_candidates"), ["target"])
    return render.score_lines(evaluate.scores(ranked, view(spark, d, "v_labels"), K)).select("target", "line")


# --- documentation run: E13, E14, E16, K8, U9 ---
_FENCE = "chr(10) || '---' || chr(10)"


@query("prompts", f"""{ctes('v_names')} SELECT ord, 'guide' AS kind, 'How is this point extended? Say what it is, when it is used, and the steps, by these facts only.' || chr(10) || chr(10) || p_name AS prompt FROM v_names
  UNION ALL SELECT ord, 'example', 'Write the smallest plugin for this point, as one Python code block and nothing else. Import from ' || p_brand || '; subclass a class, and give each abstract method a body. Use names of these facts only.' || chr(10) || chr(10) || p_name FROM v_names
  UNION ALL SELECT min(ord), 'overview', 'How can this codebase be extended? Group its points by kind, by these facts only.' || chr(10) || chr(10) || CAST(count(DISTINCT p_brand) AS STRING) || ' modules, ' || CAST(count(*) AS STRING) || ' dependencies' || chr(10) || chr(10)
    || string_agg(p_name, {_FENCE} ORDER BY ord) FROM v_names""")
def _(spark, d):
    n = view(spark, d, "v_names")
    of = lambda kind, text: n.select("ord", F.lit(kind).alias("kind"), text.alias("prompt"))
    facts = n.agg(F.min("ord").alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "p_name"))), lambda x: x["p_name"]).alias("facts"), F.countDistinct("p_brand").alias("m"), F.count(F.lit(1)).alias("e"))
    overview = facts.select("ord", F.lit("overview").alias("kind"), docgen.overview_prompt(F.col("facts"), F.col("m"), F.col("e")).alias("prompt"))
    return of("guide", docgen.guide_prompt(F.col("p_name"))).unionByName(of("example", docgen.example_prompt(F.col("p_name"), F.col("p_brand")))).unionByName(overview)


@query("remedies", f"""{ctes('v_names')}, r AS (SELECT ord, CASE ord % 4 WHEN 0 THEN 'missing_dependency' WHEN 1 THEN 'not_found' WHEN 2 THEN 'import_error' ELSE 'ok' END AS reason, lower(p_type) || '.sub' AS missing FROM v_names)
  SELECT ord, CASE reason WHEN 'missing_dependency' THEN missing || ' isn''t installed: pip install ' || string_split(missing, '.')[1] || ', then run again.' WHEN 'not_found' THEN 'The package can''t be imported: pip install -e . in its folder, then run again.'
    WHEN 'import_error' THEN 'Mend the error above, then run again.' ELSE '' END AS remedy FROM r""")
def _(spark, d):
    k = F.col("ord") % 4
    reason = F.when(k == 0, "missing_dependency").when(k == 1, "not_found").when(k == 2, "import_error").otherwise("ok")
    return view(spark, d, "v_names").select("ord", docgen.remedy(reason, F.concat(F.lower("p_type"), F.lit(".sub"))).alias("remedy"))


@query("source_archives", f"""{ctes('v_names')} SELECT ord, 'https://repo1.maven.org/maven2/' || replace('org.' || lower(p_type), '.', '/') || '/' || replace(p_name, ' ', '-') || '/' || CAST(ord AS STRING) || '/' || replace(p_name, ' ', '-') || '-' || CAST(ord AS STRING) || '-sources.jar' AS url,
  'cache/' || replace(p_name, ' ', '-') || '-' || CAST(ord AS STRING) AS folder FROM v_names""")
def _(spark, d):
    name, version = F.replace("p_name", F.lit(" "), F.lit("-")), F.col("ord").cast("string")
    return view(spark, d, "v_names").select("ord", N.archive_url(F.concat(F.lit("org."), F.lower("p_type"), F.lit(":"), name), version).alias("url"), N.archive_folder(F.lit("cache"), name, version).alias("folder"))


@query("doc_files", f"""{ctes('v_scaffolds')} SELECT ord, 'examples/' || regexp_replace(id, '[^\\p{{L}}\\p{{N}}]', '_', 'g') || '.' || CASE ord % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'ts' ELSE 'java' END AS path,
  '| [' || id || '](guide.md) | ' || category || ' | ' || module || ' | ' || CASE ord % 2 WHEN 0 THEN 'compiled' ELSE 'UNVERIFIED' END || ' |' AS line FROM v_scaffolds""")
def _(spark, d):
    s = view(spark, d, "v_scaffolds")
    language = F.when(F.col("ord") % 3 == 0, "python").when(F.col("ord") % 3 == 1, "typescript").otherwise("java")
    status = F.when(F.col("ord") % 2 == 0, "compiled").otherwise("unverified")
    return s.select("ord", docgen.example_path(F.col("id"), language).alias("path"), docgen.index_line(F.col("id"), F.col("category"), F.col("module"), status).alias("line"))


@query("cached_answers", f"""{ctes('v_prompts')}, keyed AS (SELECT doc_id, sha256(source || chr(0) || lang) AS key FROM (SELECT doc_id, source, coalesce(lang, '') AS lang FROM documents) d), c AS (SELECT sha256(d.source || chr(0) || coalesce(d.lang, '')) AS key, max(CAST(n_chars AS STRING)) AS response FROM documents d GROUP BY 1)
  SELECT k.doc_id, c.response FROM keyed k LEFT JOIN c ON c.key = k.key""")
def _(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    keyed = t.select("doc_id", docgen.cache_key(F.col("source"), F.coalesce("lang", F.lit(""))).alias("key"), F.col("n_chars").cast("string").alias("response"))
    return docgen.cached(keyed.select("doc_id", "key"), keyed.select("key", "response")).select("doc_id", "response")

