"""Queries of the source scan and the text rules, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from randaudit.functions import lexicon as lx
from randaudit.functions import text_rules as tr
from randaudit.jobs.fixtures import view, with_views
from randaudit.operators import source_scan as scan
from randaudit.sources import contracts as src
from randaudit.sources import named_files
from randaudit.sources.scratch import shared_dir, stored

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "contract_source")


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def joined(name: str) -> F.Column:
    return F.array_join(name, ",").alias(name)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- SQL building blocks (DuckDB) ---
_LEX = "lex(ord, pattern, source_type, base_risk, description, regex) AS (VALUES " + ", ".join(
    f"({k}, {lit(p)}, {lit(t)}, CAST({risk} AS DOUBLE), {lit(d)}, {lit(lx.token_regex(p))})" for k, (p, t, risk, d) in enumerate(lx.LEXICON)
) + ")"


def _tokens_sql(source: str, code: str, keys: str, lex: str = "lex") -> str:
    return f"""pieces AS (SELECT {keys}, {code}, l.*, string_split_regex({code}, l.regex) AS parts FROM {source}, {lex} l WHERE regexp_matches({code}, l.regex)),
tokens AS (SELECT * EXCLUDE (parts, k), CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(pattern) AS BIGINT) AS position
  FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM pieces))"""


def _score_sql(name: str, text: str) -> str:
    return " + ".join(f"CAST(regexp_matches(lower({text}), {lit('(?i)' + r)}) AS INT)" for r in lx.CONTEXTS[name])


def _use_sql(text: str, source: str, into: str) -> str:
    best = "greatest(gam, tim, ran, acc)"
    highest = f"CASE {best} WHEN gam THEN 'gambling' WHEN tim THEN 'timing' WHEN ran THEN 'randomness' ELSE 'access_control' END"
    return f"""{into}_s AS (SELECT *, {_score_sql('gambling', text)} AS gam, {_score_sql('timing', text)} AS tim, {_score_sql('randomness', text)} AS ran,
  {_score_sql('access_control', text)} AS acc FROM {source}),
{into} AS (SELECT *, CASE usage_context WHEN 'unknown' THEN base_risk
    ELSE greatest(CAST(0.1 AS DOUBLE), least(CAST(1.0 AS DOUBLE), base_risk * CAST(CASE usage_context WHEN 'gambling' THEN 1.3 WHEN 'timing' THEN 0.5 WHEN 'randomness' THEN 1.5 ELSE 0.3 END AS DOUBLE))) END AS contextual_risk
  FROM (SELECT *, CASE WHEN {best} = 0 THEN 'unknown'
    WHEN pattern IN ('block.timestamp', 'now') THEN CASE WHEN gam > 0 THEN 'gambling' WHEN tim > 0 AND ran = 0 THEN 'timing' WHEN ran > 0 THEN 'randomness' ELSE {highest} END
    WHEN pattern = 'msg.sender' THEN CASE WHEN ran > 0 OR gam > 0 THEN 'randomness' WHEN acc > 0 THEN 'access_control' ELSE {highest} END
    WHEN pattern IN ('block.difficulty', 'blockhash', 'block.prevrandao') THEN 'randomness' ELSE {highest} END AS usage_context FROM {into}_s))"""


def _level_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 0.8 THEN 'critical' WHEN {x} >= 0.6 THEN 'high' WHEN {x} >= 0.4 THEN 'medium' ELSE 'low' END"


def _nested_sql(code: str) -> str:
    before = f"substr({code}, CAST(greatest(position - 200, 0) + 1 AS BIGINT), CAST(position - greatest(position - 200, 0) AS BIGINT))"
    return "(" + " OR ".join(f"regexp_matches({before}, {lit(r)})" for r in lx.NESTED) + ")"


_FACTORS_SQL = """concat_ws(',', CASE usage_context WHEN 'gambling' THEN 'gambling_context,high_stakes,manipulation_incentive' WHEN 'randomness' THEN 'randomness_generation,predictable_source'
  WHEN 'timing' THEN 'time_dependency,miner_influence' WHEN 'access_control' THEN 'access_check,low_risk' END, CASE WHEN is_nested THEN 'complex_expression' END)"""
_CONTEXT_SQL = "substr(code, CAST(greatest(position - 200, 0) + 1 AS BIGINT), CAST(position + length(pattern) + 200 - greatest(position - 200, 0) AS BIGINT))"
_HITS = f"""WITH {_LEX}, {_tokens_sql('contract_source', 'code', 'contract_id')},
near AS (SELECT * EXCLUDE (code), {_CONTEXT_SQL} AS context, {_nested_sql('code')} AS is_nested FROM tokens),
{_use_sql('context', 'near', 'used')},
token_hits AS (SELECT contract_id, concat('source_', replace(pattern, '.', '_'), '_', position) AS node_id, source_type, pattern, position, pattern AS matched_text, 'function' AS context_type,
  'unknown' AS context_name, substr(context, 1, 200) AS snippet, {_level_sql('contextual_risk')} AS risk_level, base_risk, contextual_risk, usage_context, 'CWE-330' AS cwe, description,
  is_nested, {_FACTORS_SQL} AS risk_factors, 'token' AS kind FROM used)"""


def _combined_sql(source: str, code: str, keys: str) -> str:
    rules = ", ".join(f"({k}, {lit('(?i)' + r)})" for k, r in enumerate(lx.COMBINED))
    return f"""rules(rule, rx) AS (VALUES {rules}),
cut AS (SELECT {keys}, {code}, rule, string_split_regex({code}, rx) AS parts, regexp_extract_all({code}, rx) AS ms FROM {source}, rules WHERE regexp_matches({code}, rx)),
combined AS (SELECT {keys}, {code}, rule, ms[k] AS text, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS position
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM cut))"""


_COMBINED_HITS = """combined_hits AS (SELECT contract_id, concat('source_combined_', position) AS node_id, 'combined' AS source_type, 'combined_sources' AS pattern, position, text AS matched_text, 'function' AS context_type,
  'unknown' AS context_name, text AS snippet, 'critical' AS risk_level, CAST(0.95 AS DOUBLE) AS base_risk, CAST(0.95 AS DOUBLE) AS contextual_risk, 'randomness' AS usage_context, 'CWE-330' AS cwe,
  'Multiple randomness sources combined' AS description, true AS is_nested, 'combined_sources,high_predictability' AS risk_factors, 'combined' AS kind FROM combined)"""
_STATE = lit("(?m)" + lx.STATE_VARIABLE)
_STATE_HITS = f"""state_cut AS (SELECT contract_id, string_split_regex(code, {_STATE}) AS parts, regexp_extract_all(code, {_STATE}) AS ms, regexp_extract_all(code, {_STATE}, 2) AS names,
    regexp_extract_all(code, {_STATE}, 3) AS vals FROM contract_source WHERE regexp_matches(code, {_STATE})),
state_found AS (SELECT contract_id, ms[k] AS text, names[k] AS name, vals[k] AS val,
    CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS position
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM state_cut)),
state_all AS (SELECT s.*, l.pattern, l.source_type, l.base_risk * CAST(0.8 AS DOUBLE) AS risk, concat('source_state_', name, '_', replace(l.pattern, '.', '_')) AS node_id
  FROM state_found s JOIN lex l ON contains(s.val, l.pattern)),
state_hits AS (SELECT contract_id, node_id, source_type, pattern, position, pattern AS matched_text, 'state' AS context_type, name AS context_name, text AS snippet, {_level_sql('risk')} AS risk_level,
  risk AS base_risk, risk AS contextual_risk, 'state_initialization' AS usage_context, 'CWE-330' AS cwe, concat('State variable initialized with ', pattern) AS description, false AS is_nested,
  'state_variable,initialization' AS risk_factors, 'state' AS kind FROM state_all QUALIFY row_number() OVER (PARTITION BY contract_id, node_id ORDER BY position DESC) = 1)"""
_ALL = f"""{_HITS}, {_combined_sql('contract_source', 'code', 'contract_id')}, {_COMBINED_HITS}, {_STATE_HITS},
all_hits AS (SELECT * FROM token_hits UNION ALL BY NAME SELECT * FROM combined_hits UNION ALL BY NAME SELECT * FROM state_hits)"""


def _flat(hits: DataFrame) -> DataFrame:
    """Hits with arrays as text and whole numbers as long, for comparison."""
    return hits.withColumn("risk_factors", F.array_join("risk_factors", ",")).withColumn("position", F.col("position").cast("long"))


@query(with_views(f"{_HITS} SELECT usage_context, risk_level, count(*) AS n_hits, count(DISTINCT contract_id) AS n_contracts, round(avg(contextual_risk), 6) AS avg_risk FROM token_hits GROUP BY ALL", "contract_source"))
def source_risk_summary(spark, sf_dir):
    return scan.risk_summary(scan.token_hits(contracts(spark, sf_dir)))


@query(with_views(f"WITH {_LEX}, {_tokens_sql('contract_source', 'code', 'contract_id')} SELECT contract_id, pattern, position, CAST(len(string_split(substr(code, 1, CAST(position AS BIGINT)), chr(10))) AS BIGINT) AS line_number FROM tokens", "contract_source"))
def token_positions(spark, sf_dir):
    found = scan.tokens(contracts(spark, sf_dir))
    return found.withColumn("line_number", tr.line_number("code", "position")).select("contract_id", "pattern", *long("position", "line_number"))


@query(with_views(f"{_HITS} SELECT contract_id, pattern, position, context, substr(context, 1, 200) AS snippet FROM near", "contract_source"))
def source_context(spark, sf_dir):
    found = scan.tokens(contracts(spark, sf_dir)).withColumn("context", scan.context())
    return found.select("contract_id", "pattern", *long("position"), "context", F.substring("context", 1, 200).alias("snippet"))


@query(with_views(f"{_HITS} SELECT contract_id, pattern, position, CAST(gam AS BIGINT) AS gambling, CAST(tim AS BIGINT) AS timing, CAST(ran AS BIGINT) AS randomness, CAST(acc AS BIGINT) AS access_control, usage_context, contextual_risk, is_nested FROM used", "contract_source"))
def usage_context(spark, sf_dir):
    found = scan.tokens(contracts(spark, sf_dir)).withColumn("context", scan.context()).withColumn("is_nested", scan.is_nested()).drop("code")
    used = scan.usage_context(found.select("*", *[s.cast("long").alias(n) for n, s in scan.scores(F.lower("context")).items()]))
    risk = scan.contextual_risk(F.col("base_risk"), F.col("usage_context")).alias("contextual_risk")
    return used.select("contract_id", "pattern", *long("position"), "gambling", "timing", "randomness", "access_control", "usage_context", risk, "is_nested")


@query(with_views(f"{_HITS} SELECT * FROM token_hits", "contract_source"))
def source_hits(spark, sf_dir):
    return _flat(scan.token_hits(contracts(spark, sf_dir)))


@query(with_views(f"WITH {_combined_sql('contract_source', 'code', 'contract_id')} SELECT contract_id, CAST(rule AS BIGINT) AS rule, position, text FROM combined", "contract_source"))
def combined_sources(spark, sf_dir):
    return scan.combined(contracts(spark, sf_dir)).select("contract_id", *long("rule", "position"), "text")


@query(with_views(f"WITH {_LEX}, {_combined_sql('contract_source', 'code', 'contract_id')} SELECT contract_id, CAST(rule AS BIGINT) AS rule, position, string_agg(pattern, ',' ORDER BY ord) AS individual FROM combined JOIN lex ON contains(text, pattern) GROUP BY ALL", "contract_source"))
def combined_individuals(spark, sf_dir):
    found = scan.combined(contracts(spark, sf_dir)).withColumn("individual", scan.individual_sources(F.col("text")))
    return found.where(F.size("individual") > 0).select("contract_id", *long("rule", "position"), joined("individual"))


@query(with_views(f"WITH {_LEX}, {_STATE_HITS} SELECT * FROM state_hits", "contract_source"))
def state_var_sources(spark, sf_dir):
    return _flat(scan.state_variable_hits(contracts(spark, sf_dir)))


_BODIES = f"""bodies_all AS (SELECT contract_id, unnest(regexp_extract_all(code, {lit(lx.FUNCTION)}, 1)) AS function, unnest(regexp_extract_all(code, {lit(lx.FUNCTION)}, 2)) AS body,
    unnest(range(len(regexp_extract_all(code, {lit(lx.FUNCTION)})))) AS ord FROM contract_source
  UNION ALL SELECT contract_id, 'constructor', regexp_extract(code, {lit(lx.CONSTRUCTOR)}, 1), 1000000 FROM contract_source WHERE regexp_matches(code, {lit(lx.CONSTRUCTOR)})),
bodies AS (SELECT contract_id, function, body FROM bodies_all QUALIFY row_number() OVER (PARTITION BY contract_id, function ORDER BY ord DESC) = 1)"""


@query(with_views(f"WITH {_BODIES} SELECT contract_id, function, body FROM bodies", "contract_source"))
def function_bodies(spark, sf_dir):
    return scan.functions(contracts(spark, sf_dir))


@query(with_views(f"""WITH {_LEX}, {_BODIES}, {_tokens_sql('bodies', 'body', 'contract_id, function')},
bounds AS (SELECT *, position + length(pattern) AS e, greatest(position - 1000, 0) AS low, least(length(body), position + length(pattern) + 1000) AS high FROM tokens),
semis AS (SELECT *, instr(reverse(substr(body, CAST(low + 1 AS BIGINT), CAST(position - low AS BIGINT))), ';') AS back, instr(substr(body, CAST(e + 1 AS BIGINT), CAST(high - e AS BIGINT)), ';') AS ahead FROM bounds),
span AS (SELECT *, CASE WHEN back > 0 THEN position - back + 1 ELSE low END AS f, CASE WHEN ahead > 0 THEN e + ahead ELSE high END AS t FROM semis),
near AS (SELECT * EXCLUDE (body), CASE WHEN length(body) < 2000 THEN body ELSE regexp_replace(substr(body, CAST(f + 1 AS BIGINT), CAST(t - f AS BIGINT)), '^\\s+|\\s+$', '', 'g') END AS context,
  {_nested_sql('body')} AS is_nested, len(string_split(substr(body, 1, CAST(position AS BIGINT)), chr(10))) AS line_number FROM span),
{_use_sql('context', 'near', 'used')},
{_combined_sql('bodies', 'body', 'contract_id, function')},
both_hits AS (SELECT contract_id, function, concat('source_combined_', function, '_', position) AS node_id, 'combined' AS source_type, 'combined_sources' AS pattern, position,
  len(string_split(substr(body, 1, CAST(position AS BIGINT)), chr(10))) AS line_number, CAST(0.95 AS DOUBLE) AS base_risk, CAST(0.95 AS DOUBLE) AS contextual_risk, 'randomness' AS usage_context, text AS snippet, true AS is_nested,
  'combined_sources,high_predictability' AS risk_factors, (SELECT coalesce(string_agg(pattern, ',' ORDER BY ord), '') FROM lex WHERE contains(text, pattern)) AS individual_sources
  FROM combined QUALIFY row_number() OVER (PARTITION BY contract_id, function, position ORDER BY rule DESC) = 1)
SELECT contract_id, function, concat('source_', replace(pattern, '.', '_'), '_', function, '_', position) AS node_id, source_type, pattern, position, CAST(line_number AS BIGINT) AS line_number, base_risk, contextual_risk,
  usage_context, substr(context, 1, 200) AS snippet, is_nested, {_FACTORS_SQL} AS risk_factors, '' AS individual_sources FROM used
UNION ALL BY NAME SELECT * REPLACE (CAST(line_number AS BIGINT) AS line_number) FROM both_hits""", "contract_source"))
def function_sources(spark, sf_dir):
    hits = scan.function_hits(scan.functions(contracts(spark, sf_dir)))
    return _flat(hits).withColumn("line_number", F.col("line_number").cast("long")).withColumn("individual_sources", F.array_join("individual_sources", ","))


@query(with_views(f"{_ALL} SELECT * FROM all_hits", "contract_source"))
def all_sources(spark, sf_dir):
    return _flat(scan.detect(contracts(spark, sf_dir)))


@query(with_views(f"""{_ALL},
t AS (SELECT contract_id, string_agg(concat(source_type, '=', n), ',' ORDER BY source_type) AS by_type FROM (SELECT contract_id, source_type, count(*) AS n FROM all_hits GROUP BY ALL) GROUP BY contract_id),
r AS (SELECT contract_id, string_agg(concat(risk_level, '=', n), ',' ORDER BY risk_level) AS by_risk FROM (SELECT contract_id, risk_level, count(*) AS n FROM all_hits WHERE kind <> 'state' GROUP BY ALL) GROUP BY contract_id),
c AS (SELECT contract_id, count(*) AS total_sources, count(*) FILTER (WHERE is_nested AND kind <> 'state') AS nested_sources FROM all_hits GROUP BY contract_id)
SELECT contract_id, total_sources, nested_sources, by_type, coalesce(by_risk, '') AS by_risk FROM c LEFT JOIN t USING (contract_id) LEFT JOIN r USING (contract_id)""", "contract_source"))
def source_statistics(spark, sf_dir):
    found = scan.statistics(scan.detect(contracts(spark, sf_dir)))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(m)
    return found.select("contract_id", *long("total_sources", "nested_sources"), text("by_type"), text("by_risk"))


@query(with_views(f"""{_ALL} SELECT contract_id, source_type, risk_level, count(*) AS n, count(*) FILTER (WHERE kind <> 'state') AS ranked, count(*) FILTER (WHERE is_nested AND kind <> 'state') AS nested
FROM all_hits GROUP BY GROUPING SETS ((contract_id, source_type), (contract_id, risk_level), (contract_id))""", "contract_source"))
def source_statistics_long(spark, sf_dir):
    return scan.statistics_long(scan.detect(contracts(spark, sf_dir)))


_EXT = "ext(pattern, controller, level, misuse, regex, base_risk) AS (VALUES " + ", ".join(f"({lit(p)}, {lit(c)}, {lit(v)}, {lit(m)}, {lit(lx.token_regex(p))}, CAST(0.5 AS DOUBLE))" for p, c, v, m in lx.EXTENDED) + ")"


@query(with_views(f"""WITH {_EXT}, {_tokens_sql('contract_source', 'code', 'contract_id', 'ext')}, near AS (SELECT * EXCLUDE (code), {_CONTEXT_SQL} AS context FROM tokens), {_use_sql('context', 'near', 'used')}
SELECT contract_id, pattern, position, usage_context, controller, level, misuse FROM used""", "contract_source"))
def extended_sources(spark, sf_dir):
    return scan.extended_hits(contracts(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


def _files(spark, sf_dir):
    found = contracts(spark, sf_dir).withColumn("file_name", F.concat(F.lit("c"), F.col("contract_id"), F.lit(".sol")))
    asts = found.select("file_name", F.col("contract_id").alias("ast_id"))
    code = found.where("contract_id % 9 <> 0").select("file_name", F.concat(F.col("batch"), F.lit("/"), F.col("file_name")).alias("path"), "code")
    return asts, code.unionByName(code.where("length(code) % 3 = 0").withColumn("path", F.concat(F.lit("a/"), F.col("path"))))


_FILES_SQL = """WITH asts AS (SELECT concat('c', contract_id, '.sol') AS file_name, contract_id AS ast_id FROM contract_source),
one AS (SELECT concat('c', contract_id, '.sol') AS file_name, concat(batch, '/c', contract_id, '.sol') AS path, code FROM contract_source WHERE contract_id % 9 <> 0),
files AS (SELECT * FROM one UNION ALL SELECT file_name, concat('a/', path), code FROM one WHERE length(code) % 3 = 0),
first AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY path) = 1)"""


@query(with_views(f"{_FILES_SQL} SELECT ast_id, file_name, path, CAST(length(code) AS BIGINT) AS n_chars FROM asts LEFT JOIN first USING (file_name)", "contract_source"))
def match_ast_to_code(spark, sf_dir):
    return scan.match_code(*_files(spark, sf_dir)).select("ast_id", "file_name", "path", F.length("code").cast("long").alias("n_chars"))


@query(with_views(f"{_FILES_SQL} SELECT ast_id, file_name FROM asts ANTI JOIN first USING (file_name)", "contract_source"))
def unmatched_ast(spark, sf_dir):
    return scan.unmatched(*_files(spark, sf_dir)).select("ast_id", "file_name")


_DIRTY = "concat(CASE WHEN doc_id % 3 = 0 THEN chr(65279) ELSE '' END, replace(replace(text, '. ', concat('.', chr(13), chr(10))), ', ', concat(',', chr(13), chr(7), chr(11), chr(133))))"


def _dirty(spark, sf_dir):
    # Spark's chr takes one byte, so characters beyond 127 stand as literals here.
    expr = _DIRTY.replace("chr(65279)", "'﻿'").replace("chr(133)", "'\u0085'")
    return view(spark, sf_dir, "documents").select("doc_id", F.expr(expr).alias("code"))


@query(f"""WITH d AS (SELECT doc_id, {_DIRTY} AS code FROM documents),
a AS (SELECT doc_id, regexp_replace(CASE WHEN starts_with(code, chr(65279)) THEN substr(code, 2) ELSE code END, '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g') AS code FROM d)
SELECT doc_id, CAST(length(c) AS BIGINT) AS n, md5(c) AS md5 FROM (SELECT doc_id, replace(replace(code, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS c FROM a)""")
def clean_source(spark, sf_dir):
    code = tr.clean_source(F.col("code"))
    return _dirty(spark, sf_dir).select("doc_id", F.length(code).cast("long").alias("n"), F.md5(code.cast("binary")).alias("md5"))


@query(f"""SELECT doc_id, CAST(length(c) AS BIGINT) AS n, md5(c) AS md5 FROM (SELECT doc_id, regexp_replace({_DIRTY}, '\\r\\n?', chr(10), 'g') AS c FROM documents)""")
def normalise_newlines(spark, sf_dir):
    code = tr.normalise_newlines(F.col("code"))
    return _dirty(spark, sf_dir).select("doc_id", F.length(code).cast("long").alias("n"), F.md5(code.cast("binary")).alias("md5"))


@query(with_views("SELECT contract_id, regexp_extract(c, 'pragma[^;]*;') AS pragma, md5(c) AS md5 FROM (SELECT contract_id, replace(code, '^0.5.25', '^0.5.17') AS c FROM contract_source)", "contract_source"))
def rewrite_pragma(spark, sf_dir):
    done = contracts(spark, sf_dir).select("contract_id", tr.rewrite_pragma(F.col("code")).alias("c"))
    return done.select("contract_id", F.regexp_extract("c", "pragma[^;]*;", 0).alias("pragma"), F.md5(F.col("c").cast("binary")).alias("md5"))


#: Compiler versions that the stand-in job chooses from.
VERSIONS = [f"0.4.{k}" for k in range(11, 27)] + [f"0.5.{k}" for k in range(18)] + [f"0.6.{k}" for k in range(13)] + [f"0.7.{k}" for k in range(7)] + [f"0.8.{k}" for k in range(21)]
_SPEC_SQL = "SELECT contract_id, trim(regexp_extract(code, 'pragma\\s+solidity\\s+([^;]+);', 1)) AS spec FROM contract_source"
_REQUEST_SQL = f"""s AS ({_SPEC_SQL}), p AS (SELECT *, replace(replace(spec, '^', ''), '~', '') AS plain FROM s),
r AS (SELECT contract_id, spec, CASE WHEN contains(spec, '0.5.25') THEN '0.5.17' WHEN contains(plain, '>') THEN NULL WHEN len(string_split(plain, '.')) = 3 THEN plain WHEN len(string_split(plain, '.')) = 2 THEN plain || '.0' END AS exact,
  CASE WHEN contains(spec, '0.5.25') THEN NULL WHEN contains(plain, '>=') THEN regexp_extract(plain, '>=(\\S+)', 1) WHEN contains(plain, '>') AND contains(plain, '<') THEN regexp_extract(plain, '>(\\S+)', 1) END AS low FROM p)"""


@query(with_views(f"WITH {_REQUEST_SQL} SELECT contract_id, spec, exact, low FROM r", "contract_source"))
def pragma_versions(spark, sf_dir):
    spec = contracts(spark, sf_dir).select("contract_id", tr.pragma_spec(F.col("code")).alias("spec"))
    exact, low = tr.version_request(F.col("spec"))
    return spec.select("contract_id", "spec", exact.alias("exact"), low.alias("low"))


@query(with_views(f"""WITH {_REQUEST_SQL}, v(version) AS (VALUES {', '.join(f"('{v}')" for v in VERSIONS)}),
m AS (SELECT low, arg_min(version, list_transform(string_split(version, '.'), lambda x: CAST(x AS INT))) AS best FROM (SELECT DISTINCT low FROM r WHERE low IS NOT NULL), v
  WHERE list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) >= list_transform(string_split(low, '.'), lambda x: CAST(x AS INT)) GROUP BY low)
SELECT contract_id, spec, CASE WHEN exact IS NOT NULL THEN exact WHEN r.low IS NOT NULL THEN coalesce(best, '0.8.19') END AS version FROM r LEFT JOIN m ON r.low = m.low""", "contract_source"))
def compatible_version(spark, sf_dir):
    spec = contracts(spark, sf_dir).select("contract_id", tr.pragma_spec(F.col("code")).alias("spec"))
    return spec.select("contract_id", "spec", tr.required_version(F.col("spec"), VERSIONS).alias("version"))


_BROKEN = """SELECT contract_id, concat(code, chr(10), 'uint x = y * 16.66; uint8(keccak256(a)); f(string a, string b); address winner; address  winners; winner.transfer(1); keccak256(a, b); ',
  'constructor(uint a) public ', chr(123), chr(125), ' sha3(x); throw; suicide(owner); knowing;') AS code,
  CASE contract_id % 6 WHEN 0 THEN 'Type is not implicitly convertible' WHEN 1 THEN 'Explicit type conversion not allowed' WHEN 2 THEN 'Data location must be "memory"' WHEN 3 THEN 'transfer needs address payable'
    WHEN 4 THEN 'This function only accepts a single "bytes" argument' ELSE 'Visibility for constructor is ignored' END AS error,
  CASE contract_id % 4 WHEN 0 THEN '0.4.24' WHEN 1 THEN '0.5.0' WHEN 2 THEN '0.7.0' ELSE '0.8.19' END AS version FROM {contract_source}"""
_BASIC_SQL = f"""broken AS ({_BROKEN.format(contract_source='contract_source')}),
f1 AS (SELECT *, contains(code, '16.66') AND contains(error, 'not implicitly convertible') AS a FROM broken),
f2 AS (SELECT * REPLACE (CASE WHEN a THEN replace(code, '* 16.66', '* 1666 / 100') ELSE code END AS code) FROM f1),
f3 AS (SELECT * REPLACE (CASE WHEN b THEN regexp_replace(code, 'uint8\\s*\\(\\s*keccak256', 'uint8(uint256(keccak256', 'g') ELSE code END AS code) FROM (SELECT *, contains(code, 'uint8(keccak256') AND contains(error, 'Explicit type conversion not allowed') AS b FROM f2)),
f4 AS (SELECT * REPLACE (CASE WHEN c THEN regexp_replace(regexp_replace(code, '\\(string\\s+', '(string memory ', 'g'), ',\\s*string\\s+', ', string memory ', 'g') ELSE code END AS code) FROM (SELECT *, contains(error, 'Data location must be "memory"') AS c FROM f3)),
f5 AS (SELECT * REPLACE (CASE WHEN d THEN regexp_replace(code, '\\baddress\\s+winner\\b', 'address payable winner', 'g') ELSE code END AS code) FROM (SELECT *, contains(error, 'transfer') AND contains(error, 'address payable') AS d FROM f4)),
basic AS (SELECT contract_id, error, version, CASE WHEN e THEN regexp_replace(code, '\\bnow\\b', 'block.timestamp', 'g') ELSE code END AS code, a OR b OR c OR d OR e AS fixed FROM (SELECT *, version >= '0.7.0' AND contains(code, 'now') AS e FROM f5))"""


def _repaired(spark, sf_dir):
    broken = spark.sql(_BROKEN, contract_source=contracts(spark, sf_dir))
    code, fixed = tr.autofix_basic(F.col("code"), F.col("error"), F.col("version"))
    return broken.select("contract_id", "error", "version", code.alias("code"), fixed.alias("fixed"))


@query(with_views(f"WITH {_BASIC_SQL} SELECT contract_id, fixed, md5(code) AS md5, CAST(length(code) AS BIGINT) AS n FROM basic", "contract_source"))
def autofix_basic(spark, sf_dir):
    return _repaired(spark, sf_dir).select("contract_id", "fixed", F.md5(F.col("code").cast("binary")).alias("md5"), F.length("code").cast("long").alias("n"))


@query(with_views(f"""WITH {_BASIC_SQL},
g1 AS (SELECT * REPLACE (CASE WHEN f THEN regexp_replace(code, 'keccak256\\s*\\(([^)]+,[^)]+)\\)', 'keccak256(abi.encodePacked(\\1))', 'g') ELSE code END AS code) FROM (SELECT *, contains(error, 'This function only accepts a single "bytes" argument') AS f FROM basic)),
g2 AS (SELECT * REPLACE (CASE WHEN g THEN regexp_replace(code, 'constructor\\s*(\\([^)]*\\))\\s*(public|internal|private|external)', 'constructor\\1', 'g') ELSE code END AS code) FROM (SELECT *, contains(error, 'Visibility for constructor is ignored') AS g FROM g1)),
g3 AS (SELECT * REPLACE (CASE WHEN h THEN regexp_replace(code, '\\bsha3\\b', 'keccak256', 'g') ELSE code END AS code) FROM (SELECT *, contains(code, 'sha3') AND version >= '0.5.0' AS h FROM g2)),
g4 AS (SELECT * REPLACE (CASE WHEN i THEN regexp_replace(code, '\\bthrow\\b', 'revert()', 'g') ELSE code END AS code) FROM (SELECT *, contains(code, 'throw') AND version >= '0.5.0' AS i FROM g3)),
g5 AS (SELECT *, contains(code, 'suicide') AS k FROM g4)
SELECT contract_id, fixed OR f OR g OR h OR i OR k AS fixed, md5(CASE WHEN k THEN regexp_replace(code, '\\bsuicide\\b', 'selfdestruct', 'g') ELSE code END) AS md5 FROM g5""", "contract_source"))
def autofix_enhanced(spark, sf_dir):
    done = _repaired(spark, sf_dir)
    code, fixed = tr.autofix_enhanced(F.col("code"), F.col("error"), F.col("version"), F.col("fixed"))
    return done.select("contract_id", fixed.alias("fixed"), F.md5(code.cast("binary")).alias("md5"))


@query("""SELECT doc_id, coalesce(lang, '') AS as_str, coalesce(TRY_CAST(x AS BIGINT), 0) AS as_int, coalesce(TRY_CAST(y AS DOUBLE), CAST(0 AS DOUBLE)) AS as_float FROM (SELECT doc_id, lang,
  CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN text END AS x, CASE doc_id % 3 WHEN 0 THEN concat(doc_id, '.5') WHEN 1 THEN text END AS y FROM documents)""")
def safe_casts(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN text END AS x", "CASE doc_id % 3 WHEN 0 THEN concat(doc_id, '.5') WHEN 1 THEN text END AS y")
    return docs.select("doc_id", tr.safe_str(F.col("lang")).alias("as_str"), tr.safe_int(F.col("x")).alias("as_int"), tr.safe_float(F.col("y")).alias("as_float"))


@query(with_views(f"""{_ALL}, docs AS (SELECT contract_id, concat('c', contract_id, '.sol') AS file_name FROM contract_source)
SELECT d.contract_id, file_name, count(node_id) AS n_sources, coalesce(string_agg(node_id, ',' ORDER BY node_id, coalesce(snippet, '')), '') AS node_ids FROM docs d LEFT JOIN all_hits h ON d.contract_id = h.contract_id GROUP BY ALL""", "contract_source"))
def merged_ast_sources(spark, sf_dir):
    name = F.concat(F.lit("c"), F.col("contract_id"), F.lit(".sol")).alias("file_name")
    parts = src.source_parts(scan.detect(contracts(spark, sf_dir)).withColumn("file_name", name), "contract_id")
    ids = parts.select("contract_id", F.explode("entries.nodeId").alias("node_id")).groupBy("contract_id")
    listed = ids.agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.sort_array(F.collect_list("node_id")), ",").alias("node_ids"))
    every = contracts(spark, sf_dir).select("contract_id", name).join(listed, "contract_id", "left")
    return every.select("contract_id", "file_name", F.coalesce("n_sources", F.lit(0).cast("long")).alias("n_sources"), F.coalesce("node_ids", F.lit("")).alias("node_ids"))


# --- files: contracts and AST documents written, read back and merged ---
#: Every thirteenth contract is listed, but has no file. Odd ones are ISO-8859-1 where that loses nothing.
_CONTRACT_FILES = """SELECT doc_id, concat('c', doc_id) AS contract_id, source AS batch, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS label,
  replace(text, '. ', concat('.', chr(13), chr(10))) AS code FROM {documents}"""


@query(f"""WITH c AS ({_CONTRACT_FILES.replace('{documents}', 'documents')}),
r AS (SELECT *, doc_id % 13 <> 0 AND length(code) > 0 AS present, replace(code, chr(13) || chr(10), chr(10)) AS plain,
  doc_id % 2 = 1 AND regexp_full_match(code, '(?s)[\\x00-\\x{{FF}}]*') AND NOT regexp_full_match(code, '(?s)[\\x00-\\x7F]*') AS latin FROM c)
SELECT contract_id, CASE WHEN present THEN batch END AS batch, CASE WHEN present THEN label END AS label, CASE WHEN present THEN 'read' ELSE 'missing' END AS status,
  CASE WHEN present THEN CASE WHEN latin THEN 'ISO-8859-1' ELSE 'UTF-8' END END AS encoding, CASE WHEN present THEN CAST(length(plain) AS BIGINT) END AS n_chars, CASE WHEN present THEN md5(plain) END AS md5 FROM r""")
def contract_files(spark, sf_dir):
    """Contracts are written as files, in two encodings and with line ends of two characters, and read again with those that are missing."""
    docs = spark.sql(_CONTRACT_FILES, documents=view(spark, sf_dir, "documents"))
    latin = F.encode("code", "ISO-8859-1")
    content = F.when((F.col("doc_id") % 2 == 1) & (F.decode(latin, "ISO-8859-1") == F.col("code")), latin).otherwise(F.encode("code", "UTF-8"))
    name = F.concat_ws("/", "batch", F.when(F.col("label") == 1, "vulnerable").otherwise("safe"), F.concat("contract_id", F.lit(".sol")))
    path = f"{shared_dir(spark)}/contract-files-{uuid.uuid4().hex}"
    named_files.write(docs.where("doc_id % 13 <> 0").select(name.alias("name"), content.alias("content")), path)
    found = src.with_missing(docs.select("contract_id"), src.from_bytes(named_files.read(spark, path, glob="*.sol")), "contract_id")
    return found.select("contract_id", "batch", F.col("label").cast("long").alias("label"), "status", "encoding", F.length("code").cast("long").alias("n_chars"), F.md5(F.col("code").cast("binary")).alias("md5"))


#: AST documents of the contracts: broken ones, ones that are no object or name no file, ones that hold old sources.
_AST_FILES = """SELECT contract_id, concat('c', contract_id, '.json') AS name, CASE WHEN contract_id % 10 = 3 THEN concat(chr(123), '"file_name": "c', contract_id)
  WHEN contract_id % 10 = 7 THEN concat('[', contract_id, ']')
  ELSE concat(chr(123), CASE WHEN contract_id % 4 = 1 THEN '' ELSE concat('"file_name": "c', contract_id, '.sol", ') END, CASE WHEN contract_id % 4 = 2 THEN '"sources": ["old"], "sourcesSummary": 1, ' ELSE '' END,
    '"contracts": ', chr(123), '"C": ', chr(123), '"id": ', contract_id, chr(125), chr(125), ', "note": "', CASE WHEN contract_id % 3 = 0 THEN 'schön' ELSE 'null' END, '"', chr(125)) END AS json,
  CASE WHEN contract_id % 13 = 0 THEN 'missing' WHEN contract_id % 10 = 3 THEN 'broken' WHEN contract_id % 10 = 7 THEN 'no object' ELSE 'read' END AS expected FROM {contract_source}"""


def _ast_files(spark, sf_dir):
    """All names, and the documents as they are read from files, of those that have one; some are written as ISO-8859-1."""
    docs = spark.sql(_AST_FILES, contract_source=contracts(spark, sf_dir))
    path = f"{shared_dir(spark)}/ast-files-{uuid.uuid4().hex}"
    content = F.when(F.col("contract_id") % 2 == 1, F.encode("json", "ISO-8859-1")).otherwise(F.encode("json", "UTF-8"))
    named_files.write(docs.where("contract_id % 13 <> 0").select(F.concat(F.lit("asts/"), "name").alias("name"), content.alias("content")), path)
    return docs.select("name"), src.asts_from_bytes(named_files.read(spark, path, glob="*.json"))


_AST_SQL = "a AS (" + _AST_FILES.replace("{contract_source}", "contract_source") + ")"


@query(with_views(f"""WITH {_AST_SQL} SELECT name, expected AS status, CASE WHEN expected <> 'missing' THEN concat('c', contract_id, '.sol') END AS file_name,
CASE WHEN expected = 'read' THEN contract_id END AS id, CASE WHEN expected = 'read' THEN CASE WHEN contract_id % 3 = 0 THEN 'schön' ELSE 'null' END END AS note FROM a""", "contract_source"))
def ast_files(spark, sf_dir):
    """AST documents are written as files and read again, with a row for broken and missing ones."""
    names, asts = _ast_files(spark, sf_dir)
    read = asts.withColumn("name", F.regexp_extract("path", r"[^/]*$", 0))
    found = src.with_missing(names, read, "name")
    field = lambda path, kind: F.when(F.col("status") == "read", F.try_variant_get("ast", path, kind))
    return found.select("name", "status", "file_name", field("$.contracts.C.id", "long").alias("id"), field("$.note", "string").alias("note"))


#: Characters of code in a part of the merged documents; small, so that many documents have several.
_SPAN = 4096


@query(with_views(f"""{_ALL}, {_AST_SQL},
p AS (SELECT contract_id, count(*) AS n_sources, md5(string_agg(concat_ws(' ', node_id, source_type, pattern, position, matched_text, context_type, context_name, risk_level, contextual_risk, base_risk, usage_context,
    CASE WHEN is_nested THEN 'true' ELSE 'false' END, risk_factors), chr(10) ORDER BY position, kind, node_id, matched_text)) AS sources, CAST(max(CAST(floor(position / {_SPAN}) AS BIGINT)) + 1 AS BIGINT) AS n_parts FROM all_hits GROUP BY contract_id),
t AS (SELECT contract_id, string_agg(concat(source_type, '=', n), ',' ORDER BY source_type) AS by_type FROM (SELECT contract_id, source_type, count(*) AS n FROM all_hits GROUP BY ALL) GROUP BY contract_id),
r AS (SELECT contract_id, string_agg(concat(risk_level, '=', n), ',' ORDER BY risk_level) AS by_risk FROM (SELECT contract_id, risk_level, count(*) AS n FROM all_hits WHERE kind <> 'state' GROUP BY ALL) GROUP BY contract_id),
c AS (SELECT contract_id, count(*) AS total_sources, count(*) FILTER (WHERE is_nested AND kind <> 'state') AS nested_sources FROM all_hits GROUP BY contract_id)
SELECT concat('c', a.contract_id, '.sol') AS file_name, a.contract_id AS id, CASE WHEN a.contract_id % 3 = 0 THEN 'schön' ELSE 'null' END AS note, coalesce(n_sources, 0) AS n_sources, coalesce(sources, md5('')) AS sources,
  coalesce(n_parts, 1) AS n_parts, coalesce(total_sources, 0) AS total_sources, coalesce(nested_sources, 0) AS nested_sources, coalesce(by_type, '') AS by_type, coalesce(by_risk, '') AS by_risk
FROM a LEFT JOIN p USING (contract_id) LEFT JOIN t USING (contract_id) LEFT JOIN r USING (contract_id) LEFT JOIN c USING (contract_id) WHERE expected = 'read' AND contract_id % 9 <> 0""", "contract_source"))
def merged_documents(spark, sf_dir):
    """AST documents are read, get the sources and the summary of their contract, are written as the next version, and are read back."""
    asts = _ast_files(spark, sf_dir)[1].select("path", "file_name", "ast")
    code = contracts(spark, sf_dir).where("contract_id % 9 <> 0").select(F.concat(F.lit("c"), F.col("contract_id"), F.lit(".sol")).alias("contract_id"), "code")
    hits = stored(scan.detect(code), "merged-hits").withColumnRenamed("contract_id", "file_name")  # parts and summary read them
    summary = scan.statistics(hits.withColumnRenamed("file_name", "contract_id")).withColumnRenamed("contract_id", "file_name")
    own = asts.join(code.select(F.col("contract_id").alias("file_name")).distinct(), "file_name", "left_semi")
    path = f"{shared_dir(spark)}/merged-documents-{uuid.uuid4().hex}"
    src.write_merged(src.merge_sources(own, hits, summary, span=_SPAN), path)
    return _merged_report(src.read_merged(spark, path))


def _merged_report(merged: DataFrame) -> DataFrame:
    """A row for each document, from its parts."""
    get = lambda path, kind: F.try_variant_get("ast", path, kind)
    entry = lambda x, path, kind="string": F.try_variant_get(x, path, kind)
    fields = ["nodeId", "sourceType", "pattern", "position", "matchedText", "context.type", "context.name", "riskLevel", "taintLevel", "baseRisk", "usageContext", "isNested"]
    texts = F.transform(get("$.sources", "array<variant>"), lambda x: F.concat_ws(" ", *[_as_text(entry, x, f) for f in fields], F.array_join(entry(x, "$.riskFactors", "array<string>"), ",")))
    pairs = lambda path: F.array_join(F.transform(F.array_sort(F.map_entries(get(path, "map<string,bigint>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    head = F.struct(get("$.contracts.C.id", "long").alias("id"), get("$.note", "string").alias("note"), *[get(f"$.sourcesSummary.{n}", "long").alias(n) for n in ("total_sources", "nested_sources")],
                    pairs("$.sourcesSummary.by_type").alias("by_type"), pairs("$.sourcesSummary.by_risk").alias("by_risk"))
    rows = merged.select("file_name", "part", texts.alias("texts"), F.when(F.col("part") == 0, head).alias("head"))
    found = rows.groupBy("file_name").agg(F.max("head").alias("head"), (F.max("part") + 1).alias("n_parts"), F.sort_array(F.collect_list(F.struct("part", "texts"))).alias("parts"))
    every = F.flatten("parts.texts")
    return found.select("file_name", "head.*", "n_parts", F.size(every).cast("long").alias("n_sources"), F.md5(F.array_join(every, "\n").cast("binary")).alias("sources"))


def _as_text(entry, x, field: str) -> F.Column:
    kind = {"position": "long", "taintLevel": "double", "baseRisk": "double", "isNested": "boolean"}.get(field, "string")
    return entry(x, f"$.{field}", kind).cast("string")
