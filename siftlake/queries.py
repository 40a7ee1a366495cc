"""The operators on the given tables, each with its SQL. Adapters turn tables into findings, lines and items."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .functions import text as T
from .operators import cache, changes, entropy, evaluate, graph, history, kb, lines, masks, replies, report, rules, store, validate
from .plans.staging import shared_dir
from .sources import files
from .streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("$F", F_SQL).replace("$L", L_SQL)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Events as findings: a user is a file, the hour since the first of January 2024 a line."""
    e = table(spark, d, "events")
    hour = "cast(timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) as int)"
    return e.selectExpr(
        "event_id pos", "concat('u', user_id) path", "event_type rule_id", f"{hour} line_start", f"cast({hour} + event_id % 4 as int) line_end",
        "case event_type when 'error' then 'critical' when 'click' then 'high' when 'purchase' then 'medium' else 'low' end severity",
        "case when event_type in ('error', 'click') then 'security' when event_type = 'purchase' then 'logic' else 'style' end category",
        "case when event_id % 3 = 0 then 'llm' else 'static' end detector", "event_id % 2 = 0 verified", "least(value / 100D, 1D) confidence",
        "cast(1 + event_id % 3 as int) votes", "array(concat('m', event_id % 3)) models", "props fix", "event_type title", "'' analysis", "ts",
    )


HOUR = "date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts)"
F_SQL = f"""f AS (SELECT event_id AS pos, 'u' || user_id AS path, event_type AS rule_id, {HOUR}::INT AS line_start, ({HOUR} + event_id % 4)::INT AS line_end,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN event_type IN ('error', 'click') THEN 'security' WHEN event_type = 'purchase' THEN 'logic' ELSE 'style' END AS category,
  CASE WHEN event_id % 3 = 0 THEN 'llm' ELSE 'static' END AS detector, event_id % 2 = 0 AS verified, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS confidence,
  (1 + event_id % 3)::INT AS votes, 'm' || (event_id % 3) AS model, props AS fix, ts FROM events)"""
L_SQL = """l AS (SELECT path, unnest(a) AS line, generate_subscripts(a, 1)::INT AS line_no FROM (
  SELECT doc_id AS path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))"""


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.lines(table(spark, d, "documents"), "doc_id")


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr("conv_id path", "turn line_no", "text line", "role")


# ---- lines and rules ----------------------------------------------------------------------------------------


@query("WITH $L SELECT path, line_no, line FROM l")
def line_explode(spark, d):
    return document_lines(spark, d)


# Documents hold no code: each gets lines of these behind its text, by its id, indented by tabs or spaces.
_CODE_PY = (
    "os.system(cmd)", "x = eval(y)", "# eval(y)", "\t# TODO: later", "value = hashlib.md5(b)", "hashlib.md5(b)  # nosec", "def f(a=[]):", "if a is 'x':", "\tf = open(p)", "debug=True", "from os import *", "a = 1; return a",
    "Password = 'abcdefgh1'", "requests.get(u, verify=False)", "pickle.loads(b)", "except:", "go = lambda: 1", "cursor.execute(f\"select {x}\")", "subprocess.run(c, shell=True)", "token = random.choice(key)", "yaml.load(f)  # noqa", "\u3000# exec(y)",
)
_CODE_JS = (
    "eval(x)", "\t// eval(x)", "\t/* eval(y)", "eval(z)", "*/ eval(w)", "el.innerHTML = v", "el.innerHTML = ''", "if (a == b) go()", "debugger;", "document.write(x) // eslint-disable", "// eslint-disable-next-line", "Math.random()",
    "try { f() } catch (e) {}", "const apiKey = 'abcdefghij0123456789'", "new Function('x')", "rejectUnauthorized: false", "a === b", "\u00a0// debugger",
)
_CODE_GUARD = (
    "d = yaml.safe_load(f)", "if p.startswith(base):", "q = os.path.realpath(p)", "c.execute('select ?', a)", "subprocess.run(['ls'])", "with self._lock:", "with sqlite3.connect(p) as c:", "with open(p) as f:", "v = d.get(k, 0)", "x = a if b else c",
    "(n := d.get(k))", "if len(a) == 2 and b:", "os.environ.get('A')", "h = hashlib.md5(b)  # cache", "PASSWORD = 'SECRET_NAME'", "nothing",
)


def _code_sql(lines_: tuple[str, ...], by: int = 5) -> str:
    """A text and five lines behind it, the same in both dialects."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    pick = lambda k: f"CASE (doc_id * {by} + {k}) % {len(lines_)} " + " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(lines_)) + " END"
    return "text || chr(10) || " + " || chr(10) || ".join(pick(k) for k in range(5))


def code(spark, d, lines_: tuple[str, ...], suffix: str = "") -> DataFrame:
    """documents as source files: path, text."""
    text = _code_sql(lines_).replace("''", chr(92) + "'")
    return table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("path") if suffix else F.col("doc_id").alias("path"), F.expr(text).alias("text"))


def code_lines(lines_: tuple[str, ...]) -> str:
    """L_SQL over the texts of code()."""
    return L_SQL.replace("string_split(text, chr(10))", f"string_split({_code_sql(lines_)}, chr(10))")


_BARE = "trim({}, '" + T.WHITE.replace("'", "''") + "')"
_LEFT = "ltrim({}, '" + T.WHITE + "')"


# What RE2, which knows no look-around, needs in place of three patterns.
_RE2 = {"R-SEC-003": r"(^|[^.\w])(eval|exec)\s*\(", "R-SEC-004": r"pickle\.loads?\s*\(|yaml\.load\s*\([^S]*$", "R-LOG-003": r"""\bis\s+("|'|[0-9]+([^!0-9\w]|$))"""}


def _rule_sql(r: rules.Rule) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cond = [f"regexp_matches(line, {q(_RE2.get(r.id, r.pattern))})", f"NOT regexp_matches(line, {q(rules.SUPPRESS)})"]
    cond += [] if r.in_comments else [f"NOT starts_with({_LEFT.format('line')}, '#')"]
    cond += [f"NOT contains(line, {q(x)})" for x in r.exclude]
    return f"SELECT {q(r.id)} AS rule_id, {q(r.severity)} AS severity, {q(r.category)} AS category, count(*)::BIGINT AS hits, count(DISTINCT path)::BIGINT AS files FROM l WHERE " + " AND ".join(cond)


@query("WITH " + code_lines(_CODE_PY) + " " + " UNION ALL ".join(map(_rule_sql, rules.PYTHON)))
def rule_scan_counts(spark, d):
    found = rules.scan_texts(code(spark, d, _CODE_PY))
    return rules.counts(found, rules.dimension(spark))


_RE2_JS = {
    "JS-SEC-001": r"(^|[^.\w])eval\s*\(", "JS-SEC-003": r"\.innerHTML\s*=([^=]|$)", "JS-SEC-005": r"""child_process\.exec\s*\(|(^|[^.\w])exec\s*\(\s*[`"'].*\$\{""", "JS-ENG-001": r"(^|[^.\w])debugger\s*;?",
}
_J_SQL = f"""l2 AS (SELECT *, {_BARE.format('line')} AS t, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS before FROM l),
j AS (SELECT *, last_value(CASE WHEN starts_with(t, '/*') AND NOT contains(substr(t, 3), '*/') THEN true WHEN contains(line, '*/') THEN false END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM l2),
s AS (SELECT path, line_no, line, string_split(line, '//')[1] AS code FROM j WHERE NOT (starts_with(t, '//') OR starts_with(t, '/*') OR coalesce(inside, false)) AND NOT regexp_matches(line, '{rules.JS_SUPPRESS}') AND NOT coalesce(regexp_matches(before, '{rules.JS_NEXT}'), false))"""


def _js_sql(r: rules.Rule) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cond = [f"regexp_matches(code, {q(_RE2_JS.get(r.id, r.pattern))})", *(f"NOT contains(line, {q(x)})" for x in r.exclude)]
    return f"SELECT {q(r.id)} AS rule_id, count(*)::BIGINT AS hits, count(DISTINCT path)::BIGINT AS files FROM s WHERE {' AND '.join(cond)} HAVING count(*) > 0"


@query("WITH " + code_lines(_CODE_JS) + ", " + _J_SQL + " " + " UNION ALL ".join(map(_js_sql, rules.JS)))
def js_scan_counts(spark, d):
    rows = lines.lines(code(spark, d, _CODE_JS, ".js"))
    return rules.scan_js(rows).groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files"))


def _guard_sql(g: tuple) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    need = f" AND path IN (SELECT doc_id FROM documents WHERE regexp_matches({_code_sql(_CODE_GUARD)}, {q('(?i)' + g[2])}))" if g[2] else ""
    return " UNION ".join(f"SELECT path, {q(k)} AS key, line_no AS line FROM l WHERE regexp_matches(line, {q(g[0])}){need}" for k in g[1])


@query("WITH " + code_lines(_CODE_GUARD) + ", p AS (" + " UNION ".join(map(_guard_sql, rules.GUARDS)) + ") SELECT path, key, line FROM p")
def guard_lines(spark, d):
    return rules.guard_points(code(spark, d, _CODE_GUARD)).distinct()


@query()
def rule_scan_checked(spark, d):
    """All documents as sources, with masks and block checks; Python's grammar decides, so no SQL."""
    rows = masks.python_masks(table(spark, d, "documents").selectExpr("concat(doc_id, '.py') path", "text"))
    return rules.counts(rules.scan(rows, masks=True), rules.dimension(spark))


@query("""WITH $L SELECT lang, count(*)::BIGINT AS lines, sum((starts_with(ltrim(line), '#'))::INT)::BIGINT AS comments,
sum(regexp_matches(line, '#\\s*(noqa|nosec|pylint:\\s*disable)')::INT)::BIGINT AS suppressed, sum(contains(line, 'http')::INT)::BIGINT AS excluded FROM l JOIN documents ON doc_id = path GROUP BY lang""")
def scan_suppression(spark, d):
    rows = lines.lines(table(spark, d, "documents").selectExpr("struct(doc_id, lang) p", "text"), "p").select("path.lang", "line")
    flag = lambda c: F.count_if(c)
    return rows.groupBy("lang").agg(
        F.count("*").alias("lines"), flag(F.startswith(F.ltrim("line"), F.lit("#"))).alias("comments"),
        flag(F.rlike("line", F.lit(rules.SUPPRESS))).alias("suppressed"), flag(F.contains("line", F.lit("http"))).alias("excluded"),
    )


@query("""SELECT conv_id AS path, turn AS line_no, coalesce(contains(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '?'), false) AS suppressed FROM conversations""")
def prev_line_suppress(spark, d):
    return turns(spark, d).select("path", "line_no", F.coalesce(F.contains(lines.previous(), F.lit("?")), F.lit(False)).alias("suppressed"))


@query("""SELECT conv_id AS path, turn AS line_no, len(a)::INT AS following, list_bool_or(list_transform(a, lambda x: contains(x, ','))) IS TRUE AS any_comma FROM (
SELECT conv_id, turn, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS a FROM conversations)""")
def block_lookahead(spark, d):
    rest = lines.following(F.col("line"), 3)
    rows = turns(spark, d).withColumn("a", rest)
    return rows.select("path", "line_no", F.size("a").alias("following"), F.exists("a", lambda x: F.contains(x, F.lit(","))).alias("any_comma"))


def _mask_sql(text: str) -> str:
    """Every match of T.SECRET put in marks, then each kind shown as far as it may be."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    parts = " || ".join(["chr(1)", *(f"'{chr(92)}{k}' || chr({k + 1})" for k in (1, 2, 3))])
    out = f"regexp_replace({text}, {q(T.SECRET)}, {parts}, 'g')"
    for pattern, to in T.SHOWN:
        out = f"regexp_replace({out}, {q(pattern)}, {q(to.replace('$1', chr(92) + '1'))}, 'g')"
    return out


# Documents hold few secrets: every third gets one before and one behind its text, of six kinds.
_KINDS = ("'api_key = \"AB+/=cdefgh;x\" '", "'p@ss!word päßwörter123 token: abc_de-f '", "'sk-a_bcdefghij and sk-short '", "'SECRET=sk-abcdefghijkl '", "'Passwd:\n  hunter22hunter '", "'apikey=12345 api_key=123456 '")
_WITH = "CASE doc_id % 18 " + " ".join(f"WHEN {3 * i} THEN {k} || text || {k}" for i, k in enumerate(_KINDS)) + " ELSE text END"


def _with_secrets(spark, d):
    """documents with a sample of secrets in every third text."""
    return table(spark, d, "documents").withColumn("text", F.expr(_WITH))


@query(f"SELECT doc_id, md5(m) AS masked_md5, length(m)::INT AS masked_len FROM (SELECT doc_id, text, {_mask_sql('text')} AS m FROM (SELECT doc_id, {_WITH} AS text FROM documents)) WHERE m <> text")
def secret_mask(spark, d):
    m = _with_secrets(spark, d).select("doc_id", "text", T.mask_secrets(F.col("text")).alias("m")).where("m <> text")
    return m.select("doc_id", F.md5("m").alias("masked_md5"), F.length("m").alias("masked_len"))


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]{20,}')) AS token FROM documents),
c AS (SELECT token, unnest(string_split(token, '')) AS ch FROM t), n AS (SELECT token, ch, count(*) / length(token)::DOUBLE AS p FROM c GROUP BY token, ch)
SELECT token, round(sum(-p * log2(p)), 4) AS entropy, regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '[0-9]') AND NOT regexp_full_match(token, '[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}')
AND NOT regexp_matches(token, '(?i)(example|placeholder|your[_-]?|xxxx|changeme|dummy|sample|test[_-]?key)') AS secret FROM n GROUP BY token""")
def entropy_tokens(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{20,}"), 0)).alias("token")).distinct()
    return t.select("token", F.round(entropy.shannon(F.col("token")), 4).alias("entropy"), entropy.secret_like(F.col("token")).alias("secret"))


@query("""SELECT o_orderkey, CASE WHEN lower(trim(p)) IN ('critical', 'high', 'medium', 'low') THEN lower(trim(p)) ELSE 'medium' END AS severity,
least(greatest(o_totalprice / 400000.0, 0.0), 1.0)::DOUBLE AS confidence, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_orderkey % 7 END::INT AS line_start
FROM (SELECT *, substr(o_orderpriority, 3) AS p FROM orders)""")
def enum_coerce(spark, d):
    o = table(spark, d, "orders")
    conf = schema.clamp((F.col("o_totalprice") / 400000.0).cast("string"))
    return o.select("o_orderkey", schema.enum(F.expr("substring(o_orderpriority, 3)"), schema.SEVERITIES, "medium").alias("severity"), conf.alias("confidence"), schema.line_number((F.col("o_orderkey") % 7).cast("string")).alias("line_start"))


# ---- findings -----------------------------------------------------------------------------------------------


@query("WITH $F SELECT rule_id, count(*)::BIGINT AS count, min(pos) AS first_pos FROM f GROUP BY rule_id")
def findings_count_by(spark, d):
    return report.count_by(findings(spark, d), "rule_id")


@query("""WITH $F SELECT 'total' AS kind, 'all' AS value, count(*)::BIGINT AS count FROM f UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'detector', detector, count(*) FROM f GROUP BY 2""")
def report_stats(spark, d):
    return report.stats(findings(spark, d))


# Rows of a key, one by one: a is what those before have become, b the next.
_RANK = "(x.verified, x.detector = 'both', length(x.fix), x.confidence)"
_LATER = f"{_RANK.replace('x.', 'b.')} >= {_RANK.replace('x.', 'a.')}"


@query(f"""WITH $F, s AS (SELECT path, rule_id, line_start, {{'pos': pos, 'verified': verified, 'fix': fix, 'votes': votes, 'models': [model], 'detector': detector, 'confidence': confidence}} AS x, pos FROM (SELECT * REPLACE (floor(line_start / 24)::INT AS line_start) FROM f)),
g AS (SELECT path, rule_id, line_start, list_reduce(list(x ORDER BY pos), lambda a, b: {{'pos': if({_LATER}, b.pos, a.pos), 'verified': if({_LATER}, b.verified, a.verified), 'fix': if({_LATER}, b.fix, a.fix),
'votes': a.votes + b.votes, 'models': list_sort(list_distinct(list_concat(a.models, b.models))), 'detector': if(a.detector <> b.detector, 'both', a.detector),
'confidence': if(a.detector <> b.detector, least(1.0::DOUBLE, greatest(a.confidence, b.confidence) + 0.05::DOUBLE), if({_LATER}, b.confidence, a.confidence))}}) AS r FROM s GROUP BY ALL)
SELECT path, rule_id, line_start, r.pos AS pos, r.votes AS votes, array_to_string(r.models, ',') AS models, r.detector AS detector, round(r.confidence, 6) AS confidence FROM g""")
def dedupe_merge(spark, d):
    """A day is a line, so that keys have several findings."""
    out = validate.dedupe(findings(spark, d).withColumn("line_start", F.floor(F.col("line_start") / 24).cast("int")))
    return out.select("path", "rule_id", "line_start", "pos", "votes", F.concat_ws(",", "models").alias("models"), "detector", F.round("confidence", 6).alias("confidence"))


_KEY = "CASE rule_id WHEN 'error' THEN 'CWE-79' WHEN 'click' THEN 'CWE-79' WHEN 'view' THEN 'CWE-22' ELSE rule_id END"


def keyed(f: DataFrame) -> DataFrame:
    cwe = F.when(F.col("rule_id").isin("error", "click"), "CWE-79").when(F.col("rule_id") == "view", "CWE-22")
    return f.withColumn("key", validate.rule_key(F.col("rule_id"), cwe))


@query(f"""WITH $F, k AS (SELECT *, {_KEY} AS key FROM f), m AS (SELECT *, max(line_end) OVER (PARTITION BY path, key ORDER BY line_start, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM k),
i AS (SELECT *, sum(CASE WHEN seen IS NULL OR line_start > seen THEN 1 ELSE 0 END) OVER (PARTITION BY path, key ORDER BY line_start, pos) AS island FROM m)
SELECT path, key, min(line_start) AS line_start, max(line_end) AS line_end, count(*)::BIGINT AS merged, max(confidence) AS confidence FROM i GROUP BY path, key, island""")
def line_islands(spark, d):
    return validate.merge_intervals(keyed(findings(spark, d))).drop("island")


# Rows of an island, one by one: acc is the list of what those before have become, b a list of the next one.
_MEETS = "(e.detector <> b[1].detector OR (e.detector = 'llm' AND NOT list_has_any(e.models, b[1].models))) AND e.line_start <= b[1].line_end AND b[1].line_start <= e.line_end"
_AT = f"list_position(list_transform(acc, lambda e: {_MEETS}), true)"


@query(f"""WITH $F, k AS (SELECT *, {_KEY} AS key FROM f), m AS (SELECT *, max(line_end) OVER (PARTITION BY path, key ORDER BY line_start, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM k),
i AS (SELECT *, sum(CASE WHEN seen IS NULL OR line_start > seen THEN 1 ELSE 0 END) OVER (PARTITION BY path, key ORDER BY line_start, pos) AS island FROM m),
g AS (SELECT path, key, list_reduce(list([{{'pos': pos, 'line_start': line_start, 'line_end': line_end, 'detector': detector, 'votes': votes, 'models': [model], 'verified': verified, 'confidence': confidence}}] ORDER BY pos),
lambda acc, b: if({_AT} IS NULL OR {_AT} = 0, list_concat(acc, b), list_concat(list_filter(acc, lambda e, n: n <> {_AT}), list_transform(list_filter(acc, lambda e, n: n = {_AT}), lambda e: {{'pos': b[1].pos,
'line_start': least(e.line_start, b[1].line_start), 'line_end': greatest(e.line_end, b[1].line_end), 'detector': if(e.detector = 'llm' AND b[1].detector = 'llm', 'cross', if(e.detector <> b[1].detector, 'both', e.detector)),
'votes': e.votes + b[1].votes, 'models': list_sort(list_distinct(list_concat(e.models, b[1].models))), 'verified': e.verified OR b[1].verified, 'confidence': least(1.0::DOUBLE, greatest(e.confidence, b[1].confidence))}})))) AS r FROM i GROUP BY path, key, island)
SELECT x.pos AS pos, path, key, x.line_start AS line_start, x.line_end AS line_end, x.detector AS detector, x.votes AS votes, array_to_string(x.models, ',') AS models, x.verified AS verified, x.confidence AS confidence FROM (SELECT path, key, unnest(r) AS x FROM g)""")
def cwe_merge(spark, d):
    return validate.merge(keyed(findings(spark, d))).select("pos", "path", "key", "line_start", "line_end", "detector", "votes", F.concat_ws(",", "models").alias("models"), "verified", "confidence")


@query("""WITH v AS (SELECT DISTINCT p_brand AS rule_id FROM part WHERE p_size > 48), b AS (SELECT p_partkey AS pos, p_brand AS rule_id, p_partkey % 3 = 0 AS static FROM part),
g AS (SELECT pos, rule_id, NOT static AND rule_id NOT IN (SELECT rule_id FROM v) AS gated FROM b)
SELECT pos, rule_id, gated, 0::INT AS noted FROM g WHERE NOT gated UNION ALL SELECT pos, format('DISCOVERED-{}-{:02d}', rule_id, row_number() OVER (ORDER BY pos)), true, 1::INT FROM g WHERE gated""")
def id_gate(spark, d):
    part = table(spark, d, "part")
    f = part.selectExpr("p_partkey pos", "p_brand rule_id", "if(p_partkey % 3 = 0, 'static', 'llm') detector", "'' analysis")
    out = validate.id_gate(f, part.where("p_size > 48").selectExpr("p_brand rule_id"))
    return out.select("pos", "rule_id", "gated", F.contains("analysis", F.lit("not known")).cast("int").alias("noted"))


@query(f"""WITH $F, k AS (SELECT *, {_KEY} AS key FROM f) SELECT pos, path, key, line_start, line_end FROM k a WHERE rule_id <> 'signup' AND (detector <> 'llm' OR NOT EXISTS (
SELECT 1 FROM k g WHERE g.confidence > 0.4 AND g.path = a.path AND g.key = a.key AND g.line_start BETWEEN a.line_start - 3 AND a.line_end + 3))""")
def guard_suppress(spark, d):
    k = keyed(findings(spark, d))
    guards = k.where("confidence > 0.4D").selectExpr("path", "key", "line_start line")
    out = validate.suppress(k.where("rule_id <> 'signup'").withColumns({"lo": F.col("line_start"), "hi": F.col("line_end")}), guards)
    return out.select("pos", "path", "key", "line_start", "line_end")


@query("""WITH $F SELECT pos, detector, confidence, CASE WHEN detector = 'llm' AND confidence < 0.7 THEN '[low confidence] ' ELSE '' END AS analysis FROM f WHERE NOT (detector = 'llm' AND (NOT verified OR confidence < 0.5))""")
def conf_gate(spark, d):
    return validate.confidence_gate(findings(spark, d)).select("pos", "detector", "confidence", "analysis")


@query("""WITH $F, g AS (SELECT path, rule_id, line_start, count(DISTINCT detector) AS k, min(detector) AS d, count(DISTINCT model) AS m FROM f GROUP BY ALL),
c AS (SELECT sum((m >= 2)::INT)::BIGINT AS agreed, sum((m < 2 AND k = 1)::INT)::BIGINT AS single, sum((m < 2 AND k > 1)::INT)::BIGINT AS by_rule FROM g WHERE k > 1 OR d <> 'static') SELECT *, round(agreed / nullif(agreed + single, 0)::DOUBLE, 3) AS agreement FROM c""")
def cross_review(spark, d):
    return validate.cross_review(validate.dedupe(findings(spark, d)))[1]


@query("""WITH $L, f AS (SELECT path * 100000 + line_no AS pos, path, CASE WHEN line_no % 3 = 0 THEN line_no + 9 ELSE line_no END::INT AS line_start, CASE WHEN line_no % 7 = 0 THEN line_no + 12 END::INT AS line_end, CASE WHEN line_no % 5 = 0 THEN 'nowhere to be found' ELSE line END AS evidence FROM l),
s AS (SELECT path, line_no, replace(line, ' ', '') AS x FROM l), w AS (SELECT path, string_agg(x, chr(10) ORDER BY line_no) AS x, max(line_no) AS lines FROM s GROUP BY path),
n AS (SELECT f.pos, string_agg(s.x, chr(10) ORDER BY s.line_no) AS x FROM f JOIN s ON f.path = s.path AND s.line_no BETWEEN f.line_start - 3 AND coalesce(f.line_end, f.line_start) + 3 GROUP BY f.pos),
p AS (SELECT f.*, substr(replace(evidence, ' ', ''), 1, 40) AS probe FROM f)
SELECT p.pos, CASE WHEN line_start > lines THEN 'range' WHEN probe = '' OR contains(n.x, probe) THEN 'ok' WHEN contains(w.x, probe) THEN 'drift' ELSE 'missing' END AS verdict FROM p LEFT JOIN n ON p.pos = n.pos LEFT JOIN w ON p.path = w.path""")
def verify_evidence(spark, d):
    f = document_lines(spark, d).selectExpr("path * 100000 + line_no pos", "path", "cast(if(line_no % 3 = 0, line_no + 9, line_no) as int) line_start", "cast(if(line_no % 7 = 0, line_no + 12, null) as int) line_end", "if(line_no % 5 = 0, 'nowhere to be found', line) evidence")
    return validate.verify(f, table(spark, d, "documents").selectExpr("doc_id path", "text")).select("pos", "verdict")


# ---- evaluation ---------------------------------------------------------------------------------------------

_CLUSTER = """c AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line_start, pos)::BIGINT AS cluster FROM (SELECT *, CASE WHEN line_start - lag(line_end) OVER (PARTITION BY path ORDER BY line_start, pos) <= 3 THEN 0 ELSE 1 END AS new FROM f))"""


@query(f"WITH $F, {_CLUSTER} SELECT path, cluster, min(line_start) AS lo, max(line_end) AS hi, count(*)::BIGINT AS size FROM c GROUP BY path, cluster")
def cluster_lines(spark, d):
    c = evaluate.clusters(findings(spark, d))
    return c.groupBy("path", "cluster").agg(F.min("line_start").alias("lo"), F.max("line_end").alias("hi"), F.count("*").alias("size"))


_SCORE = """c AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line_start, pos)::BIGINT AS cluster FROM (SELECT *, CASE WHEN line_start - lag(line_end) OVER (PARTITION BY path ORDER BY line_start, pos) <= 3 THEN 0 ELSE 1 END AS new FROM f WHERE confidence <= 0.2)),
k AS (SELECT path, cluster, min(line_start) AS lo, max(line_end) AS hi, list_distinct(list(rule_id)) AS keys, bool_or(category <> 'style') AS defect FROM c GROUP BY ALL),
x AS (SELECT path, rule_id AS key, line_start AS line, pos AS ord FROM f WHERE confidence > 0.2),
m AS (SELECT k.path, k.cluster, min(x.ord) AS ord FROM k JOIN x ON k.path = x.path AND x.line BETWEEN k.lo - 2 AND k.hi + 2 AND list_contains(k.keys, x.key) GROUP BY ALL),
u AS (SELECT defect FROM k ANTI JOIN m ON k.path = m.path AND k.cluster = m.cluster),
n AS (SELECT (SELECT count(DISTINCT ord) FROM m) AS tp, (SELECT count(*) FROM u WHERE defect) AS fp, (SELECT count(*) FROM x) - (SELECT count(DISTINCT ord) FROM m) AS fn, (SELECT count(*) FROM u WHERE NOT defect) AS advisory)"""


@query(f"""WITH $F, {_SCORE} SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, advisory::BIGINT AS advisory, round(tp / (tp + fp)::DOUBLE, 3) AS precision, round(tp / (tp + fn)::DOUBLE, 3) AS recall, round(2.0 * tp / (2 * tp + fp + fn)::DOUBLE, 3) AS f1 FROM n""")
def eval_prf(spark, d):
    f = findings(spark, d).withColumn("key", F.col("rule_id"))
    return evaluate.score_run(f.where("confidence <= 0.2D"), f.where("confidence > 0.2D").selectExpr("path", "key", "line_start line", "pos ord"))


@query("""WITH t AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'T' ELSE 'F' END AS verdict, source AS pattern FROM labels l JOIN documents d ON l.doc_id = d.doc_id), h AS (SELECT doc_id FROM documents WHERE n_chars > 1000),
j AS (SELECT t.*, h.doc_id IS NOT NULL AS hit FROM t LEFT JOIN h ON t.doc_id = h.doc_id)
SELECT pattern, sum((verdict = 'T' AND hit)::INT)::BIGINT AS kept_t, sum((verdict = 'T' AND NOT hit)::INT)::BIGINT AS lost_t, sum((verdict = 'F' AND hit)::INT)::BIGINT AS still_fp, sum((verdict = 'F' AND NOT hit)::INT)::BIGINT AS removed_fp FROM j GROUP BY pattern""")
def precision_by_pattern(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    truth = table(spark, d, "labels").join(docs, "doc_id").selectExpr("doc_id", "if(toxic = 1, 'T', 'F') verdict", "source pattern")
    return evaluate.against_baseline(truth, docs.where("n_chars > 1000"), ["doc_id"])


@query("""WITH $F, a AS (SELECT * FROM f WHERE rule_id = 'error'), g AS (SELECT * FROM f WHERE rule_id = 'click'),
j AS (SELECT a.pos AS f_id, g.pos AS g_id, abs(a.line_start - g.line_start)::INT AS delta, row_number() OVER (PARTITION BY a.pos ORDER BY abs(a.line_start - g.line_start), g.line_start, g.pos) AS n
FROM a JOIN g ON a.path = g.path AND g.line_start BETWEEN a.line_start - 3 AND a.line_start + 3) SELECT f_id, g_id, delta FROM j WHERE n = 1""")
def nearest_match(spark, d):
    f = findings(spark, d).selectExpr("path", "line_start line", "pos id", "rule_id")
    return evaluate.nearest(f.where("rule_id = 'error'"), f.where("rule_id = 'click'"))


@query("""WITH $F, k AS (SELECT DISTINCT rule_id, path, line_start // 24 AS day FROM f), n AS (SELECT day, count(*) AS n FROM (SELECT DISTINCT day, path FROM k) GROUP BY day), s AS (SELECT DISTINCT day, path FROM k),
j AS (SELECT a.day AS run_a, b.day AS run_b, count(*)::BIGINT AS shared FROM s a JOIN s b ON a.path = b.path AND a.day < b.day GROUP BY ALL)
SELECT run_a::BIGINT AS run_a, run_b::BIGINT AS run_b, shared, (x.n + y.n - shared)::BIGINT AS either, round(shared / (x.n + y.n - shared)::DOUBLE, 6) AS jaccard FROM j JOIN n x ON x.day = run_a JOIN n y ON y.day = run_b""")
def run_jaccard(spark, d):
    return evaluate.jaccard(findings(spark, d).selectExpr("cast(line_start div 24 as bigint) day", "path"), "day", "path")


@query("""WITH $F, s AS (SELECT DISTINCT line_start // 24 AS day, path, rule_id FROM f), n AS (SELECT day, count(*) AS n FROM s GROUP BY day), r AS (SELECT count(*) AS runs FROM n),
j AS (SELECT a.day AS x, b.day AS y, count(*) AS shared FROM s a JOIN s b ON a.path = b.path AND a.rule_id = b.rule_id AND a.day < b.day GROUP BY ALL),
t AS (SELECT sum(shared / (a.n + b.n - shared)::DOUBLE) AS total FROM j JOIN n a ON a.day = x JOIN n b ON b.day = y),
k AS (SELECT path, rule_id FROM s GROUP BY ALL HAVING count(*) = (SELECT runs FROM r))
SELECT runs::BIGINT AS runs, round(coalesce(total, 0) / (runs * (runs - 1) / 2), 3)::DOUBLE AS avg_pairwise, coalesce((SELECT string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FROM k), '') AS stable FROM r, t""")
def run_consistency(spark, d):
    runs = findings(spark, d).selectExpr("cast(line_start div 24 as bigint) day", "path", "rule_id")
    return evaluate.consistency(runs, "day", ["path", "rule_id"], "rule_id").select("runs", "avg_pairwise", F.concat_ws(",", "stable_rules").alias("stable"))


# Leftovers here are at most one on either side, so the one-to-one match is a join.
@query("""WITH $F, k AS (SELECT path, rule_id, line_start // 24 AS day, min(line_start) AS line FROM f GROUP BY ALL), o AS (SELECT * FROM k WHERE day = 3), n AS (SELECT * FROM k WHERE day = 4),
j AS (SELECT coalesce(o.path, n.path) AS path, coalesce(o.rule_id, n.rule_id) AS rule_id, o.line - 72 AS a, n.line - 96 AS b FROM o FULL JOIN n ON o.path = n.path AND o.rule_id = n.rule_id)
SELECT path, rule_id, a::INT AS old_line, b::INT AS new_line, CASE WHEN a = b THEN 'kept' ELSE 'moved' END AS status FROM j WHERE abs(a - b) <= 5
UNION ALL SELECT path, rule_id, a::INT, -1, 'removed' FROM j WHERE a IS NOT NULL AND (b IS NULL OR abs(a - b) > 5) UNION ALL SELECT path, rule_id, -1, b::INT, 'added' FROM j WHERE b IS NOT NULL AND (a IS NULL OR abs(a - b) > 5)""")
def diff_reports(spark, d):
    k = findings(spark, d).withColumn("day", F.expr("line_start div 24")).groupBy("path", "rule_id", "day").agg(F.min("line_start").alias("line"), F.min("pos").alias("pos"))
    day = lambda n: k.where(F.col("day") == n).select("path", "rule_id", (F.col("line") - 24 * n).cast("int").alias("line_start"), "pos")
    missing = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return history.diff(day(3), day(4), 5).select("path", "rule_id", missing("old_line"), missing("new_line"), "status")


# All findings of both runs; the recursion goes through a path's and rule's near pairs in order and keeps the lines used.
@query("""WITH RECURSIVE $F, k AS (SELECT DISTINCT path, rule_id, line_start // 24 AS day, (line_start % 24)::INT AS line FROM f WHERE line_start // 24 IN (3, 4)),
o AS (SELECT * FROM k WHERE day = 3), n AS (SELECT * FROM k WHERE day = 4),
kept AS (SELECT path, rule_id, line FROM o JOIN n USING (path, rule_id, line)), a AS (SELECT path, rule_id, line FROM o ANTI JOIN kept USING (path, rule_id, line)), b AS (SELECT path, rule_id, line FROM n ANTI JOIN kept USING (path, rule_id, line)),
p AS (SELECT path, rule_id, a.line AS x, b.line AS y, row_number() OVER (PARTITION BY path, rule_id ORDER BY abs(a.line - b.line), a.line, b.line) AS i FROM a JOIN b USING (path, rule_id) WHERE abs(a.line - b.line) <= 5),
r AS (SELECT path, rule_id, i, [x] AS xs, [y] AS ys FROM p WHERE i = 1 UNION ALL
SELECT p.path, p.rule_id, p.i, CASE WHEN list_contains(xs, x) OR list_contains(ys, y) THEN xs ELSE list_append(xs, x) END, CASE WHEN list_contains(xs, x) OR list_contains(ys, y) THEN ys ELSE list_append(ys, y) END
FROM r JOIN p ON p.path = r.path AND p.rule_id = r.rule_id AND p.i = r.i + 1),
m AS (SELECT path, rule_id, unnest(arg_max(xs, i)) AS x, unnest(arg_max(ys, i)) AS y FROM r GROUP BY path, rule_id)
SELECT path, rule_id, line AS old_line, line AS new_line, 'kept' AS status FROM kept UNION ALL SELECT path, rule_id, x, y, 'moved' FROM m
UNION ALL SELECT path, rule_id, line, -1, 'removed' FROM a ANTI JOIN m ON a.path = m.path AND a.rule_id = m.rule_id AND a.line = m.x
UNION ALL SELECT path, rule_id, -1, line, 'added' FROM b ANTI JOIN m ON b.path = m.path AND b.rule_id = m.rule_id AND b.line = m.y""")
def diff_findings(spark, d):
    k = findings(spark, d).withColumn("day", F.expr("line_start div 24"))
    day = lambda n: k.where(F.col("day") == n).select("path", "rule_id", (F.col("line_start") - 24 * n).cast("int").alias("line_start"), "pos")
    missing = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return history.diff(day(3), day(4), 5).select("path", "rule_id", missing("old_line"), missing("new_line"), "status")


@query("""WITH $F, r AS (SELECT (line_start // 24)::BIGINT AS day, count(*)::BIGINT AS n FROM f GROUP BY 1) SELECT count(*)::BIGINT AS runs, arg_min(n, day) AS first, arg_max(n, day) AS last, arg_max(n, day) - arg_min(n, day) AS delta, max(n) AS largest FROM r""")
def trend_points(spark, d):
    runs = findings(spark, d).groupBy(F.expr("line_start div 24").alias("day")).agg(F.count("*").alias("n"))
    return history.trend(runs, ["day"], "n")


@query("WITH $F, r AS (SELECT pos, path, row_number() OVER (PARTITION BY path ORDER BY ts DESC, pos DESC) AS n FROM f) SELECT pos, path, n::INT AS n FROM r WHERE n <= 5")
def retention_latest_n(spark, d):
    return history.latest(findings(spark, d).select("pos", "path", "ts"), "path", [F.desc("ts"), F.desc("pos")], 5).select("pos", "path", "n")


@query("WITH $F SELECT concat_ws('|', rule_id, path, rule_id) AS key, rule_id AS rule, count(*)::BIGINT AS count, min(line_start) AS first, max(line_start) AS last FROM f GROUP BY ALL")
def feedback_upsert(spark, d):
    f = findings(spark, d).selectExpr("rule_id rule", "path", "rule_id title", "line_start ts", "pos")
    return history.merge_feedback(history.feedback(f.where("pos % 2 = 0")), history.feedback(f.where("pos % 2 = 1")))


@query("""WITH $F, k AS (SELECT rule_id AS rule, path AS file, detector AS title, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT rule, max(n)::BIGINT AS most, count(DISTINCT file)::BIGINT AS files, sum(n)::BIGINT AS total FROM k GROUP BY rule) SELECT * FROM r WHERE most >= 2 OR files >= 3""")
def feedback_promote(spark, d):
    return history.promote(findings(spark, d).selectExpr("rule_id rule", "path", "detector title"))


@query("""SELECT d.doc_id AS key, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN toxic = 1 THEN 'reject' ELSE 'accept' END AS decision FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""")
def review_join(spark, d):
    decisions = table(spark, d, "labels").selectExpr("doc_id key", "if(toxic = 1, 'reject', 'accept') decision", "toxic ts")
    return history.review(table(spark, d, "documents").selectExpr("doc_id key"), decisions)


@query("""WITH v AS (SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'T' WHEN toxic = 1 THEN 'F' ELSE '?' END AS verdict FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
c AS (SELECT lang, sum((verdict = 'T')::INT)::BIGINT AS t, sum((verdict = 'F')::INT)::BIGINT AS f, sum((verdict = '?')::INT)::BIGINT AS open FROM v GROUP BY lang) SELECT lang, t, f, open, round(t / nullif(t + f, 0)::DOUBLE, 6) AS precision FROM c""")
def verdict_pivot(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.verdict_pivot(rows.selectExpr("lang", "case when quality = 1 and toxic = 0 then 'T' when toxic = 1 then 'F' else '?' end verdict"), "lang")


@query("""WITH n AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), s AS (SELECT p_brand, avg((p_size > 25)::INT) AS share FROM part GROUP BY 1)
SELECT p_brand, n::BIGINT AS n, round(n * share, 4) AS estimated FROM n JOIN s USING (p_brand)""")
def extrapolate(spark, d):
    part = table(spark, d, "part")
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("n").alias("n"))
    share = part.groupBy("p_brand").agg(F.avg((F.col("p_size") > 25).cast("int")).alias("share"))
    return n.join(share, "p_brand").select("p_brand", "n", F.round(F.col("n") * F.col("share"), 4).alias("estimated"))


@query("SELECT count(*)::BIGINT AS common, sum((quality <> toxic)::INT)::BIGINT AS changed, round(sum((quality <> toxic)::INT) / count(*)::DOUBLE, 6) AS rate FROM labels")
def flip_rate(spark, d):
    labels = table(spark, d, "labels")
    return evaluate.flips(labels.selectExpr("doc_id", "quality verdict"), labels.selectExpr("doc_id", "toxic verdict"), ["doc_id"])


# ---- retrieval ----------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in kb.STOP)


@query(f"""WITH q AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z_]{{3,}}')) AS word FROM documents), t AS (SELECT item_id AS ord, unnest(regexp_extract_all(lower(text), '[a-z_]{{3,}}')) AS word FROM benchmark),
w AS (SELECT ord, word, count(*) AS weight FROM t GROUP BY ALL), s AS (SELECT query_id, ord, sum(weight)::BIGINT AS score FROM q JOIN w USING (word) WHERE word NOT IN ({_STOP}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord)::INT AS rank FROM s) SELECT query_id, ord, score, rank FROM r WHERE rank <= 5""")
def kb_topk_keyword(spark, d):
    none = "cast(array() as array<string>)"
    items = table(spark, d, "benchmark").selectExpr("item_id ord", f"{none} triggers", f"{none} tags", "text title", f"{none} not_when", f"{none} require_any_in")
    return kb.retrieve(table(spark, d, "documents").selectExpr("doc_id query_id", "text"), items, 5).select("query_id", "ord", "score", "rank")


# A passage of the benchmark is an item: pieces of it are its triggers, vetoes, conditions and tags.
_ITEMS = """SELECT item_id AS ord, text AS title, {a}(substr(text, 1, 9), replace(substr(text, 12, 7), 'e', 'E')) AS triggers, {a}(lower(substr(text, 1, 4)), 'licensed') AS tags,
CASE WHEN item_id % 3 = 0 THEN {a}(substr(text, 30, 4)) ELSE {e} END AS not_when, CASE WHEN item_id % 4 = 1 THEN {a}(substr(text, 50, 5), 'License') ELSE {e} END AS require_any_in FROM {t}"""


@query(f"""WITH i AS ({_ITEMS.format(a="list_value", e="[]::VARCHAR[]", t="benchmark")}), q AS (SELECT doc_id, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[a-z_]{{3,}}')) AS words FROM documents),
p AS (SELECT doc_id AS query_id, ord, 3 * len(list_filter(triggers, lambda x: contains(low, lower(x)))) + 2 * len(list_filter(tags, lambda x: list_contains(words, lower(x)) AND lower(x) NOT IN ({_STOP})))
+ len(list_filter(regexp_extract_all(lower(title), '[a-z_]{{3,}}'), lambda x: list_contains(words, x) AND x NOT IN ({_STOP}))) AS score,
len(list_filter(not_when, lambda x: contains(low, lower(x)))) > 0 OR (len(require_any_in) > 0 AND len(list_filter(require_any_in, lambda x: contains(low, lower(x)))) = 0) AS vetoed FROM q, i)
SELECT query_id, ord, score::BIGINT AS score, vetoed FROM p WHERE score > 0 OR vetoed""")
def kb_retrieve(spark, d):
    """Scores and vetoes of all items for all documents."""
    items = spark.sql(_ITEMS.format(a="array", e="cast(array() as array<string>)", t="{t}"), t=table(spark, d, "benchmark"))
    return kb.retrieve(table(spark, d, "documents").selectExpr("doc_id query_id", "text"), items, vetoes=True)


def _nearest(spark, d) -> DataFrame:
    """The five nearest of every 50th vector among all others."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return kb.vector_top_k(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "ord"), 5, others=True)


_VEC = """s AS (SELECT q.vec_id AS query_id, e.vec_id AS ord, greatest(round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6), 0.0) AS score, q.label = e.label AS good, q.label AS grp FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord)::INT AS rank FROM s)"""


@query(f"WITH {_VEC} SELECT query_id, ord, score, rank FROM r WHERE rank <= 5")
def kb_topk_vector(spark, d):
    return _nearest(spark, d).select("query_id", "ord", "score", "rank")


@query(f"WITH {_VEC}, p AS (SELECT grp, query_id, max(good::INT) AS hit FROM r WHERE rank <= 5 GROUP BY ALL) SELECT grp, count(*)::BIGINT AS queries, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS recall FROM p GROUP BY grp")
def rag_recall_at_k(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    found = _nearest(spark, d).join(labels.toDF("ord", "l"), "ord").join(labels.toDF("query_id", "grp"), "query_id")
    return evaluate.recall_at_k(found.select("query_id", "ord", "score", "rank", (F.col("l") == F.col("grp")).alias("good"), "grp"), 5)


# ---- graphs -------------------------------------------------------------------------------------------------

_E = "e AS (SELECT o_custkey AS src, l_suppkey AS dst, count(*)::BIGINT AS calls FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


@query(f"WITH {_E} SELECT src, dst, calls FROM e")
def call_counts(spark, d):
    o, l_ = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(l_, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("calls"))


# A customer is a function of the module of its number modulo 50, every third a method of its class K; each module imports
# all others. An order's line calls the function of the supplier's number: by the module, bare, by self or by the class.
_FQN = "'m' || {0} % 50 || if({0} % 3 = 0, '.K', '') || '.f' || {0}"


@query(f"""WITH c AS (SELECT {_FQN.format("c_custkey")} AS fqn FROM customer), x AS (SELECT o_custkey AS k, l_suppkey AS s, (o_orderkey + l_linenumber) % 5 AS how FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e AS (SELECT {_FQN.format("k")} AS caller, CASE WHEN how = 0 THEN 'm' || s % 50 || '.f' || s WHEN how = 1 THEN 'm' || k % 50 || '.f' || s WHEN how = 2 AND k % 3 = 0 THEN 'm' || k % 50 || '.K.f' || s WHEN how = 3 THEN 'm' || k % 50 || '.K.f' || s END AS callee FROM x)
SELECT caller, callee, count(*)::BIGINT AS calls FROM e WHERE callee IN (SELECT fqn FROM c) AND caller <> callee GROUP BY ALL""")
def call_edges(spark, d):
    def make(t, path, kind, scope, klass, name, target, line):
        none = "cast(array() as array<string>)"
        return t.selectExpr(f"{path} path", f"'{kind}' kind", f"{scope} scope", f"{klass} klass", f"{name} name", f"{target} target", "0 pos", f"{line} line", f"{none} names", f"{none} flags")

    file = "concat('m', {} % 50, '.py')"
    scope, klass = "concat(if({0} % 3 = 0, 'K.', ''), 'f', {0})", "if({0} % 3 = 0, 'K', '')"
    calls = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"))
    calls = calls.withColumn("how", F.expr("(o_orderkey + l_linenumber) % 5"))
    named = "case how when 0 then concat('x', l_suppkey % 50, '.f', l_suppkey) when 1 then concat('f', l_suppkey) when 2 then concat('self.f', l_suppkey) when 3 then concat('K.f', l_suppkey) else 'print' end"
    c = table(spark, d, "customer")
    modules = c.selectExpr("c_custkey % 50 m").distinct()
    facts = make(c, file.format("c_custkey"), "node", scope.format("c_custkey"), klass.format("c_custkey"), "concat('f', c_custkey)", "''", "1")
    facts = facts.union(make(modules.select("m", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("k")), file.format("m"), "alias", "''", "''", "concat('x', k)", "concat('m', k)", "1"))
    facts = facts.union(make(calls, file.format("o_custkey"), "edge", scope.format("o_custkey"), klass.format("o_custkey"), named, "''", "l_linenumber"))
    return graph.call_edges(facts).groupBy("caller", "callee").agg(F.count("*").alias("calls"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, (user_id * 7 + floor(value)::BIGINT) % 150 AS dst FROM events WHERE event_type = 'purchase' AND value > 60),
r AS (SELECT 1::BIGINT AS node, 0 AS round UNION SELECT e.dst, round + 1 FROM r JOIN e ON e.src = r.node WHERE round < 6) SELECT node, min(round)::INT AS round FROM r GROUP BY node""")
def reach_fixpoint(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase' and value > 60").selectExpr("user_id src", "(user_id * 7 + cast(floor(value) as bigint)) % 150 dst")
    return graph.reach(e, spark.range(1, 2).toDF("node"))


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS n, (c_custkey * 7 + 1) % (SELECT count(*) FROM customer) AS t, c_acctbal < 0 AS cut FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
a AS (SELECT n FROM c WHERE cut UNION SELECT c.n FROM a JOIN c ON c.t = a.n) SELECT 'm' || n || '.f' AS fqn FROM a""")
def call_changes(spark, d):
    """Customers as files, some calling another's function; those in debt stop to. All functions that can notice."""
    c = table(spark, d, "customer")
    n = c.count()
    calls = "c_mktsegment in ('BUILDING', 'MACHINERY')"
    source = lambda when: F.expr(f"if({when}, concat('from m', (c_custkey * 7 + 1) % {n}, ' import f as g\\n\\ndef f():\\n    g()\\n'), 'def f():\\n    pass\\n')").alias("text")
    path = F.expr("concat('m', c_custkey, '.py')").alias("path")
    before = changes.refresh(changes.empty(spark), c.select(path, source(calls)))
    after = changes.refresh(before, c.select(path, source(f"{calls} and c_acctbal >= 0")))
    return changes.affected(before, after).select("fqn")


def _colour_rounds(rounds: int) -> str:
    """SQL of the rounds of graph.colours over e(src, dst, via) and c0(node, f): a table a round of what it reaches first."""
    out = []
    for k in range(1, rounds + 1):
        old = " AND ".join(f"dst NOT IN (SELECT node FROM c{i})" for i in range(k))
        out.append(f"c{k} AS MATERIALIZED (SELECT dst AS node, bool_or(via OR f) AS f FROM e JOIN c{k - 1} ON src = node WHERE {old} GROUP BY dst)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT node, f AS \"foreign\", {k}::INT AS round FROM c{k}" for k in range(rounds + 1))


@query(f"""WITH l AS (SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS nxt, l_returnflag FROM lineitem),
e AS (SELECT l_partkey AS src, nxt AS dst, bool_or(l_returnflag = 'R') AS via FROM l WHERE nxt IS NOT NULL GROUP BY 1, 2),
c0 AS (SELECT p_partkey AS node, p_size = 50 AS f FROM part WHERE p_size >= 49), {_colour_rounds(6)}""")
def taint_colours(spark, d):
    """Parts in an order's sequence as variables; what was returned went through a parameter."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), (F.col("l_returnflag") == "R").alias("foreign")).where("dst is not null")
    return graph.colours(e, table(spark, d, "part").where("p_size >= 49").selectExpr("p_partkey node", "p_size = 50 foreign"))


@query("""WITH $F, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE rule_id WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, line_start, pos) AS n FROM f) SELECT path, rule_id, line_start, pos FROM r WHERE n = 1""")
def origin_priority(spark, d):
    rank = F.when(F.col("rule_id") == "error", 0).when(F.col("rule_id") == "click", 1).when(F.col("rule_id") == "view", 2).otherwise(3)
    return findings(spark, d).groupBy("path").agg(F.min_by(F.struct("rule_id", "line_start", "pos"), F.struct(rank, "line_start", "pos")).alias("o")).select("path", "o.*")


@query("""WITH t AS (SELECT l_suppkey, count(*) AS size FROM lineitem GROUP BY 1 ORDER BY size DESC, l_suppkey LIMIT 8), r AS (SELECT l.l_suppkey, l_orderkey, l_linenumber, size, row_number() OVER (PARTITION BY l.l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem l JOIN t ON l.l_suppkey = t.l_suppkey)
SELECT l_suppkey, l_orderkey, l_linenumber, size::BIGINT AS size, n::INT AS n FROM r WHERE n <= 6""")
def worklist_topn(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("o"))
    return evaluate.nested_top(rows, "l_suppkey", 8, 6, "o").drop("o")


# ---- evaluation of planted rows, stores and caches ----------------------------------------------------------


@query("""WITH $F, m AS (SELECT pos AS id, path AS file, line_start AS a, line_end AS b, CASE WHEN pos % 4 = 0 THEN 'TRAP' ELSE rule_id END AS expect FROM f WHERE confidence > 0.8),
h AS (SELECT path AS file, line_start AS line, rule_id AS rule, fix AS evidence FROM f WHERE confidence <= 0.8),
n AS (SELECT id, expect, h.rule, contains(evidence, '5') AS named FROM m LEFT JOIN h ON m.file = h.file AND line BETWEEN a - (expect <> 'TRAP')::INT AND b + (expect <> 'TRAP')::INT),
r AS (SELECT id, expect, count(rule) AS n, coalesce(bool_or(rule = expect), false) AS hit, coalesce(bool_or(rule = expect AND named), false) AS placed FROM n GROUP BY id, expect)
SELECT expect, CASE WHEN expect = 'TRAP' THEN CASE WHEN n > 0 THEN 'TRAP_BREACH' ELSE 'trap_clean' END WHEN placed THEN 'hit_located' WHEN hit THEN 'hit_unlocated' ELSE 'MISS' END AS result, count(*)::BIGINT AS rows FROM r GROUP BY ALL""")
def planted_results(spark, d):
    f = findings(spark, d)
    m = f.where("confidence > 0.8D").selectExpr("pos id", "'l' lib", "path file", "line_start start", "line_end end", "if(pos % 4 = 0, 'TRAP', rule_id) expect")
    hits = f.where("confidence <= 0.8D").selectExpr("'l' lib", "path file", "line_start line", "rule_id rule", "fix evidence")
    words = f.selectExpr("rule_id rule", "'5' word").distinct()
    return evaluate.planted(m, hits, words).groupBy("expect", "result").agg(F.count("*").alias("rows"))


_ADJ = "t AS (SELECT CASE WHEN quality = 1 THEN 'T' WHEN toxic = 1 THEN 'F' ELSE 'O' END AS gt, d.n_chars > 1500 AS keep FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query(f"""WITH {_ADJ}, c AS (SELECT count(*)::BIGINT AS n, sum((gt = 'T')::INT)::BIGINT AS t_before, sum((gt = 'F')::INT)::BIGINT AS f_before, sum((gt = 'T' AND keep)::INT)::BIGINT AS t_after, sum((gt = 'F' AND keep)::INT)::BIGINT AS f_after,
sum((gt = 'F' AND NOT keep)::INT)::BIGINT AS fp_killed, sum((gt = 'T' AND NOT keep)::INT)::BIGINT AS lost_t, sum((gt = 'O' AND keep)::INT)::BIGINT AS novel_kept FROM t)
SELECT *, round(t_before / nullif(t_before + f_before, 0)::DOUBLE, 3) AS precision_before, round(t_after / nullif(t_after + f_after, 0)::DOUBLE, 3) AS precision_after FROM c""")
def adjudication(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.adjudication_summary(rows.selectExpr("case when quality = 1 then 'T' when toxic = 1 then 'F' else 'O' end gt", "n_chars > 1500 real"))


@query("""WITH t AS (SELECT l_shipdate - INTERVAL 0 SECOND AS ts, l_suppkey, l_orderkey * 10 + l_linenumber AS i FROM lineitem), n AS (SELECT *, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY l_suppkey ORDER BY ts, i) AS k FROM t)
SELECT i::BIGINT AS i, (max(ms - k) OVER (PARTITION BY l_suppkey ORDER BY ts, i ROWS UNBOUNDED PRECEDING) + k)::BIGINT AS stamp_ms FROM n""")
def rising_stamps(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("timestamp_millis(cast(timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate) as bigint)) ts", "l_suppkey", "l_orderkey * 10 + l_linenumber i")
    return history.stamped(rows, "ts", "l_suppkey", "i").select("i", F.unix_millis("stamp").alias("stamp_ms"))


@query("""SELECT event_type || '|u' || user_id || '|' || CASE WHEN event_id % 3 = 0 THEN 'llm' ELSE 'static' END AS key, event_type AS rule, count(*)::BIGINT AS count, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2""")
def feedback_stream(spark, d):
    """Events as a stream of feedback, kept as state."""
    # a stream takes a pattern where it would not take the path of one file
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    said = rows.selectExpr("cast(ts as timestamp) ts", "event_type rule", "concat('a/u', user_id) path", "if(event_id % 3 = 0, 'llm', 'static') title")
    out = f"{shared_dir(spark)}/feedback-{uuid4().hex}"
    incremental.keep_feedback(said, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    kept = incremental.feedback_now(spark, f"{out}/rows")
    return kept.select("key", "rule", "count", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


@query("""WITH e AS (SELECT md5(text) AS key, max(doc_id) AS ts, arg_max(lang, doc_id) AS model FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1), k AS (SELECT * FROM e ORDER BY ts DESC, key LIMIT 60)
SELECT model, count(*)::BIGINT AS entries FROM k GROUP BY model""")
def cache_prune(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 3 <> 0").selectExpr("md5(text) key", "text raw", "doc_id ts", "lang model")
    return cache.stats(cache.put(docs.limit(0), docs, most=80, keep=60))


@query("""WITH e AS (SELECT DISTINCT sha1(text) AS h FROM documents WHERE doc_id % 3 <> 0) SELECT doc_id, 'f:' || sha1(text) AS key, sha1(text) IN (SELECT h FROM e) AS hit FROM documents""")
def cache_probe(spark, d):
    docs = table(spark, d, "documents")
    stored = docs.where("doc_id % 3 <> 0").select(cache.content_key(F.col("text"), F.lit("f")).alias("key")).distinct()
    return cache.probe(docs.select("doc_id", cache.content_key(F.col("text"), F.lit("f")).alias("key")), stored)


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'x y' ELSE 'K-' || p_partkey % 40 END AS id, p_name AS title, CASE WHEN p_size > 45 THEN 'odd' ELSE 'low' END AS severity FROM part),
c AS (SELECT *, CASE WHEN NOT regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9_.-]{1,63}') THEN 'id' WHEN severity = 'odd' THEN 'severity' WHEN id IN (SELECT 'K-' || s_suppkey FROM supplier WHERE s_suppkey < 10) THEN 'builtin' ELSE '' END AS reason FROM n)
SELECT id, reason, count(*)::BIGINT AS rows FROM c GROUP BY ALL""")
def store_checks(spark, d):
    new = table(spark, d, "part").selectExpr("p_partkey pos", "if(p_partkey % 5 = 0, 'x y', concat('K-', p_partkey % 40)) id", "p_name title", "if(p_size > 45, 'odd', 'low') severity", "'security' category")
    builtin = table(spark, d, "supplier").where("s_suppkey < 10").selectExpr("concat('K-', s_suppkey) id")
    return store.checked(new, builtin).groupBy("id", "reason").agg(F.count("*").alias("rows"))


def _tree_sql(rows: str) -> str:
    """SQL of store.tree_hash over a table with a column text: a level of nodes after the other."""
    levels = ["n8 AS (SELECT left(leaf, 8) AS pre, sha256(string_agg(leaf, '' ORDER BY leaf)) AS hash, sum(n) AS n FROM leaves GROUP BY 1)"]
    levels += [f"n{k} AS (SELECT left(pre, {k}) AS pre, sha256(string_agg(hash, '' ORDER BY pre)) AS hash, sum(n) AS n FROM n{k + 2} GROUP BY 1)" for k in (6, 4, 2, 0)]
    return f"leaves AS (SELECT sha256(text || '#' || count(*)) AS leaf, count(*) AS n FROM {rows} GROUP BY text), " + ", ".join(levels)


@query(f"""WITH r AS (SELECT '{{"id":"R-' || p_partkey || '","severity":' || CASE WHEN p_size > 45 THEN 'null' ELSE '"low"' END || ',"title":"' || p_name || '"}}' AS text FROM part), {_tree_sql("r")} SELECT 'pack' AS kind, n::BIGINT AS rows, hash[:32] AS checksum FROM n0""")
def pack_tree(spark, d):
    """The checksum of a pack of all parts as rules."""
    rows = table(spark, d, "part").selectExpr("concat('R-', p_partkey) id", "if(p_size > 45, null, 'low') severity", "p_name title")
    return store.pack_checksum(rows)


@query("""WITH n AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'x y' ELSE 'K-' || p_partkey END AS id, p_partkey AS pos, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '(' || p_name WHEN 2 THEN p_name || '[' ELSE '(' || p_name || ')+' END AS pattern FROM part)
SELECT id, pos::BIGINT AS pos, CASE WHEN id = 'x y' THEN 'id' WHEN pos % 4 <> 3 THEN 'pattern' ELSE '' END AS reason FROM n""")
def rule_admission(spark, d):
    """Rules whose patterns are empty, don't compile or do."""
    pattern = "case p_partkey % 4 when 0 then '' when 1 then concat('(', p_name) when 2 then concat(p_name, '[') else concat('(', p_name, ')+') end pattern"
    new = table(spark, d, "part").selectExpr("p_partkey pos", "if(p_partkey % 5 = 0, 'x y', concat('K-', p_partkey)) id", "p_name title", "'low' severity", "'security' category", pattern)
    return store.checked(new, new.select("id").limit(0)).select("id", "pos", "reason")


@query("SELECT doc_id, 'FP-' || lang || '-' || substr(sha1(source), 1, 6) AS proposal, substr(sha256(text), 1, 32) AS checksum FROM documents")
def proposal_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", history.proposal_id(F.col("lang"), F.col("source")).alias("proposal"), T.checksum(F.col("text")).alias("checksum"))


@query(f"SELECT doc_id AS pos, source AS path, md5({_mask_sql('text')}) AS evidence_md5 FROM (SELECT doc_id, source, {_WITH} AS text FROM documents)")
def shared_report(spark, d):
    f = _with_secrets(spark, d).selectExpr("doc_id pos", "concat('a/b/', source) path", "text evidence")
    return report.redacted(f).select("pos", "path", F.md5("evidence").alias("evidence_md5"))


@query("""SELECT conv_id, turn, regexp_extract(t, '(?s)```[a-zA-Z0-9_+-]*[ \t]*\n(.*?)```', 1) AS code FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'see' || chr(10) || '```py' || chr(10) || replace(text, '`', '') || '```' ELSE replace(text, '`', '') END AS t FROM conversations)""")
def reply_code(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("see\n```py\n"), F.replace("text", F.lit("`"), F.lit("")), F.lit("```"))).otherwise(F.replace("text", F.lit("`"), F.lit(""))).alias("t"))
    return t.select("conv_id", "turn", F.coalesce(replies.fenced(F.col("t")), F.lit("")).alias("code"))


@query("""WITH $L, n AS (SELECT path, line_no, line, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k FROM l WHERE regexp_matches(line, '(the|und)')) SELECT path, line_no, regexp_extract(line, '(the|und)', 0)[:60] AS found FROM n WHERE k <= 20""")
def pattern_preview(spark, d):
    return store.preview(document_lines(spark, d), "(the|und)", 20)


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS n, p_size AS z FROM part)
SELECT 'DEP-' || CASE WHEN z % 3 = 0 THEN 'CVE-' || k ELSE 'G-' || k END AS rule_id, 'high' AS severity, n || '==' || z AS evidence, CASE WHEN z % 5 = 0 THEN 'see the advisory' ELSE z || '.1, ' || z || '.2' END AS fix, 'r' || k AS path FROM p WHERE k % 2 = 0
UNION ALL SELECT 'DEP-NPM-' || n, CASE z % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'medium' END, n, 'see the advisory', 'r' || k FROM p WHERE k % 2 = 1""")
def dependency_reports(spark, d):
    """Parts as packages in the reports of a scanner, each row twice, or of a registry."""
    scanner = """concat('{"dependencies":[{"name":"', p_name, '","version":"', p_size, '","vulns":[', v, ',', v, ']}]}')"""
    v = """concat('{"id":"G-', p_partkey, '","aliases":[', if(p_size % 3 = 0, concat('"X-1","CVE-', p_partkey, '"'), ''), '],"fix_versions":[', if(p_size % 5 = 0, '', concat('"', p_size, '.1","', p_size, '.2"')), ']}') v"""
    registry = """concat('{"vulnerabilities":{"', p_name, '":{"severity":"', element_at(array('Critical', 'moderate', 'low', 'odd'), p_size % 4 + 1), '","via":[{"a":1},"b"]}}}')"""
    rows = table(spark, d, "part").selectExpr("*", v).selectExpr("concat('r', p_partkey) path", f"if(p_partkey % 2 = 0, {scanner}, {registry}) text")
    return files.dependency_issues(rows).select("rule_id", "severity", "evidence", "fix", "path")


# ---- reports ------------------------------------------------------------------------------------------------


@query("WITH $F, g AS (SELECT rule_id, min(pos) AS first_pos, count(*)::BIGINT AS count FROM f GROUP BY 1) SELECT rule_id, first_pos, count, (row_number() OVER (ORDER BY first_pos) - 1)::INT AS rule_index FROM g")
def first_seen_index(spark, d):
    return report.first_seen(findings(spark, d))


@query("""WITH $F, g AS (SELECT rule_id, row_number() OVER (ORDER BY min(pos)) - 1 AS i FROM f GROUP BY 1), x AS (SELECT *, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'low' THEN 'note' ELSE 'warning' END AS level,
CASE WHEN line_start = 0 THEN 1 ELSE line_start END AS a, CASE WHEN line_end = 0 THEN 1 ELSE line_end END AS b FROM f)
SELECT pos, x.rule_id, i::INT AS rule_index, level, CASE severity WHEN 'critical' THEN '9.0' WHEN 'high' THEN '7.0' WHEN 'low' THEN '2.0' ELSE '5.0' END AS score, path, greatest(a, 1)::INT AS line,
'{"ruleId":"' || x.rule_id || '","ruleIndex":' || i || ',"level":"' || level || '","message":{"text":"' || x.rule_id || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '"},"region":{"startLine":' || greatest(a, 1) || ',"endLine":' || greatest(a, b)
|| '}}}],"partialFingerprints":{"primaryLocationLineHash":"' || x.rule_id || ':' || path || ':' || a || '"},"properties":{"severity":"' || severity || '","category":"' || category || '","detector":"' || detector || '","confidence":0.5,"evidence":"","fix":"' || replace(fix[:1000], '"', chr(92) || '"') || '","source":""}}' AS result FROM x JOIN g ON x.rule_id = g.rule_id""")
def sarif_json(spark, d):
    """Every finding's SARIF result, as text."""
    return report.sarif_results(findings(spark, d).withColumn("confidence", F.lit(0.5)))


@query("SELECT p_partkey AS pos, p_brand AS rule_id, p_type AS category FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size > 45) AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey = 1)")
def preset_filter(spark, d):
    part = table(spark, d, "part").selectExpr("p_partkey pos", "p_brand rule_id", "p_type category", "p_size")
    return report.preset(part, part.where("p_size > 45"), part.where("pos = 1")).select("pos", "rule_id", "category")


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 WHEN o_orderpriority LIKE '3%' THEN 2 WHEN o_orderpriority LIKE '4%' THEN 3 END AS r FROM orders)
SELECT coalesce(r, -1)::INT AS rank, count(*)::BIGINT AS n, count(*) > 0 AS fails FROM s WHERE r IS NULL OR r <= 1 GROUP BY 1""")
def severity_gate(spark, d):
    sev = F.when(F.col("o_orderpriority").like("1%"), "critical").when(F.col("o_orderpriority").like("2%"), "high").when(F.col("o_orderpriority").like("3%"), "medium").when(F.col("o_orderpriority").like("4%"), "low").otherwise("none")
    kept = report.at_least(table(spark, d, "orders").select("o_orderkey", sev.alias("severity")), "high")
    return kept.groupBy(F.coalesce(schema.severity_rank(F.col("severity")), F.lit(-1)).alias("rank")).agg(F.count("*").alias("n"), (F.count("*") > 0).alias("fails"))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 0)
SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'common', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'novel', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)""")
def union_sets(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 5000").selectExpr("c_nationkey k").distinct()
    s = table(spark, d, "supplier").where("s_acctbal > 0").selectExpr("s_nationkey k").distinct()
    tag = lambda name, x: x.select(F.lit(name).alias("op"), "k")
    return tag("union", c.union(s).distinct()).union(tag("common", c.intersect(s))).union(tag("novel", c.join(s, "k", "left_anti")))


@query("""WITH $L SELECT path, line_no, md5(string_agg(lpad(line_no::VARCHAR, 4, ' ') || '| ' || line, chr(10) ORDER BY line_no) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS context_md5 FROM l""")
def numbered_context(spark, d):
    return lines.context(document_lines(spark, d), 2).select("path", "line_no", F.md5("context").alias("context_md5"))


@query("""SELECT page_id, string_split(url, '/')[-1] AS base, regexp_extract(string_split(url, '/')[-1], '(\\.[^.]+)$', 1) AS suffix, regexp_replace(string_split(url, '/')[-1], '\\.[^.]+$', '') AS stem, regexp_matches(url, '/(en|fr)/') AS skipped FROM pages""")
def path_functions(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.base_name(u).alias("base"), T.suffix(u).alias("suffix"), T.stem(u).alias("stem"), F.rlike(u, F.lit("/(en|fr)/")).alias("skipped"))


@query("SELECT doc_id, substr(sha1(text), 1, 16) AS content_key, substr(sha256(lang || chr(0) || text), 1, 32) AS prompt_key, count(*) OVER (PARTITION BY sha1(text))::BIGINT AS copies FROM documents")
def hash_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("h"), T.short_hash(F.col("text")).alias("content_key"), T.prompt_key(F.col("lang"), F.col("text")).alias("prompt_key"))
    n = docs.groupBy("h").agg(F.count("*").alias("copies"))
    return docs.join(n, "h").drop("h")
