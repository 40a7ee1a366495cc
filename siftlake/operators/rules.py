"""Line rules: a table of patterns and exemptions, compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literals import candidates, fold, matches
from ..functions.text import lstrip, strip
from . import lines as L


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    pattern: str
    exclude: tuple[str, ...] = ()
    skip_path: str = ""
    in_comments: bool = False
    in_docstrings: bool = False
    top_only: bool = False
    checks: tuple[str, ...] = ()
    exts: tuple[str, ...] = field(default=(".py",))


# The patterns of the line rules and what they leave out.
PYTHON = (
    Rule("R-SEC-001", "critical", "security", r"""execute\w*\s*\(\s*f["']|execute\w*\s*\([^)]*\.format\(|execute\w*\s*\(\s*["'][^"']*["']\s*(%|\+)|execute\w*\s*\(\s*\w+\s*(\+|%)""", ("# nosec",)),
    Rule("R-SEC-002", "critical", "security", r"os\.system\s*\(", ("# nosec",)),
    Rule("R-SEC-003", "critical", "security", r"(?<![.\w])(?<!def )(?:eval|exec)\s*\(", skip_path="(?:_vendor|vendored|site-packages)[/]"),
    Rule("R-SEC-004", "high", "security", r"pickle\.loads?\s*\(|yaml\.load\s*\((?![^)]*Safe)"),
    Rule("R-SEC-005", "high", "security", r"verify\s*=\s*False"),
    Rule("R-SEC-006", "high", "security", r"""(?i)(api_?key|secret|password|passwd|token)\s*=\s*["'][^"']{8,}["']"""),
    Rule("R-SEC-007", "medium", "security", r"hashlib\.(md5|sha1)\s*\(", ("# nosec", "usedforsecurity=False")),
    Rule("R-SEC-008", "high", "security", r"shell\s*=\s*True"),
    Rule("R-LOG-001", "medium", "logic", r"\bexcept\s*(:|Exception\s*:|BaseException\s*:)", checks=("no_reraise", "not_probe", "not_logged")),
    Rule("R-LOG-002", "medium", "logic", r"def\s+\w+\([^)]*=(\[\]|\{\}|set\(\))"),
    Rule("R-LOG-003", "low", "logic", r"""\bis\s+("|'|[0-9]+\b(?!!))"""),
    Rule("R-ENG-001", "low", "engineering", r"=\s*(open|sqlite3\.connect|requests\.(get|post))\s*\(", checks=("not_closed",)),
    Rule("R-ENG-002", "low", "style", r"#\s*(TODO|FIXME|HACK|XXX)", in_comments=True),
    Rule("R-SEC-009", "medium", "security", r"random\.(random|randint|choice|sample)\s*\(.*(token|code|salt|pass|nonce|key)"),
    Rule("R-SEC-010", "high", "security", r"debug\s*=\s*True|run\s*\([^)]*debug\s*=\s*True"),
    Rule("R-STYLE-001", "low", "style", r"[^;#\s];\s*(?:if|for|while|import|return|print|assert|pass|raise)\b"),
    Rule("R-STYLE-002", "low", "style", r"from\s+[\w.]+\s+import\s+\*", skip_path=r"/?__init__\.py$"),
    Rule("R-STYLE-003", "low", "style", r"^\s*[A-Za-z_]\w*\s*=\s*lambda\b", top_only=True),
)
JS_EXT = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
JS = (
    Rule("JS-SEC-001", "critical", "security", r"(?<![.\w])eval\s*\(", exts=JS_EXT),
    Rule("JS-SEC-002", "critical", "security", r"new\s+Function\s*\(", exts=JS_EXT),
    Rule("JS-SEC-003", "high", "security", r"\.innerHTML\s*=(?!=)", ('= ""', "= ''", "= ``"), exts=JS_EXT),
    Rule("JS-SEC-004", "high", "security", r"document\.write(?:ln)?\s*\(", exts=JS_EXT),
    Rule("JS-SEC-005", "critical", "security", r"""child_process\.exec\s*\(|(?<![.\w])exec\s*\(\s*[`"'].*\$\{""", exts=JS_EXT),
    Rule("JS-SEC-006", "critical", "security", r"(?:query|execute)\s*\(\s*`[^`]*\$\{", exts=JS_EXT),
    Rule("JS-SEC-007", "high", "security", r"Math\.random\s*\(", ("// non-security", "// visual", "// animation"), exts=JS_EXT),
    Rule("JS-SEC-008", "high", "security", r"""rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0""", exts=JS_EXT),
    Rule("JS-SEC-009", "high", "security", r"""(?i)(?:api_?key|apikey|secret|password|passwd|token)\s*[:=]\s*["'][A-Za-z0-9_\-]{16,}["']""", ("process.env", "example", "placeholder", "xxxx"), exts=JS_EXT),
    Rule("JS-LOG-001", "medium", "logic", r"catch\s*(?:\([^)]*\))?\s*\{\s*\}", exts=JS_EXT),
    Rule("JS-LOG-002", "low", "logic", r"[^=!<>]==[^=]", ("=== ", "!=="), exts=JS_EXT),
    Rule("JS-ENG-001", "low", "engineering", r"(?<![.\w])debugger\s*;?", exts=JS_EXT),
)
SUPPRESS = r"#\s*(noqa|nosec|pylint:\s*disable)\b"
JS_SUPPRESS = r"//\s*(eslint-disable|nosec|noqa)\b"
JS_NEXT = r"//\s*eslint-disable-next-line\b"
# Guards, the lines that protect what stands near them: (pattern, weaknesses, a pattern the file must hold too).
GUARDS = (
    (r"yaml\.safe_load|SafeLoader", ("CWE-502",), ""),
    (r"startswith\(|os\.path\.commonpath|relative_to\(", ("CWE-22",), "realpath|abspath"),
    (r"""execute\(\s*["'][^"']*[?%][^"']*["']\s*,""", ("CWE-89",), ""),
    (r"shell\s*=\s*False|subprocess\.(run|Popen|call|check_output)\s*\(\s*\[", ("CWE-78",), ""),
    (r"with\s+\w*[Ll]ock|with self\._lock|Lock\(\)", ("LOG-003", "CWE-362"), ""),
    (r"with\s+sqlite3\.connect", ("LOG-004", "CWE-404"), ""),
    (r"with\s+.*open\(", ("LOG-004", "CWE-404", "ENG-001"), ""),
    (r"\.get\([^)]*,[^)]*\)", ("LOG-012", "CWE-476"), ""),
    (r"if\s+\w+\s+else", ("LOG-001", "LOG-013"), ""),
    (r":=.*\.get\(|is not None and", ("LOG-012", "CWE-476"), ""),
    (r"len\([^)]*\)\s*==\s*\d+\s+and\b|\band\s+len\([^)]*\)\s*[=!<>]", ("LOG-001", "LOG-012"), ""),
    (r"environ\.get\(|environ\[", ("CWE-798", "CWE-532", "ENG-010"), ""),
    (r"md5\(|sha1\(", ("CWE-327",), "cache|dedup|checksum|etag|fingerprint|integrity"),
    (r"""(?i)(password|secret|token|api_key)[^=]*=\s*["'][A-Z][A-Z0-9_]+["']""", ("CWE-798", "CWE-532"), "environ"),
)


def guard_points(texts: DataFrame, guards: tuple = GUARDS) -> DataFrame:
    """texts(path, text) -> path, key, line: lines of a guard, once for every weakness it protects from. What a guard
    requires is looked for in the whole file, in any case."""
    needs = {g[2] for g in guards if g[2]}
    have = texts.select("path", "text", *(F.rlike("text", F.lit(f"(?iU){n}")).alias(f"need{i}") for i, n in enumerate(sorted(needs))))
    rows = candidates(have, tuple(g[0] for g in guards), L.cut_lines, ("path", *(f"need{i}" for i in range(len(needs)))))
    order = sorted(needs)
    found = [F.when(F.array_contains("may", k) & F.rlike("line", F.lit(f"(?U){p}")) & (F.col(f"need{order.index(need)}") if need else F.lit(True)), F.array(*map(F.lit, keys))) for k, (p, keys, need) in enumerate(guards)]
    out = rows.select("path", F.col("line_no").alias("line"), F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*found))))).alias("key"))
    return out.select("path", "key", "line")


# A statement that only falls back, a call that reports, and what opens a block.
PROBE = r"""^(continue|return\s+(False|True|None|default|-?\d+|["'][^"']*["'])\s*$|return\s*$|\w+\s*=\s*(None|False|True|\[\]|\{\}|["'][^"']*["']?)\s*(#.*)?$)"""
LOGGED = (
    r"\b(?:logger|logging|log|self\.log)\s*\.\s*(?:debug|info|warning|warn|error|exception|critical)\s*\(|\b[A-Z][A-Z0-9_]*_?LOGGER\b\s*\.\s*\w+\s*\("
    r"|\bwarnings\s*\.\s*warn(?:ing)?\s*\(|\btraceback\s*\.\s*print|\.showtraceback\s*\(|exc_info\s*=\s*True"
)
OPENS = r"^(raise|try|if|for|while|with)"


def checks() -> dict[str, Column]:
    """Named exemptions over the block that follows a line; true keeps the hit."""
    code = lambda n: F.filter(L.block(n), lambda x: (strip(x) != "") & ~F.startswith(lstrip(x), F.lit("#")))
    like = lambda x, p: F.rlike(x, F.lit(f"(?U){p}"))
    tail = F.regexp_extract("line", r":(.*)$", 1)
    short = F.transform(code(7), lambda x: strip(x))
    explicit = like(strip(F.col("line")), r"^except\s+Exception(\s+as\s+\w+)?\s*:\s*(#.*)?$")
    caught = like(strip(F.col("line")), r"^except\s+(:|Exception|BaseException)(\s+as\s+\w+)?\s*:")
    held = F.regexp_extract("line", r"(?U)^\s*(\w+)\s*=\s*(?:[^\n]*\b(?:open|connect)\s*\()", 1)
    close = F.concat(F.lit(r"(?U)\b"), held, F.lit(r"\.close\s*\("))
    return {
        "no_reraise": ~(like(tail, r"\braise\b") | F.exists(code(39), lambda x: like(strip(x), r"^raise(\s|$|from\b|,)"))),
        "not_probe": ~(explicit & (F.size(short) > 0) & F.forall(short, lambda x: like(x, PROBE) & ~like(x, OPENS))),
        "not_logged": ~(caught & F.exists(L.block(11), lambda x: like(x, LOGGED))),
        "not_closed": ~((held != "") & F.exists(L.following(F.col("line"), 39), lambda x: F.rlike(x, close))),
    }


def hit(rule: Rule, folded: bool = False) -> tuple[Column, Column]:
    """Whether the rule fires on a row of path and line (folded: and _fold), masks apart, and the 1-based place of its match.
    Its pattern is tried only on lines that hold its literals."""
    place = F.regexp_instr("line", F.lit(f"(?U){rule.pattern}"))
    out = matches(F.col("line"), F.col("_fold") if folded else fold(F.col("line")), rule.pattern)
    if rule.skip_path:
        out &= ~F.rlike(F.replace(F.col("path").cast("string"), F.lit("\\"), F.lit("/")), F.lit(rule.skip_path))
    if rule.exts == (".py",):
        if not rule.in_comments:
            out &= ~F.startswith(lstrip(F.col("line")), F.lit("#"))
        out &= ~F.rlike("line", F.lit(SUPPRESS))
    for word in rule.exclude:
        out &= ~F.contains("line", F.lit(word))
    return out, place


def _within(place: Column) -> Column:
    """The 1-based place lies in a string of the line."""
    return F.exists("strings", lambda s: (s["a"] <= place - 1) & (place - 1 < s["b"]))


def scan(rows: DataFrame, rules: tuple[Rule, ...] = PYTHON, masks: bool = False, block_checks: bool = True) -> DataFrame:
    """rows(path, line_no, line) -> findings: rule-major within a line, a row for every rule that fires. See scan_texts for
    whole texts; its rows bring may, the numbers of the rules that can fire.

    All patterns are literals of one projection, so a line is read once; a pattern is tried only where the line holds the
    literals it needs. masks:
    rows also have docstring, strings, comment_at and depth, as ``masks.python_masks`` gives them. block_checks:
    look at the following lines for the rules that ask for it; all lines then pass a window.
    """
    named = {c for r in rules for c in r.checks}
    if block_checks and named:
        known = checks()
        rows = rows.withColumns({f"_{c}": known[c] for c in sorted(named)})
    rows, told = rows.withColumn("_fold", fold(F.col("line"))), "may" in rows.columns
    fired = []
    for k, r in enumerate(rules):
        ok, place = hit(r, True)
        ok = F.array_contains("may", k) & ok if told else ok
        if masks:
            if not r.in_docstrings:
                ok &= ~F.col("docstring")
            ok &= ~_within(place) & (F.lit(r.in_comments) | F.col("comment_at").isNull() | (place - 1 < F.col("comment_at")))
            if r.top_only:
                ok &= F.col("depth") == 0
        if block_checks:
            for c in r.checks:
                ok &= F.col(f"_{c}")
        fired.append(F.when(ok, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"))))
    out = rows.select("path", "line_no", "line", F.explode(F.array_compact(F.array(*fired))).alias("r"))
    return out.select("path", F.col("line_no").alias("line_start"), "r.*", F.substring(strip(F.col("line")), 1, 200).alias("evidence"), F.lit(0.95).alias("confidence"))


def scan_texts(texts: DataFrame, rules: tuple[Rule, ...] = PYTHON) -> DataFrame:
    """texts(path, text) -> the findings that scan gives for their lines without masks and block checks."""
    return scan(candidates(texts, tuple(r.pattern for r in rules), L.cut_lines), rules, block_checks=False)


def js_comment_mask(rows: DataFrame) -> DataFrame:
    """rows(path, line_no, line) + comment: a ``//`` line, one that begins with ``/*``, or one below that up to ``*/``.

    A block is open after a line that begins it and doesn't end it, until a line that holds ``*/``: the last line that
    decides either way tells, but lines inside a block decide nothing by their beginning; as a line that ends a block
    ends it whatever it begins with, the last decision is that of the last such line.
    """
    t = strip(F.col("line"))
    opens = F.startswith(t, F.lit("/*")) & ~F.contains(F.substr(t, F.lit(3)), F.lit("*/"))
    decides = F.when(opens, True).when(F.contains("line", F.lit("*/")), False)
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last(decides, ignorenulls=True).over(w), F.lit(False))
    return rows.withColumn("comment", F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*")) | inside)


def scan_js(rows: DataFrame, rules: tuple[Rule, ...] = JS) -> DataFrame:
    """Findings of script lines: comments, the tails of lines behind ``//`` and suppressed lines don't count."""
    rows = js_comment_mask(rows).withColumn("before", L.previous())
    rows = rows.where(~F.col("comment") & ~F.rlike("line", F.lit(JS_SUPPRESS)) & ~F.coalesce(F.rlike("before", F.lit(JS_NEXT)), F.lit(False)))
    rows = rows.withColumn("_code", F.substring_index("line", "//", 1)).withColumn("_fold", fold(F.col("_code")))
    fired = []
    for r in rules:
        ok = matches(F.col("_code"), F.col("_fold"), r.pattern)
        for word in r.exclude:
            ok &= ~F.contains("line", F.lit(word))
        ok &= F.exists(F.array(*map(F.lit, r.exts)), lambda e: F.endswith(F.col("path"), e))
        fired.append(F.when(ok, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"))))
    out = rows.select("path", "line_no", "line", F.explode(F.array_compact(F.array(*fired))).alias("r"))
    return out.select("path", F.col("line_no").alias("line_start"), "r.*", F.substring(strip(F.col("line")), 1, 200).alias("evidence"), F.lit(0.9).alias("confidence"))


def dimension(spark: SparkSession, rules: tuple[Rule, ...] = PYTHON) -> DataFrame:
    rows = [(i, r.id, r.severity, r.category, r.pattern) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, rule_id string, severity string, category string, pattern string")


def counts(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """A row per rule, hits or not."""
    n = findings.groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rules.select("rule_id", "severity", "category").join(n, "rule_id", "left").select("rule_id", "severity", "category", zero("hits"), zero("files"))
