"""Sources: file trees, rule and report files, dependency scans, change lists."""

from __future__ import annotations

import fnmatch
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What a walk leaves out by default.
IGNORED = (".git/", "__pycache__/", "node_modules/", ".venv/", "venv/", "dist/", "build/")
EXTS = (".py", ".js", ".jsx", ".ts", ".tsx")


def ignore_regex(patterns) -> str:
    """One pattern for all globs: as they are, below any folder, and with all that lies under them."""
    parts = []
    for p in patterns:
        p = p.strip().rstrip("/")
        if p and not p.startswith("#"):
            glob = fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
            parts.append(rf"(?:.*/)?{glob}(?:/.*)?")
    return f"^(?:{'|'.join(parts)})$" if parts else "^$"


# Folders that the walk of an audit leaves out, whatever the ignore file says.
AUDIT_IGNORED = (".git", ".venv", "venv", "__pycache__", "node_modules", "out", "data", ".cache", "build", "dist")
#: Bytes of files to a partition, about.
PART = 1 << 25


class SourceTree(DataSource):
    """Source files below a local or shared folder: path (relative to root), text.

    The listing is the plan: folders and files that are ignored are pruned before anything in them is opened, and files are
    dealt to partitions by their sizes. Spark's own file sources never list names that begin with an underscore or a dot,
    as ``__init__.py`` does. Options: root, exts, ignore (globs) and folders (names), each a JSON array. Text that isn't
    UTF-8 has replacement characters; a file that goes away between listing and reading gives no row, one that can't be
    read otherwise fails the task.
    """

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"].removeprefix("file://")
        self.exts, ignore, self.folders = (json.loads(options.get(k, "[]")) for k in ("exts", "ignore", "folders"))
        self.ignored = re.compile(ignore_regex(ignore))

    def listing(self):
        """(path, size) of the files that stay, in order; ignored folders are not entered."""
        if os.path.isfile(self.root):
            yield self.root, os.path.getsize(self.root)
            return
        for top, folders, files in os.walk(self.root):
            at = os.path.relpath(top, self.root).replace(os.sep, "/")
            place = lambda n, at=at: n if at == "." else f"{at}/{n}"
            folders[:] = sorted(d for d in folders if d not in self.folders and not self.ignored.match(place(d)))
            for n in sorted(files):
                full = os.path.join(top, n)
                if os.path.splitext(n)[1] in self.exts and not self.ignored.match(place(n)) and os.path.isfile(full):
                    yield full, os.path.getsize(full)

    def partitions(self) -> list[InputPartition]:
        parts, held, size = [], [], 0
        for path, n in self.listing():
            held.append(path)
            size += n + 4096
            if size >= PART:
                parts.append(InputPartition(held))
                held, size = [], 0
        return [*parts, InputPartition(held)]

    def read(self, partition):
        one = os.path.isfile(self.root)
        for path in partition.value:
            try:
                with open(path, encoding="utf-8", errors="replace", newline="") as f:
                    text = f.read()
            except FileNotFoundError:
                continue
            yield os.path.basename(path) if one else os.path.relpath(path, self.root).replace(os.sep, "/"), text


def read_files(spark: SparkSession, root: str, exts=EXTS, ignore=IGNORED, folders=()) -> DataFrame:
    """path (relative to root), text: every file below root of the suffixes, without ignored ones. A file of its own is taken
    as it is. folders: names of folders that are never entered (AUDIT_IGNORED for the walk of an audit). Roots of another
    file system go through Spark's binary files, which don't list names with an underscore or dot at their beginning."""
    if "://" not in root or root.startswith("file://"):
        spark.dataSource.register(SourceTree)
        return spark.read.format("sourcetree").options(root=root, exts=json.dumps(list(exts)), ignore=json.dumps(list(ignore)), folders=json.dumps(list(folders))).load()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(exts) + "}").load(root)
    rel = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/?", "")
    rel = F.when(rel == "", F.element_at(F.split("path", "/"), -1)).otherwise(rel)
    out = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text")).where(~F.rlike("path", F.lit(ignore_regex(ignore))))
    return out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, folders)))) if folders else out


def ignore_patterns(spark: SparkSession, root: str, name: str = ".auditignore") -> list[str]:
    """The default globs and those of the root's ignore file: a few lines."""
    try:
        rows = [r.value for r in spark.read.text(f"{root.rstrip('/')}/{name}").collect()]
    except Exception as e:  # no such file
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    return [*IGNORED, *(r for r in rows if r.strip() and not r.lstrip().startswith("#"))]


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files of a change list(path); all are read for graphs, these are reported."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


RULES = (
    "rules array<struct<id:string,title:string,category:string,severity:string,source:string,pattern:string,exclude:array<string>,exts:array<string>,why:string,impact:string,suggestion:string,"
    "skip_path_rx:string,body_check:string,probe_check:string,logged_check:string,resource_check:string,match_comment:boolean,skip_docstring:boolean,top_only:boolean>>"
)


def _items(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """The rows of an array field of JSON files, with file, place and ord, their order by file name and place. Unreadable files have none."""
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(field).alias("place", "r"))
    return raw.select("file", "place", "r.*").withColumn("ord", F.struct("file", "place"))


def read_rules(spark: SparkSession, path: str, scripts: str = "js_rules.json") -> DataFrame:
    """Line rules of JSON files {rules: [...]}, in order of file name and place; those of the scripts' file apart."""
    return _items(spark, path, RULES, "rules").where(F.col("file") != scripts)


def read_script_rules(spark: SparkSession, path: str) -> DataFrame:
    return _items(spark, path, RULES, "rules")


# The switches of a rule's row and the checks they name.
CHECKS = {"body_check": "no_reraise", "probe_check": "not_probe", "logged_check": "not_logged", "resource_check": "not_closed"}


def as_rules(rows: DataFrame, exts: tuple[str, ...] = (".py",)) -> tuple:
    """Rows of read_rules as rules that rules.scan takes. A set of rules is small: it becomes part of the plan. Patterns that don't compile are left out."""
    from ..operators.rules import Rule

    out = []
    for r in rows.orderBy("ord").collect():
        try:
            re.compile(r.pattern or "(")
        except re.error:
            continue
        checks = tuple(name for switch, name in CHECKS.items() if r[switch])
        out.append(Rule(r.id, (r.severity or "medium").lower(), (r.category or "security").lower(), r.pattern, tuple(r.exclude or ()), r.skip_path_rx or "", bool(r.match_comment), r.skip_docstring is False or bool(r.match_comment and r.skip_docstring is None), bool(r.top_only), checks, tuple(r.exts or exts)))
    return tuple(out)


GUARD = "guards array<struct<id:string,title:string,pattern:string,requires:string,protects:array<string>,why:string>>"


def read_guards(spark: SparkSession, path: str) -> tuple:
    """Guards of a JSON file as rules.guard_points takes them."""
    rows = _items(spark, path, GUARD, "guards").orderBy("ord").collect()
    return tuple((r.pattern, tuple(r.protects or ()), r.requires or "") for r in rows if r.pattern)


ITEM = "items array<struct<id:string,title:string,category:string,severity:string,tags:array<string>,triggers:array<string>,pattern:string,impact:string,fix:string,source:string,not_when:array<string>,require_any:array<string>>>"


def read_knowledge(spark: SparkSession, path: str, custom: str = "custom.json") -> DataFrame:
    """Knowledge items of JSON files {items: [...]}, with ord, their order by file and place, and builtin."""
    return _items(spark, path, ITEM, "items").withColumn("builtin", F.col("file") != custom)


CATALOG = "sources array<struct<match:string,cwe:string,note:string>>, sinks array<struct<match:string,cwe:string,note:string>>"


def read_catalog(spark: SparkSession, path: str) -> tuple[tuple[str, ...], dict[str, str]]:
    """A taint catalog as graph.taint_paths takes it: the sources' names, the sinks' names with their weakness."""
    rows = spark.read.schema(CATALOG).json(path, multiLine=True).collect()
    return tuple(s.match for r in rows for s in r.sources or ()), {s.match: s.cwe for r in rows for s in r.sinks or ()}


def read_weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, cwe of a JSON file {map: {...}}."""
    return spark.read.schema("map map<string,string>").json(path, multiLine=True).select(F.explode("map").alias("rule_id", "cwe"))


TRUTH = "meta struct<lib:string>, annotations array<struct<file:string,line:int,rule:string,verdict:string,pattern:string,note:string,why:string>>"


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """lib, pos, file, line, rule, verdict, pattern, note of labelled findings, a JSON file a library."""
    raw = spark.read.schema(TRUTH).json(path, multiLine=True)
    rows = raw.select(F.coalesce("meta.lib", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")).alias("lib"), F.posexplode("annotations").alias("pos", "a"))
    return rows.select("lib", "pos", "a.file", "a.line", "a.rule", "a.verdict", "a.pattern", F.coalesce("a.note", "a.why").alias("note"))


MANIFEST = "expected array<struct<file:string,cwe:string,line:int>>, negatives array<string>"


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The expected rows of a bench, ord their order, as evaluate.score_run takes them, and the names of its clean files."""
    raw = spark.read.schema(MANIFEST).json(path, multiLine=True)
    want = raw.select(F.posexplode("expected").alias("ord", "e")).select(F.col("e.file").alias("path"), F.col("e.cwe").alias("key"), F.col("e.line").alias("line"), "ord")
    return want, raw.select(F.explode("negatives").alias("path"))


# Folders that a benchmark's walk leaves out, and files that name dependencies.
NOT_MEASURED = ("tests", "test", "_tests", "testing", "docs", "doc", "_vendor", ".venv", "scripts", "example", "examples", "build", "dist")
MANIFESTS = ("requirements.txt", "pyproject.toml", "Pipfile.lock")


def package_files(files: DataFrame) -> DataFrame:
    """files(path, text), path relative to a package, without tests, docs and what else isn't measured."""
    parts, name = F.split(F.lower("path"), r"[/\\]"), F.element_at(F.split("path", r"[/\\]"), -1)
    return files.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, NOT_MEASURED))) & ~F.rlike(name, F.lit("^tests?_")))


def manifests(files: DataFrame) -> DataFrame:
    """Files that name dependencies."""
    return files.where(F.element_at(F.split("path", r"[/\\]"), -1).isin(*MANIFESTS))


REPORT = "target string, issues array<struct<rule_id:string,severity:string,category:string,path:string,line_start:int,line_end:int,confidence:double,detector:string,evidence:string>>"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Findings of report files, with the run's name."""
    raw = spark.read.schema(REPORT).json(path, multiLine=True)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("run_id"), "target", F.posexplode("issues").alias("pos", "i")).select("run_id", "target", "pos", "i.*")


DEPENDENCIES = "dependencies array<struct<name:string,version:string,vulns:array<struct<id:string,aliases:array<string>,fix_versions:array<string>,description:string>>>>"
ADVISORIES = "vulnerabilities map<string,string>"
#: What a package registry's severities are here; others are medium.
REGISTRY = {"critical": "critical", "high": "high", "moderate": "medium", "medium": "medium", "low": "low"}


def _advised(reports: DataFrame) -> DataFrame:
    """reports(text, ...) + d (a dependency scanner's rows), v (a registry's) and note. A list alone is a scanner's dependencies; empty and unreadable texts have a note."""
    whole = F.when(F.startswith(F.trim("text"), F.lit("[")), F.concat(F.lit('{"dependencies":'), "text", F.lit("}"))).otherwise(F.col("text"))
    got = reports.withColumn("_whole", whole).withColumns({"d": F.from_json("_whole", DEPENDENCIES)["dependencies"], "v": F.from_json("_whole", ADVISORIES)["vulnerabilities"]}).drop("_whole")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return got.withColumn("note", F.when(blank, "no scanner output").when(F.col("d").isNull() & F.col("v").isNull(), "unreadable scanner output").otherwise(""))


def dependency_notes(reports: DataFrame) -> DataFrame:
    """path, note of every scanner output in reports(path, text) that tells nothing, so that it isn't taken for one without findings."""
    return _advised(reports).where("note <> ''").select("path", "note")


def dependency_issues(reports: DataFrame) -> DataFrame:
    """reports(path, text): JSON of a dependency scanner or of a package registry's audit -> findings, one a (name, version, id) of a report.

    A scanner's findings are high and named by the CVE among the aliases, else by their id; of repeated rows the first counts.
    A registry's have the severity it gives, and are named by the package.
    """
    got = _advised(reports).select("path", "d", "v")
    vulns = got.select("path", F.posexplode("d").alias("i", "p")).select("path", "i", "p.name", "p.version", F.posexplode("p.vulns").alias("k", "u"))
    first = vulns.groupBy("path", "name", "version", F.coalesce("u.id", F.lit("CVE-?")).alias("id")).agg(F.min_by("u", F.struct("i", "k")).alias("u"))
    cves = F.filter(F.coalesce("u.aliases", F.array().cast("array<string>")), lambda a: F.startswith(a, F.lit("CVE-")))
    shown, fixes = F.coalesce(F.get(cves, 0), "id"), F.concat_ws(", ", "u.fix_versions")
    name, version = F.coalesce("name", F.lit("?")), F.coalesce("version", F.lit("?"))
    scanner = first.select(
        F.concat(F.lit("DEP-"), shown).alias("rule_id"), F.lit("high").alias("severity"), F.concat(name, F.lit(" "), version, F.lit(": known vulnerability "), shown).alias("title"), "path",
        F.concat(name, F.lit("=="), version).alias("evidence"), F.substring(F.coalesce("u.description", F.lit("")), 1, 800).alias("analysis"), F.when(fixes == "", "see the advisory").otherwise(fixes).alias("fix"),
        F.concat("id", F.when(F.size(cves) > 0, F.concat(F.lit(" ("), F.array_join(cves, ", "), F.lit(")"))).otherwise("")).alias("source"),
    )
    one = got.select("path", F.explode("v").alias("name", "u"))
    level = F.lit("medium")
    for said, here in REGISTRY.items():
        level = F.when(F.lower(F.get_json_object("u", "$.severity")) == said, here).otherwise(level)
    registry = one.select(
        F.concat(F.lit("DEP-NPM-"), "name").alias("rule_id"), level.alias("severity"), F.concat("name", F.lit(": known vulnerability")).alias("title"), "path", F.col("name").alias("evidence"),
        F.substring(F.coalesce(F.get_json_object("u", "$.via"), F.lit("[]")), 1, 800).alias("analysis"), F.lit("see the advisory").alias("fix"), F.lit("registry audit").alias("source"),
    )
    fixed = {"category": F.lit("security"), "line_start": F.lit(1), "confidence": F.lit(0.95), "detector": F.lit("static"), "verified": F.lit(True)}
    return scanner.union(registry).withColumns(fixed)


def dependency_findings(spark: SparkSession, reports: DataFrame) -> DataFrame:
    """reports(text): a dependency scanner's JSON -> name, version, id (the CVE alias if there is one), fix: each once. Unreadable text gives a row whose note says so."""
    got = _advised(reports)
    bad = got.where("d is null and v is null").select(*[F.lit(None).cast("string").alias(c) for c in ("name", "version", "id", "fix")], F.lit("unreadable scanner output").alias("note"))
    rows = got.select(F.explode("d").alias("p")).select("p.name", "p.version", F.explode("p.vulns").alias("u"))
    cve = F.get(F.filter("u.aliases", lambda a: F.startswith(a, F.lit("CVE-"))), 0)
    good = rows.select("name", "version", F.coalesce(cve, "u.id").alias("id"), F.concat_ws(", ", "u.fix_versions").alias("fix"), F.lit("").alias("note"))
    return good.dropDuplicates(["name", "version", "id"]).unionByName(bad)


def write_report(f: DataFrame, path: str) -> None:
    """Findings as JSON lines in report order within files."""
    f.write.mode("overwrite").json(path)
