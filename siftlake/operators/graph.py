"""Call graphs and taint as joins, repeated until nothing changes."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage


def module_name(path):
    """Dotted name of a file's module; a package's ``__init__`` is the package."""
    dotted = F.translate(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"^[./\\]+", ""), "/\\", "..")
    return F.regexp_replace(dotted, r"\.?__init__$", "")


# Builtins that are no function of a module.
NOISE = ("print", "len", "isinstance", "super", "getattr", "setattr", "hasattr", "open", "range", "dict", "list", "set", "tuple", "str", "int", "float", "bool", "type")


def definitions(facts: DataFrame, kind: str = "node") -> DataFrame:
    """facts of ``masks.facts`` -> fqn, path, line, args: functions of modules and methods of their classes; of kind def nested ones too."""
    d = facts.where(F.col("kind") == kind)
    return d.select(F.concat_ws(".", module_name(F.col("path")), "scope").alias("fqn"), "path", "line", F.col("names").alias("args"))


def _targets(facts: DataFrame) -> DataFrame:
    """Calls with the dotted name they mean: caller, callee, path, line, name.

    A bare name is an alias of the file's, else one of its module, unless it is a builtin. self is the class around it. Of
    other dotted names the root is an alias, a class of the module if it begins with a capital, or the module's own
    name; else the call means nothing that can be told, and callee is null.
    """
    mod = module_name(F.col("path"))
    parts = F.split(mod, r"\.")
    package = F.rlike("path", F.lit(r"(^|[/\\])__init__\.py$"))
    # a relative import starts at the module's package and goes up a package for each further dot
    kept = F.greatest(F.size(parts) - (F.col("pos") - 1) - F.when(package, 0).otherwise(1), F.lit(0))
    base = F.when(F.col("pos") > 0, F.array_join(F.slice(parts, 1, kept), ".")).otherwise("")
    full = F.when(base == "", F.col("target")).otherwise(F.concat_ws(".", base, "target"))
    alias = facts.where("kind = 'alias'").groupBy("path", F.col("name").alias("root")).agg(F.max_by(full, "line").alias("full"))
    calls = facts.where("kind = 'edge'").select("path", mod.alias("mod"), "scope", "klass", "name", "line", F.substring_index("name", ".", 1).alias("root"))
    calls = calls.join(alias, ["path", "root"], "left")
    rest, bare = F.expr("substring(name, length(root) + 2)"), ~F.contains("name", F.lit("."))
    callee = (
        F.when(F.col("name") == "", None)
        .when(bare, F.when(~F.col("name").isin(*NOISE), F.coalesce("full", F.concat_ws(".", "mod", "name"))))
        .when(F.col("root") == "self", F.when(F.col("klass") != "", F.concat_ws(".", "mod", "klass", rest)))
        .when(F.col("full").isNotNull(), F.concat_ws(".", "full", rest))
        .when(F.rlike("root", F.lit(r"^\p{Lu}")), F.concat_ws(".", "mod", "name"))
        .when(F.col("root") == F.substring_index("mod", ".", -1), F.concat_ws(".", "mod", rest))
    )
    return calls.select(F.concat_ws(".", "mod", "scope").alias("caller"), callee.alias("callee"), "path", "line", "name")


def call_edges(facts: DataFrame) -> DataFrame:
    """caller, callee, path, line: calls that mean a definition of these files; no self calls."""
    defs = definitions(facts).select(F.col("fqn").alias("callee")).distinct()
    return _targets(facts).join(defs, "callee", "left_semi").where("caller <> callee").select("caller", "callee", "path", "line")


def graph_stats(facts: DataFrame) -> DataFrame:
    """One row: files, defs, edges, unresolved (calls that mean no definition)."""
    defs = definitions(facts).select(F.col("fqn").alias("callee")).distinct().withColumn("known", F.lit(True))
    t = _targets(facts).join(defs, "callee", "left").agg(F.count_if(F.col("known") & (F.col("caller") != F.col("callee"))).alias("edges"), F.count_if(F.col("known").isNull()).alias("unresolved"))
    return facts.agg(F.countDistinct("path").alias("files"), F.countDistinct(F.when(F.col("kind") == "node", F.struct("path", "scope"))).alias("defs")).crossJoin(t)  # one row each


def calls_of(facts: DataFrame, path: str, name: str, limit: int = 8) -> DataFrame:
    """One row: callers ("fqn(file:line)") and callees of a file's function, as text, in order of name and line.

    The module's own function of that name is looked up first, then methods of that name; the first with any edge counts.
    callees are distinct and cut to 200 characters, callers are limit at most.
    """
    edges = call_edges(facts)
    mine = definitions(facts).where((F.col("path") == path) & (F.substring_index("fqn", ".", -1) == name))
    mine = mine.select("fqn", F.when(F.col("fqn") == F.concat_ws(".", module_name(F.lit(path)), F.lit(name)), 0).otherwise(1).alias("rank")).distinct()
    row = F.concat(F.col("caller"), F.lit("("), F.element_at(F.split("path", r"[/\\]"), -1), F.lit(":"), F.col("line").cast("string"), F.lit(")"))
    into = edges.join(mine, F.col("callee") == F.col("fqn")).select("rank", "fqn", F.struct("caller", "line", row.alias("text")).alias("into"), F.lit(None).cast("struct<line:int,callee:string>").alias("out"))
    out = edges.join(mine, F.col("caller") == F.col("fqn")).select("rank", "fqn", F.lit(None).cast(into.schema["into"].dataType).alias("into"), F.struct("line", "callee").alias("out"))
    found = into.union(out).groupBy("rank", "fqn").agg(F.array_sort(F.collect_list("into")).alias("into"), F.array_sort(F.collect_list("out")).alias("out")).orderBy("rank", "fqn").limit(1)
    callers = F.array_join(F.transform(F.slice("into", 1, limit), lambda x: x["text"]), "; ")
    return found.select("fqn", callers.alias("callers"), F.substring(F.array_join(F.array_distinct(F.transform("out", lambda x: x["callee"])), "; "), 1, 200).alias("callees"))


def external_callers(edges: DataFrame, prefix: str, n: int = 12) -> DataFrame:
    """Distinct (caller, callee) from outside a module into it, the first n."""
    inside = lambda c: (F.col(c) == prefix) | F.startswith(c, F.lit(prefix + "."))
    return edges.where(inside("callee") & ~inside("caller")).groupBy("caller", "callee").agg(F.min("line").alias("line")).orderBy("caller", "callee").limit(n)


def reach(edges: DataFrame, seeds: DataFrame, rounds: int | None = 6) -> DataFrame:
    """edges(src, dst), seeds(node) -> node, round in which it was first reached (0 for seeds); rounds at most, None for no bound.

    Each round joins only what the round before found, which is written; nodes reached before are dropped by an
    anti-join. It ends early when a round finds nothing.
    """
    plain = lambda d: d.withColumn("foreign", F.lit(True))
    return colours(plain(edges.select("src", "dst")), plain(seeds.select("node")), rounds).drop("foreign")


def colours(edges: DataFrame, seeds: DataFrame, rounds: int | None = 6) -> DataFrame:
    """edges(src, dst, foreign), seeds(node, foreign) -> node, foreign, round in which it was first reached (0 for seeds).

    A node's colour is decided in that round and stays: foreign if an edge that reaches it then is foreign itself or
    comes from a foreign node, else that of the command line. A node that nothing reached before has no coloured
    neighbour older than the last round, so a round joins only what the round before found.
    """
    found = frontier = stage(seeds.groupBy("node").agg(F.max("foreign").alias("foreign")).withColumn("round", F.lit(0)), "reach")
    e = stage(edges.groupBy("src", "dst").agg(F.max("foreign").alias("by")), "reach-edges")
    for k in count(1) if rounds is None else range(1, rounds + 1):
        step = e.join(frontier, e.src == frontier.node).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("by") | F.col("foreign")).alias("foreign"))
        frontier = stage(step.join(found.select("node"), "node", "left_anti").withColumn("round", F.lit(k)), "reach")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


# Where foreign data comes in, and the calls it must not reach, with their weakness; what tells an expression
# that holds foreign data; string literals; builtins that count by their bare name only; checks of a path; calls that
# need a shell to be dangerous.
SOURCES = (
    "input", "raw_input", "os.getenv", "request.args.get", "request.form.get", "request.get_json", "request.data", "request.values.get", "request.cookies.get", "request.headers.get",
    "sys.argv", "socket.recv", "urllib.request.urlopen", "requests.get", "requests.post",
)
SINKS = {
    "os.system": "CWE-78", "os.popen": "CWE-78", "subprocess.run": "CWE-78", "subprocess.Popen": "CWE-78", "subprocess.call": "CWE-78", "eval": "CWE-95", "exec": "CWE-95",
    "cursor.execute": "CWE-89", "cur.execute": "CWE-89", "conn.execute": "CWE-89", "db.execute": "CWE-89", "session.execute": "CWE-89", "pickle.loads": "CWE-502", "pickle.load": "CWE-502",
    "yaml.load": "CWE-502", "open": "CWE-22", "send_file": "CWE-22", "render_template_string": "CWE-94", "Markup": "CWE-79", "redirect": "CWE-601",
}
EXTERNAL = (
    r"\brequest\b|\bflask\b|\bargv\b|os\.environ|os\.getenv|\binput\s*\(|sys\.stdin"
    r"|(?:request|req|flask|self\.request|ctx\.request|environ|os\.environ)\.(?:args|form|json|data|values|cookies|headers|query_params|GET|POST)\b",
    r"\b(?:request|argv|environ|getenv|stdin)\b",
)
STRINGS = r"""(?s)\"\"\".*?\"\"\"|'''.*?'''|"[^"\n]*"|'[^'\n]*'"""
BARE, CHECKED, SHELLED = ("open", "eval", "exec"), ("isfile", "exists", "isabs", "is_dir", "safe_join"), ("run", "Popen", "call", "check_output", "check_call")


def strip_strings(text):
    """A text whose string literals are empty."""
    return F.regexp_replace(text, STRINGS, '""')


def external(text):
    """The expression, strings apart, takes foreign data."""
    bare = strip_strings(text)
    return F.rlike(bare, F.lit(f"(?U){EXTERNAL[0]}")) | F.rlike(bare, F.lit(f"(?U){EXTERNAL[1]}"))


def catalogued(name, entries):
    """The first entry that a dotted name is, ends in or begins with; null without one."""
    out = F.lit(None).cast("string")
    for e in reversed(list(entries)):
        out = F.when((name == e) | F.endswith(name, F.lit("." + e)) | F.startswith(name, F.lit(e + ".")), F.lit(e)).otherwise(out)
    return out


def inapplicable(name, flags):
    """Why a call that is named like a sink is none: bare, buffer, noshell; null if it is one."""
    last = F.substring_index(name, ".", -1)
    bare = last.isin(*BARE) & F.contains(name, F.lit(".")) & ~F.startswith(name, F.lit("builtins."))
    buffer = F.endswith(name, F.lit("send_file")) & F.array_contains(flags, "buffer")
    quiet = last.isin(*SHELLED) & F.startswith(name, F.lit("subprocess")) & ~F.array_contains(flags, "shell")
    return F.when(bare, "bare").when(buffer, "buffer").when(quiet, "noshell")


def taint_paths(facts: DataFrame, rounds: int = 6, keep_cli: bool = False, sources=SOURCES, sinks=SINKS) -> DataFrame:
    """path, fn, line, sink, cwe, pos, vars, external, origin, reason: sink arguments that foreign data may reach.

    reason is null for those that count; else what takes it out: bare, buffer, noshell (no sink, whether data reaches it
    or not), cli (only from the command line's parser), guard (the path is checked in the function).

    Variables are nodes (function, name); an assignment leads from the names on its right to the one on its left, a
    call from an argument's names to the callee's parameter. Assignments of foreign data seed the rounds, those that
    hold __file__ don't. What the command line's parser gave keeps that colour through assignments; a parameter is
    foreign whatever it was given (see colours). origin: source or external with file and line of the first assignment,
    else the first two callers that pass it, else direct.
    """
    fn = F.concat_ws(".", module_name(F.col("path")), "scope")
    node = lambda f, v: F.concat_ws("#", f, v)
    base = F.element_at(F.split("path", r"[/\\]"), -1)
    bare = strip_strings(F.col("target"))
    is_source = catalogued(F.col("flags")[0], sources).isNotNull()
    assign = facts.where("kind = 'assign'").select(
        "path", fn.alias("fn"), "name", "names", "line", is_source.alias("source"), external(F.col("target")).alias("ext"), F.contains(bare, F.lit("parse_args(")).alias("cli"), F.contains(bare, F.lit("__file__")).alias("own"),
    )
    seeds = assign.where("source or ((ext or cli) and not own)").groupBy(node(F.col("fn"), F.col("name")).alias("node")).agg((~F.max("cli")).alias("foreign"))
    within = assign.select("fn", "name", F.explode("names").alias("used")).select(node(F.col("fn"), F.col("used")).alias("src"), node(F.col("fn"), F.col("name")).alias("dst"))
    args = stage(facts.where("kind = 'arg'").select(fn.alias("fn"), "path", "line", "name", "pos", "target", "names", "flags"), "taint-args")
    edges = call_edges(facts).select("callee", F.col("path").alias("p"), F.col("line").alias("l"), F.col("caller").alias("c"))
    params = definitions(facts, "def").select(F.col("fqn").alias("callee"), F.posexplode(F.filter("args", lambda a: ~a.isin("self", "cls"))).alias("pos", "param"))
    used = args.select("fn", "path", "line", "name", "pos", F.explode("names").alias("used"))
    passed = used.join(edges, (used.path == edges.p) & (used.line == edges.l) & (used.fn == edges.c)).join(params, ["callee", "pos"])
    across = stage(passed.select(node(F.col("fn"), F.col("used")).alias("src"), node(F.col("callee"), F.col("param")).alias("dst"), F.concat(F.col("fn"), F.lit("("), base, F.lit(":"), F.col("line").cast("string"), F.lit(")")).alias("via")).distinct(), "taint-across")
    flow = within.withColumn("foreign", F.lit(False)).union(across.select("src", "dst", F.lit(True)))
    hot = stage(colours(flow, seeds, rounds).select("node", "foreign"), "taint-hot")
    entered = across.join(hot.select("node"), F.col("src") == F.col("node"), "left_semi")
    cwe = F.lit(None).cast("string")
    entry = catalogued(F.col("name"), sinks)
    for name, c in sinks.items():
        cwe = F.when(entry == name, F.lit(c)).otherwise(cwe)
    at = ["path", "fn", "line", "sink", "pos"]
    sink = args.withColumn("cwe", cwe).where("cwe is not null").withColumnRenamed("name", "sink")
    hits = sink.select(*at, F.explode("names").alias("var")).join(hot.withColumnRenamed("node", "h"), node(F.col("fn"), F.col("var")) == F.col("h"))
    hits = hits.groupBy(*at).agg(F.array_sort(F.collect_set("var")).alias("vars"), F.max(F.coalesce("foreign", F.lit(False))).alias("foreign"))
    guards = args.where(F.substring_index("name", ".", -1).isin(*CHECKED)).select("fn", F.explode("names").alias("g")).groupBy("fn").agg(F.collect_set("g").alias("guards"))
    none = F.array().cast("array<string>")
    out = sink.join(hits, at, "left").join(guards, "fn", "left").withColumns({"vars": F.coalesce("vars", none), "guards": F.coalesce("guards", none), "external": external(F.col("target"))})
    idents = F.regexp_extract_all("target", F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)
    cli = (F.size("vars") > 0) & ~F.col("foreign") & ~F.col("external") & F.lit(not keep_cli)
    guarded = F.substring_index("sink", ".", -1).isin("open", "send_file") & (F.size("guards") > 0) & ((F.size(F.array_except("vars", "guards")) == 0) | F.arrays_overlap(idents, "guards"))
    reason = F.coalesce(inapplicable(F.col("sink"), F.col("flags")), F.when(cli, "cli").when(guarded, "guard"))
    out = out.withColumn("reason", reason).where((F.size("vars") > 0) | F.col("external") | F.col("reason").isin("bare", "buffer", "noshell"))
    told = assign.where("source or ext").select("fn", F.col("name").alias("var"), F.struct("line", F.when(F.col("source"), "source").otherwise("external").alias("kind"), F.concat(base, F.lit(":"), F.col("line").cast("string")).alias("where")).alias("o"))
    from_assign = out.select(*at, F.explode("vars").alias("var")).join(told, ["fn", "var"]).groupBy(*at).agg(F.min("o").alias("o"))
    evidence = entered.groupBy("dst").agg(F.array_sort(F.collect_set("via")).alias("via"))
    from_call = out.select(*at, F.explode("vars").alias("var")).join(evidence, node(F.col("fn"), F.col("var")) == F.col("dst")).groupBy(*at).agg(F.min_by("via", "var").alias("via"))
    out = out.join(from_assign, at, "left").join(from_call, at, "left")
    origin = F.when(F.col("o").isNotNull(), F.concat_ws(" ", "o.kind", "o.where")).when(F.col("via").isNotNull(), F.concat(F.lit("callers: "), F.array_join(F.slice("via", 1, 2), "; "))).otherwise("direct")
    return out.select("path", "fn", "line", "sink", "cwe", "pos", "vars", "external", origin.alias("origin"), "reason")


def taint(facts: DataFrame, rounds: int = 6, **options) -> DataFrame:
    """The sink arguments of taint_paths that count: path, fn, line, sink, cwe, pos, vars, external, origin; distinct."""
    return taint_paths(facts, rounds, **options).where("reason is null").drop("reason").distinct()


def taint_stats(paths: DataFrame) -> DataFrame:
    """paths of taint_paths -> reason (paths for those that count), count."""
    return paths.groupBy(F.coalesce("reason", F.lit("paths")).alias("reason")).agg(F.count("*").alias("count"))


def evidence_of(paths: DataFrame, path: str, name: str = "", limit: int = 0) -> DataFrame:
    """The first paths of a file (8) or of a function in it (5), by line."""
    own = paths.where(F.col("path") == path)
    own = own.where(F.endswith("fn", F.lit("." + name))) if name else own
    return own.orderBy("line", "sink", "pos").limit(limit or (5 if name else 8))
