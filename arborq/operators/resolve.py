"""Names to what they stand for: in a file by its scopes, across files by modules; and the rules that follow from it.

All of it is joins over the facts' tables. A use looks outward: its scopes up to its module are a short array, exploded
and joined with bindings by (file, scope, name); the nearest wins. What no scope binds is looked up in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborq.operators import analysis, graph, relational, symbols, visibility
from arborq.operators.analysis import child

FINDING = ("uri", "rule_id", "message", "start", "stop")
ITEM = ["item_root", "item_path", "item_name"]


def _finding(df: DataFrame, rule: str, message, stop=None) -> DataFrame:
    return df.select("uri", F.lit(rule).alias("rule_id"), message.alias("message"), "start", (F.col("start") if stop is None else stop).alias("stop"))


def bound_uses(found: DataFrame) -> DataFrame:
    """(uri, scope_id, name, start, bound_scope, kind): uses that a scope of their file binds, each with the nearest such scope."""
    scopes = child(found, "scopes").select("uri", "scope_id", F.posexplode("outward").alias("distance", "bound_scope"))
    bindings = child(found, "bindings").groupBy("uri", F.col("scope_id").alias("bound_scope"), "name").agg(F.min_by("kind", "start").alias("kind"))
    uses = child(found, "refs").join(scopes, ["uri", "scope_id"]).join(bindings, ["uri", "bound_scope", "name"])
    best = uses.groupBy("uri", "scope_id", "name", "start").agg(F.min(F.struct("distance", "bound_scope", "kind")).alias("b"))
    return best.select("uri", "scope_id", "name", "start", "b.bound_scope", "b.kind")


def free_uses(found: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """(uri, name, start, in_macro, module): uses that no scope of their file binds. bound: `bound_uses`, if at hand."""
    free = child(found, "refs").join((bound_uses(found) if bound is None else bound).select("uri", "name", "start"), ["uri", "name", "start"], "left_anti")
    return free.join(child(found, "scopes").select("uri", "scope_id", "module"), ["uri", "scope_id"]).select("uri", "name", "start", "in_macro", "module")


def unused(found: DataFrame) -> DataFrame:
    """Findings of locals, arguments and type parameters that nothing uses; names of underscores, or locals that begin with one, are exempt."""
    used = bound_uses(found).select("uri", F.col("bound_scope").alias("scope_id"), "name").distinct()
    never = child(found, "bindings").join(used, ["uri", "scope_id", "name"], "left_anti")
    rule = F.when(F.col("kind") == "argument", "unused_function_argument").when(F.col("kind") == "typeparam", "unused_type_parameter").when((F.col("kind") == "local") & ~F.col("name").startswith("_"), "unused_binding")
    never = never.withColumn("rule", F.when(~F.col("name").rlike("^_+$"), rule)).where("rule is not null")
    never = never.groupBy("uri", "scope_id", "name", "rule").agg(F.min("start").alias("start"))
    return never.select("uri", F.col("rule").alias("rule_id"), F.concat("name", F.lit(" is never used")).alias("message"), "start", (F.col("start") + F.char_length("name")).alias("stop"))


def in_modules(rows: DataFrame, spliced: DataFrame) -> DataFrame:
    """rows (uri, module) with root and path: the whole module path under each root."""
    own = spliced.select("root", F.col("file").alias("uri"), F.col("path").alias("base"))
    return rows.join(own, "uri").withColumn("path", F.concat("base", "module")).drop("base")


def cross_file_uses(found: DataFrame, spliced: DataFrame, declared: DataFrame) -> DataFrame:
    """(root, path, name, uri, start): free uses that an item of their module, in any file, declares."""
    uses = in_modules(free_uses(found), spliced)
    return uses.join(declared.select("root", "path", "name").distinct(), ["root", "path", "name"]).select("root", "path", "name", "uri", "start")


def missing_references(found: DataFrame, spliced: DataFrame, declared: DataFrame, env_names: DataFrame, known_packages: DataFrame) -> DataFrame:
    """Findings of free uses that neither their module nor the environment (name) has. Not in macro calls, nor in a module with a bare `using` of a package that isn't known (name)."""
    uses = in_modules(free_uses(found).where("NOT in_macro"), spliced).join(env_names.select("name"), "name", "left_anti")
    uses = uses.join(declared.select("root", "path", "name"), ["root", "path", "name"], "left_anti")
    wild = child(found, "imports").where("keyword = 'using' AND size(names) = 0 AND dots = 0").withColumn("name", F.get("path", 0)).drop("path")
    wild = in_modules(wild.join(known_packages.select("name"), "name", "left_anti"), spliced).select("root", "path").distinct()
    uses = uses.join(wild, ["root", "path"], "left_anti").select("uri", "name", "start").distinct()
    return _finding(uses, "missing_reference", F.concat(F.lit("nothing is called "), "name"), F.col("start") + F.char_length("name"))


def unresolved_imports(found: DataFrame, spliced: DataFrame, known_packages: DataFrame) -> DataFrame:
    """Findings of absolute imports whose first name is neither a known package nor a module around or beside them."""
    imports = child(found, "imports").where("dots = 0").select("uri", F.get("path", 0).alias("name"), "module", "start")
    unknown = imports.join(known_packages.select("name"), "name", "left_anti")
    modules = in_modules(child(found, "items").where("kind IN ('module', 'baremodule')").select("uri", "name", "module"), spliced)
    around = in_modules(unknown, spliced).withColumn("outer", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda i: F.slice("path", 1, i))))
    there = around.join(modules.select("root", F.col("path").alias("outer"), "name").distinct(), ["root", "outer", "name"], "left_semi").select("uri", "name", "start")
    return _finding(unknown.join(there, ["uri", "name", "start"], "left_anti"), "unresolved_import", F.concat(F.lit("there is no package "), "name"))


def redeclared(found: DataFrame) -> DataFrame:
    """Findings of items that redeclare a constant or datatype of their module and file; not in branches of an `if`, where one excludes the other."""
    items = child(found, "items").where("size(qualifier) = 0 AND kind NOT IN ('module', 'baremodule')")
    branches = child(found, "nodes").where("kind = 'if'").select("uri", F.col("start").alias("low"), F.col("stop").alias("high"))
    inside = relational.contained(items.select("uri", "start"), branches, ["uri"], "start", "low", "high").select("uri", "start")
    own = Window.partitionBy("uri", "module", "name").orderBy("ord")
    fixed = ("const", *symbols.DATATYPES)
    rows = items.join(inside, ["uri", "start"], "left_anti").withColumn("before", F.lag("kind").over(own))
    wrong = rows.where(F.col("before").isin(*fixed) & ~((F.col("kind") == "function") & F.col("before").isin(*symbols.DATATYPES)))
    return _finding(wrong, "const_decl", F.concat("name", F.lit(" is a constant already")))


def unfit_calls(found: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Findings of calls that no method of the item they lead to fits, by counts and keywords. Items that anything but functions declares have none, nor have names that some module adds methods to by a qualified name; a call that leads to several items is wrong only if no method of any fits."""
    declared, every = known or resolved(found)
    item = [F.col("root").alias("item_root"), F.col("path").alias("item_path"), F.col("name").alias("item_name")]
    own = declared.where("kind = 'function' AND min_args IS NOT NULL AND size(qualifier) = 0").select(*item, "min_args", "max_args", "kws", "kwsplat")
    other = declared.where("(kind <> 'function' OR min_args IS NULL) AND size(qualifier) = 0").select(*item)
    added = declared.where("size(qualifier) > 0").select(F.col("name").alias("item_name"))
    methods = own.join(other, ITEM, "left_anti").join(added, "item_name", "left_anti")
    uses = every.where("role = 'use' AND item_name IS NOT NULL").select("uri", "start", *ITEM).distinct()
    calls = child(found, "calls").join(uses, ["uri", "start"]).join(methods.select(*ITEM), ITEM, "left_semi")
    fits = symbols.arity_fits(
        {"min": F.col("c.min_args"), "max": F.col("c.max_args"), "kws": F.col("c.kws"), "has_splat": F.col("c.max_args") == symbols.UNBOUNDED},
        {"min": F.col("m.min_args"), "max": F.col("m.max_args"), "kws": F.col("m.kws"), "kwsplat": F.col("m.kwsplat")},
    )
    shape = ["min_args", "max_args", "kws"]
    kinds = methods.select(*ITEM, "min_args", "max_args", "kws", "kwsplat")
    shapes = symbols.fit_shapes(calls, kinds, ITEM, shape, fits).where("fit").drop("fit")
    good = symbols.of_shapes(calls, shapes).select("uri", "start").distinct()
    wrong = calls.select("uri", "callee", "start", "stop").distinct().join(good, ["uri", "start"], "left_anti")
    return _finding(wrong, "incorrect_call_args", F.concat(F.lit("no method of "), "callee", F.lit(" takes these arguments")), F.col("stop"))


def modules_of(found: DataFrame, spliced: DataFrame) -> DataFrame:
    """(root, path) of all modules, the roots' own among them."""
    own = in_modules(child(found, "items").where("kind IN ('module', 'baremodule')").select("uri", "name", "module"), spliced)
    return own.select("root", F.concat("path", F.array("name")).alias("path")).unionByName(spliced.select("root", F.array().cast("array<string>").alias("path"))).distinct()


def reached(rows: DataFrame, modules: DataFrame, dots: str, wanted: str) -> DataFrame:
    """rows (root, path, ...) with the module (to_root, to_path) that their array `wanted` names from there.

    With dots, from as many modules out, less one. Without, the nearest module of that path inside one of those around, or
    else one of that path under any root. Rows whose module isn't there are left out.
    """
    own = rows.columns
    depth = F.size("path")
    outward = F.when(F.col(dots) > 0, F.array(depth - F.col(dots) + 1)).otherwise(F.sequence(F.lit(0), depth))
    around = rows.withColumn("__n", F.explode(outward)).where("__n >= 0").withColumns({"to_root": F.col("root"), "to_path": F.concat(F.slice("path", 1, F.col("__n")), wanted)})
    there = modules.select(F.col("root").alias("to_root"), F.col("path").alias("to_path"))
    near = around.join(there, ["to_root", "to_path"]).select(*own, "__n", "to_root", "to_path")
    # under other roots all of them, for a module may be spliced under several
    far = rows.where(F.col(dots) == 0).withColumn("to_path", F.col(wanted)).join(there, "to_path").select(*own, F.lit(-1).alias("__n"), "to_root", "to_path")
    nearest = F.max("__n").over(Window.partitionBy(*own))
    return near.unionByName(far).withColumn("__nearest", nearest).where("__n = __nearest").drop("__n", "__nearest")


def exposed(found: DataFrame, spliced: DataFrame, declared: DataFrame) -> DataFrame:
    """(root, path, name, item_root, item_path, item_name): what each name means in each module: its own declarations, and what it imports from modules of the workspace, under the alias it gives, through as many modules as pass it on."""
    key = lambda root, path: F.concat_ws("\x1f", root, path)
    modules = graph.stored(modules_of(found, spliced).withColumn("module", key("root", "path")))
    imports = in_modules(child(found, "imports").withColumnRenamed("path", "wanted"), spliced)
    columns = ["root", "path", "keyword", "dots", "wanted", "names", "called", "ord"]
    own, to = key("root", "path").alias("module"), key("to_root", "to_path").alias("target")
    listed = reached(imports.where("size(names) > 0").select(*columns), modules, "dots", "wanted").withColumn("n", F.explode(F.arrays_zip("called", "names")))
    explicit = listed.select(own, F.col("n.called").alias("name"), to, F.col("n.names").alias("target_name"), "ord")
    whole = imports.where("size(names) = 0 AND size(wanted) > 0").select(*columns)
    last = whole.withColumns({"target_name": F.element_at("wanted", -1), "outer": F.slice("wanted", 1, F.size("wanted") - 1), "name": F.get("called", 0)})
    explicit = explicit.unionByName(reached(last.where("size(outer) > 0 OR dots > 0"), modules, "dots", "outer").select(own, "name", to, "target_name", "ord"))
    wildcard = reached(whole.where("keyword = 'using'"), modules, "dots", "wanted").select(own, to, "ord")
    exports = in_modules(child(found, "exports").select("uri", "name", "module"), spliced).select(own, "name")
    items = declared.where("size(qualifier) = 0").select(own, "name")
    seen = visibility.visible(items, explicit, wildcard, exports).where("item_module is not null")
    there = modules.select(F.col("module").alias("item_module"), F.col("root").alias("item_root"), F.col("path").alias("item_path"))
    return seen.join(modules, "module").join(there, "item_module").select("root", "path", "name", *ITEM).distinct()


def sites(found: DataFrame, spliced: DataFrame, declared: DataFrame) -> DataFrame:
    """(uri, start, name, role, scope, item_root, item_path, item_name): every place that stands for something known. scope is that of a local binding, null for an item; role is use, head, import or export."""
    # tables that several of the joins below read: stored, so that plans stay small
    seen, within, modules = (graph.stored(x) for x in (exposed(found, spliced, declared), bound_uses(found), modules_of(found, spliced)))
    scopes = child(found, "scopes").select("uri", "scope_id", "module")
    none = [F.lit(None).cast("string").alias("item_root"), F.lit(None).cast("array<string>").alias("item_path"), F.lit(None).cast("string").alias("item_name")]
    bound = within.where("kind <> 'import'").select("uri", "start", "name", F.lit("use").alias("role"), F.col("bound_scope").alias("scope"), *none)
    heads = child(found, "bindings").where("kind <> 'import'").select("uri", "start", "name", F.lit("head").alias("role"), F.col("scope_id").alias("scope"), *none)
    local = lambda df, role: df.select("uri", "start", "name", F.lit(role).alias("role"), F.lit(None).cast("int").alias("scope"), *ITEM)
    # what is bound at the top of a file or module is an item, or imported
    top = child(found, "scopes").where("kind IN ('module', 'file')").select("uri", F.col("scope_id").alias("scope"))
    at_top = within.join(top.withColumnRenamed("scope", "bound_scope"), ["uri", "bound_scope"], "left_semi").join(scopes, ["uri", "scope_id"]).select("uri", "name", "start", "module")
    free = in_modules(free_uses(found, within).select("uri", "name", "start", "module").unionByName(at_top), spliced)
    uses = local(free.join(seen, ["root", "path", "name"]), "use")
    items = declared.where("size(qualifier) = 0").select("uri", F.col("name_start").alias("start"), "name", F.col("root").alias("item_root"), F.col("path").alias("item_path"), F.col("name").alias("item_name"))
    members = reached(in_modules(child(found, "members").withColumn("dots", F.lit(0)), spliced).select("root", "path", "uri", "name", "start", "qualifier", "dots"), modules, "dots", "qualifier")
    members = members.select("uri", "name", "start", F.col("to_root").alias("root"), F.col("to_path").alias("path")).join(seen, ["root", "path", "name"])
    exports = in_modules(child(found, "exports").select("uri", "name", "start", "module"), spliced).join(seen, ["root", "path", "name"])
    imports = in_modules(child(found, "imports").withColumnRenamed("path", "wanted"), spliced)
    last = F.element_at("wanted", -1)
    imports = imports.select("root", "path", "uri", "dots", F.when(F.size("names") > 0, F.col("wanted")).otherwise(F.slice("wanted", 1, F.greatest(F.size("wanted") - 1, F.lit(0)))).alias("outer"), F.explode(F.arrays_zip(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(last)).alias("n"), F.col("starts").alias("s"))).alias("x"))
    imports = reached(imports.select("root", "path", "uri", "dots", "outer", F.col("x.n").alias("name"), F.col("x.s").alias("start")), modules, "dots", "outer")
    imports = imports.select("uri", "name", "start", F.col("to_root").alias("root"), F.col("to_path").alias("path")).join(seen, ["root", "path", "name"])
    heads = heads.join(top, ["uri", "scope"], "left_anti").select(*heads.columns)
    bound = bound.join(top, ["uri", "scope"], "left_anti").select(*bound.columns)
    out = bound.unionByName(heads).unionByName(uses)
    for df, role in ((items, "head"), (members, "use"), (exports, "export"), (imports, "import")):
        out = out.unionByName(local(df, role))
    return out.where("start is not null").distinct()


def resolved(found: DataFrame, spliced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(declarations, sites) of all files, stored: for several questions to them."""
    spliced = analysis.splices(found) if spliced is None else spliced
    declared = graph.stored(analysis.declarations(found, spliced))
    return declared, graph.stored(sites(found, spliced, declared))


def _at(points: DataFrame, every: DataFrame) -> DataFrame:
    """(uri, offset, at_name, scope, item_root, item_path, item_name) of what stands at each place."""
    spans = every.select("uri", "start", (F.col("start") + F.char_length("name")).alias("stop")).distinct()
    at = relational.innermost(points, spans, ["uri"], "offset", "start", "stop").select("uri", "offset", "start")
    return at.join(every, ["uri", "start"]).select("uri", "offset", F.col("name").alias("at_name"), "scope", *ITEM).distinct()


def definitions(found: DataFrame, points: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(uri, offset, name, target_uri, target_start): where what each place stands for is bound in its file, or declared as an item of its module, of one that is imported or of the one it is qualified by."""
    declared, every = known or resolved(found)
    at = _at(points, every)
    first = child(found, "bindings").groupBy("uri", F.col("scope_id").alias("scope"), F.col("name").alias("at_name")).agg(F.min("start").alias("target_start"))
    local = at.where("scope is not null").join(first, ["uri", "scope", "at_name"]).select("uri", "offset", F.col("at_name").alias("name"), F.col("uri").alias("target_uri"), "target_start")
    items = declared.where("size(qualifier) = 0").select(F.col("root").alias("item_root"), F.col("path").alias("item_path"), F.col("name").alias("item_name"), F.col("uri").alias("target_uri"), F.col("start").alias("target_start"))
    return local.unionByName(at.join(items, ITEM).select("uri", "offset", F.col("at_name").alias("name"), "target_uri", "target_start")).distinct()


def references(found: DataFrame, points: DataFrame, known: tuple[DataFrame, DataFrame] | None = None, roles: tuple[str, ...] = ("use", "import")) -> DataFrame:
    """(uri, offset, name, ref_uri, ref_start, ref_name): all sites of what each place stands for: of the same binding in its file, or of the same item in any file, whatever it is called there. roles: those of `sites` that are wanted."""
    every = (known or resolved(found))[1]
    at = _at(points, every)
    wanted = every.where(F.col("role").isin(*roles)).select(F.col("uri").alias("ref_uri"), F.col("start").alias("ref_start"), F.col("name").alias("ref_name"), F.col("scope").alias("ref_scope"), *ITEM)
    local = at.where("scope is not null").drop(*ITEM).join(wanted.where("ref_scope is not null").drop(*ITEM), (F.col("uri") == F.col("ref_uri")) & (F.col("scope") == F.col("ref_scope")) & (F.col("at_name") == F.col("ref_name")))
    items = at.join(wanted.where("ref_scope is null"), ITEM)
    columns = ["uri", "offset", F.col("at_name").alias("name"), "ref_uri", "ref_start", "ref_name"]
    return local.select(*columns).unionByName(items.select(*columns)).distinct()


def rename_sites(found: DataFrame, points: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(uri, start, name): all places where what stands at a place is spelled by its own name, its declarations, exports and imports too; aliases stay."""
    known = known or resolved(found)
    rows = references(found, points, known, ("use", "head", "import", "export"))
    spelled = _at(points, known[1]).select("uri", "offset", F.coalesce("item_name", "at_name").alias("spelled")).distinct()
    rows = rows.join(spelled, ["uri", "offset"]).where(F.col("ref_name") == F.col("spelled"))
    return rows.select(F.col("ref_uri").alias("uri"), F.col("ref_start").alias("start"), F.col("spelled").alias("name")).distinct()
