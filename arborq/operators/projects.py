"""Folders as packages, projects and environments, and what governs a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborq.functions import paths
from arborq.operators import relational
from arborq.operators.config import load_toml

#: Names of project files and manifests, the preferred ones first.
PROJECT_FILES = ("JuliaProject.toml", "Project.toml")
MANIFEST_FILES = ("JuliaManifest.toml", "Manifest.toml")
#: Lower-cased names of projects and of manifests, those for a version of the language too.
TOML_NAMES = r"^(julia)?(project|manifest(-v\d+(\.\d+)*)?)\.toml$"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def candidates(files: DataFrame, names: tuple[str, ...], alias: str) -> DataFrame:
    """(folder, alias): for each folder the first of names that it has."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("base"))
    own = files.select("uri", paths.dirname(F.col("uri")).alias("folder"), paths.basename(F.col("uri")).alias("base"))
    return own.where(rank > 0).groupBy("folder").agg(F.min_by("uri", rank).alias(alias))


def folders(files: DataFrame, version: str | None = None) -> DataFrame:
    """(folder, project, manifest); a manifest for the running version (say 1.11) goes before those without one."""
    own = tuple(x.replace(".toml", f"-v{version}.toml") for x in MANIFEST_FILES) if version else ()
    return candidates(files, PROJECT_FILES, "project").join(candidates(files, own + MANIFEST_FILES, "manifest"), "folder", "left")


def _project(text: str | None) -> dict | None:
    t, problem = load_toml(text)
    if problem:
        return None
    take = lambda k: t[k] if isinstance(t.get(k), str) else None
    return {"name": take("name"), "uuid": take("uuid"), "version": take("version")}


def project_fields(content: Column) -> Column:
    """Name, uuid and version as a project file gives them; null if it isn't TOML."""
    return F.udf(_project, "struct<name: string, uuid: string, version: string>", useArrow=False)(content)


DEPS = "array<struct<name: string, kind: string, uuid: string, version: string, tree_sha: string, path: string>>"


def manifest_entries(text: str | None) -> list[dict] | None:
    """A manifest's dependencies; null if it isn't TOML or of an unknown format. A name with several entries, and an entry that fits no kind of dependency, are left out."""
    t, problem = load_toml(text)
    major = str(t.get("manifest_format", "1")).split(".")[0]
    if problem or major not in ("1", "2"):
        return None
    table = t if major == "1" else t.get("deps", {})
    out = []
    for name, entries in table.items() if isinstance(table, dict) else ():
        if not isinstance(entries, list) or len(entries) != 1 or not isinstance(entries[0], dict):
            continue
        uuid, version, sha, path = (x if isinstance(x := entries[0].get(k), str) else None for k in ("uuid", "version", "git-tree-sha1", "path"))
        if uuid and path is not None:
            out.append({"name": name, "kind": "dev", "uuid": uuid, "version": version or "", "tree_sha": None, "path": path})
        elif uuid and sha and version is not None:
            out.append({"name": name, "kind": "registered", "uuid": uuid, "version": version, "tree_sha": sha, "path": None})
        elif uuid:
            out.append({"name": name, "kind": "stdlib", "uuid": uuid, "version": version, "tree_sha": None, "path": None})
    return out


def dependencies(content: Column) -> Column:
    return F.udf(manifest_entries, DEPS, useArrow=False)(content)


def classified(found: DataFrame, fields: Column) -> DataFrame:
    """found (folder, project, manifest, and what fields are taken from) with is_package, is_project, is_env (neither)."""
    out = found.withColumn("__f", fields)
    package = F.coalesce(F.col("__f.name").isNotNull() & F.col("__f.version").isNotNull() & F.col("__f.uuid").rlike(UUID), F.lit(False))
    project = F.col("manifest").isNotNull()
    return out.withColumns({"is_package": package, "is_project": project, "is_env": ~package & ~project}).drop("__f")


def governing(files: DataFrame, cascade: list[tuple[DataFrame, str]]) -> DataFrame:
    """files (uri) with folder and via: of several folder tables (folder), each with a name, the first that has one above a file; within a table the deepest."""
    out, choices = files, []
    for k, (table, name) in enumerate(cascade):
        out = relational.deepest_match(out, table.select(F.col("folder").alias(f"__{k}")), "uri", f"__{k}")
        choices.append((F.col(f"__{k}"), name))
    folder = F.coalesce(*[c for c, _ in choices])
    via = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, n in choices])
    return out.select(*files.columns, folder.alias("folder"), via.alias("via"))


def env_ready(state: DataFrame) -> DataFrame:
    """state (uri, override, project_required, project_settled, env_pending, needs_test_env, test_env_pending) with ready; a null counts as what doesn't hold it up."""
    t, f = F.lit(True), F.lit(False)
    hold = F.coalesce("project_required", f) & ~F.coalesce("project_settled", f)
    hold = hold | F.coalesce("env_pending", f) | (F.coalesce("needs_test_env", f) & F.coalesce("test_env_pending", f))
    return state.withColumn("ready", F.when(F.coalesce("override", f), t).otherwise(~hold))


def deving(packages: DataFrame, deps: DataFrame) -> DataFrame:
    """packages (folder) with project: the folder of a project whose manifest has the package as a dependency under development, null where none has; of several the least.

    deps: (project, kind, path), entries of the manifests; a path is taken from the project's folder unless it is absolute,
    and compared without dots and slashes at its end. Entries of other kinds, and without a path, count for nothing.
    """
    path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat("project", F.lit("/"), "path"))
    dev = deps.where("kind = 'dev' AND path IS NOT NULL AND project IS NOT NULL").select(paths.normalised(path).alias("folder"), "project")
    return packages.join(dev.groupBy("folder").agg(F.min("project").alias("project")), "folder", "left")


def test_environments(packages: DataFrame, projects: DataFrame, active: str | None) -> DataFrame:
    """packages (folder, project as of `deving`) with test_env: the folder whose environment the package's tests run in: its own where it is a project itself or no project develops it, else the active project (null without one)."""
    own = projects.select("folder", F.lit(True).alias("__own")).distinct()
    out = packages.join(own, "folder", "left")
    return out.withColumn("test_env", F.when(F.col("__own") | F.col("project").isNull(), F.col("folder")).otherwise(F.lit(active).cast("string"))).drop("__own")
