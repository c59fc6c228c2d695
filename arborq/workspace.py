"""A workspace: the files there are, and all questions to them, as DataFrames.

Files are a table (uri, content, language_id, revision, is_regular); a change gives the next revision of it. Questions are
lazy: nothing runs until the answer is collected. Facts of files come from `refresh`, which parses only files whose
content hash is new, and keeps the results of the others in Parquet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.functions import paths
from arborq.operators import analysis, config, diagnostics, edits, features, graph, lifecycle, producers, projects, relational, resolve, rules, symbols
from arborq.operators.graph import shared_dir
from arborq.sources import folders
from arborq.streaming import changes

FILES = "uri string, content string, language_id string, revision long, is_regular boolean"


class UnknownFile(KeyError):
    pass


class DuplicateFile(ValueError):
    pass


class Workspace:
    def __init__(self, spark: SparkSession, files: DataFrame | None = None, lint_config: str = paths.LINT_CONFIG, format_config: str = paths.FORMAT_CONFIG):
        self.spark, self.lint_config, self.format_config = spark, lint_config, format_config
        self.files = files if files is not None else spark.createDataFrame([], FILES)
        self.active_project: str | None = None
        self.pending = spark.createDataFrame([], "kind string, path string, package string, content_hash string")
        self.failed = spark.createDataFrame([], "kind string, path string, package string, content_hash string, message string")
        #: (package, name): what installed packages and the language export; null: rules that need it are withheld.
        self.environment: DataFrame | None = None
        #: (package, name): what packages export that could be brought in, for FixMissingRef.
        self.available: DataFrame | None = None
        self._facts: DataFrame | None = None
        self._known: tuple | None = None

    @classmethod
    def from_folders(cls, spark: SparkSession, *where: str, **options) -> Workspace:
        out = None
        for folder in where:
            own = _as_files(folders.scan(spark, folder))
            out = own if out is None else out.unionByName(own)
        return cls(spark, None if out is None else out.dropDuplicates(["uri"]), **options)

    # changes
    def _set(self, files: DataFrame) -> None:
        path = f"{shared_dir(self.spark)}/workspace-{uuid.uuid4().hex[:12]}"
        files.write.parquet(path)
        self.files = self.spark.read.schema(FILES).parquet(path)

    def add_files(self, added: DataFrame) -> None:
        """added: (uri, content[, language_id]), all at once; none of them may be there."""
        if not added.join(self.files, "uri", "left_semi").isEmpty() or added.groupBy("uri").count().where("count > 1").limit(1).count():
            raise DuplicateFile("a file is there already")
        self._set(self.files.unionByName(_as_files(added)))

    def update_files(self, updated: DataFrame) -> None:
        """updated: (uri, content[, language_id]), each file once; one without a language keeps the one it has, and all stay regular or indirect as they are."""
        if updated.groupBy("uri").count().where("count > 1").limit(1).count():
            raise DuplicateFile("a file is updated twice at once")
        if not updated.join(self.files, "uri", "left_anti").isEmpty():
            raise UnknownFile("a file isn't there")
        language = F.col("language_id") if "language_id" in updated.columns else F.lit(None).cast("string")
        new = updated.select("uri", "content", language.alias("told")).join(self.files.drop("content"), "uri")
        new = new.select("uri", "content", F.coalesce("told", "language_id").alias("language_id"), (F.col("revision") + 1).alias("revision"), "is_regular")
        self._set(self.files.join(updated.select("uri"), "uri", "left_anti").unionByName(new))

    def add_file(self, uri: str, content: str, language_id: str | None = None) -> None:
        self.add_files(self.spark.createDataFrame([(uri, content, language_id)], "uri string, content string, language_id string"))

    def update_file(self, uri: str, content: str, language_id: str | None = None) -> None:
        self.update_files(self.spark.createDataFrame([(uri, content, language_id)], "uri string, content string, language_id string"))

    def remove_file(self, uri: str) -> None:
        if not self.has_file(uri):
            raise UnknownFile(uri)
        self._set(self.files.where(F.col("uri") != uri))

    def remove_all_children(self, folder: str) -> None:
        self._set(self.files.where(~F.col("uri").startswith(folder.rstrip("/") + "/")))

    def add_file_from_disc(self, path: str) -> None:
        self.add_files(folders.read_one(self.spark, path))

    def update_file_from_disc(self, path: str) -> None:
        self.update_files(folders.read_one(self.spark, path))

    def add_folder_from_disc(self, folder: str, max_julia_files: int | None = None) -> None:
        self.add_files(folders.scan(self.spark, folder, max_julia_files))

    def apply(self, feed: DataFrame) -> DataFrame:
        """A batch of changes (seq, op, uri, content); gives those that didn't fit and were passed over. A file that is updated keeps its language, and whether it is regular; its revision counts the updates."""
        wrong = changes.errors(self.files, feed)
        last = changes.outcome(feed.join(wrong.select("seq"), "seq", "left_anti"))
        kept = self.files.join(last.select("uri"), "uri", "left_anti")
        before = self.files.select("uri", F.col("language_id").alias("language_before"), F.col("revision").alias("before"), F.col("is_regular").alias("regular_before"))
        new = last.where("op <> 'remove'").join(before, "uri", "left")
        stays = ~F.col("added")
        new = new.select(
            "uri", "content", F.when(stays, F.col("language_before")).otherwise(paths.language_of(F.col("uri"))).alias("language_id"),
            (F.when(stays, F.col("before")).otherwise(1) + F.col("updates")).alias("revision"), F.when(stays, F.col("regular_before")).otherwise(True).alias("is_regular"),
        )
        self._set(kept.unionByName(new))
        return wrong

    def set_indirect(self, files: DataFrame | None, *gone: str) -> None:
        """Files that others lead to without being part of the workspace: those of `files` replaced, those `gone` dropped."""
        out = self.files.where(~F.col("uri").isin(*gone) | F.col("is_regular")) if gone else self.files
        if files is not None:
            new = _as_files(files).withColumn("is_regular", F.lit(False)).join(self.files.where("is_regular"), "uri", "left_anti")
            out = out.join(new.select("uri"), "uri", "left_anti").unionByName(new)
        self._set(out)

    # files
    def text_files(self) -> DataFrame:
        return self.files.where("is_regular").select("uri")

    def julia_files(self) -> DataFrame:
        return self.files.where(paths.is_julia(F.col("uri"), F.col("language_id")) & F.col("is_regular")).select("uri")

    def indirect_files(self) -> DataFrame:
        return self.files.where("NOT is_regular").select("uri")

    def has_file(self, uri: str) -> bool:
        return not self.files.where((F.col("uri") == uri) & F.col("is_regular")).isEmpty()

    def text_file(self, uri: str) -> str | None:
        got = self.files.where(F.col("uri") == uri).select("content").take(1)
        if not got:
            raise UnknownFile(uri)
        return got[0]["content"]

    # facts
    def refresh(self, results: DataFrame | None = None) -> DataFrame:
        """Facts of all Julia files: those of `results` (the last refresh, if not given) are kept where the content is the same."""
        code = self.files.where(paths.is_julia(F.col("uri"), F.col("language_id"))).withColumn("hash", lifecycle.content_hash("content"))
        before = results if results is not None else self._facts
        parse = lambda df: analysis.facts(df).join(df.select("uri", "hash"), "uri")
        new = code.select("uri", "content", "hash")
        out = parse(new) if before is None else lifecycle.refreshed(new, before, "uri", "hash", parse)
        path = f"{shared_dir(self.spark)}/facts-{uuid.uuid4().hex[:12]}"
        out.write.parquet(path)
        self._facts = self.spark.read.schema(out.schema).parquet(path)
        return self._facts

    @property
    def known(self) -> tuple[DataFrame, DataFrame]:
        """Declarations and what every place stands for (`resolve.resolved`), stored until the facts change."""
        facts = self.facts
        if self._known is None or self._known[0] is not facts:
            self._known = facts, resolve.resolved(facts)
        return self._known[1]

    @property
    def facts(self) -> DataFrame:
        return self._facts if self._facts is not None else self.refresh()

    def table(self, name: str) -> DataFrame:
        """One of analysis.TABLES, with uri."""
        return analysis.child(self.facts, name)

    # include graph
    def include_records(self) -> DataFrame:
        return analysis.include_records(self.facts)

    def edges(self) -> DataFrame:
        return self.include_records().where("target is not null").select("src", F.col("target").alias("dst"))

    def nodes(self) -> DataFrame:
        return analysis.uris(self.facts).select(F.col("uri").alias("node"))

    def roots(self) -> DataFrame:
        return graph.roots(self.nodes(), self.edges())

    def roots_for(self, *uris: str) -> DataFrame:
        starts = self.nodes().where(F.col("node").isin(*uris)) if uris else None
        return graph.roots_of(self.nodes(), self.edges(), starts)

    def best_root(self, *uris: str) -> DataFrame:
        return graph.best_root(self.roots_for(*uris), F.col("root").contains("/test/"))

    def declarations(self) -> DataFrame:
        return analysis.declarations(self.facts, analysis.splices(self.facts))

    # projects
    def project_folders(self) -> DataFrame:
        found = projects.folders(self.files)
        content = self.files.select(F.col("uri").alias("project"), "content")
        return projects.classified(found.join(content, "project"), projects.project_fields(F.col("content"))).drop("content")

    def packages(self) -> DataFrame:
        return self.project_folders().where("is_package").select("folder", "project")

    def projects(self) -> DataFrame:
        return self.project_folders().where("is_project").select("folder", "project", "manifest")

    def dependencies(self) -> DataFrame:
        content = self.files.select(F.col("uri").alias("manifest"), "content")
        rows = self.projects().join(content, "manifest")
        return rows.select("folder", F.explode(projects.dependencies(F.col("content"))).alias("d")).select("folder", "d.*")

    def governing_project(self) -> DataFrame:
        found = self.project_folders()
        cascade = [(found.where("is_env"), "environment"), (found.where("is_project"), "project"), (found.where("is_package"), "package")]
        if self.active_project:
            cascade.append((self.spark.createDataFrame([(self.active_project,)], "folder string"), "active"))
        return projects.governing(self.files.select("uri"), cascade)

    # diagnostics
    def lint_configs(self) -> DataFrame:
        return config.configs(self.files, self.lint_config)

    def toml_files(self) -> DataFrame:
        """Configurations, projects and manifests: the files that have to be TOML."""
        name = F.lower(paths.basename(F.col("uri")))
        return self.files.where(name.isin(self.lint_config.lower(), self.format_config.lower(), paths.TESTITEMS_CONFIG.lower()) | name.rlike(projects.TOML_NAMES))

    def findings(self) -> DataFrame:
        """(uri, rule_id, message, start, stop) of all producers, as one union."""
        return producers.findings(self)

    def workspace_packages(self) -> DataFrame:
        """(name) of the packages in the workspace."""
        content = self.files.select(F.col("uri").alias("project"), "content")
        return self.packages().join(content, "project").select(projects.project_fields(F.col("content")).getField("name").alias("name"))

    def diagnostics(self) -> DataFrame:
        """findings with severity, of regular files in scope. A configuration file that leaves itself out still reports, but not one that a configuration above its folder leaves out."""
        found = self.lint_configs()
        regular = self.files.where("is_regular").select("uri")
        every = found.select("config").unionByName(config.configs(self.files, self.format_config).select("config"))
        scope = config.scoped(regular, found).join(config.scoped_above(every, found), F.col("uri") == F.col("config"), "left").select("uri", F.coalesce("by_others", "in_scope").alias("in_scope"))
        return diagnostics.diagnostics(self.findings(), config.effective(regular, found), scope, self.ready_files(), rules.rules(self.spark))

    def diagnostics_per_file(self) -> DataFrame:
        return diagnostics.per_file(self.text_files(), self.diagnostics())

    def ready_files(self) -> DataFrame:
        """(uri, ready): false for files whose governing project has work pending that hasn't failed."""
        waits = relational.missing(self.pending, self.failed, ["kind", "path", "package", "content_hash"]).select(F.col("path").alias("folder"), F.lit(False).alias("ready")).distinct()
        return self.governing_project().join(waits, "folder", "left").select("uri", F.coalesce("ready", F.lit(True)).alias("ready"))

    def is_ready(self) -> bool:
        return relational.missing(self.pending, self.failed, ["kind", "path", "package", "content_hash"]).isEmpty()

    def retry_failed(self) -> None:
        self.failed = self.failed.limit(0)

    # features
    def test_items(self) -> DataFrame:
        return analysis.test_ids(self.facts)

    def document_symbols(self, uri: str) -> DataFrame:
        return analysis.document_symbols(self.facts.where(F.col("uri") == uri))

    def workspace_symbols(self, query: str) -> DataFrame:
        return analysis.workspace_symbols(self.facts, query)

    def module_at(self, uri: str, *offsets: int) -> DataFrame:
        return analysis.module_at(self.facts.where(F.col("uri") == uri), self._points(uri, offsets))

    def selection_ranges(self, uri: str, *offsets: int) -> DataFrame:
        return features.selection_ranges(self.table("nodes"), self._points(uri, offsets))

    def current_block(self, uri: str, *offsets: int) -> DataFrame:
        return features.current_block(self.table("nodes"), self._points(uri, offsets))

    def signature_help(self, uri: str, *offsets: int) -> DataFrame:
        return features.signature_help(self.table("calls"), self.table("items"), self._points(uri, offsets))

    def hover(self, uri: str, *offsets: int) -> DataFrame:
        return features.hover(self.table("calls"), self.table("items"), self._points(uri, offsets))

    def definitions(self, uri: str, *offsets: int) -> DataFrame:
        return resolve.definitions(self.facts, self._points(uri, offsets), self.known)

    def references(self, uri: str, *offsets: int) -> DataFrame:
        return resolve.references(self.facts, self._points(uri, offsets), self.known)

    def highlights(self, uri: str, *offsets: int) -> DataFrame:
        return self.references(uri, *offsets).where(F.col("ref_uri") == uri)

    def rename_edits(self, uri: str, offset: int, name: str) -> DataFrame:
        """(uri, start, stop, text): all places that spell what stands at a place, given another name."""
        rows = resolve.rename_sites(self.facts, self._points(uri, (offset,)), self.known)
        return rows.select("uri", "start", (F.col("start") + F.char_length("name")).alias("stop"), F.lit(name).alias("text"))

    def document_links(self, uri: str | None = None) -> DataFrame:
        own = self.files if uri is None else self.files.where(F.col("uri") == uri)
        return features.document_links(own, self.files)

    def completions(self, query: str) -> DataFrame:
        names = self.table("items").where("name is not null").select(F.col("name").alias("label"), F.lit("module").alias("source"), F.lit(0).alias("depth")).distinct()
        return symbols.completions(names, query)

    def code_actions(self, messages: DataFrame | None = None) -> DataFrame:
        return features.code_actions(self.findings() if messages is None else messages)

    def action_edits(self, *actions: str) -> DataFrame:
        """(uri, start, stop, text, action): the edits that answer findings; of the actions named, or all."""
        found = edits.of_findings(self.findings(), self.files, self.available)
        return found.where(F.col("action").isin(*actions)) if actions else found

    def apply_edits(self, wanted: DataFrame) -> DataFrame:
        """Makes edits (uri, start, stop, text) of any number of files as one revision, and gives those that couldn't be made (uri, start, stop, text, rank)."""
        plan = graph.stored(edits.composed(wanted))
        done = graph.stored(edits.applied(self.files, plan))
        changed = done.where("n_edits > 0").select("uri", "content")
        if not changed.isEmpty():
            self.update_files(changed)
        return edits.conflicts(plan).unionByName(edits.conflicts(done))

    def apply_actions(self, *actions: str) -> DataFrame:
        """`apply_edits` of `action_edits`."""
        return self.apply_edits(self.action_edits(*actions).select("uri", "start", "stop", "text"))

    def format_edits(self, formatter: Callable[[str], str]) -> DataFrame:
        code = self.files.where("is_regular").join(self.julia_files(), "uri", "left_semi")
        scope = config.scoped(code.select("uri"), config.configs(self.files, self.format_config)).where("in_scope")
        return features.format_edits(code.join(scope.select("uri"), "uri", "left_semi"), formatter)

    def _points(self, uri: str, offsets: tuple[int, ...]) -> DataFrame:
        return self.spark.createDataFrame([(uri, o) for o in offsets], "uri string, offset int")


def _as_files(df: DataFrame) -> DataFrame:
    language = F.coalesce(F.col("language_id"), paths.language_of(F.col("uri"))) if "language_id" in df.columns else paths.language_of(F.col("uri"))
    return df.select("uri", "content", language.alias("language_id"), F.lit(1).cast("long").alias("revision"), F.lit(True).alias("is_regular"))
