import random

from arborq.operators import config, projects
from arborq.sources import caches
from arborq.workspace import Workspace


def test_toml_problem():
    assert config.toml_problem(None) is None and config.toml_problem("a = 1\n[b]\n") is None
    message, start, stop = config.toml_problem("ok = 1\nbad = = 2\n")
    assert (start, stop) == (13, 14) and "line" not in message
    assert config.toml_problem("a = 1\r\nb = =\r\n")[1] == 11  # places count the text's own characters
    assert config.toml_problem("[open")[1:] == (5, 5)
    assert config.toml_problem("a = " + "[" * 5000) is not None


def test_toml_findings(spark):
    broken, fine = "name = = 1\n", 'name = "P"\n'
    there = {"/p/Project.toml": broken, "/p/Manifest-v1.11.toml": broken, "/q/JuliaManifest.toml": broken, "/JuliaLint.toml": broken, "/q/Project.toml": fine, "/q/data.toml": broken, "/q/a.jl": "x = 1\n", "/r/Manifest.toml": None}
    w = Workspace(spark, spark.createDataFrame([(u, t, None, 1, True) for u, t in there.items()], "uri string, content string, language_id string, revision long, is_regular boolean"))
    assert {r["uri"] for r in w.toml_files().collect()} == set(there) - {"/q/data.toml", "/q/a.jl"}
    got = {r["uri"]: (r["rule_id"], r["start"], r["stop"]) for r in config.toml_findings(w.toml_files()).collect()}
    assert got == {u: ("toml_syntax_errors", 7, 8) for u in ("/p/Project.toml", "/p/Manifest-v1.11.toml", "/q/JuliaManifest.toml", "/JuliaLint.toml")}
    found = w.diagnostics().where("rule_id = 'toml_syntax_errors'")
    assert {(r["uri"], r["severity"]) for r in found.collect()} == {(u, "error") for u in got}
    none = Workspace(spark, spark.createDataFrame([], w.files.schema))
    assert config.toml_findings(none.toml_files()).count() == 0


def odd_toml():
    """Texts of the right keys with values of every type, broken ones, and deep nesting."""
    r = random.Random(1)
    values = ["3", "true", '"x"', "[]", "[1]", '["a", 2]', "{}", "{ severity = 3 }", '{ severity = "error" }', "1979-05-27", "1e999", "[[1]]", '[{ paths = 3, rules = "x" }]', '[{ uuid = 3 }]', '[{ uuid = "u" }]', '[{ uuid = "u", path = 1 }]', "nan", '"' + "\\u0000" + '"']
    keys = [*config.KEYS, "manifest_format", "deps", "name", "uuid", '"1.2.3"', '"1.x"', '"99999999999999999999"', '"v1"', '"1.2-rc1+b"', "Pkg"]
    for _ in range(400):
        picked = r.sample(keys, r.randrange(1, 6))
        yield "\n".join(f"{k} = {r.choice(values)}" for k in picked) + r.choice(["", "", "\n[deps]\nA = 1\n", "\n[[deps.B]]\nuuid = 1\n", "\n= 3"])
    yield from ["a = " + "[" * 3000, "[" * 3000, None, "", "\x00", "a = 9" + "9" * 5000, "d = 0000-00-00"]


def test_readers_of_toml_raise_nothing():
    for text in odd_toml():
        got = config.parse_config(text)
        assert isinstance(got["errors"], list) and all(isinstance(x, str) for x in [got["preset"], *got["include"], *got["exclude"], *got["rules"], *got["rules"].values()])
        projects.manifest_entries(text), projects._project(text), caches.parse_versions(text), config.toml_problem(text)
    assert config.parse_config("rules = 3")["errors"] == ["rules isn't a table"]
    assert config.parse_config('overrides = [1, { paths = ["a.jl"] }]')["errors"] == ["an override isn't a table"]
    assert [v["version"] for v in caches.parse_versions('["1.2.3"]\n["1.x"]\n["2"]\n')] == ["1.2.3", "2"]


def test_one_bad_file_stops_nothing(spark):
    there = {f"/p{i}/{name}": t for i, t in enumerate(odd_toml()) if i % 9 == 0 or i >= 400 for name in ("JuliaLint.toml", "Project.toml", "Manifest.toml")}
    there |= {f"/p{i}/a.jl": "x = 1\n" for i in range(0, 400, 9)}
    w = Workspace(spark, spark.createDataFrame([(u, t, None, 1, True) for u, t in there.items()], "uri string, content string, language_id string, revision long, is_regular boolean"))
    assert w.diagnostics().count() > 0
