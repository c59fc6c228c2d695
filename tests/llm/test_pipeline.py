import os

import pytest

import corpus_pipeline
from arborq.llm import queries

SF = "/root/testdata/sf0.001"


def test_queries_are_all_there():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert queries.SQL.keys() <= queries.QUERIES.keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        if name != "pack":
            from arborq.llm.common import stored

            out = stored(out, f"test-{name}")
            assert out.columns == names
            assert 0 < out.select("doc_id").distinct().count() <= before
            assert name == "mix" or out.count() <= before  # mixing takes good documents more than once
    pieces = out.collect()
    assert pieces and all(0 < r["length"] <= 4096 for r in pieces)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Stages by name over odd rows: nulls in every column, repeated rows, clashing extra columns; and the folder of their labels."""
    from pyspark.sql import functions as F

    from tests.llm.helpers import DOCS, odd_texts

    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(None, None, None), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else "s", len(t or "")) for i, t in enumerate(odd_texts() * 2)]
    rows += [(None, None, None, None, None), (None, "a text without id", "en", "s", None), rows[8], rows[8]]
    df = spark.createDataFrame(rows, DOCS)
    clash = "id row digest batch key gone pos mark lang_pred score rate kept n_tokens n_lines n_dropped posterior part text_a sketch own_text copies".split()
    return df, df.withColumns({c: F.lit(f"extra {c}") for c in clash}), sf


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, name):
    plain, clashing, sf = odd
    stage = dict(corpus_pipeline.STAGES)[name]
    for df in (plain, clashing):
        out = stage(spark, df, sf)
        rows = out.collect()
        assert rows
        if name == "pack":
            assert sum(r["length"] for r in rows) == sum(t for _, t in {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]): r["length"] for r in rows}.items())
            continue
        assert out.columns == df.columns
        for r in rows[:3]:
            assert all(r[c] == f"extra {c}" for c in df.columns[5:])
        if name == "line_dedup":
            assert len(rows) == df.count()
        if name == "near_dedup":
            texts = [r["text"] for r in rows]
            assert len([t for t in texts if t == "a text without id"]) == 1 and len(rows) < df.count() // 2 + 2
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"]) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, odd, name):
    plain, _, sf = odd
    assert dict(corpus_pipeline.STAGES)[name](spark, plain.limit(0), sf).count() == 0


def test_each_stage_takes_effect(spark, tmp_path):
    """One language apart, a line of ten documents, a near copy, a toxic document: each goes where it should, and clean documents stay."""
    import random

    from tests.llm.helpers import DOCS, words

    r = random.Random(1)
    clean = [" ".join(words(r, 80, 3000)) for _ in range(60)]
    rows = [(i, t + ("\nA line that ten have." if i < 12 else ""), "en", "s", len(t)) for i, t in enumerate(clean)]
    rows.append((100, clean[20] + " w1", "en", "s", 1))
    rows.append((101, "?! 12 34", "en", "s", 8))
    toxic = {200 + i: " ".join(words(r, 60, 3000) + ["idiot"]) for i in range(12)}
    rows += [(i, t, "en", "s", len(t)) for i, t in toxic.items()]
    labels = [(i, 1, 0) for i in range(60)] + [(i, 1, 1) for i in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from arborq.llm.common import stored

        docs = stored(stage(spark, docs, str(tmp_path)), f"test-{name}")
        kept[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert 101 not in kept["language_id"] and set(range(60)) <= kept["language_id"].keys()
    assert not any("A line that ten have" in t for t in kept["line_dedup"].values()) and kept["line_dedup"].keys() == kept["language_id"].keys()
    assert kept["line_dedup"].keys() - kept["near_dedup"].keys() == {100}
    assert not kept["mix"].keys() & toxic.keys() and len(kept["mix"].keys() & set(range(60))) >= 58


def test_copies_count_as_one_text(spark):
    """Copies of a text, with blank lines between paragraphs or a final newline: the line stage leaves them whole, and one is kept. A line in ten different texts goes, from copies too."""
    from tests.llm.helpers import DOCS

    copy = "A first paragraph of words\n\nand a second one\n \t\nthen the last\nBoilerplate\n"
    rows = [(i, copy if i % 2 else copy.upper(), "en", "s", len(copy)) for i in range(12)] + [(20, "and a second one\n\nits own line\n", "en", "s", 1)]
    rows += [(30 + i, f"Text number {i}\nboilerplate", "en", "s", 1) for i in range(9)] + [(50, " boilerplate", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    out = corpus_pipeline.line_dedup(spark, df.where("doc_id < 38"), "")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert all(got[r[0]] == (r[1], len(r[1])) for r in rows if r[0] < 38)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    less = copy.replace("Boilerplate\n", "")
    assert all(got[i] == (less if i % 2 else less.upper()) for i in range(12))
    assert got[20] == rows[12][1] and got[30] == "Text number 0" and got[50] == ""


@pytest.mark.skipif(not os.path.isdir(SF.replace("0.001", "0.01")), reason="needs the test tables")
def test_mixing_leaves_what_is_not_toxic(spark):
    """On labelled documents of the test tables: toxic ones go, the others stay."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.mix(spark, docs, sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic, clean = {r["doc_id"] for r in labels if r["toxic"]}, {r["doc_id"] for r in labels if not r["toxic"]}
    assert len(clean & kept) >= 0.95 * len(clean) and len(toxic & kept) <= 0.1 * len(toxic)
