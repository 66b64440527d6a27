import duckdb
import pytest
from helpers import DOCS, corpus, frame

import corpus_pipeline
from echosieve.llm.queries import queries
from echosieve.llm.sql import oracle_sql


def tables(spark, top, rows):
    frame(spark, rows, extra=False).coalesce(1).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    item = " ".join(f"b{i}" for i in range(14))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return item


def test_stages_take_effect(spark, tmp_path):
    text = lambda i: " ".join(f"w{(i * 37 + k * k) % 997}" for k in range(60))
    rows = [(i, text(i) + (" you moron" if i % 9 == 0 else ""), "en", "ab"[i % 2], 1) for i in range(300)]
    item = " ".join(f"b{i}" for i in range(14))
    rows += [(1000, text(1), "en", "a", 1), (1001, text(2) + " end", "en", "b", 1), (1002, f"{text(400)} {item} {text(401)}", "en", "a", 1), (1003, None, "en", "a", 0)]
    tables(spark, tmp_path, rows)
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
    ids = {n: {r.doc_id for r in seen[n].select("doc_id").collect()} for n in list(seen)[:-1]}
    assert ids["toxicity"] == {i for i, t, *_ in rows if "moron" not in (t or "")}
    assert ids["toxicity"] - ids["near_duplicates"] == {1000, 1001}
    assert ids["near_duplicates"] - ids["decontamination"] == {1002}
    assert ids["mixing"] <= ids["decontamination"] and 1003 in ids["mixing"]
    assert seen["mixing"].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {x for r in seen["packing"].select("doc_ids").collect() for x in r.doc_ids} == ids["mixing"]


def _stages(spark, docs, top):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(top))
        docs.write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        out.append(docs)
    return out


def test_awkward_rows_in_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and doc_ids, and extra columns with the operators' own names."""
    rows = [r for r in corpus(31, 60) if r[0] is not None]
    item = tables(spark, tmp_path, rows[:1])
    rows += [rows[4]] * 3 + [(None, "lone words here", None, None, None), (None, None, None, None, None), (4, "another text under a known id", "en", "a", 1)]
    rows += [(700, f"x {item} y", "en", "b", 1), (701, "clean " + "z " * 200_000, "en", None, 1), (702, "you moron " * 50, "en", "a", 1)]
    docs = frame(spark, rows)
    *kept, packed = _stages(spark, docs, tmp_path)
    assert all(sorted(k.columns) == sorted(docs.columns) for k in kept)
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert 702 not in ids[0] and ids[0] >= {None, 700, 701}
    near = kept[1].select("doc_id", "text").collect()
    assert {r.text for r in near if r.doc_id is None} == {None, "lone words here"} and "another text under a known id" in {r.text for r in near}
    assert sum(r.doc_id == 4 and r.text == rows[4][1] for r in near) <= 1
    assert 700 not in ids[2] and {None, 701} <= ids[2]
    assert {r.doc_id for r in kept[3].where("trim(coalesce(text, '')) = ''").select("doc_id").collect()} <= ids[2]
    assert {x for r in packed.select("doc_ids").collect() for x in r.doc_ids} == ids[3]


def test_empty_tables_in_every_stage(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [d.count() for d in _stages(spark, spark.createDataFrame([], DOCS), tmp_path)] == [0] * 5
    one = spark.createDataFrame([(1, "a b c", "en", "s", 5)], DOCS)
    (tmp_path / "one").mkdir()
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/one/{name}.parquet")
    assert [d.count() for d in _stages(spark, one, tmp_path / "one")][:3] == [1, 1, 1]


def test_run_is_the_stages(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 31 + k * k) % 499}" for k in range(20)), "en", "a", 1) for i in range(60)]
    tables(spark, tmp_path, rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0 and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    names = [x[0] for x in found.description]
    df = queries()[name](spark, d)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, df.select(*names).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))) == sorted(map(str, __import__("pandas").DataFrame(found.fetchall(), columns=names, dtype=object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))
