"""Whole queries on the small tables, the pipeline's stages, and the guard around the subpackage."""

import corpus_pipeline
from tessera.llm.queries import oracle_sql, queries

from ..compare import connect, rows


def test_sql(spark, data):
    con = connect(data)
    for name, sql in oracle_sql().items():
        assert rows(queries()[name](spark, data).toPandas()) == rows(con.execute(sql).fetchdf())


def test_registered():
    names = list(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_pipeline(spark, data, docs, empty, tmp_path):
    for source in (spark.read.parquet(f"{data}/documents.parquet"), docs.drop("h1", "runs"), empty.drop("h1", "runs")):
        at, n = source, []
        for name, stage in corpus_pipeline.STAGES:
            out = str(tmp_path / f"{id(source)}-{len(n)}")
            stage(spark, at, data).write.parquet(out)
            at = spark.read.parquet(out)
            n.append(at.count())
            if name != corpus_pipeline.STAGES[-1][0]:
                assert at.columns == corpus_pipeline.COLUMNS
        assert n[0] >= n[1] >= n[2] and n[3] == n[4]
        assert at.where("not round_trip").count() <= 2  # a text with the word mark itself, as often as the mix takes it
