"""Every query against its SQL; those without SQL give rows and a stable schema."""

import pytest

from tessera.plans.queries import QUERIES, SQL

from .compare import connect, rows


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    got = QUERIES[name](spark, data).toPandas()
    want = con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0
    assert df.schema == QUERIES[name](spark, data).schema


def test_media_come_back(spark, data):
    """What is decoded is close to what was coded: frames at the finest step, spectral voice but for its dropped coefficients."""
    video = QUERIES["v1_v2_video_round_trip"](spark, data).collect()
    assert all(r["bytes"] == 3 * r["width"] * r["height"] and len(r["decoded_sha256"]) == 64 and r["error"] < 3 for r in video)
    boxes = QUERIES["v3_person_regions"](spark, data).collect()
    assert any(r["bytes"] for r in boxes) and all((r["width"], r["height"]) == tuple(r["bbox"][2:]) for r in boxes if r["bytes"])
    spectral, parametric = (QUERIES[n](spark, data).collect() for n in ("v6_voice_spectral", "v5_voice_parametric"))
    assert all(r["samples"] == 64 for r in spectral + parametric) and sum(r["error"] for r in spectral) < sum(r["error"] for r in parametric)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
