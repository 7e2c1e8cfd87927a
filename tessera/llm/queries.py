"""Queries opN_<name> over the whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, collocate, langid, linededup, media, mixing, packing, pieces, quality, runs, simhash, suffix, warc
from .common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.analyse(media.store(table(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(warc.read(spark, warc.write(table(spark, sf_dir, "pages")))).drop("digest_ok")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.remainder(F.col("doc_id")) == 2, F.lit(False))
    langs, model = langid.fit(docs.where(~held_out))
    made = langid.predict(docs, langs, model, keep=["doc_id"])
    return made.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.components(table(spark, sf_dir, "documents"))
    return made.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks = packing.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)
    return packing.read_ids(blocks)


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return made.select("doc_id", "n_lines", "n_removed", F.octet_length(text).cast("long").alias("kept_bytes"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents"))).drop("rid")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.made_periodic(table(spark, sf_dir, "documents"))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocate.collocations(table(spark, sf_dir, "documents"))


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bytebpe.digests(bytebpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
h AS (SELECT d, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON p.d = h.d
"""


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k AS words, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS ks(k))),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f FROM f WHERE words > 1 AND f >= 30),
i AS (SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, max(f) AS most
      FROM (SELECT lang, w, f, k, unnest(generate_series(1, words - k + 1)) AS i FROM c, (VALUES (2), (3)) AS ks(k) WHERE k < words) GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN i ON c.lang = i.lang AND c.phrase = i.phrase WHERE most IS NULL OR 100 * most::HUGEINT < 80 * f::HUGEINT),
t AS (SELECT lang, phrase, f, w, unnest(generate_series(1, words - 1)) AS k FROM d),
s AS (SELECT t.lang, t.phrase, t.f AS a, k, l.f AS l, r.f AS r, (2000000 * t.f::HUGEINT) // (l.f + r.f) AS score
      FROM t JOIN f l ON l.lang = t.lang AND l.phrase = array_to_string(list_slice(w, 1, k), ' ') JOIN f r ON r.lang = t.lang AND r.phrase = array_to_string(list_slice(w, k + 1, len(w)), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b JOIN n ON b.lang = n.lang QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op12_collocations": OP12_SQL}
