"""Queries on codings: correction formats, parity packets, composition, packet files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, values, wire
from ..operators import corrections, framing, masks, media
from ..sources import asp
from ..sources.tables import shared_folder
from . import fixtures as fx
from .queries import RECTS, frame_pairs, longs, query, rects, rgb_rows, voice_frames

RUNS = """runs AS (SELECT frame_id, count_if(v IS DISTINCT FROM before) AS runs, count_if((v - coalesce(before, 0)) & 255 IS DISTINCT FROM (before - coalesce(before2, 0)) & 255) AS deltas
  FROM (SELECT frame_id, v, lag(v) OVER w AS before, lag(v, 2) OVER w AS before2 FROM frames WINDOW w AS (PARTITION BY frame_id ORDER BY y * 64 + x)) GROUP BY 1)"""


@query(f"""WITH {fx.FRAMES}, {RUNS} SELECT frame_id, format, CASE format WHEN 'Raw' THEN 4096 WHEN 'Rle' THEN 3 * runs WHEN 'DeltaRle' THEN 3 * deltas END AS bytes, true AS lossless
  FROM runs, (VALUES ('Raw'), ('Rle'), ('Lz4'), ('Zstd'), ('DeltaRle')) AS t(format)""")
def p26_corrections(spark, d):
    """Frames in every correction format and back: sizes of those that have a definite one, and whether the bytes are the same."""
    f = fx.frame_rows(spark, d).withColumn("format", F.explode(F.array(*[F.lit(n) for n in values.COMPRESSION_FORMATS.values()])))
    back = corrections.decode(corrections.encode(f), into="back")
    sized = F.when(F.col("format").isin("Raw", "Rle", "DeltaRle"), F.length("coded").cast("long"))
    return back.select("frame_id", "format", sized.alias("bytes"), (F.col("back") == F.col("data")).alias("lossless"))


@query(f"""WITH {fx.FRAMES}, masks AS (SELECT frame_id, y * 64 + x AS pos, CASE WHEN v > 127 THEN 1 ELSE 0 END AS v FROM frames),
  m AS (SELECT frame_id, count_if(v IS DISTINCT FROM before) AS runs, count_if((v - coalesce(before, 0)) & 255 IS DISTINCT FROM (before - coalesce(before2, 0)) & 255) AS deltas
  FROM (SELECT frame_id, v, lag(v) OVER w AS before, lag(v, 2) OVER w AS before2 FROM masks WINDOW w AS (PARTITION BY frame_id ORDER BY pos)) GROUP BY 1)
  SELECT frame_id, CASE WHEN 4096 <= least(3 * runs, 3 * deltas) THEN 'Raw' WHEN runs <= deltas THEN 'Rle' ELSE 'DeltaRle' END AS format, least(4096, 3 * runs, 3 * deltas) AS bytes FROM m""")
def p26_smallest_format(spark, d):
    """The format that makes each frame's mask of bright pixels smallest."""
    f = fx.frame_rows(spark, d)
    bright = F.unhex(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.hex("data"), "(..)", "$1 "), "[89A-F]. ", "01"), "[0-7]. ", "00"))
    return corrections.smallest(f.select("frame_id", bright.alias("data")), ["frame_id"]).select("frame_id", "format", F.length("coded").cast("long").alias("bytes"))


def framed(spark, d) -> DataFrame:
    """stream_id, sequence, event_id, packet_type, raw: packets whose payload is their event's id and as many more bytes as it leaves over 7."""
    p = fx.packets(spark, d)
    body = F.concat(F.unhex(F.lpad(F.hex(F.col("event_id").cast("long")), 16, "0")), F.unhex(F.expr("repeat('AB', cast(event_id % 7 as int))")))
    return p.select("stream_id", "sequence", "event_id", "packet_type", framing.seal_crc(F.concat(framing.header(F.col("packet_type"), F.col("sequence"), F.length(body)), body)).alias("raw"))


GROUPED = fx.PACKETS + """, g AS (SELECT *, (sequence - 1) // 8 AS part, event_id % 7 = 0 AS gone FROM packets), l AS (SELECT stream_id, part, count_if(gone) AS lost, count_if(event_id % 5 = 0) AS cut FROM g GROUP BY 1, 2)"""


@query(f"""WITH {GROUPED} SELECT g.stream_id, sequence, CASE WHEN NOT gone THEN 'received' WHEN lost <= CASE WHEN cut > 2 THEN 2 ELSE 3 END THEN 'restored' ELSE 'lost' END AS status,
  CASE WHEN NOT gone OR lost <= CASE WHEN cut > 2 THEN 2 ELSE 3 END THEN event_id END AS event_id FROM g JOIN l USING (stream_id, part)""")
def s27_parity(spark, d):
    """Packets with three parity packets for eight; one in seven is lost, and the second parity packet of groups in which more than two ids end in 0 or 5."""
    p = framed(spark, d)
    codes = corrections.parity(p, 8, 3)
    cut = p.groupBy("stream_id", F.expr("(sequence - 1) div 8").alias("part")).agg(F.count_if(F.col("event_id") % 5 == 0).alias("cut"))
    left = codes.join(cut, ["stream_id", "part"]).where("not (cut > 2 and number = 1)").drop("cut")
    out = corrections.restore(p.where("event_id % 7 <> 0"), left, 8, 3)
    return out.select("stream_id", "sequence", "status", F.conv(F.hex(F.substring("raw", 17, 8)), 16, 10).cast("long").alias("event_id"))


@query(f"""WITH {fx.FRAMES}, p AS (SELECT c.frame_id, c.x, c.y, CASE WHEN c.v & 1 = 1 AND c.x >= c.frame_id % 20 AND c.x < c.frame_id % 20 + 30 AND c.y >= c.frame_id % 17 AND c.y < c.frame_id % 17 + 40 THEN c.v ELSE b.v END AS v
  FROM frames c JOIN frames b ON b.frame_id = c.frame_id - 1 AND b.x = c.x AND b.y = c.y)
  SELECT frame_id, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 64 + x)) AS BIGINT) AS placed FROM p GROUP BY 1""")
def m12_composite(spark, d):
    """A box of each frame over the frame before, where the frame's mask is set."""
    f = fx.frame_rows(spark, d)
    rle = masks.encode(masks.runs(fx.masks(spark, d)))
    x, y = F.col("frame_id") % 20, F.col("frame_id") % 17
    region = corrections.crop(F.col("data"), F.col("width"), x, y, F.lit(30), F.lit(40))
    over = f.select("frame_id", "width", "height", F.array(x, y, F.lit(30).cast("long"), F.lit(40).cast("long")).alias("bbox"), region.alias("region"))
    under = f.select((F.col("frame_id") + 1).alias("frame_id"), F.col("data").alias("background"))
    made = corrections.compose(over.join(under, "frame_id").join(rle, "frame_id"))
    v = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda k: F.conv(F.hex(F.substring("composed", k + 1, F.lit(1))), 16, 10).cast("long"))
    sums = F.aggregate(F.transform(v, lambda x, k: F.struct(x.alias("t"), (x * k).alias("p"))), F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("p")), lambda a, b: F.struct((a["t"] + b["t"]).alias("t"), (a["p"] + b["p"]).alias("p")))
    return made.select("frame_id", sums.alias("s")).select("frame_id", F.col("s.t").alias("total"), F.col("s.p").alias("placed"))


@query(f"WITH {fx.PACKETS} SELECT event_id, sequence, packet_type, 8 + event_id % 7 AS payload_len, 'ok' AS status FROM packets WHERE packet_type IN (1, 3) AND sequence > 4")
def s26_packet_files(spark, d):
    """Packets written to packet files and read back in splits of 64 kB, with filters on headers pushed to the reader."""
    asp.register(spark)
    folder = shared_folder(spark, "packets")
    framed(spark, d).select("raw").write.format("packets").mode("append").save(folder)
    back = spark.read.format("packets").option("splitBytes", 1 << 16).load(folder).where("packet_type in (1, 3) and sequence > 4")
    return longs(back.select(F.conv(F.hex(F.substring("raw", 17, 8)), 16, 10).cast("long").alias("event_id"), "sequence", "packet_type", "payload_len", "status"))


# --- video: the transform, quantiser and symbols in SQL ----------------------------------------------------------------


def _lift_sql(source: str, made: str, axis: str, inverse: bool) -> str:
    """CTEs of one pass of the 5/3 lifting along x or y, within the first rw by rh values of each plane."""
    size, at, cross = ("rw", "x", "y") if axis == "x" else ("rh", "y", "x")
    inside = "(x < rw AND y < rh)"
    over = f"OVER (PARTITION BY frame_id, ch, {cross}, {inside} ORDER BY {at})"
    odd = "floor(-0.5 * (lag({v}) {o} + coalesce(lead({v}) {o}, lag({v}) {o})) + 0.5)"
    even = "floor(0.25 * (coalesce(lag({v}) {o}, lead({v}) {o}) + coalesce(lead({v}) {o}, lag({v}) {o})) + 0.5)"
    keep = "frame_id, ch, w, h, rw, rh"
    if not inverse:
        first = f"{made}_d AS (SELECT {keep}, x, y, CASE WHEN {inside} AND {at} % 2 = 1 THEN v + {odd.format(v='v', o=over)} ELSE v END AS v FROM {source})"
        moved = f"CASE WHEN NOT {inside} THEN {at} WHEN {at} % 2 = 0 THEN {at} // 2 ELSE ({size} + 1) // 2 + {at} // 2 END AS {at}"
        return f"{first}, {made} AS (SELECT {keep}, {cross}, {moved}, CASE WHEN {inside} AND {at} % 2 = 0 THEN v + {even.format(v='v', o=over)} ELSE v END AS v FROM {made}_d)"
    moved = f"CASE WHEN NOT {inside} THEN {at} WHEN {at} < ({size} + 1) // 2 THEN 2 * {at} ELSE 2 * ({at} - ({size} + 1) // 2) + 1 END AS {at}"
    put = f"{made}_p AS (SELECT {keep}, {cross}, {moved}, v FROM {source})"
    first = f"{made}_e AS (SELECT {keep}, x, y, CASE WHEN {inside} AND {at} % 2 = 0 THEN v - {even.format(v='v', o=over)} ELSE v END AS v FROM {made}_p)"
    return f"{put}, {first}, {made} AS (SELECT {keep}, x, y, CASE WHEN {inside} AND {at} % 2 = 1 THEN v - {odd.format(v='v', o=over)} ELSE v END AS v FROM {made}_e)"


def _half(level: int, size: str) -> str:
    return size if level == 0 else f"(({_half(level - 1, size)}) + 1) // 2"


def _sized(source: str, made: str, level: int) -> str:
    return f"{made} AS (SELECT frame_id, ch, w, h, {_half(level, 'w')} AS rw, {_half(level, 'h')} AS rh, x, y, v FROM {source})"


STEP, LEVELS = 8, 3
VIDEO = fx.RGB + """, pixels AS (SELECT frame_id, i % 21 AS x, i // 21 AS y, r - b AS co, CAST(b + floor((r - b) / 2.0) AS BIGINT) AS t, g FROM rgb),
planes AS (SELECT frame_id, x, y, unnest([0, 1, 2]) AS ch, unnest([t + CAST(floor((g - t) / 2.0) AS BIGINT), co, g - t]) AS v FROM pixels),
f0 AS (SELECT *, 21 AS w, max(y) OVER (PARTITION BY frame_id) + 1 AS h FROM planes)"""
for _k in range(LEVELS):
    VIDEO += f", {_sized(f'f{_k}', f'f{_k}s', _k)}, {_lift_sql(f'f{_k}s', f'f{_k}y', 'y', False)}, {_lift_sql(f'f{_k}y', f'f{_k + 1}', 'x', False)}"
VIDEO += f""", quantized AS (SELECT frame_id, ch, w, h, x, y, CAST(sign(v) * (abs(v) // {STEP}) AS BIGINT) AS q FROM (SELECT * REPLACE (CAST(v AS BIGINT) AS v) FROM f{LEVELS})),
ranged AS (SELECT *, min(q) OVER p AS low, max(q) OVER p AS high FROM quantized WINDOW p AS (PARTITION BY frame_id, ch)),
symbols AS MATERIALIZED (SELECT frame_id, ch, w, h, x, y, low, high, CASE WHEN high - low <= 255 THEN q - low ELSE least(255, CAST(trunc(CAST(q - low AS REAL) * (CAST(255 AS REAL) / CAST(high - low AS REAL))) AS BIGINT)) END AS symbol FROM ranged)"""
DECODED = f""", g{LEVELS} AS (SELECT frame_id, ch, w, h, x, y, {STEP} * (low + CASE WHEN high - low <= 255 THEN symbol
  ELSE CAST(trunc(CAST(symbol AS REAL) * (CAST(1 AS REAL) / (CAST(255 AS REAL) / CAST(high - low AS REAL))) + CAST(0.5 AS REAL)) AS BIGINT) END) AS v FROM symbols)"""
for _k in reversed(range(LEVELS)):
    DECODED += f", {_sized(f'g{_k + 1}', f'g{_k}s', _k)}, {_lift_sql(f'g{_k}s', f'g{_k}x', 'x', True)}, {_lift_sql(f'g{_k}x', f'g{_k}', 'y', True)}"
DECODED += """, back AS (SELECT frame_id, y * 21 + x AS i, CAST(max(CASE WHEN ch = 0 THEN v END) AS BIGINT) AS l, CAST(max(CASE WHEN ch = 1 THEN v END) AS BIGINT) AS co, CAST(max(CASE WHEN ch = 2 THEN v END) AS BIGINT) AS cg FROM g0 GROUP BY ALL),
mixed AS (SELECT *, l - CAST(floor(cg / 2.0) AS BIGINT) AS t FROM back), seen AS (SELECT *, t - CAST(floor(co / 2.0) AS BIGINT) AS b FROM mixed),
bytes AS (SELECT frame_id, i, greatest(0, least(255, b + co)) AS r, greatest(0, least(255, cg + t)) AS g, greatest(0, least(255, b)) AS b FROM seen)"""


@query(f"WITH {VIDEO} SELECT frame_id, ch AS channel, symbol, count(*) AS n FROM symbols GROUP BY ALL")
def v1_v4_symbols(spark, d):
    """The histogram of every channel, read from coded frames by expressions: what colour transform, wavelet, quantiser and symbols make of the pixels."""
    coded = media.encode_video(rgb_rows(spark, d), 50)
    each = coded.select("frame_id", "coded", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("channel"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: scalar.uint_le(F.substring("coded", 49 + F.col("channel") * 1028 + 4 * k, F.lit(4)), 0, 4))
    return longs(each.select("frame_id", "channel", F.posexplode(counts).alias("symbol", "n")).where("n > 0"))


@query(f"WITH {VIDEO}{DECODED} SELECT frame_id, 21 AS width, count(*) // 21 AS height, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum((3 * i) * r + (3 * i + 1) * g + (3 * i + 2) * b) AS BIGINT) AS placed FROM bytes GROUP BY 1")
def v2_v4_decoded(spark, d):
    """Coded frames decoded again: sums of the colours and of all bytes times their places."""
    back = media.decode_video(media.encode_video(rgb_rows(spark, d), 50))
    v = F.transform(F.sequence(F.lit(0), F.length("rgb") - 1), lambda k: F.conv(F.hex(F.substring("rgb", k + 1, F.lit(1))), 16, 10).cast("long"))
    back = back.withColumn("v", v)
    total = lambda c: F.aggregate(F.filter("v", lambda x, k: k % 3 == c), F.lit(0).cast("long"), lambda s, x: s + x)
    placed = F.aggregate(F.transform("v", lambda x, k: x * k), F.lit(0).cast("long"), lambda s, x: s + x)
    return longs(back.select("frame_id", "width", "height", *[total(k).alias(c) for k, c in enumerate("rgb")], placed.alias("placed")))


@query("""WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS sequence, embedding FROM embeddings),
s AS (SELECT label, sequence, k, sum(CAST(embedding[i + 1] AS DOUBLE) * cos((2 * i + 1) * k * pi() / 128)) * sqrt(1 / 32.0) * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END AS c FROM v CROSS JOIN range(0, 64) a(i) CROSS JOIN range(0, 64) b(k) GROUP BY label, sequence, k)
SELECT CAST(label AS BIGINT) AS stream_id, sequence, count(*) AS coefficients, CAST(sum(k) AS BIGINT) AS places, round(sum(abs(c)), 2) AS magnitude
FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label, sequence ORDER BY abs(c) DESC, k) <= 16) GROUP BY 1, 2""")
def v6_coefficients(spark, d):
    """The sixteen largest coefficients of each spectral frame, read from its bytes: how many, the sum of their places and of their magnitudes."""
    raw = media.encode_voice(voice_frames(spark, d), layer=1)
    read = F.udf(lambda x: [(int(i), float(v)) for p in wire.unpack_spectral(wire.read_audio_frame(x)["payload"]) for i, v in p["coefficients"]], "array<struct<k: int, c: double>>")
    one = raw.select("stream_id", "sequence", F.explode(read("raw")).alias("p"))
    return longs(one.groupBy("stream_id", "sequence").agg(F.count("*").alias("coefficients"), F.sum("p.k").alias("places"), F.round(F.sum(F.abs("p.c")), 2).alias("magnitude")))


def _near(source: str, made: str) -> str:
    return f"{made} AS (SELECT DISTINCT cur_id, x + i AS x, y + j AS y FROM {source} CROSS JOIN range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(j) WHERE x + i BETWEEN 0 AND 63 AND y + j BETWEEN 0 AND 63)"


@query(f"""WITH {fx.FRAMES}, moved AS (SELECT c.frame_id AS cur_id, c.x, c.y FROM frames c JOIN frames p ON p.frame_id = c.frame_id - 1 AND p.x = c.x AND p.y = c.y WHERE abs(c.v - p.v) > 25),
  {_near('moved', 'once')}, {_near('once', 'twice')}, kept AS (SELECT a.cur_id, a.x, a.y FROM twice a JOIN twice b ON a.cur_id = b.cur_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1
    GROUP BY ALL HAVING count(*) = (1 + CAST(a.x > 0 AS INT) + CAST(a.x < 63 AS INT)) * (1 + CAST(a.y > 0 AS INT) + CAST(a.y < 63 AS INT))),
  boxes AS (SELECT cur_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n FROM kept GROUP BY 1 HAVING count(*) >= 100)
  SELECT f.cur_id, coalesce(b.x, 0) AS x, coalesce(b.y, 0) AS y, coalesce(w, 0) AS w, coalesce(h, 0) AS h, coalesce(n, 0) AS foreground, n IS NOT NULL AS coded
  FROM (SELECT DISTINCT frame_id AS cur_id FROM frames WHERE frame_id > 0) f LEFT JOIN boxes b USING (cur_id)""")
def v3_regions(spark, d):
    """The box of what moved in each frame: differences above 25, dilated twice, eroded once, of 100 pixels or more."""
    made = media.person_regions(frame_pairs(spark, d))
    return longs(made.select("cur_id", *[F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")], "foreground", F.col("coded").isNotNull().alias("coded")))


@query("""WITH s AS (SELECT label, vec_id, avg(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS power FROM (SELECT label, vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2)
SELECT CAST(label AS BIGINT) AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS sequence, round(10 * log10(power + 1e-10), 2) AS energy_db, 10 * log10(power + 1e-10) > -50 AS active FROM s""")
def v5_energy(spark, d):
    """Energy and activity of parametric frames, read from their bytes."""
    raw = media.encode_voice(voice_frames(spark, d), layer=0)
    read = F.udf(lambda x: (lambda p: (float(p["energy_db"]), bool(p["active"])))(wire.unpack_parametric(wire.read_audio_frame(x)["payload"])[0]), "struct<energy_db: double, active: boolean>")
    return raw.select("stream_id", "sequence", read("raw").alias("p")).select("stream_id", "sequence", F.round("p.energy_db", 2).alias("energy_db"), "p.active")


def _le_sql(c: str) -> str:
    return " || ".join(f"format('{{:02X}}', ({c}) >> {8 * k} & 255)" for k in range(4))


@query(f"""WITH {RECTS} SELECT stream_id, sequence, {_le_sql('x')} || {_le_sql('y')} || {_le_sql('w')} || {_le_sql('h')} AS rect_hex, format('{{:02X}}{{:02X}}{{:02X}}', x & 255, y & 255, w & 255) AS color_hex, w AS width, h AS height, y & 255 AS g FROM rects""")
def s19_structs(spark, d):
    """Rectangles and colours as their wire structs, and read back."""
    r = F.col("r")
    color = F.struct(*[(r[c] % 256).alias(n) for n, c in zip("rgb", ("x", "y", "width"))])
    made = rects(spark, d).select("stream_id", "sequence", scalar.rect_bytes(r).alias("rect"), scalar.color_bytes(color).alias("color"))
    return longs(made.select("stream_id", "sequence", F.hex("rect").alias("rect_hex"), F.hex("color").alias("color_hex"), scalar.bytes_rect(F.col("rect"))["width"].alias("width"), scalar.bytes_rect(F.col("rect"))["height"].alias("height"), scalar.bytes_color(F.col("color"))["g"].alias("g")))
