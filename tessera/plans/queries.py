"""One query per operator over the derived relations, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions import records, scalar, values
from ..operators import blocks, bridges, framing, masks, media, palette, stream, transform
from ..sources import tables
from ..sources.tables import scan
from . import fixtures as fx

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
R = 4  # digits of floating results


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    """Integers as long, so that types don't depend on an expression's width."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def enum_sql(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + " END"


# --- sources, headers, framing -----------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def s25_table_scan(spark, d):
    return scan(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name", "n_regionkey")


HEADER_SQL = "'41535031' || '01' || lpad(CAST(packet_type AS VARCHAR), 2, '0') || '0000' || format('{:08X}', sequence) || format('{:08X}', payload_len)"


@query(f"WITH {fx.PACKETS} SELECT stream_id, sequence, {HEADER_SQL} AS header_hex FROM packets")
def s1_header_encode(spark, d):
    return fx.packets(spark, d).select("stream_id", "sequence", F.hex(framing.header(F.col("packet_type"), F.col("sequence"), F.col("payload_len"))).alias("header_hex"))


@query(f"""WITH {fx.PACKETS} SELECT stream_id, sequence AS sent, CASE sequence % 5 WHEN 1 THEN 'incomplete' WHEN 2 THEN 'magic' WHEN 3 THEN 'type' ELSE 'ok' END AS status,
  CASE WHEN sequence % 5 IN (0, 4) THEN sequence END AS sequence, CASE WHEN sequence % 5 IN (0, 4) THEN packet_type END AS packet_type, CASE WHEN sequence % 5 IN (0, 4) THEN payload_len END AS payload_len FROM packets""")
def s3_header_decode(spark, d):
    p = fx.packets(spark, d)
    h = framing.header(F.col("packet_type"), F.col("sequence"), F.col("payload_len"))
    bad = F.when(F.col("sequence") % 5 == 1, F.substring(h, 1, 10)).when(F.col("sequence") % 5 == 2, F.concat(F.unhex(F.lit("00")), F.substring(h, 2, 15))).when(F.col("sequence") % 5 == 3, F.concat(F.substring(h, 1, 5), F.unhex(F.lit("09")), F.substring(h, 7, 10))).otherwise(h)
    out = p.select("stream_id", F.col("sequence").alias("sent"), framing.decode_header(bad).alias("h"))
    return out.select("stream_id", "sent", "h.status", "h.sequence", "h.packet_type", "h.payload_len")


@query("SELECT event_id, event_id % 8 & 1 <> 0 AS compressed, event_id % 8 & 2 <> 0 AS encrypted, event_id % 8 & 4 <> 0 AS fec, (event_id % 8 | 4) AS with_fec, (event_id % 8) & 65534 AS without_compressed FROM events")
def s4_flags(spark, d):
    f = F.col("event_id") % 8
    return scan(spark, d, "events").select("event_id", *[scalar.flag(f, n).alias(n) for n in values.FLAGS], scalar.set_flag(f, "fec", F.lit(True)).alias("with_fec"), scalar.set_flag(f, "compressed", F.lit(False)).alias("without_compressed"))


@query(f"WITH {fx.PACKETS} SELECT stream_id, sequence, payload_len + 16 AS total_size FROM packets")
def s5_total_size(spark, d):
    return fx.packets(spark, d).select("stream_id", "sequence", framing.total_size(F.col("payload_len")).alias("total_size"))


CRC32 = """steps AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
sealed AS (SELECT stream_id, sequence, h || format('{:08X}', xor(list_reduce(list_transform(range(16), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)) AS raw_hex FROM headers, steps)"""


@query(f"WITH {fx.PACKETS}, headers AS (SELECT stream_id, sequence, {HEADER_SQL} AS h FROM packets), {CRC32} SELECT stream_id, sequence, raw_hex, true AS crc_ok FROM sealed")
def s6_crc32(spark, d):
    h = framing.seal_crc(framing.header(F.col("packet_type"), F.col("sequence"), F.col("payload_len")))
    return fx.packets(spark, d).select("stream_id", "sequence", F.hex(h).alias("raw_hex"), framing.crc_ok(h).alias("crc_ok"))


@query(f"""WITH {fx.PACKETS} SELECT stream_id, sequence, CASE packet_type WHEN 1 THEN 64 + 128 * (payload_len % 7) WHEN 2 THEN 32 + 12 * (payload_len % 50) + 64 * (sequence % 3)
  WHEN 3 THEN 32 + (payload_len + 32) + (sequence + 32) ELSE 64 END AS payload_estimate FROM packets""")
def s7_packet_sizes(spark, d):
    n, q = F.col("payload_len"), F.col("sequence")
    est = F.when(F.col("packet_type") == 1, framing.estimate_i(n % 7)).when(F.col("packet_type") == 2, framing.estimate_d(n % 50, q % 3)).when(F.col("packet_type") == 3, framing.estimate_c(F.array(n, q))).otherwise(framing.estimate_s())
    return fx.packets(spark, d).select("stream_id", "sequence", est.alias("payload_estimate"))


@query(f"WITH {fx.PACKETS} SELECT packet_type, sum(payload_len + 36 - 16) AS bytes FROM packets GROUP BY 1")
def s8_estimated_size(spark, d):
    return fx.packets(spark, d).groupBy("packet_type").agg(F.sum(framing.estimated_size(F.col("payload_len"))).alias("bytes"))


def built_packets(spark, d, *more: str) -> DataFrame:
    """Packets of every kind with a payload each."""
    mv = F.array(F.struct(*[F.col(c).cast("int").alias(c) for c in ("block_x", "block_y", "dx", "dy")], F.col("sad").cast("long").alias("sad")))
    p = fx.motion_vectors(spark, d, "packet_type", "timestamp_ms").withColumn("mv", mv)
    kind = scalar.enum_name(F.col("packet_type"), values.PACKET_TYPES)
    fields = F.struct(
        F.when(kind == "I", 640).cast("long").alias("width"), F.when(kind == "I", 480).cast("long").alias("height"), F.when(kind == "I", 30.0).cast("float").alias("fps"), F.when(kind == "I", (F.col("sequence") % 4).cast("int")).alias("quality"),
        F.col("timestamp_ms"), F.when(kind == "D", F.col("sequence") - 1).alias("ref_sequence"), F.when(kind == "D", F.col("mv")).alias("vectors"),
        F.lit(None).cast("array<struct<dx: int, dy: int>>").alias("compact"), F.when(kind == "S", (F.col("sequence") % 8 + 1).cast("int")).alias("command"),
    )
    return p.select("stream_id", F.col("sequence").alias("sent"), kind.alias("kind"), F.col("sequence"), fields.cast(framing.PAYLOAD).alias("payload"), *more)


ROUND_TRIP_SQL = f"""WITH {fx.VECTORS} SELECT p.stream_id, p.sequence AS sent, 'ok' AS status, {enum_sql('packet_type', values.PACKET_TYPES)} AS kind, p.sequence,
  CASE WHEN packet_type <> 3 THEN timestamp_ms END AS timestamp_ms, CASE WHEN packet_type = 2 THEN p.sequence - 1 END AS ref_sequence, CASE WHEN packet_type = 2 THEN dx END AS dx,
  CASE WHEN packet_type = 1 THEN 1 END AS quality, CASE WHEN packet_type = 4 THEN CASE WHEN p.sequence % 8 = 7 THEN 8 ELSE 7 END END AS command FROM packets p JOIN mv USING (event_id)"""


def _decoded(df: DataFrame) -> DataFrame:
    c = F.col("payload")
    return framing.decode_packets(df).select("stream_id", "sent", "status", "kind", "sequence", c["timestamp_ms"].alias("timestamp_ms"), c["ref_sequence"].alias("ref_sequence"), F.try_element_at(c["vectors"], F.lit(1))["dx"].cast("long").alias("dx"), c["quality"].cast("long").alias("quality"), c["command"].cast("long").alias("command"))


@query(ROUND_TRIP_SQL)
def s9_s10_packet_round_trip(spark, d):
    return _decoded(framing.encode_packets(built_packets(spark, d)))


@query(f"""WITH {fx.PACKETS} SELECT stream_id, sequence AS sent, CASE sequence % 3 WHEN 1 THEN 'checksum' WHEN 2 THEN 'incomplete' ELSE 'ok' END AS status FROM packets""")
def s10_packet_errors(spark, d):
    raw = framing.encode_packets(built_packets(spark, d))
    broken = F.when(F.col("sequence") % 3 == 1, F.concat(F.substring(F.col("raw"), 1, 20), F.unhex(F.when(F.hex(F.substring("raw", 21, 1)) == "FF", "00").otherwise("FF")), F.expr("substring(raw, 22)"))).when(F.col("sequence") % 3 == 2, F.substring("raw", 1, 19)).otherwise(F.col("raw"))
    return framing.decode_packets(raw.withColumn("raw", broken)).select("stream_id", "sent", "status")


@query(f"""WITH {fx.PACKETS} SELECT stream_id, sequence, packet_type = 1 AS is_keyframe, CASE WHEN packet_type = 1 THEN 640 END AS i_width, CASE WHEN packet_type = 2 THEN sequence - 1 END AS d_ref FROM packets""")
def s11_accessors(spark, d):
    a = framing.accessors(built_packets(spark, d))
    return a.select("stream_id", "sequence", "is_keyframe", F.col("as_i.width").alias("i_width"), F.col("as_d.ref_sequence").alias("d_ref"))


@query(f"WITH {fx.PACKETS} SELECT stream_id, sequence AS sent, sequence % 4 AS quality FROM packets WHERE packet_type = 1")
def s12_encoder_quality(spark, d):
    return _decoded(framing.encode_packets(built_packets(spark, d).where("kind = 'I'"), keep_quality=True)).select("stream_id", "sent", "quality")


@query(f"WITH {fx.VECTORS} SELECT stream_id, sequence, packet_type, CASE WHEN packet_type = 2 THEN dx END AS dx, CASE WHEN packet_type = 1 THEN sequence % 4 END AS quality FROM packets JOIN mv USING (stream_id, sequence, event_id)")
def s13_full_fidelity(spark, d):
    """Packets of every kind written with all their fields and read back."""
    b = tables.stored(built_packets(spark, d, "packet_type").select("stream_id", "sequence", "kind", "packet_type", "payload"), "packets-full")
    return b.select("stream_id", "sequence", "packet_type", F.try_element_at("payload.vectors", F.lit(1))["dx"].cast("long").alias("dx"), F.col("payload.quality").cast("long").alias("quality"))


@query(f"""WITH {fx.VECTORS} SELECT stream_id, count(*) AS vectors, sum(dx) AS dx, sum(dy) AS dy, sum(sad) AS sad FROM mv GROUP BY 1""")
def s14_delta_builder(spark, d):
    """All vectors of a stream in delta packets of at most 4096, written and read back."""
    v = bridges.packets_of_vectors(fx.motion_vectors(spark, d), "stream_id", F.col("sequence"), "event_id", 4096)
    payload = records.wire_payload(ref_sequence=F.col("ref_sequence"), vectors=F.col("vectors"), timestamp_ms=F.lit(7))
    raw = framing.encode_packets(v.select("stream_id", F.lit("D").alias("kind"), "sequence", payload.alias("payload")))
    x = framing.decode_packets(raw).select("stream_id", F.explode("payload.vectors").alias("v"))
    return x.groupBy("stream_id").agg(F.count("*").alias("vectors"), *[F.sum(F.col(f"v.{c}").cast("long")).alias(c) for c in ("dx", "dy", "sad")])


def compact_packets(spark, d) -> DataFrame:
    """Delta packets for each stream, one for each 4096 sequences, with full and compact vectors (those that fit in bytes)."""
    v = fx.motion_vectors(spark, d).withColumn("c", scalar.to_compact(F.expr("dx div 2"), F.col("dy")))
    own = v.groupBy("stream_id", F.expr("sequence div 4096")).agg(F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("sequence", F.col("c.dx").cast("int").alias("dx"), F.col("c.dy").cast("int").alias("dy"))))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("sequence") % 2 == 1, F.struct("sequence", *[F.col(x).cast("int").alias(x) for x in ("block_x", "block_y", "dx", "dy")], "sad")))).alias("v"))
    compact, full = F.transform("c", lambda x: x.dropFields("sequence")), F.transform("v", lambda x: x.dropFields("sequence"))
    return own.select("stream_id", F.lit("D").alias("kind"), F.lit(9).cast("long").alias("sequence"), records.wire_payload(ref_sequence=F.lit(8), vectors=full, compact=compact, timestamp_ms=F.col("stream_id")).alias("payload"))


@query(f"""WITH {fx.VECTORS}, c AS (SELECT stream_id, CAST(trunc(dx / 2) AS BIGINT) AS cx, dy AS cy FROM mv WHERE trunc(dx / 2) BETWEEN -128 AND 127 AND dy BETWEEN -128 AND 127)
  SELECT stream_id, stream_id AS timestamp_ms, 8 AS ref_sequence, (SELECT count(*) FROM mv m WHERE m.stream_id = s.stream_id AND sequence % 2 = 1) AS vectors, count(*) AS compact, CAST(sum(cx) AS BIGINT) AS cx, CAST(sum(cy) AS BIGINT) AS cy FROM c s GROUP BY 1""")
def s14_compact_vectors(spark, d):
    """Compact vectors beside full ones, written and read back."""
    p = F.col("payload")
    out = framing.decode_packets(framing.encode_packets(compact_packets(spark, d))).where("status = 'ok'")
    total = lambda c: F.aggregate(p["compact"], F.lit(0).cast("long"), lambda s, x: s + x[c])
    own = out.select("stream_id", p["timestamp_ms"].alias("timestamp_ms"), p["ref_sequence"].alias("ref_sequence"), F.size(p["vectors"]).alias("vectors"), F.size(p["compact"]).alias("compact"), total("dx").alias("cx"), total("dy").alias("cy"))
    return longs(own.groupBy("stream_id", "timestamp_ms", "ref_sequence").agg(*[F.sum(c).alias(c) for c in ("vectors", "compact", "cx", "cy")]).where("compact > 0"))


@query(f"""WITH {fx.VECTORS}, n AS (SELECT stream_id, 100 + (12 * count(*) + 7) // 8 * 8 AS need FROM mv GROUP BY 1)
  SELECT stream_id, CASE WHEN need <= 1000 THEN 'ok' ELSE 'buffer too small: need ' || need || ', got 1000' END AS status FROM n""")
def s14_buffer_sizes(spark, d):
    """Whether a stream's vectors in one packet fit a buffer of 1000 bytes."""
    v = bridges.packets_of_vectors(fx.motion_vectors(spark, d), "stream_id", F.col("sequence"), "event_id")
    raw = framing.encode_packets(v.select("stream_id", F.lit("D").alias("kind"), "sequence", records.wire_payload(ref_sequence=F.col("ref_sequence"), vectors=F.col("vectors"), timestamp_ms=F.lit(7)).alias("payload")))
    return raw.select("stream_id", framing.fits(F.col("raw"), F.lit(1000)).alias("status"))


READ_SQL = """CASE WHEN sequence % 5 = 1 THEN 'incomplete' WHEN sequence % 5 = 2 THEN 'malformed' WHEN packet_type = 2 THEN 'ok' ELSE 'payload type' END"""


@query(f"WITH {fx.PACKETS} SELECT stream_id, sequence, {READ_SQL} AS status, CASE WHEN {READ_SQL} = 'ok' THEN 'D' END AS kind, CASE WHEN {READ_SQL} = 'ok' THEN sequence - 1 END AS ref_sequence FROM packets")
def s16_read_deltas(spark, d):
    """Payload tables read as deltas: other kinds, cut and damaged tables are told apart."""
    raw = framing.encode_packets(built_packets(spark, d)).withColumn("body", F.expr("substring(raw, 17, length(raw) - 20)"))
    body = F.when(F.col("sequence") % 5 == 1, F.substring("body", 1, 7)).when(F.col("sequence") % 5 == 2, F.concat(F.unhex(F.lit("FFFFFF7F")), F.expr("substring(body, 5)"))).otherwise(F.col("body"))
    out = framing.read_payloads(raw.select("stream_id", "sequence", body.alias("body")), expected="D")
    return out.select("stream_id", "sequence", "status", "kind", F.col("payload.ref_sequence").alias("ref_sequence"))


@query(f"WITH {fx.PACKETS} SELECT stream_id, sequence, CASE packet_type WHEN 1 THEN 'I' WHEN 2 THEN 'D' ELSE 'S' END AS kind FROM packets")
def s16_payload_types(spark, d):
    """The kind that each payload table says it is; what a C packet carries is a ping."""
    raw = framing.encode_packets(built_packets(spark, d))
    out = framing.read_payloads(raw.select("stream_id", "sequence", F.expr("substring(raw, 17, length(raw) - 20)").alias("body")))
    return out.select("stream_id", "sequence", "kind")


@query(f"WITH {fx.PACKETS} SELECT stream_id, sequence, CASE WHEN packet_type = 4 AND sequence % 8 + 1 IN (7, 8) THEN sequence % 8 + 1 ELSE 7 END AS command, timestamp_ms FROM packets WHERE packet_type >= 3")
def s15_sync_builder(spark, d):
    """S payloads with their commands: the wire keeps pings and pongs, others and C packets are pings."""
    raw = framing.encode_packets(built_packets(spark, d).where("kind in ('C', 'S')"))
    out = framing.read_payloads(raw.select("stream_id", "sequence", F.expr("substring(raw, 17, length(raw) - 20)").alias("body")), expected="S")
    return longs(out.select("stream_id", "sequence", F.col("payload.command").alias("command"), F.col("payload.timestamp_ms").alias("timestamp_ms")))


@query(f"""WITH {fx.PACKETS} SELECT stream_id, sequence, (SELECT string_agg(substr(h, 2 * i + 1, 2), '' ORDER BY i DESC) FROM range(0, 4) r(i)) AS sequence_le, 26 AS header_bytes
  FROM (SELECT stream_id, sequence, format('{{:08X}}', sequence) AS h FROM packets)""")
def s20_audio_header(spark, d):
    h = media.audio_header(F.col("sequence"), F.col("timestamp_ms"), F.lit(0), F.lit(16000), F.lit(64), (F.col("sequence") == 1).cast("long"), F.col("payload_len"))
    return fx.packets(spark, d).select("stream_id", "sequence", F.substring(h, 1, 8).alias("sequence_le"), F.expr("26L").alias("header_bytes"))


# --- projections -------------------------------------------------------------------------------------------------


@query("SELECT event_id, " + ", ".join(f"{enum_sql('event_id % 10', t)} AS {n}" for n, t in values.ENUMS.items()) + ", CASE WHEN event_id % 10 NOT IN (1, 2, 3, 4) THEN 'unknown code ' || CAST(event_id % 10 AS VARCHAR) END AS packet_type_error FROM events")
def p1_enum_decode(spark, d):
    c = F.col("event_id") % 10
    return scan(spark, d, "events").select("event_id", *[scalar.enum_name(c, t).alias(n) for n, t in values.ENUMS.items()], scalar.enum_error(c, values.PACKET_TYPES).alias("packet_type_error"))


@query(f"WITH {fx.RGB} SELECT frame_id, i, round(0.299 * r + 0.587 * g + 0.114 * b, {R}) AS luminance FROM rgb")
def p2_luminance(spark, d):
    return fx.rgb(spark, d).select("frame_id", "i", F.round(scalar.luminance(F.col("r"), F.col("g"), F.col("b")).cast("double"), R).alias("luminance"))


def rects(spark, d) -> DataFrame:
    m = fx.motion_vectors(spark, d)
    return m.select("stream_id", "sequence", scalar.rect(F.col("block_x") * 16, F.col("block_y") * 16, F.abs("dx") + 1, F.abs("dy") + 1).alias("r"), scalar.rect(F.col("sad"), F.col("sad"), F.lit(100), F.lit(100)).alias("o"))


RECTS = fx.VECTORS + ", rects AS (SELECT stream_id, sequence, block_x * 16 AS x, block_y * 16 AS y, abs(dx) + 1 AS w, abs(dy) + 1 AS h, sad AS ox, sad AS oy FROM mv)"


@query(f"WITH {RECTS} SELECT stream_id, sequence, w * h AS area, 120 >= x AND 120 < x + w AND 200 >= y AND 200 < y + h AS inside, x < ox + 100 AND ox < x + w AND y < oy + 100 AND oy < y + h AS meets FROM rects")
def p4_p6_rects(spark, d):
    r, o = F.col("r"), F.col("o")
    return rects(spark, d).select("stream_id", "sequence", scalar.area(r).alias("area"), scalar.contains(r, F.lit(120), F.lit(200)).alias("inside"), scalar.intersects(r, o).alias("meets"))


@query("SELECT event_id, (event_id * 7919) & 65535 AS block_x FROM events")
def p7_wrapping_index(spark, d):
    return scan(spark, d, "events").select("event_id", scalar.wrap16(F.col("event_id") * 7919).alias("block_x"))


@query(f"WITH {fx.VECTORS} SELECT stream_id, sequence, dx = 0 AND dy = 0 AS is_zero, round(sqrt(dx * dx + dy * dy), {R}) AS magnitude FROM mv")
def p8_magnitude(spark, d):
    return fx.motion_vectors(spark, d).select("stream_id", "sequence", scalar.is_zero(F.col("dx"), F.col("dy")).alias("is_zero"), F.round(scalar.magnitude(F.col("dx"), F.col("dy")), R).alias("magnitude"))


@query(f"WITH {fx.VECTORS} SELECT stream_id, sequence, CASE WHEN dx * 2 BETWEEN -128 AND 127 AND dy BETWEEN -128 AND 127 THEN dx * 2 END AS dx, CASE WHEN dx * 2 BETWEEN -128 AND 127 AND dy BETWEEN -128 AND 127 THEN dy END AS dy FROM mv")
def p9_compact(spark, d):
    c = scalar.to_compact(F.col("dx") * 2, F.col("dy"))
    return longs(fx.motion_vectors(spark, d).select("stream_id", "sequence", c["dx"].alias("dx"), c["dy"].alias("dy")))


@query(f"WITH {fx.RGB} SELECT frame_id, arg_min(r, i) AS r, arg_min(g, i) AS g, arg_min(b, i) AS b FROM rgb GROUP BY 1")
def p12_dominant(spark, d):
    c = fx.rgb(spark, d).groupBy("frame_id").agg(F.array(F.min_by(F.struct("r", "g", "b"), "i")).alias("colors"))
    x = scalar.dominant(F.col("colors"))
    return c.select("frame_id", x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b"))


@query(f"SELECT event_id, round(greatest(0.0, least(1.0, value / 100 - 0.5)), {R}) AS confidence FROM events")
def p15_confidence(spark, d):
    return scan(spark, d, "events").select("event_id", F.round(scalar.clamp01(F.col("value") / 100 - 0.5), R).alias("confidence"))


@query(f"""WITH {fx.PACKETS} SELECT stream_id, sequence, {enum_sql('sequence % 8 + 1', values.SYNC_COMMANDS)} AS command,
  CASE sequence % 8 + 1 WHEN 2 THEN 'sequence' WHEN 3 THEN 'sequence' WHEN 5 THEN 'bitrate' WHEN 6 THEN 'quality' ELSE 'none' END AS data FROM packets WHERE packet_type = 4""")
def p16_sync_commands(spark, d):
    n = F.col("sequence")
    made = {1: records.request_keyframe(), 2: records.ack(n), 3: records.nack(n), 4: records.end_of_stream(), 5: records.bitrate_adjust(n), 6: records.s_payload(6, quality=n % 4), 7: records.ping(), 8: records.pong()}
    made = {k: v.cast(records.S_PAYLOAD) for k, v in made.items()}
    payload = F.element_at(F.array(*[made[k] for k in sorted(made)]), (n % 8 + 1).cast("int"))
    p = fx.packets(spark, d).where("packet_type = 4").select("stream_id", "sequence", payload.alias("p"))
    data = F.when(F.col("p.sequence").isNotNull(), "sequence").when(F.col("p.bitrate_kbps").isNotNull(), "bitrate").when(F.col("p.quality").isNotNull(), "quality").otherwise("none")
    return p.select("stream_id", "sequence", scalar.enum_name(F.col("p.command"), values.SYNC_COMMANDS).alias("command"), data.alias("data"))


@query("SELECT doc_id, 4 + strlen(coalesce(text, '')) AS scene_size, 4 + strlen(coalesce(text, '')) >= 16 AND doc_id % 2 = 0 AS valid FROM documents")
def p18_scene_magic(spark, d):
    data = F.concat(F.unhex(F.when(F.col("doc_id") % 2 == 0, values.SCENE_MAGIC_HEX).otherwise("00000000")), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return scan(spark, d, "documents").select("doc_id", F.length(data).cast("long").alias("scene_size"), scalar.has_scene_magic(data).alias("valid"))


@query(f"WITH {fx.HYBRID} SELECT stream_id, sequence, delta_new_version - 1 AS ref_version, delta_new_version, delta_bytes AS delta_size FROM hybrid WHERE delta_new_version IS NOT NULL")
def p19_scene_deltas(spark, d):
    data = F.rpad(F.lit(""), F.col("delta_bytes").cast("int"), F.lit("x")).cast("binary")
    h = fx.hybrid_frames(spark, d).where("delta_new_version is not null").withColumn("s", records.scene_delta("animation_update", F.col("delta_new_version") - 1, data))
    return longs(h.select("stream_id", "sequence", F.col("s.ref_scene_version").alias("ref_version"), F.col("s.new_scene_version").alias("delta_new_version"), F.col("s.size").alias("delta_size")))


@query(f"""WITH {fx.MASKS} SELECT frame_id, round(sum(bit) / 4096.0, {R}) AS coverage, round(CASE WHEN frame_id = 0 THEN 1.0 ELSE 32.0 * 32 / (64 * 64) END, {R}) AS bandwidth_ratio FROM masks GROUP BY 1""")
def p20_mask_ratios(spark, d):
    m = fx.masks(spark, d).groupBy("frame_id").agg(F.sum("bit").alias("n"))
    side = F.when(F.col("frame_id") == 0, 0).otherwise(64)
    return m.select("frame_id", F.round(scalar.coverage(F.col("n"), F.lit(4096)), R).alias("coverage"), F.round(scalar.bandwidth_ratio(F.lit(32), F.lit(32), side, side), R).alias("bandwidth_ratio"))


@query(f"""SELECT event_id, CAST(floor(640 * (360 + event_id % 720) / 8) AS BIGINT) AS traditional,
  CAST(floor(640 * (360 + event_id % 720) * 0.25 * 1.5 / 8) + floor(640 * (360 + event_id % 720) * 0.25 / 50) AS BIGINT) + 5000 AS hybrid FROM events""")
def p23_estimate_savings(spark, d):
    e = scalar.estimate_bytes(F.lit(640), 360 + F.col("event_id") % 720, F.lit(0.25), F.lit(5000), F.lit(1.5))
    return scan(spark, d, "events").select("event_id", e["traditional"].alias("traditional"), e["hybrid"].cast("long").alias("hybrid"))


@query("SELECT event_id, event_id % 16 AS block_x, (event_id // 16) & 65535 AS block_y, ((event_id // 16) & 65535) * 16 + event_id % 16 AS entity FROM events")
def p24_grid(spark, d):
    c = scalar.grid_cell(F.col("event_id"), 16)
    return scan(spark, d, "events").select("event_id", c["block_x"].alias("block_x"), c["block_y"].alias("block_y"), scalar.from_grid(c["block_x"], c["block_y"], 16).alias("entity"))


# --- filters -----------------------------------------------------------------------------------------------------


@query(f"WITH {fx.VECTORS} SELECT * FROM mv WHERE dx <> 0 OR dy <> 0")
def f1_nonzero_motion(spark, d):
    return fx.motion_vectors(spark, d).where(~scalar.is_zero(F.col("dx"), F.col("dy")))


CONTRAST = "contrast AS (SELECT frame_id, x // 8 AS bx, y // 8 AS by, max(v) - min(v) AS strength FROM frames GROUP BY 1, 2, 3)"


@query(f"WITH {fx.FRAMES}, {CONTRAST} SELECT * FROM contrast WHERE strength > 50")
def f2_strong_blocks(spark, d):
    return blocks.contrast(fx.frame_rows(spark, d), 8).where(F.col("strength") > values.CONTRAST_THRESHOLD)


@query(f"WITH {RECTS} SELECT stream_id, sequence, w * h AS area FROM rects WHERE w * h >= 64")
def f3_min_area(spark, d):
    return rects(spark, d).select("stream_id", "sequence", scalar.area(F.col("r")).alias("area")).where(F.col("area") >= values.MIN_REGION_AREA)


@query(f"WITH {fx.RGB} SELECT frame_id, i, r, g, b FROM rgb WHERE i % 10 = 0")
def f8_sampled_pixels(spark, d):
    return palette.sample(fx.rgb(spark, d), 0.1)


@query(f"WITH {fx.SYNC} SELECT stream_id, event_id, entity, dx, dy FROM sync WHERE kind = 'Motion'")
def f6_motion_events(spark, d):
    return fx.sync_events(spark, d).where("kind = 'Motion'").select("stream_id", "event_id", "entity", "dx", "dy")


# --- joins -------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.FRAMES} SELECT frame_id, x, y, v AS cur, prev FROM (SELECT *, lag(v) OVER w AS prev, lag(frame_id) OVER w AS before FROM frames WINDOW w AS (PARTITION BY x, y ORDER BY frame_id))
  WHERE before = frame_id - 1 AND v > prev + 100""")
def j1_pixel_pairs(spark, d):
    f = fx.frames(spark, d)
    prev = f.select((F.col("frame_id") + 1).alias("frame_id"), "x", "y", F.col("v").alias("prev"))
    return f.withColumnRenamed("v", "cur").join(prev, ["frame_id", "x", "y"]).where("cur > prev + 100").select("frame_id", "x", "y", "cur", "prev")


@query(f"""WITH {RECTS} SELECT a.stream_id, a.sequence AS a, b.sequence AS b FROM rects a JOIN rects b ON a.stream_id = b.stream_id AND a.sequence < b.sequence
  AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h""")
def j3_overlaps(spark, d):
    """All overlapping rectangles of each stream."""
    r = rects(spark, d).select(F.col("stream_id").alias("key"), F.col("sequence").alias("id"), "r")
    return blocks.overlaps(r).withColumnRenamed("key", "stream_id")


CENTRES = "centres AS (SELECT frame_id, cluster, arg_min(r, i) AS cr, arg_min(g, i) AS cg, arg_min(b, i) AS cb FROM (SELECT *, i // 269 AS cluster FROM rgb) GROUP BY 1, 2)"
ASSIGNED = CENTRES + """, assigned AS (SELECT frame_id, i, r, g, b, arg_min(cluster, dist * 100 + cluster) AS cluster, min(dist) AS distance FROM (SELECT p.*, c.cluster,
  (p.r - cr) * (p.r - cr) + (p.g - cg) * (p.g - cg) + (p.b - cb) * (p.b - cb) AS dist FROM rgb p JOIN centres c USING (frame_id)) GROUP BY 1, 2, 3, 4, 5)"""


def centres(spark, d) -> DataFrame:
    """Five starting centres a frame: the first pixel of each fifth."""
    px = fx.rgb(spark, d).withColumn("cluster", F.expr("i div 269"))
    return px.groupBy("frame_id", "cluster").agg(*[F.min_by(c, "i").alias(f"c{c}") for c in "rgb"])


@query(f"WITH {fx.RGB}, {ASSIGNED} SELECT frame_id, i, cluster, distance FROM assigned")
def j4_nearest_centre(spark, d):
    return palette.assign(fx.rgb(spark, d), centres(spark, d)).select("frame_id", "i", "cluster", "distance")


@query(f"WITH {fx.PACKETS} SELECT d.stream_id, d.sequence, d.sequence - 1 AS ref_sequence, i.sequence AS key_sequence FROM packets d LEFT JOIN packets i ON i.stream_id = d.stream_id AND i.sequence = d.sequence - 1 AND i.packet_type = 1 WHERE d.packet_type = 2")
def j6_references(spark, d):
    return stream.resolve_references(fx.packets(spark, d).withColumn("ref_sequence", F.col("sequence") - 1)).drop("key_timestamp_ms")


@query(f"WITH {fx.PACKETS} SELECT stream_id, count(*) AS dangling FROM packets d WHERE packet_type = 2 AND NOT EXISTS (SELECT 1 FROM packets i WHERE i.stream_id = d.stream_id AND i.sequence = d.sequence - 1 AND i.packet_type = 1) GROUP BY 1")
def j6_dangling(spark, d):
    return stream.dangling(fx.packets(spark, d).withColumn("ref_sequence", F.col("sequence") - 1)).groupBy("stream_id").agg(F.count("*").alias("dangling"))


@query(f"""WITH {fx.PACKETS} SELECT d.stream_id, d.sequence, d.payload_len % 4 AS region_index, CASE WHEN d.payload_len % 4 < i.sequence % 5 THEN d.payload_len % 4 * 16 END AS region_x
  FROM packets d LEFT JOIN packets i ON i.stream_id = d.stream_id AND i.sequence = d.sequence - 1 AND i.packet_type = 1 WHERE d.packet_type = 2""")
def j6_region_deltas(spark, d):
    """Region deltas with the region of their keyframe; each keyframe has sequence % 5 regions."""
    p = fx.packets(spark, d)
    made = F.transform(F.filter(F.array(*[F.lit(k) for k in range(4)]), lambda k: k < F.col("sequence") % 5), lambda k: F.struct((k * 16).cast("long").alias("x"), F.lit(16).alias("width")))
    keys = p.where("packet_type = 1").select("stream_id", "sequence", made.alias("regions"))
    deltas = p.where("packet_type = 2").select("stream_id", "sequence", (F.col("sequence") - 1).alias("ref_sequence"), (F.col("payload_len") % 4).alias("region_index"))
    return stream.resolve_region_deltas(deltas, keys).select("stream_id", "sequence", "region_index", F.col("region.x").alias("region_x"))


# --- aggregations ------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.PACKETS} SELECT stream_id, sum(size) AS total_bytes, count(*) AS total_packets, count_if(packet_type = 1) AS i_packets, count_if(packet_type = 2) AS d_packets,
  count_if(packet_type = 3) AS c_packets, count_if(packet_type = 4) AS s_packets FROM packets GROUP BY 1""")
def a1_stream_stats(spark, d):
    return stream.packet_stats(fx.packets(spark, d))


@query(f"WITH {fx.VECTORS} SELECT stream_id, round(avg(sqrt(dx * dx + dy * dy)), {R}) AS avg_magnitude, round(max(sqrt(dx * dx + dy * dy)), {R}) AS max_magnitude FROM mv GROUP BY 1")
def a2_motion_stats(spark, d):
    return stream.motion_stats(fx.motion_vectors(spark, d)).select("stream_id", F.round("avg_magnitude", R).alias("avg_magnitude"), F.round("max_magnitude", R).alias("max_magnitude"))


@query(f"WITH {fx.PACKETS} SELECT stream_id, sum(payload_len) AS correction_bytes, count(*) AS corrections FROM packets WHERE packet_type = 3 GROUP BY 1")
def a3_corrections(spark, d):
    return fx.packets(spark, d).where("packet_type = 3").groupBy("stream_id").agg(F.sum("payload_len").alias("correction_bytes"), F.count("*").alias("corrections"))


DIFF = "diff AS (SELECT c.frame_id, c.x, c.y, abs(c.v - p.v) AS d FROM frames c JOIN frames p ON p.frame_id = c.frame_id - 1 AND p.x = c.x AND p.y = c.y)"


@query(f"WITH {fx.FRAMES}, {DIFF} SELECT frame_id, x // 8 AS bx, y // 8 AS by, CAST(sum(d) AS BIGINT) AS sad FROM diff GROUP BY 1, 2, 3")
def a4_block_sad(spark, d):
    return blocks.block_sad(frame_pairs(spark, d), 8)


EDGES = """edges AS (SELECT frame_id, x // 16 AS bx, y // 16 AS by, CAST(sum(abs(r - l) + abs(b - t)) // 196 AS BIGINT) AS strength FROM (SELECT *, lag(v) OVER h AS l, lead(v) OVER h AS r, lag(v) OVER u AS t, lead(v) OVER u AS b
  FROM frames WINDOW h AS (PARTITION BY frame_id, y ORDER BY x), u AS (PARTITION BY frame_id, x ORDER BY y)) WHERE x % 16 BETWEEN 1 AND 14 AND y % 16 BETWEEN 1 AND 14 GROUP BY 1, 2, 3)"""


@query(f"WITH {fx.FRAMES}, {EDGES} SELECT * FROM edges")
def a5_edge_strength(spark, d):
    return blocks.edge_strength(fx.frame_rows(spark, d), 16)


@query(f"WITH {fx.FRAMES}, {CONTRAST} SELECT * FROM contrast")
def a6_contrast(spark, d):
    return blocks.contrast(fx.frame_rows(spark, d), 8)


@query(f"WITH {fx.FRAMES}, {DIFF} SELECT frame_id, x // 16 AS bx, y // 16 AS by, CAST(sum(d) // 256 AS BIGINT) AS strength FROM diff GROUP BY 1, 2, 3")
def a7_motion_magnitude(spark, d):
    return blocks.motion_magnitude(frame_pairs(spark, d), 16)


@query(f"""WITH {fx.RGB}, {ASSIGNED}, means AS (SELECT frame_id, cluster, CAST(sum(r) // count(*) AS BIGINT) AS r, CAST(sum(g) // count(*) AS BIGINT) AS g, CAST(sum(b) // count(*) AS BIGINT) AS b FROM assigned GROUP BY 1, 2)
  SELECT c.frame_id, c.cluster, coalesce(m.r, 0) AS r, coalesce(m.g, 0) AS g, coalesce(m.b, 0) AS b FROM centres c LEFT JOIN means m ON m.frame_id = c.frame_id AND m.cluster = c.cluster""")
def a8_cluster_means(spark, d):
    c = centres(spark, d)
    return palette.update(palette.assign(fx.rgb(spark, d), c), c)


@query(f"WITH {fx.RGB}, {ASSIGNED} SELECT frame_id, cluster, round(count(*) / sum(count(*)) OVER (PARTITION BY frame_id), {R}) AS weight FROM assigned GROUP BY 1, 2")
def a9_palette_weights(spark, d):
    return palette.weights(palette.assign(fx.rgb(spark, d), centres(spark, d))).withColumn("weight", F.round("weight", R))


@query(f"WITH {fx.RGB} SELECT frame_id, min(r) AS min_r, max(r) AS max_r, min(g) AS min_g, max(g) AS max_g, min(b) AS min_b, max(b) AS max_b FROM rgb GROUP BY 1")
def a10_channel_ranges(spark, d):
    return palette.channel_ranges(fx.rgb(spark, d))


@query(f"WITH {fx.BLOCKS8} SELECT vec_id AS block, round(CASE WHEN sum(v * v) = 0 THEN 1 ELSE 1 - sum((v - v // 8 * 8) * (v - v // 8 * 8)) / sum(v * v) END, {R}) AS compaction FROM blocks8 GROUP BY 1")
def a11_energy_compaction(spark, d):
    b = fx.blocks8(spark, d).select(F.col("vec_id").alias("block"), F.col("v").alias("o"), F.expr("v div 8 * 8").alias("r"))
    return transform.energy_compaction(b).withColumn("compaction", F.round("compaction", R))


@query(f"WITH {fx.FRAMES} SELECT f.frame_id, s.i AS symbol, count(frames.v) AS n FROM (SELECT DISTINCT frame_id FROM frames) f CROSS JOIN range(0, 256) s(i) LEFT JOIN frames ON frames.frame_id = f.frame_id AND frames.v = s.i GROUP BY 1, 2")
def a12_histogram(spark, d):
    c = fx.frames(spark, d).groupBy("frame_id", "v").agg(F.count("*").alias("n"))
    held = c.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("h"))
    return held.select("frame_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("symbol"), "h").select("frame_id", "symbol", F.coalesce(F.try_element_at("h", F.col("symbol")), F.lit(0)).alias("n"))


BANDWIDTH = """bw AS (SELECT stream_id, CAST(coalesce(sum(CASE WHEN is_keyframe THEN scene_bytes END), 0) AS BIGINT) AS scene_bytes, CAST(coalesce(sum(CASE WHEN NOT is_keyframe THEN delta_bytes END), 0) AS BIGINT) AS delta_bytes,
  CAST(coalesce(sum(mask_bytes), 0) AS BIGINT) AS mask_bytes, CAST(sum(video_bytes) AS BIGINT) AS video_bytes, CAST(sum(audio_bytes) AS BIGINT) AS audio_bytes,
  CAST(sum(coalesce(CASE WHEN is_keyframe THEN scene_bytes END, 0) + coalesce(CASE WHEN NOT is_keyframe THEN delta_bytes END, 0) + coalesce(mask_bytes, 0) + video_bytes + audio_bytes) AS BIGINT) AS hybrid_bytes,
  CAST(sum(tx_width * tx_height * 3 // 20) AS BIGINT) AS traditional_bytes, count(*) AS frame_count FROM tx GROUP BY 1)"""


@query(f"WITH {fx.HYBRID}, {BANDWIDTH} SELECT * FROM bw")
def a13_bandwidth(spark, d):
    return stream.bandwidth(stream.transmit(fx.hybrid_frames(spark, d))).drop("saved_percent", "saved_ratio")


@query(f"WITH {fx.HYBRID}, {BANDWIDTH} SELECT stream_id, round(CASE WHEN traditional_bytes = 0 THEN 0 ELSE (1 - hybrid_bytes / traditional_bytes) * 100 END, {R}) AS saved_percent, round(CASE WHEN traditional_bytes = 0 THEN 1 ELSE traditional_bytes / greatest(hybrid_bytes, 1) END, {R}) AS saved_ratio FROM bw")
def p21_savings(spark, d):
    return stream.bandwidth(stream.transmit(fx.hybrid_frames(spark, d))).select("stream_id", F.round("saved_percent", R).alias("saved_percent"), F.round("saved_ratio", R).alias("saved_ratio"))


REPORT_SQL = """printf('frames %d, hybrid %d B (scene %d, delta %d, mask %d, video %d, audio %d), traditional %d B, saved %.2f %%, ratio %.2f', frame_count, hybrid_bytes, scene_bytes, delta_bytes, mask_bytes, video_bytes, audio_bytes, traditional_bytes,
  CASE WHEN traditional_bytes = 0 THEN 0.0 ELSE (1 - hybrid_bytes / traditional_bytes) * 100 END::DOUBLE, CASE WHEN traditional_bytes = 0 THEN 1.0 ELSE traditional_bytes / greatest(hybrid_bytes, 1) END::DOUBLE)"""


@query(f"WITH {fx.HYBRID}, {BANDWIDTH} SELECT stream_id, {REPORT_SQL} AS report FROM bw")
def p22_report(spark, d):
    return stream.report(stream.bandwidth(stream.transmit(fx.hybrid_frames(spark, d))))


@query(f"WITH {fx.SYNC} SELECT stream_id, count_if(kind = 'Motion') AS motion_events FROM sync GROUP BY 1")
def a14_motion_events(spark, d):
    return fx.sync_events(spark, d).groupBy("stream_id").agg(F.count_if(F.col("kind") == "Motion").alias("motion_events"))


@query(f"WITH {fx.FRAMES} SELECT frame_id, min(v) AS low, max(v) AS high FROM frames GROUP BY 1")
def a15_symbol_range(spark, d):
    return fx.frames(spark, d).groupBy("frame_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))


# --- windows, state ----------------------------------------------------------------------------------------------


@query(f"WITH {fx.HYBRID} SELECT stream_id, sequence, tx_sequence, tx_scene_version, tx_width, tx_height, tx_timestamp_ms FROM tx")
def w1_w4_m10_transmit(spark, d):
    return longs(stream.transmit(fx.hybrid_frames(spark, d)).select("stream_id", "sequence", "tx_sequence", "tx_scene_version", "tx_width", "tx_height", "tx_timestamp_ms"))


@query(f"""WITH {fx.HYBRID} SELECT stream_id, sequence, last_value(CASE WHEN is_keyframe AND scene_bytes > 0 THEN 1 END IGNORE NULLS) OVER w IS NOT NULL AS render_background,
  coalesce(last_value(CASE WHEN is_keyframe AND scene_bytes > 0 THEN scene_version END IGNORE NULLS) OVER w, 0) AS scene_version, last_value(CASE WHEN mask_bytes IS NOT NULL THEN sequence END IGNORE NULLS) OVER w AS mask_from,
  video_bytes AS person_video_size, tx_width AS frame_width, tx_height AS frame_height, count(*) OVER w AS frames_received FROM tx WINDOW w AS (PARTITION BY stream_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w3_receive(spark, d):
    return longs(stream.receive(fx.hybrid_frames(spark, d)))


@query(f"WITH {fx.FRAMES} SELECT DISTINCT frame_id AS cur_id, frame_id - 1 AS prev_id FROM frames WHERE frame_id > 0")
def w5_frame_pairs(spark, d):
    return frame_pairs(spark, d).select("cur_id", "prev_id")


RUNS = """runs AS (SELECT frame_id, min(pos) AS start, any_value(bit) AS value, count(*) AS length FROM (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY pos) AS island FROM
  (SELECT *, CASE WHEN bit = lag(bit) OVER (PARTITION BY frame_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM masks)) GROUP BY frame_id, island)"""


@query(f"WITH {fx.MASKS}, {RUNS} SELECT * FROM runs")
def w6_rle_runs(spark, d):
    return masks.runs(fx.masks(spark, d))


@query(f"WITH {fx.MASKS}, {RUNS} SELECT frame_id, string_agg(format('{{:02X}}', length % 256) || format('{{:02X}}', length // 256) || format('{{:02X}}', value), '' ORDER BY start) AS rle_hex FROM runs GROUP BY 1")
def w6_rle_encode(spark, d):
    return masks.encode(masks.runs(fx.masks(spark, d))).select("frame_id", F.hex("rle").alias("rle_hex"))


@query(f"WITH {fx.MASKS} SELECT frame_id, pos, bit FROM masks")
def w7_rle_decode(spark, d):
    e = masks.encode(masks.runs(fx.masks(spark, d)))
    return longs(e.select("frame_id", F.posexplode(masks.decode(F.col("rle"), F.lit(4096))).alias("pos", "bit")))


@query(f"WITH {fx.MASKS}, {RUNS} SELECT frame_id, round(sum(CASE WHEN value = 1 THEN length ELSE 0 END) / 4096.0, {R}) AS coverage, 3 * count(*) AS mask_size FROM runs GROUP BY 1")
def m11_person_mask(spark, d):
    m = fx.masks(spark, d)
    e = masks.encode(masks.runs(m)).join(m.groupBy("frame_id").agg(F.sum("bit").alias("n")), "frame_id")
    p = masks.person_masks(e, F.col("n"), F.array(*[F.lit(x) for x in (0, 0, 64, 64)]), 64, 64)
    return longs(p.select("frame_id", F.round("coverage", R).alias("coverage"), "mask_size"))


# --- sorts and sets -----------------------------------------------------------------------------------------------


@query(f"WITH {fx.RGB}, {ASSIGNED}, n AS (SELECT frame_id, cluster, count(*) AS n FROM assigned GROUP BY 1, 2) SELECT frame_id, cluster, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, cluster) AS place FROM n")
def t1_palette_order(spark, d):
    w = palette.weights(palette.assign(fx.rgb(spark, d), centres(spark, d)))
    return w.select("frame_id", "cluster", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("weight"), "cluster")).cast("long").alias("place"))


@query(f"WITH {RECTS} SELECT stream_id, sequence, row_number() OVER (PARTITION BY stream_id ORDER BY w * h DESC, sequence) AS place FROM rects")
def t2_region_order(spark, d):
    r = rects(spark, d).withColumn("area", scalar.area(F.col("r")))
    return r.select("stream_id", "sequence", F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("area"), "sequence")).cast("long").alias("place"))


@query(f"WITH {fx.RGB}, f AS (SELECT p.frame_id, p.i, (p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b) AS dist FROM rgb p JOIN rgb q ON q.frame_id = p.frame_id AND q.i = 0) SELECT frame_id, arg_max(i, dist * 100000 + i) AS farthest, max(dist) AS distance FROM f GROUP BY 1")
def t5_farthest(spark, d):
    px = fx.rgb(spark, d)
    q = px.where("i = 0").select("frame_id", *[F.col(c).alias(f"c{c}") for c in "rgb"])
    dist = palette.distance_sq(*[F.col(c) for c in ("r", "g", "b", "cr", "cg", "cb")])
    return px.join(q, "frame_id").withColumn("d", dist).groupBy("frame_id").agg(F.max_by("i", F.struct("d", "i")).alias("farthest"), F.max("d").alias("distance"))


@query(f"""WITH {fx.FRAMES}, {CONTRAST} SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY "by", bx) AS place, bx, "by" FROM contrast""")
def t7_raster_order(spark, d):
    return blocks.contrast(fx.frame_rows(spark, d), 8).select("frame_id", F.row_number().over(Window.partitionBy("frame_id").orderBy("by", "bx")).cast("long").alias("place"), "bx", "by")


REGIONS = """regions AS (SELECT frame_id, bx * 16 AS x, "by" * 16 AS y, 3 AS roi_type, least(strength, 255) / 255.0 AS confidence FROM edges WHERE strength > 30
  UNION ALL SELECT frame_id, x // 16 * 16, y // 16 * 16, 2, least(max(v) - min(v), 255) / 255.0 FROM frames GROUP BY frame_id, x // 16, y // 16 HAVING max(v) - min(v) > 50)"""


@query(f"WITH {fx.FRAMES}, {EDGES}, {REGIONS} SELECT frame_id, x, y, CAST(roi_type AS BIGINT) AS roi_type, round(CAST(confidence AS DOUBLE), {R}) AS confidence FROM regions")
def u1_detector_union(spark, d):
    f = fx.frame_rows(spark, d)
    out = blocks.region_rows(blocks.edge_strength(f, 16), 16, 30, 3).unionByName(blocks.region_rows(blocks.contrast(f, 16), 16, 50, 2))
    return out.select("frame_id", "x", "y", "roi_type", F.round("confidence", R).alias("confidence"))


@query("SELECT count(DISTINCT sha256(text)) AS contents, count(*) AS packets FROM documents WHERE text IS NOT NULL")
def u2_content_dedup(spark, d):
    docs = scan(spark, d, "documents").where("text is not null").select(F.col("text").cast("binary").alias("raw"))
    return docs.agg(F.count("*").alias("packets")).join(bridges.distinct_packets(docs).agg(F.count("*").alias("contents"))).select("contents", "packets")


# --- transforms ----------------------------------------------------------------------------------------------------

BASIS = f"""basis AS (SELECT v.i * 8 + u.i AS uv, y.i * 8 + x.i AS pos, 0.25 * (CASE WHEN u.i = 0 THEN 1 / sqrt(2) ELSE 1 END) * (CASE WHEN v.i = 0 THEN 1 / sqrt(2) ELSE 1 END)
  * cos((2 * x.i + 1) * u.i * pi() / 16) * cos((2 * y.i + 1) * v.i * pi() / 16) AS w FROM range(0, 8) x(i), range(0, 8) y(i), range(0, 8) u(i), range(0, 8) v(i))"""
QUANT = "quant AS (SELECT i AS uv, list_extract([" + ", ".join(map(str, transform.quant_matrix(8, 50))) + "], i + 1) AS q FROM range(0, 64) t(i))"
COEFFS = f"{fx.BLOCKS8}, {BASIS}, {QUANT}, coeffs AS (SELECT vec_id AS block, uv, round(sum(v * w), 6) AS c FROM blocks8 JOIN basis USING (pos) GROUP BY 1, 2)"
QUANTIZED = COEFFS + ", quantized AS (SELECT block, uv, CAST(round(c * (1.0::DOUBLE / q)) AS BIGINT) AS q, q AS m FROM coeffs JOIN quant USING (uv))"


def coeffs(spark, d) -> DataFrame:
    """block and the coefficients, rounded to six digits."""
    return transform.forward(fx.block_arrays(spark, d)).select("block", F.transform("coeffs", lambda c: F.round(c, 6)).alias("c"))


def quantized(spark, d) -> DataFrame:
    return coeffs(spark, d).select("block", transform.quantize(F.col("c")).alias("q"))


@query(f"WITH {fx.BLOCKS8}, {BASIS} SELECT vec_id AS block, uv, round(sum(v * w), {R}) + 0.0 AS c FROM blocks8 JOIN basis USING (pos) GROUP BY 1, 2")
def k1_dct(spark, d):
    out = transform.forward(fx.block_arrays(spark, d)).select("block", F.posexplode("coeffs").alias("uv", "c"))
    return longs(out.withColumn("c", F.round("c", R) + 0.0))


@query(f"WITH {fx.BLOCKS8} SELECT vec_id AS block, pos, CAST(v AS DOUBLE) AS v FROM blocks8")
def k2_idct(spark, d):
    out = transform.inverse(transform.forward(fx.block_arrays(spark, d))).select("block", F.posexplode("samples").alias("pos", "v"))
    return longs(out.withColumn("v", F.abs(F.round("v", R))))


@query("SELECT q.quality, i AS uv, greatest(1, CAST(floor(list_extract([" + ", ".join(map(str, values.LUMINANCE_QUANT)) + "], i + 1) * (CASE WHEN q.quality < 50 THEN 5000 // q.quality ELSE 200 - 2 * q.quality END) / 100) AS BIGINT)) AS m FROM range(0, 64) t(i), (SELECT unnest([10, 50, 75, 100]) AS quality) q")
def k4_k5_quality(spark, d):
    rows = [(q, i, m) for q in (10, 50, 75, 100) for i, m in enumerate(transform.quant_matrix(8, q))]
    return spark.createDataFrame(rows, "quality long, uv long, m long")


@query(f"WITH {QUANTIZED} SELECT block, uv, q FROM quantized")
def k6_quantize(spark, d):
    return longs(quantized(spark, d).select("block", F.posexplode("q").alias("uv", "q")))


@query(f"WITH {QUANTIZED} SELECT block, uv, CAST(q * m AS DOUBLE) AS c FROM quantized")
def k7_dequantize(spark, d):
    return longs(quantized(spark, d).select("block", F.posexplode(transform.dequantize(F.col("q"))).alias("uv", "c")))


def sparse(spark, d) -> DataFrame:
    return quantized(spark, d).select("block", transform.sparse_encode(F.col("q")).alias("s"))


@query(f"WITH {QUANTIZED} SELECT block, uv % 8 AS u, uv // 8 AS v, CAST(q AS DOUBLE) AS value FROM quantized WHERE abs(q) > 1")
def k8_f4_sparse_encode(spark, d):
    return longs(sparse(spark, d).select("block", F.explode("s").alias("x")).select("block", "x.u", "x.v", F.col("x.value").cast("double").alias("value")))


@query(f"WITH {QUANTIZED} SELECT block, uv, CASE WHEN abs(q) > 1 THEN q ELSE 0 END AS q FROM quantized")
def k8_sparse_decode(spark, d):
    return longs(sparse(spark, d).select("block", F.posexplode(transform.sparse_decode(F.col("s"))).alias("uv", "q")))


@query(f"WITH {QUANTIZED} SELECT block, pos, round(sum(CASE WHEN abs(q) > 1 THEN q * m ELSE 0 END * w), 3) + 0.0 AS v FROM quantized JOIN basis USING (uv) GROUP BY 1, 2")
def k9_sparse_pipeline(spark, d):
    dense = sparse(spark, d).select("block", transform.dequantize(transform.sparse_decode(F.col("s"))).alias("coeffs"))
    out = transform.inverse(dense).select("block", F.posexplode("samples").alias("pos", "v"))
    return longs(out.withColumn("v", F.round("v", 3) + 0.0))


@query(f"WITH {fx.BLOCKS8}, {BASIS} SELECT block, CAST(sum(round(abs(c) * 10000)) AS BIGINT) AS total, max(CASE WHEN uv = 0 THEN c END) AS mean, count(*) AS n FROM (SELECT vec_id AS block, uv, round(sum(v * w), {R}) + 0.0 AS c FROM blocks8 JOIN basis USING (pos) GROUP BY 1, 2) GROUP BY 1")
def k3_dct_arrays(spark, d):
    """The bulk form: an array of coefficients a block, and what is asked of it without exploding it."""
    c = transform.forward(fx.block_arrays(spark, d)).select("block", F.transform("coeffs", lambda c: F.round(c, R) + 0.0).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.round(F.abs(x) * 10000).cast("long"))
    return c.select("block", total.alias("total"), F.col("c")[0].alias("mean"), F.size("c").cast("long").alias("n"))


@query(f"WITH {fx.FRAMES}, r AS (SELECT frame_id, min(v) AS low, max(v) AS high FROM frames GROUP BY 1) SELECT frame_id, x, y, v - low AS symbol FROM frames JOIN r USING (frame_id)")
def k10_symbols(spark, d):
    return symbols(fx.frames(spark, d)).select("frame_id", "x", "y", "symbol")


def symbols(px: DataFrame) -> DataFrame:
    """Pixels with their symbol in the frame's range, and the value that it stands for."""
    r = px.groupBy("frame_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    scale = transform.symbol_scale(F.col("low"), F.col("high"))
    met = px.join(r.select("frame_id", "low", scale.alias("scale")), "frame_id").withColumn("symbol", transform.to_symbol(F.col("v"), F.col("low"), F.col("scale")))
    return met.withColumn("value", transform.from_symbol(F.col("symbol"), F.col("low"), F.col("scale")))


@query(f"""WITH {fx.FRAMES}, wide AS (SELECT frame_id, x, y, (v - 128) * 5 AS v FROM frames), r AS (SELECT frame_id, min(v) AS low, (255::FLOAT / (max(v) - min(v))::FLOAT)::FLOAT AS scale FROM wide GROUP BY 1),
  s AS (SELECT frame_id, x, y, v, low, scale, least(255, greatest(0, CAST(trunc((v - low)::FLOAT * scale) AS BIGINT))) AS symbol FROM wide JOIN r USING (frame_id))
  SELECT frame_id, x, y, v, symbol, CAST(trunc(symbol::FLOAT * (1::FLOAT / scale)::FLOAT + 0.5::FLOAT) AS BIGINT) + low AS value FROM s""")
def k10_wide_symbols(spark, d):
    """A range above 255 (here of five times the pixels): scaled to bytes and back, in 32-bit floats."""
    px = fx.frames(spark, d).withColumn("v", (F.col("v") - 128) * 5)
    return symbols(px).select("frame_id", "x", "y", "v", "symbol", "value")


@query("SELECT event_id, event_id % 4 AS quality, event_id % 256 AS red, event_id % 3 AS regions, CASE WHEN event_id % 3 > 0 THEN 8 * 16 ELSE 0 END AS area, 1 AS region_deltas, event_id % 5 + 3 AS correction_bytes, 2 AS corrections FROM events")
def p3_p13_p14_payloads(spark, d):
    """Payloads put together step by step: colours, palettes, regions, region deltas, corrections."""
    n = F.col("event_id")
    tint = records.color(n % 256, F.lit(0), F.lit(255))
    i = records.with_palette(records.with_quality(records.i_payload(F.lit(640), F.lit(480), F.lit(30.0)), (n % 4).cast("int")), records.palette(F.array(tint, records.color(*map(F.lit, records.WHITE)))))
    bounds = scalar.rect(*map(F.lit, (0, 0, 8, 16)))
    one = records.add_region(i, records.solid(bounds, tint))
    two = records.add_region(one, records.gradient(bounds, F.array(tint, tint)))
    i = F.when(n % 3 == 0, i).when(n % 3 == 1, one).otherwise(two)
    delta = records.add_region_delta(records.d_payload(n), records.region_delta(F.lit(0), palette_delta=records.palette(F.array(tint))))
    data = lambda k: F.struct(F.rpad(F.lit(""), k.cast("int"), F.lit("x")).cast("binary").alias("data"))
    fix = records.add_correction(records.c_payload(n, F.array(data(n % 5))), data(F.lit(3)))
    out = scan(spark, d, "events").select("event_id", i.alias("i"), delta.alias("d"), fix.alias("c"))
    return longs(out.select("event_id", F.col("i.quality").alias("quality"), F.col("i.global_palette.colors")[0]["r"].alias("red"), F.size("i.regions").alias("regions"), F.coalesce(scalar.area(F.try_element_at("i.regions", F.lit(-1))["bounds"]), F.lit(0)).alias("area"), F.size("d.region_deltas").alias("region_deltas"), records.correction_bytes(F.col("c")).alias("correction_bytes"), F.col("c.correction_count").alias("corrections")))


@query("SELECT event_id, round(1 + event_id % 3 / 2.0, 4) AS zoom, 0.0::DOUBLE AS rotation, 1 AS duration, CASE event_id % 6 WHEN 0 THEN 'Linear' WHEN 1 THEN 'EaseIn' WHEN 2 THEN 'EaseOut' WHEN 3 THEN 'EaseInOut' WHEN 4 THEN 'Bounce' ELSE 'Elastic' END AS easing FROM events")
def p11_animation(spark, d):
    a = records.animation(zoom=1 + F.col("event_id") % 3 / 2, easing=F.col("event_id") % 6)
    out = scan(spark, d, "events").select("event_id", a.alias("a"))
    return longs(out.select("event_id", F.round("a.zoom_factor", R).alias("zoom"), "a.rotation", "a.duration", scalar.enum_name(F.col("a.easing"), values.EASING_TYPES).alias("easing")))


@query("SELECT doc_id, strlen(coalesce(text, '')) AS size, 1 AS scene_version, -10.0::DOUBLE AS low, 10.0::DOUBLE AS high, doc_id % 2 = 0 AS named FROM documents")
def p17_scene(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("scene "), F.col("doc_id")))
    out = scan(spark, d, "documents").select("doc_id", records.scene(F.coalesce("text", F.lit("")).cast("binary"), name=name).alias("s"))
    return longs(out.select("doc_id", "s.size", "s.scene_version", F.col("s.bounds_min")[2].alias("low"), F.col("s.bounds_max")[0].alias("high"), F.col("s.name").isNotNull().alias("named")))


@query(f"WITH {fx.VECTORS} SELECT stream_id, sequence, dx % 128 AS dx, dy % 128 AS dy, block_x, sad, dx % 128 = 0 AND dy % 128 = 0 AS is_zero FROM mv")
def p9_p10_compact_and_back(spark, d):
    """Vectors in two bytes, expanded again; what would not fit is cut to fit first."""
    v = fx.motion_vectors(spark, d).withColumn("c", F.coalesce(scalar.to_compact(F.col("dx") % 128, F.col("dy") % 128).cast("struct<dx: int, dy: int>"), records.compact()))
    e = records.expand(F.col("c"), F.col("block_x"), F.col("block_y"), F.col("sad"))
    return longs(v.select("stream_id", "sequence", e["dx"].alias("dx"), e["dy"].alias("dy"), e["block_x"].alias("block_x"), e["sad"].alias("sad"), scalar.is_zero(F.col("c.dx"), F.col("c.dy")).alias("is_zero")))


@query("SELECT '0.1.0' AS version")
def p25_version(spark, d):
    return spark.range(1).select(F.lit(__version__).alias("version"))


VOICE_SQL = "SELECT CAST(label AS BIGINT) AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS sequence, 1 AS items, 64 AS frame_size, {more}true AS whole FROM embeddings"


@query(VOICE_SQL.format(more="16000 AS sample_rate, "))
def s21_parametric_layout(spark, d):
    """Fields of parametric items read from their bytes by expressions: a count, coefficients, then 34 fixed bytes."""
    out, at = media.encode_voice(voice_frames(spark, d)).withColumn("p", F.expr("substring(raw, 27)")), scalar.uint_le
    p = F.col("p")
    out = out.withColumn("n", at(p, 4, 2)).withColumn("tail", F.expr("substring(p, 7 + 4 * n)"))
    return out.select("stream_id", "sequence", at(p, 0, 4).alias("items"), at(F.col("tail"), 26, 4).alias("frame_size"), at(F.col("tail"), 30, 4).alias("sample_rate"), (F.length("tail") == 34).alias("whole"))


@query(VOICE_SQL.format(more=""))
def s22_spectral_layout(spark, d):
    """Fields of spectral items: a count, twelve fixed bytes, then six bytes a coefficient."""
    out, at = media.encode_voice(voice_frames(spark, d), layer=1).withColumn("p", F.expr("substring(raw, 27)")), scalar.uint_le
    p = F.col("p")
    return out.select("stream_id", "sequence", at(p, 0, 4).alias("items"), at(p, 8, 4).alias("frame_size"), (F.length(p) == 16 + 6 * at(p, 12, 4)).alias("whole"))


@query(f"WITH {fx.RGB} SELECT frame_id, 21 AS width, count(*) // 21 AS height, 1 AS step, count(*) AS coefficients, true AS whole FROM rgb GROUP BY 1")
def s23_video_layout(spark, d):
    """Fields of coded frames read by expressions: 44 header bytes, a histogram for each channel (its counts add up to the pixels), then three streams."""
    c, at = F.col("coded"), scalar.uint_le
    out = media.encode_video(rgb_rows(spark, d), 100)
    counts = F.expr("transform(sequence(0, 255), k -> substring(coded, 49 + 4 * k, 4))")
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + at(x, 0, 4))
    first = 44 + 3 * (4 + 1024)
    one = at(c, first, 4)
    two = F.conv(F.hex(F.concat(*[F.substring(c, (F.lit(first + 4 + k) + one + 1).cast("int"), F.lit(1)) for k in (3, 2, 1, 0)])), 16, 10).cast("long")
    at_three = F.lit(first + 8) + one + two
    three = F.conv(F.hex(F.concat(*[F.substring(c, (at_three + k + 1).cast("int"), F.lit(1)) for k in (3, 2, 1, 0)])), 16, 10).cast("long")
    return out.select("frame_id", at(c, 0, 4).alias("width"), at(c, 4, 4).alias("height"), at(c, 8, 4).alias("step"), total.alias("coefficients"), (at_three + 4 + three == F.length(c)).alias("whole"))


# --- searches and kernels ----------------------------------------------------------------------------------------------

FRAMES_ONCE = fx.FRAMES.replace("blocks8 AS (", "blocks8 AS MATERIALIZED (")
SADS = FRAMES_ONCE + """, moved AS MATERIALIZED (SELECT frame_id AS cur_id, frame_id - 1 AS frame_id, x // 16 AS block_x, y // 16 AS block_y, a.i AS dx, b.i AS dy, x + a.i AS x, y + b.i AS y, v AS own
  FROM frames CROSS JOIN range(-16, 17) a(i) CROSS JOIN range(-16, 17) b(i) WHERE x // 16 * 16 + a.i BETWEEN 0 AND 48 AND y // 16 * 16 + b.i BETWEEN 0 AND 48),
sads AS MATERIALIZED (SELECT cur_id, block_x, block_y, dx, dy, CAST(sum(abs(own - v)) AS BIGINT) AS sad FROM moved JOIN frames USING (frame_id, x, y) GROUP BY 1, 2, 3, 4, 5)"""


@query(f"""WITH {SADS} SELECT cur_id, block_x, block_y, dx, dy, sad FROM sads
  QUALIFY row_number() OVER (PARTITION BY cur_id, block_x, block_y ORDER BY sad, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 END, dy, dx) = 1""")
def m4_f9_full_search(spark, d):
    """All offsets of the motion search's range of 16."""
    return blocks.full_search(frame_pairs(spark, d), 16, 16)


def frame_pairs(spark, d, how: str = "inner") -> DataFrame:
    return blocks.pairs(fx.frame_rows(spark, d), how)


#: A block's search as a state: phase (large pattern, small pattern, done), next place in the pattern, offset, its value.
DIAMOND = """pattern AS (SELECT unnest([0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1]) AS phase, unnest([0, 1, 2, 3, 4, 5, 6, 7, 0, 1, 2, 3]) AS k,
  unnest([0, -1, 1, -2, 2, -1, 1, 0, 0, -1, 1, 0]) AS sx, unnest([-2, -1, -1, 0, 0, 1, 1, 2, -1, 0, 0, 1]) AS sy),
walk AS (SELECT cur_id, block_x, block_y, CASE WHEN sad < 256 THEN 2 ELSE 0 END AS phase, 0 AS k, 0::BIGINT AS dx, 0::BIGINT AS dy, sad, false AS better, 0 AS rounds FROM sads WHERE dx = 0 AND dy = 0
UNION ALL SELECT cur_id, block_x, block_y,
  CASE WHEN phase = 0 AND win AND found < 256 THEN 2 WHEN NOT ends THEN phase WHEN phase = 0 THEN CASE WHEN better OR win THEN CASE WHEN rounds + 1 >= 32 THEN 1 ELSE 0 END ELSE 1 END WHEN better OR win THEN 1 ELSE 2 END,
  CASE WHEN ends THEN 0 ELSE k + 1 END, CASE WHEN win THEN nx ELSE dx END, CASE WHEN win THEN ny ELSE dy END, CASE WHEN win THEN found ELSE sad END, CASE WHEN ends THEN false ELSE better OR win END, CASE WHEN ends THEN rounds + 1 ELSE rounds END
  FROM (SELECT w.*, w.dx + sx AS nx, w.dy + sy AS ny, s.sad AS found, coalesce(s.sad < w.sad, false) AS win, w.k = CASE WHEN w.phase = 0 THEN 7 ELSE 3 END AS ends
    FROM walk w JOIN pattern p ON p.phase = w.phase AND p.k = w.k LEFT JOIN sads s ON s.cur_id = w.cur_id AND s.block_x = w.block_x AND s.block_y = w.block_y AND s.dx = w.dx + sx AND s.dy = w.dy + sy))"""


@query(f"WITH RECURSIVE {SADS}, {DIAMOND} SELECT cur_id, cur_id - 1 AS prev_id, block_x, block_y, dx, dy, sad FROM walk WHERE phase = 2 AND (dx <> 0 OR dy <> 0)")
def m1_m2_diamond(spark, d):
    return blocks.estimate_motion(frame_pairs(spark, d))


@query(f"WITH RECURSIVE {SADS}, {DIAMOND} SELECT cur_id, block_x, block_y, dx, dy, sad FROM walk WHERE phase = 2")
def m3_all_vectors(spark, d):
    """The search with blocks that did not move."""
    return blocks.estimate_motion(frame_pairs(spark, d), block=16, reach=16, threshold=256, keep_zero=True).drop("prev_id")


#: Palettes of a frame's pixels as lists: px in order, centres; the farthest pixel is the last of equals, a pixel's centre the first.
DIST = "(p.r - c.r) * (p.r - c.r) + (p.g - c.g) * (p.g - c.g) + (p.b - c.b) * (p.b - c.b)"
KMEANS_5 = f"""sampled AS (SELECT frame_id, list({{'r': r, 'g': g, 'b': b}} ORDER BY i) AS px FROM rgb WHERE i % 2 = 0 GROUP BY 1),
seeds AS (SELECT frame_id, px, [px[len(px) // 2 + 1]] AS cs FROM sampled UNION ALL
  SELECT frame_id, px, list_append(cs, px[len(px) + 1 - list_position(list_reverse(near), list_max(near))]) FROM (SELECT *, list_transform(px, lambda p: list_min(list_transform(cs, lambda c: {DIST}))) AS near FROM seeds WHERE len(cs) < 5)),
rounds AS (SELECT frame_id, px, cs, [0::BIGINT] AS own, true AS changed, 0 AS n FROM seeds WHERE len(cs) = 5 UNION ALL
  SELECT frame_id, px, list_transform(range(1, 6), lambda k: {{'r': mean(px, now, k, 'r'), 'g': mean(px, now, k, 'g'), 'b': mean(px, now, k, 'b')}}), now, now <> CASE WHEN n = 0 THEN list_transform(px, lambda p: 1::BIGINT) ELSE own END, n + 1
  FROM (SELECT *, list_transform(list_transform(px, lambda p: list_transform(cs, lambda c: {DIST})), lambda d: list_position(d, list_min(d))::BIGINT) AS now FROM rounds WHERE changed AND n < 10)),
settled AS (SELECT frame_id, cs, own FROM rounds QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY n DESC) = 1),
weighed AS (SELECT frame_id, k, cs[k] AS c, len(list_filter(own, lambda o: o = k)) / len(own) AS weight FROM settled, range(1, 6) t(k))"""
for _c in "rgb":  # the floor of a cluster's mean, 0 without pixels
    KMEANS_5 = KMEANS_5.replace(f"mean(px, now, k, '{_c}')", f"coalesce(CAST(floor(list_sum(list_transform(list_filter(list_zip(px, now), lambda z: z[2] = k), lambda z: z[1].{_c})) / nullif(len(list_filter(now, lambda o: o = k)), 0)) AS BIGINT), 0)")


def kmeans_sql(k: int, step: int) -> str:
    """The palette of k colours from every step-th pixel."""
    return KMEANS_5.replace("i % 2 = 0", f"i % {step} = 0").replace("len(cs) < 5", f"len(cs) < {k}").replace("len(cs) = 5", f"len(cs) = {k}").replace("range(1, 6)", f"range(1, {k + 1})")


@query(f"WITH RECURSIVE {fx.RGB}, {kmeans_sql(3, 1)} SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY weight DESC, k) AS place, c.r AS r, c.g AS g, c.b AS b FROM weighed WHERE weight > 0")
def m6_extractor(spark, d):
    """Three colours of all pixels: an extractor's rate is kept within 0.01 and 1."""
    p = palette.extract(rgb_rows(spark, d), colors=3, rate=1.7).select("frame_id", F.posexplode("colors").alias("at", "c"))
    return longs(p.select("frame_id", (F.col("at") + 1).alias("place"), "c.*"))


@query(f"WITH RECURSIVE {fx.RGB}, {kmeans_sql(5, 2)} SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY weight DESC, k) AS place, c.r AS r, c.g AS g, c.b AS b, round(weight, {R}) AS weight FROM weighed WHERE weight > 0")
def m5_kmeans(spark, d):
    p = palette.kmeans(rgb_rows(spark, d), rate=0.5).select("frame_id", "weights", F.posexplode("colors").alias("at", "c"))
    return longs(p.select("frame_id", (F.col("at") + 1).alias("place"), "c.*", F.round(F.col("weights")[F.col("at")], R).alias("weight")))


def _halves(source: str, made: str) -> str:
    """One level of median cut: each box is sorted by its widest channel (stable) and cut in two; boxes of one pixel stay."""
    wide = "CASE WHEN rr >= gg AND rr >= bb THEN r WHEN gg >= bb THEN g ELSE b END"
    ranges = ", ".join(f"max({c}) OVER w - min({c}) OVER w AS {c}{c}" for c in "rgb")
    return f"""{made} AS (SELECT frame_id, 2 * box + CASE WHEN n > 1 AND place > n // 2 THEN 1 ELSE 0 END AS box, place AS ord, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, box ORDER BY {wide}, ord) AS place
  FROM (SELECT *, {ranges}, count(*) OVER w AS n FROM {source} WINDOW w AS (PARTITION BY frame_id, box))))"""


CUT = f"level0 AS (SELECT frame_id, 0 AS box, i AS ord, r, g, b FROM rgb), {_halves('level0', 'level1')}, {_halves('level1', 'level2')}, {_halves('level2', 'level3')}"


@query(f"""WITH {fx.RGB}, {CUT} SELECT * FROM (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY box) AS place, CAST(sum(r) // count(*) AS BIGINT) AS r, CAST(sum(g) // count(*) AS BIGINT) AS g, CAST(sum(b) // count(*) AS BIGINT) AS b
  FROM level3 GROUP BY frame_id, box) WHERE place <= 5""")
def m7_median_cut(spark, d):
    p = palette.median_cut(rgb_rows(spark, d), 5).select("frame_id", F.posexplode("colors").alias("at", "c"))
    return longs(p.select("frame_id", (F.col("at") + 1).alias("place"), "c.*"))


def rgb_rows(spark, d) -> DataFrame:
    """frame_id, width, height, rgb: each frame's triples as a picture 21 wide."""
    h = F.transform(F.array_sort(F.collect_list(F.struct("i", "r", "g", "b"))), lambda p: F.concat(*[scalar.hex_be(p[c], 1) for c in "rgb"]))
    return fx.rgb(spark, d).groupBy("frame_id").agg(F.unhex(F.array_join(h, "")).alias("rgb"), F.lit(21).alias("width"), F.expr("cast(count(*) div 21 as int)").alias("height"))


def _merge_sql(found: str, made: str) -> str:
    """Greedy merging of each frame's regions, largest first and then in order: one seed a step takes what meets its own bounds."""
    meets = "todo[1].x < r.x + r.width AND r.x < todo[1].x + todo[1].width AND todo[1].y < r.y + r.height AND r.y < todo[1].y + todo[1].height"
    low, high = (lambda c, n: f"list_min(list_transform(met, lambda r: r.{c}))"), (lambda c, n: f"list_max(list_transform(met, lambda r: r.{c} + r.{n}))")
    box = f"'x': {low('x', '')}, 'y': {low('y', '')}, 'width': {high('x', 'width')} - {low('x', '')}, 'height': {high('y', 'height')} - {low('y', '')}"
    return f"""{made}_steps AS (SELECT frame_id, list({{'x': x, 'y': y, 'width': width, 'height': height, 'roi_type': roi_type, 'confidence': confidence}} ORDER BY width * height DESC, ord) AS todo, NULL::STRUCT(x BIGINT, y BIGINT, width BIGINT, height BIGINT, roi_type BIGINT, confidence DOUBLE) AS out, 0 AS n FROM {found} GROUP BY 1
  UNION ALL SELECT frame_id, list_filter(todo[2:], lambda r: NOT ({meets})), {{{box}, 'roi_type': todo[1].roi_type, 'confidence': list_max(list_transform(met, lambda r: r.confidence))}}, n + 1
  FROM (SELECT *, list_filter(todo, lambda r: {meets}) AS met FROM {made}_steps WHERE len(todo) > 0)),
{made} AS (SELECT frame_id, out.x AS x, out.y AS y, out.width AS width, out.height AS height, out.roi_type AS roi_type, out.confidence AS confidence, n::BIGINT AS ord FROM {made}_steps WHERE n > 0)"""


FOUND = """found AS (SELECT frame_id, bx * 16 AS x, "by" * 16 AS y, 16::BIGINT AS width, 16::BIGINT AS height, 3::BIGINT AS roi_type, least(strength, 255) / 255.0::DOUBLE AS confidence, "by" * 1000 + bx AS ord FROM edges WHERE strength > 30
  UNION ALL SELECT frame_id, x // 16 * 16, y // 16 * 16, 16, 16, 2, least(max(v) - min(v), 255) / 255.0::DOUBLE, 1000000 + y // 16 * 1000 + x // 16 FROM frames GROUP BY frame_id, x // 16, y // 16 HAVING max(v) - min(v) > 50)"""
MOVED = """both_kinds AS (SELECT * FROM once UNION ALL SELECT frame_id, x // 16 * 16, y // 16 * 16, 16, 16, 4, least(sum(d) // 256, 255) / 255.0::DOUBLE, 1000000 + y // 16 * 1000 + x // 16 FROM diff GROUP BY frame_id, x // 16, y // 16 HAVING sum(d) // 256 > 20)"""
SHOWN = f"frame_id, x, y, width, height, roi_type, 1::BIGINT AS priority, round(confidence, {R}) AS confidence"


@query(f"WITH RECURSIVE {FRAMES_ONCE}, {EDGES}, {FOUND}, {_merge_sql('found', 'once')} SELECT {SHOWN} FROM once")
def m8_m9_detect(spark, d):
    return blocks.detect(fx.frame_rows(spark, d)).withColumn("confidence", F.round("confidence", R))


@query(f"WITH RECURSIVE {FRAMES_ONCE}, {EDGES}, {DIFF}, {FOUND}, {_merge_sql('found', 'once')}, {MOVED}, {_merge_sql('both_kinds', 'twice')} SELECT {SHOWN} FROM twice")
def m9_detect_with_motion(spark, d):
    return blocks.detect_with_motion(frame_pairs(spark, d, "left")).withColumn("confidence", F.round("confidence", R))


# --- media, bridges ---------------------------------------------------------------------------------------------------


@query()
def v1_v2_video_round_trip(spark, d):
    """Frames coded and decoded: sizes, the decoded bytes' hash and the mean difference from what went in."""
    source = rgb_rows(spark, d)
    back = media.decode_video(media.encode_video(source, 100)).select("frame_id", F.col("width").alias("w"), F.col("height").alias("h"), F.col("rgb").alias("decoded"))
    met = source.join(back, "frame_id").withColumn("error", media.mean_difference(F.col("rgb"), F.col("decoded")))
    return met.select("frame_id", F.col("w").alias("width"), F.col("h").alias("height"), F.length("decoded").alias("bytes"), F.sha2("decoded", 256).alias("decoded_sha256"), F.round("error", R).alias("error"))


@query()
def v3_person_regions(spark, d):
    """What moved in each frame, coded; the coded region is decoded again and told by its size and hash."""
    made = media.person_regions(frame_pairs(spark, d)).withColumnRenamed("cur_id", "frame_id")
    back = media.decode_video(made.where("coded is not null")).select("frame_id", "width", "height", F.sha2("rgb", 256).alias("decoded_sha256"))
    return made.join(back, "frame_id", "left").select(F.col("frame_id").alias("cur_id"), "bbox", "foreground", F.length("coded").alias("bytes"), "width", "height", "decoded_sha256")


def voice_frames(spark, d) -> DataFrame:
    e = scan(spark, d, "embeddings")
    return e.select(F.col("label").cast("long").alias("stream_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long").alias("sequence"), (F.col("vec_id") * 4).alias("timestamp_ms"), F.col("embedding").alias("samples"))


def voice_back(spark, d, layer: int) -> DataFrame:
    """Frames coded and decoded: how many samples, their energy, and the largest difference from those that went in."""
    source = voice_frames(spark, d)
    back = media.decode_voice(media.encode_voice(source, layer=layer)).withColumnRenamed("samples", "decoded")
    met = source.join(back, ["stream_id", "sequence"])
    energy = F.aggregate("decoded", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    error = F.array_max(F.zip_with("samples", "decoded", lambda a, b: F.abs(a - b).cast("double")))
    return met.select("stream_id", "sequence", "keyframe", F.size("decoded").cast("long").alias("samples"), F.round(energy, 3).alias("energy"), F.round(error, 3).alias("error"))


@query()
def v5_voice_parametric(spark, d):
    return voice_back(spark, d, 0)


@query()
def v6_voice_spectral(spark, d):
    return voice_back(spark, d, 1)


@query("""SELECT CAST(label AS BIGINT) AS stream_id, row_number() OVER w AS sequence, vec_id * 4 AS timestamp_ms, 0 AS layer, 16000 AS sample_rate, 64 AS frame_size,
  row_number() OVER w = 1 AS keyframe, true AS whole FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)""")
def s20_audio_frames(spark, d):
    """Audio frames written as bytes, their header read back by expressions on columns."""
    raw, at = media.encode_voice(voice_frames(spark, d)).select("stream_id", "raw"), scalar.uint_le
    fields = {"sequence": (0, 4), "timestamp_ms": (4, 8), "layer": (12, 1), "sample_rate": (13, 4), "frame_size": (17, 4)}
    r = F.col("raw")
    return raw.select("stream_id", *[at(r, *x).alias(k) for k, x in fields.items()], (at(r, 21, 1) == 1).alias("keyframe"), (at(r, 22, 4) + 26 == F.length(r)).alias("whole"))


@query(f"SELECT label AS stream_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS sequence, row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1 AS keyframe FROM embeddings")
def w9_voice_sequence(spark, d):
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    return longs(scan(spark, d, "embeddings").select(F.col("label").alias("stream_id"), "vec_id", n.alias("sequence"), (n == 1).alias("keyframe")))


@query(f"WITH {fx.SYNC} SELECT stream_id, entity % 16 AS block_x, entity // 16 AS block_y, dx, dy, abs(dx) + abs(dy) AS sad FROM sync WHERE kind = 'Motion'")
def b1_sync_vectors(spark, d):
    return bridges.vectors_of_events(fx.sync_events(spark, d), 16).select("stream_id", "block_x", "block_y", "dx", "dy", "sad")


@query(f"WITH {fx.SYNC} SELECT stream_id, entity, dx, dy, 0 AS dz FROM sync WHERE kind = 'Motion'")
def b1_sync_inverse(spark, d):
    v = bridges.vectors_of_events(fx.sync_events(spark, d), 16)
    return longs(bridges.motions_of_packets(bridges.packets_of_vectors(v, "stream_id", F.lit(41), "event_id", 4096), 16, "stream_id"))


SNAP = fx.BODIES + """, deltas AS (SELECT body_idx, t, x - lag(x) OVER w AS fx, y - lag(y) OVER w AS fy FROM bodies WINDOW w AS (PARTITION BY body_idx ORDER BY t)),
vec AS (SELECT body_idx, t, body_idx % 16 AS block_x, body_idx // 16 & 65535 AS block_y, CAST(greatest(-32768, least(32767, trunc(round(fx * 100, 6)))) AS BIGINT) AS dx, CAST(greatest(-32768, least(32767, trunc(round(fy * 100, 6)))) AS BIGINT) AS dy
  FROM deltas WHERE fx IS NOT NULL AND NOT (abs(fx) < 1e-6 AND abs(fy) < 1e-6))"""


@query(f"WITH {SNAP} SELECT *, abs(dx) + abs(dy) AS sad FROM vec")
def b2_w8_j5_snapshot(spark, d):
    return longs(bridges.snapshot_deltas(fx.bodies(spark, d), 16))


@query(f"WITH {SNAP} SELECT t, body_idx, round(dx / 100, {R}) AS fx, round(dy / 100, {R}) AS fy FROM vec")
def b2_body_deltas(spark, d):
    out = bridges.body_deltas(bridges.snapshot_deltas(fx.bodies(spark, d), 16), 16)
    return out.select("t", "body_idx", F.round("fx", R).alias("fx"), F.round("fy", R).alias("fy"))


@query(f"WITH {fx.BODIES} SELECT body_idx, count_if(same) AS skipped FROM (SELECT body_idx, abs(x - lag(x) OVER w) < 1e-6 AND abs(y - lag(y) OVER w) < 1e-6 AS same FROM bodies WINDOW w AS (PARTITION BY body_idx ORDER BY t)) GROUP BY 1")
def f7_still_bodies(spark, d):
    w = Window.partitionBy("body_idx").orderBy("t")
    still = (F.abs(F.col("x") - F.lag("x").over(w)) < 1e-6) & (F.abs(F.col("y") - F.lag("y").over(w)) < 1e-6)
    return fx.bodies(spark, d).withColumn("same", still).groupBy("body_idx").agg(F.count_if("same").alias("skipped"))


@query(f"WITH {fx.PACKETS} SELECT stream_id, sequence, {HEADER_SQL} AS raw_hex, false AS opened_by_other FROM packets")
def c1_seal_open(spark, d):
    p = fx.packets(spark, d)
    p = p.withColumn("raw", framing.header(F.col("packet_type"), F.col("sequence"), F.col("payload_len")))
    key = lambda secret: bridges.derive_key(F.col("stream_id"), F.lit(secret).cast("binary"))
    sealed = bridges.seal(p.select("stream_id", "sequence", "raw"), key("secret"))
    other = bridges.open_sealed(sealed, key("another")).select("stream_id", "sequence", F.col("raw").isNotNull().alias("opened_by_other"), "sealed")
    return bridges.open_sealed(other, key("secret")).select("stream_id", "sequence", F.hex("raw").alias("raw_hex"), "opened_by_other")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content FROM documents")
def c2_content_hash(spark, d):
    return scan(spark, d, "documents").select("doc_id", bridges.content_hash(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("content"))
