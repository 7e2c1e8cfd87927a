"""Fixed values of the formats: codes, names, tables and limits. They must equal what other readers expect."""

#: Packet header: magic, version, size; flags.
MAGIC_HEX = "41535031"
SCENE_MAGIC_HEX = "41534446"
VERSION = 1
HEADER_BYTES = 16
CRC_BYTES = 4
FLAGS = {"compressed": 1, "encrypted": 2, "fec": 4}

PACKET_TYPES = {1: "I", 2: "D", 3: "C", 4: "S"}
PATTERN_TYPES = {0: "Solid", 1: "GradientLinear", 2: "GradientRadial", 3: "Noise", 4: "Texture", 5: "Dct", 6: "Periodic", 7: "Complex"}
MOTION_TYPES = {0: "None", 1: "Linear", 2: "Easing", 3: "Oscillate", 4: "Path", 5: "Physics"}
ROI_TYPES = {0: "General", 1: "Face", 2: "Text", 3: "Edge", 4: "Motion", 5: "Custom"}
QUALITY_LEVELS = {0: "Low", 1: "Medium", 2: "High", 3: "Ultra"}
SYNC_COMMANDS = {1: "RequestKeyframe", 2: "Ack", 3: "Nack", 4: "EndOfStream", 5: "BitrateAdjust", 6: "QualityChange", 7: "Ping", 8: "Pong"}
ENUMS = {"packet_type": PACKET_TYPES, "pattern_type": PATTERN_TYPES, "motion_type": MOTION_TYPES, "roi_type": ROI_TYPES, "quality": QUALITY_LEVELS, "sync_command": SYNC_COMMANDS}
EASING_TYPES = {0: "Linear", 1: "EaseIn", 2: "EaseOut", 3: "EaseInOut", 4: "Bounce", 5: "Elastic"}
COMPRESSION_FORMATS = {0: "Raw", 1: "Rle", 2: "Lz4", 3: "Zstd", 4: "DeltaRle"}

#: JPEG luminance quantization (ITU-T T.81, table K.1), row-major.
LUMINANCE_QUANT = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]

EDGE_THRESHOLD, MOTION_THRESHOLD, CONTRAST_THRESHOLD, MIN_REGION_AREA, ROI_BLOCK = 30, 20, 50, 64, 16
RLE_MAX_RUN = 65535
