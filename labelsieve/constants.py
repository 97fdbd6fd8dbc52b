"""Fixed values of the audit and its data model.

Everything in this module is a fixed value: names, spellings, thresholds and
tables that results depend on. They are stated once, here.
"""

# --- Labels and provenance columns ---
BINARY_LABEL = "Attack_label"
MULTICLASS_LABEL = "Attack_type"
LABEL_COLUMNS = (BINARY_LABEL, MULTICLASS_LABEL)
NORMAL_CLASS = "Normal"
DEVICE_COLUMN = "source_device"
LAYER_COLUMN = "source_layer"
PROVENANCE_COLUMNS = (DEVICE_COLUMN, LAYER_COLUMN)
ATTACK_PREFIX = "attack:"

# --- Columns the distributed recipe drops and dummy-encodes ---
RECIPE_DROP_COLUMNS = (
    "frame.time", "ip.src_host", "ip.dst_host", "arp.src.proto_ipv4",
    "arp.dst.proto_ipv4", "http.file_data", "http.request.full_uri",
    "icmp.transmit_timestamp", "http.request.uri.query", "tcp.options",
    "tcp.payload", "tcp.srcport", "tcp.dstport", "udp.port", "mqtt.msg",
)
RECIPE_DUMMY_COLUMNS = (
    "http.request.method", "http.referer", "http.request.version",
    "dns.qry.name.len", "mqtt.conack.flags", "mqtt.protoname", "mqtt.topic",
)

# --- Columns dropped when a benchmark is built (ports are kept) ---
IDENTIFIER_COLUMNS = (
    "frame.time", "ip.src_host", "ip.dst_host", "arp.src.proto_ipv4",
    "arp.dst.proto_ipv4", "http.file_data", "http.request.full_uri",
    "http.request.uri.query", "tcp.options", "tcp.payload", "mqtt.msg",
    "icmp.transmit_timestamp",
)

# --- Normal-traffic devices: name, part of the scenario, layer ---
DEVICES = (
    ("Soil_Moisture", True, "perception"),
    ("phValue", True, "perception"),
    ("Water_Level", True, "perception"),
    ("Temperature_and_Humidity", True, "perception"),
    ("Modbus", True, "actuation"),
    ("Distance", False, "perception"),
    ("Flame_Sensor", False, "perception"),
    ("Heart_Rate", False, "perception"),
    ("IR_Receiver", False, "perception"),
    ("Sound_Sensor", False, "perception"),
)
SCENARIO_DEVICES = tuple(name for name, in_scenario, _ in DEVICES if in_scenario)
ADVERSARY_LAYER = "adversary"

# --- Attack capture file stems and the class each one holds ---
ATTACK_CAPTURES = {
    "Backdoor_attack": "Backdoor",
    "DDoS_HTTP_Flood_attack": "DDoS_HTTP",
    "DDoS_ICMP_Flood_attack": "DDoS_ICMP",
    "DDoS_TCP_SYN_Flood_attack": "DDoS_TCP",
    "DDoS_UDP_Flood_attack": "DDoS_UDP",
    "MITM_attack": "MITM",
    "OS_Fingerprinting_attack": "Fingerprinting",
    "Password_attack": "Password",
    "Port_Scanning_attack": "Port_Scanning",
    "Ransomware_attack": "Ransomware",
    "SQL_injection_attack": "SQL_injection",
    "Uploading_attack": "Uploading",
    "Vulnerability_scanner_attack": "Vulnerability_scanner",
    "XSS_attack": "XSS",
}

# --- Spellings ---
MISSING_TOKEN = "<NA>"
STRING_ZERO = "0"
FLOAT_ZERO = "0.0"
ABSENT = "__absent__"
PLACEHOLDERS = ("0", "0.0", "", " ", "nan", "NaN", "<NA>", "None", "null", "NULL")
BENIGN_VALUES = ("0", "0.0", "normal", "benign", "background")
# What a CSV reader with default settings takes for a missing value.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- Injection markers: feature suffix and the characters it looks for ---
INJECTION_MARKERS = (
    ("has_angle_bracket", "<>"),
    ("has_quote", "'\""),
    ("has_path_separator", "/\\"),
    ("has_parenthesis", "()"),
    ("has_semicolon", ";"),
    ("has_equals", "="),
    ("has_dollar", "$"),
    ("has_whitespace", " \t"),
)

# --- Thresholds and defaults ---
RANDOM_SEED = 20260814
TEST_SIZE = 0.2
SEPARATION_THRESHOLD = 0.999
MAX_ONEHOT_CARDINALITY = 16
NUMERIC_PARSE_RATE = 0.99
MAX_ROWS_PER_DEVICE = 150_000
MAX_ROWS_PER_ATTACK = 60_000
Z_95 = 1.959963985
FOLD_METRICS = ("accuracy", "balanced_accuracy", "f1_macro")

# --- Uplink profiles in kbit/s, and bits per transmitted parameter ---
BACKHAUL_KBPS = {
    "lorawan_sf7": 5.47,
    "nb_iot": 250.0,
    "lte_cat_m1": 1000.0,
    "rural_4g": 5000.0,
}
BITS_PER_PARAMETER = 32

# Names of the structural features of a text column, after its name and two underscores.
STRUCTURAL_SUFFIXES = (
    "length", "digit_ratio", "alpha_ratio", "punct_ratio", "entropy", "has_angle_bracket", "has_quote",
    "has_path_separator", "has_parenthesis", "has_semicolon", "has_equals", "has_dollar", "has_whitespace",
)
