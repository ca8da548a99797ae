"""Fixed values that results depend on, stated as plain text."""

from __future__ import annotations

# --- fixed values: candidate column names -------------------------------------
COMMON_LABEL_CANDIDATES = ["label", "class", "attack_type", "attack type", "attack", "category"]
COMMON_TIMESTAMP_CANDIDATES = ["timestamp", "time", "ts", "datetime", "date_time", "flow_time"]
COMMON_SPLIT_CANDIDATES = ["split", "partition", "subset", "set", "fold"]

ADAPTER_LABEL_CANDIDATES = [
    "label", "Label", "class", "Class", "attack", "Attack", "category", "Category", "traffic_type", "Traffic Type",
]
ADAPTER_TIME_CANDIDATES = [
    "timestamp", "Timestamp", "time", "Time", "ts", "stime", "StartTime", "Flow Start", "flow_start",
]
ADAPTER_ID_CANDIDATES = ["record_id", "id", "ID", "uid", "flow_id", "Flow ID", "No.", "index"]

# --- fixed values: split names -------------------------------------------------
SPLIT_ALIASES = {
    "train": "train", "training": "train",
    "val": "val", "valid": "val", "validation": "val", "dev": "val",
    "test": "test", "testing": "test", "eval": "test", "evaluation": "test", "holdout": "test",
    "all": "all", "full": "all",
}

# --- fixed values: columns kept out of the features ----------------------------
RESERVED_PREFIXES = ("sim_", "gt_", "source_")
DROP_PATTERNS = [
    "payload", "raw_bytes", "byte_payload", "message_id", "msg_id", "command", "mavlink_msg", "application",
    "app_", "tls_sni", "hostname", "host_name", "url", "uri", "dns_query", "src_ip", "dst_ip", "source_ip",
    "destination_ip", "ip_src", "ip_dst", "five_tuple", "flow_id", "session_id",
]
PORT_PATTERNS = ["src_port", "dst_port", "source_port", "destination_port", "sport", "dport"]
RESERVED_COLUMNS = frozenset({
    "uav_id",
    "domain_id",
    "dataset_name",
    "split",
    "source_type",
    "simulation_role",
    "source_note",
    "source_timestamp",
    "source_record_id",
    "source_uav_id",
    "source_dataset_name",
    "source_label",
    "direction_type",
    "scenario_role",
    "original_group_id",
    "mission_phase",
    "mission_context",
    "sim_source",
    "sim_time",
    "record_kind",
    "attack_source_dataset",
    "attack_active",
    "attack_type",
    "gt_attack_active",
    "gt_attack_type",
    "response_action",
    "response_time",
    "response_reason",
    "battery_soc",
    "speed",
    "altitude",
    "rssi",
    "snr",
    "latency_ms",
    "loss_rate",
    "distance_to_gcs",
    "wind_level",
    "obstacle_factor",
    "bytes_up",
    "bytes_down",
    "throughput_bytes",
    "cpu_load",
    "board_temperature_c",
    "flight_energy_wh",
    "communication_energy_wh",
    "detection_energy_wh",
    "total_energy_wh",
    "cumulative_energy_wh",
    "energy",
})

# --- fixed values: label maps per source ---------------------------------------
# kind "raw" maps the trimmed cell; kind "token" maps the normalised token.
LABEL_MAPS: dict[str, dict[str, str]] = {
    "uav_ndd": {
        "Normal": "benign", "ICMP Flooding": "icmp_flooding", "UDP Flooding": "udp_flooding", "DoS": "dos",
        "DDoS": "ddos", "BruteForce": "bruteforce", "MITM": "mitm", "De-authentication": "deauthentication",
        "FakeLanding": "fake_landing", "replay": "replay", "Replay": "replay", "Jamming": "jamming",
        "Scanning": "recon_scanning", "Reconnassiance": "recon_scanning",
    },
    "gcs_to_uav_updated": {
        "Normal": "benign", "DoS": "dos", "DDoS": "ddos", "Bruteforce": "bruteforce", "MITM": "mitm",
        "Reco": "recon_scanning", "Scanning": "recon_scanning", "Reply": "replay", "FakeLanding": "fake_landing",
        "Evil": "evil",
    },
    "isot_drone": {
        "Regular": "benign", "DoS": "dos", "MITM": "mitm", "Password Cracking": "bruteforce",
        "Injection": "injection", "Ip Spoofing": "ip_spoofing", "Manipulation": "payload_manipulation",
        "Replay": "replay", "Video": "video_interception", "Unauth": "unauthorized_udp",
    },
    "uavs_normal_cyberattacks": {"benign": "benign", "DoS attack": "dos", "Replay": "replay"},
    "unsw_nb15": {
        "0": "benign", "1": "attack", "benign": "benign", "normal": "benign", "generic": "generic",
        "exploits": "exploits", "fuzzers": "fuzzers", "dos": "dos", "reconnaissance": "reconnaissance",
        "recon": "reconnaissance", "analysis": "analysis", "backdoor": "backdoor", "backdoors": "backdoor",
        "shellcode": "shellcode", "worms": "worms",
    },
    "ecu_ioft": {
        "benign": "benign", "normal": "benign", "no_attack": "benign",
        "wi_fi_deauthentication_attack": "wifi_deauth", "wifi_deauthentication_attack": "wifi_deauth",
        "wifi_deauth": "wifi_deauth", "wi_fi_deauth": "wifi_deauth", "deauthentication": "wifi_deauth",
        "wpa2_psk_wifi_cracking_attack": "wpa_cracking", "wpa2_psk_cracking_attack": "wpa_cracking",
        "wpa_cracking": "wpa_cracking", "wifi_cracking": "wpa_cracking", "wifi_cracking_attack": "wpa_cracking",
        "tello_api_exploit": "tello_api_exploit",
    },
    "uavids": {
        "benign": "benign", "normal": "benign", "normal_traffic": "benign", "flooding_attack": "flooding",
        "flood_attack": "flooding", "flooding": "flooding", "dos": "dos", "dos_attack": "dos",
        "sybil_attack": "sybil", "sybil": "sybil", "blackhole_attack": "blackhole", "blackhole": "blackhole",
        "wormhole_attack": "wormhole", "wormhole": "wormhole",
    },
}
RAW_LABEL_MAPS = frozenset({"uav_ndd", "gcs_to_uav_updated", "isot_drone", "uavs_normal_cyberattacks"})

BENIGN_ALIASES = ["benign", "normal", "background", "legitimate", "0", "none"]
DIRECTION_MARKERS = ["uav", "src", "out", "up", "forward"]

ATTACK_LABEL_ALIASES = {
    "jamming_proxy": "jamming", "flood": "udp_flooding", "scan": "recon_scanning",
    "command_injection": "injection", "replay": "replay", "benign": "benign",
}

# --- fixed values: entity registry ----------------------------------------------
# uav_id, dataset_name, dataset_display, dataset_role, source_type, simulation_role, source_note, aliases
REGISTRY_ROWS = [
    ("uav_01", "uav_ndd", "UAV-NDD", "core_uav", "uav", "uav_replay", "", ["UAV-NDD Dataset"]),
    ("uav_02", "gcs_to_uav_updated", "GCS-to-UAV Updated", "core_uav", "uav", "uav_replay", "",
     ["GCS to UAV Updated", "GCS-to-UAV Updated Dataset"]),
    ("uav_03", "isot_drone", "ISOT Drone Dataset", "core_uav", "uav", "uav_replay", "", ["ISOT Drone"]),
    ("uav_05", "unsw_nb15", "UNSW-NB15", "external_non_uav", "external_non_uav", "external_ood",
     "External OOD/generalization source, not real UAV flight traffic.", ["UNSW NB15"]),
    ("uav_06", "ecu_ioft", "ECU-IoFT-main", "extended_uav", "uav_iot_wifi", "uav_replay", "",
     ["ECU-IoFT", "ECU IoFT", "ECU-IoFT Main", "ECU IoFT Main"]),
    ("uav_07", "uavids", "UAVIDS", "extended_uav", "uav", "uav_replay", "", ["UAVIDS Dataset"]),
]

PREPARED_PREFIX = [
    "record_id", "timestamp", "uav_id", "dataset_name", "source_type", "label", "label_normalized", "split",
]

SCORE_NAMES = ("conf", "energy", "proto", "knn")
FUSION_MODES = (
    "correlation_aware", "mean", "hard_voting", "variance_weighted", "conf", "energy", "proto", "knn",
)
FUSION_ALIASES = {"validation_weighted": "variance_weighted"}
GLOBAL_STREAM_KEY = "__stream__global__"
UNGROUPED = "__ungrouped__"
WINDOW_SETTINGS = [(8, 4), (16, 8), (32, 16), (64, 32)]

PHASE_ORDER = ["idle", "takeoff", "climb", "cruise", "hover", "return_home", "land", "emergency"]
ATTACK_MODES = ["single_attack", "mixed_attack"]
