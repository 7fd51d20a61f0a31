"""Domain constants.

FIXED VALUES: the lists and tables below must equal the source application's
values for results to match. They are stated as plain data, in their natural
order, and are not derived from anything.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
REQUIRED_COLUMNS = [
    "timestamp", "source_ip", "destination_ip", "protocol",
    "bytes_sent", "bytes_received", "connection_duration",
]
OPTIONAL_COLUMNS = ["attack_type"]
NUMERIC_COLUMNS = ["bytes_sent", "bytes_received", "connection_duration"]
TEXT_FILL_COLUMNS = ["source_ip", "destination_ip", "protocol"]

ATTACK_TYPES = [
    "DDoS", "DoS", "Brute Force", "Port Scan",
    "SQL Injection", "Botnet", "Malware", "Phishing", "Unknown Threat",
]
PROTOCOLS = ["TCP", "UDP", "ICMP", "HTTP", "HTTPS"]

SEVERITY_WEIGHTS = {
    "DDoS": 0.95,
    "Botnet": 0.90,
    "Malware": 0.92,
    "SQL Injection": 0.88,
    "DoS": 0.80,
    "Brute Force": 0.65,
    "Phishing": 0.70,
    "Port Scan": 0.40,
    "Unknown Threat": 0.55,
    "Normal": 0.0,
}
DEFAULT_SEVERITY_WEIGHT = 0.5

# Upper bounds (inclusive) of the severity bands of the 0-100 threat score.
SEVERITY_BANDS = [(20, "Low"), (50, "Medium"), (80, "High")]
TOP_SEVERITY = "Critical"
SEVERITY_RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
SEVERITY_DISPLAY_ORDER = ["Critical", "High", "Medium", "Low"]

# Threat score blend: attack probability, anomaly, frequency, severity weight.
BLEND_WEIGHTS = {"attack": 0.35, "anomaly": 0.25, "frequency": 0.20, "severity": 0.20}

DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

RECOMMENDED_ACTIONS = {
    "DDoS": [
        "Block or rate-limit the identified source IP ranges at the edge/firewall.",
        "Enable upstream DDoS scrubbing or CDN-based mitigation if available.",
        "Activate connection rate limiting on affected services.",
        "Monitor bandwidth utilization for sustained anomalies.",
    ],
    "DoS": [
        "Apply rate limiting on the targeted service or endpoint.",
        "Block the offending source IP at the firewall.",
        "Review service resource limits (connections, threads) for resilience.",
        "Monitor for repeat attempts from the same source.",
    ],
    "Brute Force": [
        "Lock or temporarily disable the targeted account(s).",
        "Enforce account lockout / exponential backoff after failed attempts.",
        "Require multi-factor authentication on affected accounts.",
        "Block the source IP after repeated failed authentication attempts.",
    ],
    "Port Scan": [
        "Block the scanning source IP at the perimeter firewall.",
        "Review exposed ports and close any that are unnecessary.",
        "Enable intrusion detection alerts for sequential port access patterns.",
    ],
    "SQL Injection": [
        "Block the source IP and review affected application logs.",
        "Apply parameterized queries / input sanitization at the application layer.",
        "Deploy or update WAF rules targeting SQL injection patterns.",
        "Audit the targeted database for unauthorized access or data exfiltration.",
    ],
    "Botnet": [
        "Isolate and inspect the affected host(s) for malware/C2 implants.",
        "Block known command-and-control destination IPs.",
        "Run endpoint detection and response (EDR) scans on affected assets.",
        "Reset credentials on affected systems.",
    ],
    "Malware": [
        "Isolate the affected asset from the network immediately.",
        "Run a full endpoint antivirus/EDR scan and remove identified payloads.",
        "Review recent file and process activity on the affected host.",
        "Patch the vulnerability believed to have enabled infection.",
    ],
    "Phishing": [
        "Block the malicious sender domain / URL at the email gateway.",
        "Notify affected users and force credential resets if links were clicked.",
        "Search mail logs for other recipients of the same campaign.",
        "Conduct phishing-awareness refresher training.",
    ],
    "Unknown Threat": [
        "Escalate to a senior analyst for manual triage.",
        "Isolate the affected asset as a precaution pending investigation.",
        "Capture full packet/log context for forensic review.",
        "Update detection rules once the threat is characterized.",
    ],
}
FALLBACK_ACTION_TYPE = "Unknown Threat"

# Synthetic traffic profiles per label: (mean, std) of bytes sent, bytes
# received and duration, and the protocols the label uses.
TRAFFIC_PROFILES = {
    "Normal":         {"bs": (800, 400), "br": (1200, 600), "dur": (5, 3), "proto": ["TCP", "HTTPS", "HTTP", "UDP"]},
    "DDoS":           {"bs": (50, 30), "br": (20, 15), "dur": (0.2, 0.1), "proto": ["UDP", "ICMP"]},
    "DoS":            {"bs": (100, 50), "br": (30, 20), "dur": (0.5, 0.3), "proto": ["TCP", "UDP"]},
    "Brute Force":    {"bs": (150, 60), "br": (100, 40), "dur": (1, 0.5), "proto": ["TCP", "HTTPS"]},
    "Port Scan":      {"bs": (40, 20), "br": (10, 8), "dur": (0.1, 0.05), "proto": ["TCP"]},
    "SQL Injection":  {"bs": (600, 300), "br": (400, 200), "dur": (2, 1), "proto": ["HTTP", "HTTPS"]},
    "Botnet":         {"bs": (300, 150), "br": (250, 100), "dur": (8, 4), "proto": ["TCP", "UDP"]},
    "Malware":        {"bs": (900, 400), "br": (1500, 700), "dur": (10, 5), "proto": ["TCP", "HTTPS"]},
    "Phishing":       {"bs": (500, 250), "br": (700, 300), "dur": (3, 1.5), "proto": ["HTTP", "HTTPS"]},
    "Unknown Threat": {"bs": (400, 300), "br": (400, 300), "dur": (4, 3), "proto": PROTOCOLS},
}

# Model settings of the source application.
RF_TREES, RF_DEPTH = 80, 10
GBT_ROUNDS, GBT_DEPTH, GBT_STEP = 100, 5, 0.15
IFOREST_TREES, IFOREST_MAX_SAMPLES = 100, 256
DEFAULT_CONTAMINATION = 0.1
TEST_FRACTION = 0.25
MODEL_SEED = 42
MIN_CLASSIFIER_ROWS = 10
DEFAULT_ATTACK_RATIO = 0.22

TRAFFIC_SAMPLE_ROWS = 2000
TIME_RANGE = ("1677-09-21 00:12:44", "2262-04-11 23:47:16")

# Stored columns of a scored row.
EVENT_COLUMNS = [
    "timestamp", "source_ip", "destination_ip", "protocol", "bytes_sent", "bytes_received",
    "connection_duration", "predicted_label", "attack_type", "attack_type_predicted",
    "attack_type_confidence", "attack_probability", "anomaly_score", "is_anomaly",
    "frequency_score", "severity_weight", "threat_score", "severity",
]

# Labels of the report totals.
SUMMARY_ITEMS = [("Total Logs Analyzed", "total_logs"), ("Detected Attacks", "attack_count"),
                 ("Attack Percentage", "attack_pct"), ("Critical", "critical_count"),
                 ("High", "high_count"), ("Medium", "medium_count"), ("Low", "low_count")]
INCIDENT_SUMMARY_ITEMS = [("Total Logs Analyzed", "total_logs"), ("Detected Attacks", "attack_count"),
                          ("Critical Threats", "critical_count"), ("High Severity Threats", "high_count"),
                          ("Total Incidents Reported", "incident_count")]
LISTED_ADDRESSES = 10
# ------------------------------------------------------------ END FIXED VALUES

# Tokens the pandas CSV reader treats as missing by default (pandas docs).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
