"""Names, thresholds, lookup rows and texts that results must equal word for word."""

from __future__ import annotations

# Windowing, model and scoring constants.
WINDOW_SIZE = 50
SEED = 42
DECAY = 1.5
TOLERANCE = 0.2
THREAT_WEIGHT, STABILITY_WEIGHT, PRESSURE_WEIGHT = 40.0, 30.0, 30.0
THRESHOLD_PERCENTILE = 0.05
TREND_STEP = 2.0
EMA_ALPHA = 0.3
MAX_TRAIN_ROWS = 5000
MAX_METRIC_ROWS = 50_000

# Capture classes in concatenation order.
CLASSES = ["Normal", "DoS", "Fuzzy", "Gear", "RPM"]

# Risk categories from best to worst, with their lower bounds.
CATEGORIES = [("Secure", 80.0), ("Stable", 60.0), ("Warning", 40.0), ("High Risk", 20.0), ("Critical", 0.0)]

# The 13 window features, in model order.
FEATURES = [
    "messages_per_second",
    "unique_can_ids_window",
    "can_id_entropy",
    "window_delta_time_mean",
    "window_delta_time_std",
    "window_delta_time_min",
    "window_delta_time_max",
    "window_payload_mean",
    "window_payload_std",
    "window_payload_entropy_mean",
    "message_burst_score",
    "frequency_spike_score",
    "payload_instability_score",
]
STABILITY_FEATURES = ["messages_per_second", "can_id_entropy", "unique_can_ids_window"]
PRESSURE_FEATURES = ["message_burst_score", "frequency_spike_score", "payload_instability_score"]

# Tracked features in order (feature, label, audience, component, penalised direction).
TRACKED = [
    ("messages_per_second", "CAN message rate", "technician", "Stability", "both"),
    ("unique_can_ids_window", "CAN ID diversity", "driver", "Stability", "both"),
    ("can_id_entropy", "CAN identifier entropy", "analyst", "Stability", "both"),
    ("message_burst_score", "message burst activity", "analyst", "Pressure", "positive"),
    ("frequency_spike_score", "timing irregularity", "analyst", "Pressure", "positive"),
    ("payload_instability_score", "payload variation", "technician", "Pressure", "positive"),
    ("anomaly_score", "overall anomaly signal", "fleet_manager", "Threat", "negative"),
]
COMPONENTS = ["Threat", "Stability", "Pressure"]

# Feature group shown next to each feature.
FEATURE_CATEGORY = [
    ("messages_per_second", "Communication Rate"),
    ("unique_can_ids_window", "CAN Diversity"),
    ("can_id_entropy", "CAN Diversity"),
    ("window_delta_time_mean", "Timing"),
    ("window_delta_time_std", "Timing"),
    ("window_delta_time_min", "Timing"),
    ("window_delta_time_max", "Timing"),
    ("window_payload_mean", "Payload"),
    ("window_payload_std", "Payload"),
    ("window_payload_entropy_mean", "Payload"),
    ("message_burst_score", "Attack Pressure"),
    ("frequency_spike_score", "Attack Pressure"),
    ("payload_instability_score", "Attack Pressure"),
]

# Control units (id, name, share of the base rate) and the unit each class targets.
ECUS = [
    ("0x0A", "Central Gateway (CGW)", 0.36),
    ("0x12", "Engine Control (ECU)", 0.14),
    ("0x1A", "Transmission Control (TCU)", 0.10),
    ("0x24", "Electronic Power Steering (EPS)", 0.16),
    ("0x32", "Anti-lock Braking (ABS)", 0.12),
    ("0x48", "Body Control Module (BCM)", 0.04),
    ("0x2C", "Infotainment (IVI)", 0.08),
]
TARGETS = [
    ("Normal", "—", "None"),
    ("DoS", "0x0A", "Central Gateway (CGW)"),
    ("Fuzzy", "0x32", "Anti-lock Braking (ABS)"),
    ("Gear", "0x1A", "Transmission Control (TCU)"),
    ("RPM", "0x12", "Engine Control (ECU)"),
]

# Who hears about a risk category, how, and how fast.
CATEGORY_ROUTING = [
    ("Secure", "Driver", "Dashboard indicator (green)", "None"),
    ("Stable", "Driver, Fleet Manager", "Dashboard + log entry", "Low"),
    ("Warning", "Fleet Manager", "Notification + report", "Medium"),
    ("High Risk", "Fleet Manager + Engineer", "Alert + detailed report", "High"),
    ("Critical", "All + SOC", "Emergency alert", "Immediate"),
]

# Explanation texts per risk category (summary, trend, root cause, forecast, response).
# A name in braces is replaced by the prepared text of that name.
TEMPLATES = [
    (
        "Secure",
        "Vehicle cybersecurity status is Secure. No anomalous activity detected.",
        "Cyber Health is {health}/100 and {trend} over the last {lookback} windows. "
        "All monitoring dimensions show normal behavior.",
        "No significant deviations detected. All features within expected operating ranges.",
        "Projected to remain Secure at {forecast}/100 over the next {horizon} windows.",
        "No action required. Continue passive monitoring.",
    ),
    (
        "Stable",
        "Vehicle cybersecurity status is Stable. Minor behavioral variance detected, "
        "consistent with normal driving conditions.",
        "Cyber Health is {health}/100 and {trend} over the last {lookback} windows.",
        "Slight deviation in {primary_label} ({primary_z} sigma from baseline). No immediate threat indicators present.",
        "Projected health of {forecast}/100. Expected to remain Stable with no escalation to Warning level.",
        "Monitor trend over the next 20 windows. No intervention required at this time.",
    ),
    (
        "Warning",
        "Vehicle cybersecurity status is Warning. Moderate behavioral anomalies detected "
        "that deviate from normal operating patterns.",
        "Cyber Health declined to {health}/100 and is {trend} over the last {lookback} windows. "
        "Primary concern: {primary_component} component.",
        "Primary driver: {primary_component} — {primary_label} is {primary_z} sigma "
        "from normal baseline. Secondary contributor: {secondary_component}.",
        "Forecast indicates health may reach {forecast}/100 within {horizon} windows "
        "if the current trajectory continues.",
        "Investigate root cause. Cross-reference with vehicle diagnostics. "
        "Prepare countermeasure playbook if trend degrades further.",
    ),
    (
        "High Risk",
        "HIGH RISK: Strong indicators of active cyber attack detected. "
        "Vehicle cybersecurity is compromised — immediate attention required.",
        "Cyber Health dropped to {health}/100 and is {trend} over the last {lookback} windows. "
        "Primary concern: {primary_component} component ({component_pct}% of normal).",
        "Attack signature detected. Primary driver: {primary_component} — "
        "{primary_label} at {primary_z} sigma from normal ({primary_direction}). "
        "Secondary feature: {secondary_label} at {secondary_z} sigma.",
        "Critical escalation risk. Health projected at {forecast}/100 "
        "in {horizon} windows — may cross into Critical range.",
        "ACTIVATE COUNTERMEASURES: Isolate suspected ECUs. Enable rate-limiting on CAN bus. "
        "Alert fleet operator. Log forensic data for post-incident analysis.",
    ),
    (
        "Critical",
        "CRITICAL: Confirmed cyber attack in progress. Vehicle cybersecurity health is at a dangerous level.",
        "Cyber Health is {health}/100 — Critical level. "
        "Health has {trend} by {trend_size} points over the last {lookback} windows.",
        "Confirmed attack pattern. Primary driver: {primary_component} — "
        "{primary_label} at {primary_z} sigma from normal ({primary_direction}). "
        "Multiple features outside safe bounds: {feature_list}.",
        "Health projected to remain at {forecast}/100 or lower. "
        "Immediate intervention required to prevent system compromise.",
        "EMERGENCY RESPONSE: Isolate vehicle from network. Engage fail-safe mode on all ECUs. "
        "Initiate forensic data capture. Alert security operations center.",
    ),
]

# Known attacks (class, label, mechanism, signature, impact, mitigation).
ATTACKS = [
    (
        "DoS",
        "Denial of Service",
        "CAN bus flooding with high-priority messages",
        "elevated message rate with reduced CAN ID diversity",
        "bandwidth exhaustion, ECU denial of service",
        "rate-limiting gateway filter, suspect ECU isolation",
    ),
    (
        "Fuzzy",
        "Fuzzy",
        "Randomized CAN ID and payload injection",
        "abnormal CAN ID diversity and entropy",
        "unpredictable ECU behavior, potential system crash",
        "CAN ID whitelist, payload validation gateway",
    ),
    (
        "Gear",
        "Gear Spoofing",
        "Fabricated gear position messages",
        "timing irregularity with payload manipulation",
        "erratic transmission behavior, safety risk",
        "plausibility checks, sensor cross-validation",
    ),
    (
        "RPM",
        "RPM Spoofing",
        "Fabricated engine RPM messages",
        "timing irregularity with payload manipulation",
        "erratic engine control, safety risk",
        "plausibility checks, sensor cross-validation",
    ),
]

# Response levels (level, label, outcome, recovery, safety note).
LEVELS = [
    (0, "Monitor", "No anomalies — continued safe operation", "Automatic — no recovery needed", "No safety impact"),
    (1, "Alert", "Operator notified; threat assessment in progress", "Automatic — resolve on trend improvement",
     "No safety impact"),
    (2, "Contain", "Attack contained; further spread prevented",
     "Semi-automatic — resume normal after N windows of stable health > 60", "Minimal — actions are reversible"),
    (3, "Mitigate", "Attack mitigated; vehicle operating in degraded mode",
     "Manual review — operator must verify before full recovery",
     "Moderate — degraded vehicle functionality expected"),
    (4, "Emergency Response", "Emergency response active; vehicle in safe state",
     "Full system reset — service center inspection required", "HIGH — vehicle may enter limp-home mode"),
]
# What each response level means for the vehicle.
LEVEL_DESCRIPTIONS = [
    "Passive monitoring — no threats detected",
    "Operator notification on suspicious activity",
    "Isolate suspected ECUs from CAN bus",
    "Deploy countermeasures against confirmed attacks",
    "Full system isolation and fail-safe mode",
]
GENERIC_ACTION_TEXT = "Generic response — escalate to operator"
SAFETY_SUFFIX = [("gear", "; transmission safety at risk"), ("rpm", "; engine safety at risk")]

# Playbook actions
# (class, level, id, name, description, target, execution ms, automated, reversible, side effects).
PLAYBOOK = [
    ("DoS", 0, "dos_mon_1", "Passive monitoring", "Monitor CAN bus message rate and ID distribution",
     "CAN bus", 0, True, True, "none"),
    ("DoS", 1, "dos_alert_1", "Rate anomaly notification", "Alert fleet operator of abnormal CAN message rate",
     "network", 5, True, True, "none"),
    ("DoS", 2, "dos_cont_1", "Rate limiting activation", "Activate gateway rate limiter for suspected CAN IDs",
     "CAN bus", 50, True, True, "may delay legitimate high-priority messages"),
    ("DoS", 2, "dos_cont_2", "Suspected ECU monitoring", "Increase sampling rate on suspected ECU",
     "ECU", 20, True, True, "none"),
    ("DoS", 3, "dos_mit_1", "Suspected ECU isolation", "Isolate compromised ECU from CAN bus",
     "ECU", 200, True, False, "loss of function from isolated ECU"),
    ("DoS", 3, "dos_mit_2", "Traffic filtering", "Drop messages from suspicious CAN IDs at gateway",
     "CAN bus", 30, True, True, "none"),
    ("DoS", 4, "dos_emer_1", "Full CAN bus segmentation", "Segment CAN bus into secure zones",
     "CAN bus", 500, True, False, "temporary loss of cross-zone communication"),
    ("DoS", 4, "dos_emer_2", "Emergency fail-safe mode", "Engage vehicle limp-home mode",
     "vehicle", 1000, True, False, "reduced vehicle functionality"),
    ("DoS", 4, "dos_emer_3", "SOC escalation", "Escalate to security operations center with forensics",
     "network", 50, False, True, "none"),
    ("Fuzzy", 0, "fz_mon_1", "CAN ID entropy monitoring", "Track CAN ID entropy and diversity metrics",
     "CAN bus", 0, True, True, "none"),
    ("Fuzzy", 1, "fz_alert_1", "ID diversity alert", "Alert operator of abnormal CAN ID entropy",
     "network", 5, True, True, "none"),
    ("Fuzzy", 2, "fz_cont_1", "Invalid frame monitoring", "Flag messages from unrecognized CAN IDs",
     "CAN bus", 20, True, True, "none"),
    ("Fuzzy", 2, "fz_cont_2", "Enhanced payload inspection", "Deep packet inspection on flagged messages",
     "CAN bus", 30, True, True, "none"),
    ("Fuzzy", 3, "fz_mit_1", "CAN ID whitelist enforcement", "Block all messages from non-whitelisted CAN IDs",
     "CAN bus", 150, True, False, "may block legitimate new CAN IDs"),
    ("Fuzzy", 3, "fz_mit_2", "Invalid frame blocking", "Drop frames with invalid payload patterns",
     "CAN bus", 30, True, True, "none"),
    ("Fuzzy", 4, "fz_emer_1", "Full ID lockdown", "Lock CAN bus to known-good ID set only",
     "CAN bus", 200, True, False, "blocks all new CAN communications"),
    ("Fuzzy", 4, "fz_emer_2", "Network segmentation", "Isolate affected CAN segment",
     "CAN bus", 500, True, False, "temporary zone isolation"),
    ("Fuzzy", 4, "fz_emer_3", "Emergency diagnostics", "Log all CAN traffic for forensic analysis",
     "CAN bus", 100, True, True, "none"),
    ("Gear", 0, "gr_mon_1", "Gear message monitoring", "Monitor gear position message rate and values",
     "CAN bus", 0, True, True, "none"),
    ("Gear", 1, "gr_alert_1", "Gear anomaly notification", "Alert operator of inconsistent gear messages",
     "network", 5, True, True, "none"),
    ("Gear", 2, "gr_cont_1", "Sensor cross-validation", "Cross-check gear position against wheel speed and RPM",
     "ECU", 40, True, True, "none"),
    ("Gear", 2, "gr_cont_2", "Plausibility check activation",
     "Validate gear transitions against vehicle dynamics model", "ECU", 30, True, True, "none"),
    ("Gear", 3, "gr_mit_1", "Message plausibility filtering", "Drop implausible gear messages at gateway",
     "CAN bus", 50, True, True, "none"),
    ("Gear", 3, "gr_mit_2", "Driver notification", "Display gear sensor warning on dashboard",
     "driver", 10, True, True, "none"),
    ("Gear", 4, "gr_emer_1", "Gear sensor isolation", "Ignore gear sensor input; use inferred gear from speed/RPM",
     "ECU", 200, True, False, "gear display may lag"),
    ("Gear", 4, "gr_emer_2", "Transmission protection mode",
     "Engage transmission safe mode to prevent mechanical damage", "vehicle", 300, True, False,
     "reduced transmission responsiveness"),
    ("Gear", 4, "gr_emer_3", "Service center alert", "Schedule immediate service center visit",
     "network", 20, False, True, "none"),
    ("RPM", 0, "rp_mon_1", "RPM message monitoring", "Monitor engine RPM message rate and values",
     "CAN bus", 0, True, True, "none"),
    ("RPM", 1, "rp_alert_1", "RPM anomaly notification", "Alert operator of abnormal RPM readings",
     "network", 5, True, True, "none"),
    ("RPM", 2, "rp_cont_1", "RPM sensor cross-validation",
     "Cross-check RPM against wheel speed and engine acoustics", "ECU", 40, True, True, "none"),
    ("RPM", 2, "rp_cont_2", "Engine behavior analysis", "Analyze RPM patterns for spoofing signatures",
     "ECU", 30, True, True, "none"),
    ("RPM", 3, "rp_mit_1", "RPM plausibility filtering", "Filter implausible RPM values at gateway",
     "CAN bus", 50, True, True, "none"),
    ("RPM", 3, "rp_mit_2", "Engine protection mode", "Limit engine output to safe range",
     "vehicle", 100, True, False, "reduced engine performance"),
    ("RPM", 4, "rp_emer_1", "RPM sensor isolation", "Ignore spoofed RPM sensor; use inferred RPM",
     "ECU", 200, True, False, "RPM reading may be approximate"),
    ("RPM", 4, "rp_emer_2", "Safe fallback logic", "Engage engine safe mode with fixed RPM limits",
     "vehicle", 300, True, False, "vehicle speed may be limited"),
    ("RPM", 4, "rp_emer_3", "Mechanical integrity check", "Verify engine mechanical status before resume",
     "ECU", 500, False, False, "none"),
]
