"""Fixed values of the domain: enumerations, lookup tables, thresholds and texts.

Everything here is data that results depend on; no logic.
"""

from __future__ import annotations

# --- enumerations -----------------------------------------------------------
SHIPMENT_STATUSES = ["In Transit", "Delivered", "Delayed", "Pending", "Cancelled"]
TRAFFIC_STATUSES = ["Clear", "Heavy", "Detour"]
DELAY_REASONS = ["None", "Weather", "Traffic", "Mechanical Failure", "Other"]
VOYAGE_STATUSES = ["pending", "in_transit", "delivered", "delayed", "cancelled"]
OPEN_STATUSES = ["pending", "in_transit"]
NOTIFYING_EVENTS = ["departed", "arrived", "delayed", "customs_cleared"]

CSV_COLUMNS = [
    "Timestamp", "Asset_ID", "Latitude", "Longitude", "Inventory_Level", "Shipment_Status",
    "Temperature", "Humidity", "Traffic_Status", "Waiting_Time", "User_Transaction_Amount",
    "User_Purchase_Frequency", "Logistics_Delay_Reason", "Asset_Utilization", "Demand_Forecast",
    "Logistics_Delay",
]

# --- defaults of columns a training file may lack ---------------------------
TRAINING_DEFAULTS = {
    "asset_id": "Unknown",
    "status": "In Transit",
    "traffic_conditions": "Normal",
    "weather_conditions": "Clear",
    "delay_reason": "None",
}
LEAKAGE_COLUMNS = ["shipment_status", "logistics_delay", "logistics_delay_reason", "status", "delay_reason"]

# --- ports, congestion and routes -------------------------------------------
# name fragment, latitude, longitude; the first fragment found in a port name wins
PORT_COORDINATES = [
    ("shanghai", 31.2304, 121.4737),
    ("singapore", 1.3521, 103.8198),
    ("rotterdam", 51.9244, 4.4777),
    ("los angeles", 33.7501, -118.2537),
    ("hamburg", 53.5511, 9.9937),
    ("antwerp", 51.2194, 4.4025),
    ("hong kong", 22.3193, 114.1694),
    ("dubai", 25.2048, 55.2708),
    ("new york", 40.7128, -74.0060),
    ("bremen", 53.0793, 8.8017),
]
PORT_CONGESTION = [
    ("shanghai", 0.7),
    ("los angeles", 0.8),
    ("singapore", 0.4),
    ("rotterdam", 0.3),
    ("hamburg", 0.3),
    ("antwerp", 0.4),
]
ROUTE_COMPLEXITY = [
    ("shanghai", "los angeles", 0.8),
    ("singapore", "rotterdam", 0.9),
    ("hamburg", "new york", 0.7),
    ("dubai", "singapore", 0.6),
]
PORT_NAMES = [
    "Shanghai", "Singapore", "Rotterdam", "Los Angeles", "Hamburg",
    "Antwerp", "Hong Kong", "Dubai", "New York", "Bremen",
]
DESTINATION_PORTS = ["Shanghai", "Singapore", "Rotterdam", "Los Angeles", "Hamburg"]
COMPANIES = [
    "Global Logistics Corp", "Maritime Transport Ltd", "Ocean Freight Solutions",
    "Continental Shipping", "Express Cargo Services", "International Trade Co",
    "Worldwide Logistics", "Premier Transport", "Cargo Express Inc", "Supply Chain Masters",
]
CONTACT_CHANNELS = ["email", "sms", "phone", "webhook"]
CONTAINER_TYPES = ["20GP", "40GP", "40HC", "45HC"]
CARGO_TYPES = ["electronics", "textiles", "machinery", "chemicals"]

# --- KPI thresholds, benchmarks, scenarios ----------------------------------
# name, target, warning, critical, True where lower values are better
KPI_THRESHOLDS = [
    ("on_time_delivery_rate", 95.0, 90.0, 85.0, False),
    ("delay_rate", 5.0, 10.0, 15.0, True),
    ("avg_delivery_time", 3.0, 4.0, 5.0, True),
    ("ml_model_accuracy", 85.0, 80.0, 75.0, False),
    ("prediction_reliability", 90.0, 85.0, 80.0, False),
    ("cost_savings_from_predictions", 15.0, 10.0, 5.0, False),
    ("customer_satisfaction", 4.5, 4.0, 3.5, False),
]
# name, excellent, good, average, poor, True where lower values are better
BENCHMARKS = [
    ("on_time_delivery_rate", 98.0, 95.0, 90.0, 85.0, False),
    ("delay_rate", 2.0, 5.0, 10.0, 15.0, True),
    ("customer_satisfaction", 4.8, 4.5, 4.0, 3.5, False),
]
# name, factor on the delay rate, volume change, efficiency gain, description, assumptions
SCENARIOS = [
    ("optimistic", 0.9, 15, 12, "Best case scenario with improved operations",
     ["10% improvement in delay rate", "Enhanced ML prediction accuracy", "Optimized asset utilization"]),
    ("realistic", 1.0, 5, 3, "Most likely scenario based on current trends",
     ["Current trends continue", "Moderate operational improvements", "Stable external conditions"]),
    ("pessimistic", 1.15, -5, -8, "Worst case scenario with potential challenges",
     ["15% increase in delays due to external factors", "Resource constraints", "Market volatility"]),
]
KPI_ACTIONS = {
    "on_time_delivery_rate": [
        "Implement real-time delay prediction and alerts",
        "Optimize routing algorithms",
        "Enhance asset maintenance schedules",
        "Improve coordination with port authorities",
    ],
    "delay_rate": [
        "Identify and address root causes of delays",
        "Implement preventive maintenance programs",
        "Optimize scheduling and resource allocation",
        "Enhance communication with stakeholders",
    ],
    "customer_satisfaction": [
        "Improve communication with customers",
        "Reduce delivery delays",
        "Enhance tracking and visibility",
        "Implement proactive issue resolution",
    ],
}

# --- prediction texts --------------------------------------------------------
PREDICTION_ADVICE = {
    "high": [
        "High delay risk detected. Consider alternative routes or expedited shipping.",
        "Proactively communicate with customer about potential delays.",
    ],
    "moderate": [
        "Moderate delay risk. Monitor shipment closely.",
        "Consider notifying customer of potential delay.",
    ],
    "weather": "Severe weather conditions detected. Consider delaying departure if possible.",
    "congestion": "High port congestion detected. Consider alternative ports or routes.",
    "history": "This route has historical delay patterns. Add buffer time to schedule.",
    "default": "Low delay risk. Proceed with standard handling procedures.",
    "failed": "Unable to generate prediction. Please check manually.",
}

# --- alert rules -------------------------------------------------------------
# name, trigger, priority, cool-down minutes, enabled, conditions
ALERT_RULES = [
    ("high_delay_risk", "high_delay_risk", "HIGH", 30, True,
     {"min_delay_probability": "0.8", "risk_level": "High"}),
    ("multiple_high_risks", "multiple_high_risks", "CRITICAL", 120, True,
     {"min_high_risk_count": "3", "max_risk_percentage": "30.0"}),
    ("status_change", "status_change", "MEDIUM", 5, True,
     {"notify_on_delay": "true", "notify_on_delivery": "false", "notify_on_cancellation": "true"}),
    ("ml_model_performance", "ml_model_performance", "HIGH", 180, True,
     {"min_accuracy": "0.7", "max_prediction_errors": "10"}),
    ("system_health", "system_health", "HIGH", 60, True,
     {"api_response_time_threshold": "5.0", "database_error_threshold": "5", "ml_service_availability": "true"}),
]
# notification type, priority, channels
NOTIFICATION_TYPES = [
    ("delay_prediction", "HIGH", ["email", "webhook"]),
    ("status_change", "MEDIUM", ["email"]),
    ("high_risk_alert", "CRITICAL", ["email", "webhook", "slack"]),
    ("system_alert", "MEDIUM", ["email", "webhook"]),
]
DEFAULT_PREFERENCES = {
    "delay_prediction": True,
    "status_change": True,
    "high_risk_alert": True,
    "system_alert": True,
    "ml_model_alert": True,
    "operational_insight": False,
}
MAX_RETRIES = 3
MIN_COMMUNICATION_KEEP_DAYS = 2555
MAX_PREDICTION_KEEP_DAYS = 180

# --- customer messages (fixed texts) ---------------------------------------------------
DEFAULT_DELAY_REASON = "operational factors"
DEFAULT_ACTIONS = "Our team is working to minimize any impact to your delivery schedule."
FALLBACK_SUBJECT = "Shipment Update"
FALLBACK_TEXT = "We have an update regarding your shipment. Please contact our customer service team for more information."
FALLBACK_RECIPIENT = "customer@example.com"

# (context, channel) -> subject and body; {name} is replaced by the column of that name
TEMPLATES = {
    ("delay_notification", "email"): (
        "Important Update: Shipment {shipment_id} Delay Notification",
        "Dear {customer_name}, shipment {shipment_id} ({cargo_type}) from {origin_port} to {destination_port}, due {scheduled_eta}, "
        "is expected {delay_hours} hours late due to {delay_reason}. Revised ETA: {new_eta}. {actions} We apologize for the inconvenience.",
    ),
    ("delay_notification", "sms"): (
        None,
        "Shipment {shipment_id} may be delayed by {delay_hours}h due to {delay_reason}. New ETA: {new_eta}. We apologize for any inconvenience.",
    ),
    ("shipment_update", "email"): (
        "Shipment {shipment_id} Status Update",
        "Dear {customer_name}, the current status of shipment {shipment_id} is {status}. Location: {location}. Updated ETA: {new_eta}.",
    ),
    ("shipment_update", "sms"): (None, "Shipment {shipment_id} status: {status}. Location: {location}. ETA: {new_eta}."),
    ("proactive_communication", "email"): (
        "Proactive Update: Your Shipment {shipment_id}",
        "Dear {customer_name}, shipment {shipment_id} is progressing well and remains on schedule for {scheduled_eta}. "
        "Location: {location}. No delays are anticipated at this time.",
    ),
}
CONTACT_FOOTER = "\n\n---\nFor questions or concerns, contact our customer service."
