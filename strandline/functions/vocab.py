"""Vocabularies and constants that results depend on."""

# Equipment class codes.
EQUIPMENT_CLASSES = {
    "P": "Pump", "C": "Compressor", "K": "Blower", "E": "Heat exchanger", "V": "Vessel / drum", "D": "Drum", "T": "Tower / column", "TK": "Tank", "M": "Motor",
    "F": "Furnace / filter", "B": "Boiler", "R": "Reactor", "G": "Generator", "A": "Agitator", "H": "Heater", "S": "Separator", "X": "Miscellaneous / package",
    "FN": "Fan", "AG": "Air cooler", "CV": "Conveyor",
}

# Words that stand for a class code in one segment of a tag.
SEGMENT_WORDS = {
    "PUMP": "P", "PMP": "P", "PU": "P", "COMP": "C", "COMPRESSOR": "C", "BLOWER": "K", "EXCH": "E", "EXCHANGER": "E", "HX": "E", "HTX": "E", "VES": "V",
    "VESSEL": "V", "DRUM": "D", "COLUMN": "T", "TOWER": "T", "TANK": "TK", "MTR": "M", "MOTOR": "M", "FURN": "F", "FURNACE": "F", "FILTER": "F", "BOILER": "B",
    "REACTOR": "R", "GEN": "G", "FAN": "FN",
}

# ISA 5.1 first and succeeding letters.
ISA_FIRST = {
    "A": "Analysis", "B": "Burner / combustion", "C": "Conductivity", "D": "Density", "E": "Voltage", "F": "Flow", "H": "Hand (manual)", "I": "Current",
    "J": "Power", "K": "Time / schedule", "L": "Level", "M": "Moisture", "P": "Pressure", "Q": "Quantity / totalised", "R": "Radiation",
    "S": "Speed / frequency", "T": "Temperature", "V": "Vibration", "W": "Weight / force", "Z": "Position",
}
ISA_SUCCEEDING = {
    "A": "Alarm", "C": "Control", "E": "Element (primary sensor)", "G": "Glass / gauge", "I": "Indicate", "L": "Low", "H": "High", "R": "Record", "S": "Switch",
    "T": "Transmit", "V": "Valve", "Y": "Relay / compute", "Z": "Driver / actuator",
}

# Words left out of the index.
STOPWORDS = (
    "a an the and or of to in on at for from with by as is are was were be been being this that these those it its into than then there their they them "
    "we you your i he she his her which who whom whose what when where why how"
).split()

# BM25, rank fusion and retrieval depths.
BM25_K1, BM25_B = 1.2, 0.75
RRF_K, SUB_QUESTION_DISCOUNT = 60, 0.6
LEG_TOP_K, SHORTLIST, FINAL_K = 50, 25, 8
INTENT_WEIGHTS = {
    "lookup": {"lexical": 1.5, "dense": 1.0, "graph": 0.6},
    "diagnostic": {"lexical": 0.8, "dense": 1.0, "graph": 1.5},
    "multi_hop": {"lexical": 0.8, "dense": 0.8, "graph": 1.8},
    "procedural": {"lexical": 1.0, "dense": 1.3, "graph": 0.5},
    "aggregate": {"lexical": 0.6, "dense": 0.4, "graph": 1.8},
    "comparative": {"lexical": 1.0, "dense": 1.0, "graph": 1.2},
    "unanswerable": {"lexical": 1.0, "dense": 1.0, "graph": 1.0},
}

# Question shorthand.
ABBREVIATIONS = {
    "vib": "vibration", "temp": "temperature", "press": "pressure", "disch": "discharge", "suct": "suction", "mech": "mechanical", "bearg": "bearing",
    "brg": "bearing", "pm": "preventive maintenance", "cm": "corrective maintenance", "wo": "work order", "sd": "shutdown", "s/d": "shutdown",
    "ptw": "permit to work", "loto": "lock out tag out", "npsh": "net positive suction head", "rca": "root cause analysis", "moc": "management of change",
}

# Intents in the order they are tried, with confidence and pattern.
INTENT_RULES = [
    ("aggregate", 0.9, r"(?i)\b(how many|how much|count|total|sum|average|mean|median|top\s+\d+|most\s+\w+|worst|bad actor|rank|trend|per year|per month|breakdown by)\b"),
    ("procedural", 0.88, r"(?i)\b(how do i|how to|what are the steps|steps to|procedure for|how should|safely (isolate|start|stop)|what permit|do i need a permit|what must be (confirmed|checked|done)|before start\w*|prior to start\w*|preconditions?|prerequisites?)\b"),
    ("diagnostic", 0.88, r"(?i)\b(why (does|is|did|do)|root cause|what caused|keeps? (failing|tripping|leaking|vibrating)|reason for|diagnos)\w*\b"),
    ("comparative", 0.85, r"(?i)\b(compare|versus|vs\.?|difference between|better than|which of)\b"),
    ("multi_hop", 0.82, r"(?i)\b(spare for|standby for|downstream of|upstream of|feeds? into|fed by|affected if|impact of (taking|isolating)|connected to|isolat\w+ (points?|valves?)|what else)\b"),
]
DEFAULT_INTENT = ("lookup", 0.55)

# Confidence.
CONFIDENCE_WEIGHTS = {
    "retrieval_strength": 0.30, "claim_coverage": 0.15, "answer_relevance": 0.25, "source_agreement": 0.10, "currency": 0.10, "graph_support": 0.10,
}
RELEVANCE_FLOOR, GATE_CEILING, NO_GRAPH = 0.34, 0.35, 0.4
ANSWER_THRESHOLD, CAVEAT_THRESHOLD = 0.75, 0.50

# Entity resolution, root causes, precedents, alerts, compliance.
MERGE_THRESHOLD, REVIEW_THRESHOLD = 0.90, 0.60
CAUSE_KIND_WEIGHTS = {"incident": 1.0, "work_order": 0.7, "inspection": 0.5}
CAUSE_SIBLING_WEIGHT, CAUSE_HALF_LIFE_YEARS, CAUSE_UNDATED, CAUSE_FLOOR = 0.6, 5.0, 0.7, 2
PRECEDENT_WEIGHTS = {"semantic": 0.40, "mechanism": 0.30, "structural": 0.20, "documentary": 0.10}
PRECEDENT_FLOOR, ALERT_FLOOR = 0.35, 0.45
GRACE_DAYS, MONTH_DAYS = 30, 30
MAX_HOPS, MAX_PATHS = 3, 400
NOISE_FLOOR = 0.02
CHUNK_TARGET, CHUNK_MAX, CHUNK_MIN, CHUNK_OVERLAP = 1400, 2400, 120, 160

# Failure phrases with code and confidence.
FAILURE_TERMS = {
    "seal leak": ("ELP", 0.9), "seal leakage": ("ELP", 0.9), "seal failure": ("ELP", 0.9), "seal faces scored": ("ELP", 0.95), "seal face scored": ("ELP", 0.95),
    "mechanical seal failed": ("ELP", 0.95), "gland leak": ("ELP", 0.8), "external leakage": ("ELP", 0.85), "process leak": ("ELP", 0.8),
    "internal leakage": ("INL", 0.85), "passing valve": ("INL", 0.75), "high vibration": ("VIB", 0.9), "vibration high": ("VIB", 0.9),
    "excessive vibration": ("VIB", 0.9), "vibration increased": ("VIB", 0.85), "abnormal noise": ("NOI", 0.8), "unusual noise": ("NOI", 0.8),
    "bearing failure": ("BRD", 0.9), "bearing pitted": ("BRD", 0.9), "bearing seized": ("BRD", 0.95), "overheating": ("OHE", 0.85), "running hot": ("OHE", 0.8),
    "temperature rising": ("OHE", 0.7), "failed to start": ("FTS", 0.9), "fail to start": ("FTS", 0.9), "would not start": ("FTS", 0.85),
    "tripped on start": ("FTS", 0.8), "low discharge pressure": ("LOO", 0.85), "low flow": ("LOO", 0.8), "reduced output": ("LOO", 0.8), "cavitation": ("LOO", 0.85),
    "choked": ("PLU", 0.85), "plugged": ("PLU", 0.85), "fouled": ("PLU", 0.75), "wall loss": ("CORR", 0.9), "corrosion": ("CORR", 0.85), "wall thinning": ("CORR", 0.9),
    "pitting": ("CORR", 0.8), "cracked": ("STD", 0.85), "crack indication": ("STD", 0.85), "structural deficiency": ("STD", 0.85), "erratic reading": ("AOH", 0.8),
    "instrument drift": ("AOH", 0.8),
}
UNINFORMATIVE_CODES = ["OTHER", "MISC", "UNKNOWN", "NA", "N/A", "", "UNK"]

# Early signs in maintenance text, with weights.
DEGRADATION_CUES = {
    "seepage": 0.5, "weeping": 0.5, "slight leak": 0.6, "minor leak": 0.6, "intermittent": 0.4, "unusual noise": 0.7, "abnormal sound": 0.7, "abnormal noise": 0.7,
    "vibration increased": 0.8, "vibration high": 0.8, "running hot": 0.7, "temperature rising": 0.7, "topped up": 0.5, "refilled oil": 0.5, "tightened gland": 0.6,
    "monitor closely": 0.6, "keep watch": 0.3, "temporary repair": 0.9, "clamp fitted": 0.9, "will attend during shutdown": 0.7, "deferred to shutdown": 0.7,
}

# Header spellings of record fields.
HEADER_SYNONYMS = {
    "wo_id": ("wo_id", "work_order", "work_order_no", "order", "notification", "wo"), "asset_tag": ("asset_tag", "equipment", "equipment_tag", "tag", "tag_no", "equip"),
    "functional_location": ("functional_location", "fl", "fl_tag", "floc", "location"), "wo_type": ("wo_type", "order_type", "type", "maintenance_type"),
    "status": ("status", "wo_status", "state"), "priority": ("priority", "prio"), "description": ("description", "short_text", "title", "summary"),
    "long_text": ("long_text", "longtext", "notes", "technician_notes", "work_performed", "remarks"),
    "as_found": ("as_found", "asfound", "found_condition", "condition_on_arrival"), "as_left": ("as_left", "asleft", "left_condition", "condition_on_departure"),
    "coded_failure_mode": ("failure_code", "failure_mode_code", "damage_code", "coded_failure_mode"),
    "opened_on": ("opened_on", "created_on", "open_date", "start_date", "reported_on"), "closed_on": ("closed_on", "close_date", "completion_date", "completed_on"),
    "downtime_hours": ("downtime_hours", "downtime_hrs", "downtime"), "cost": ("cost", "actual_cost", "total_cost"), "cml_id": ("cml_id", "cml", "location_id", "point"),
    "method": ("method", "ndt_method", "technique"), "inspected_on": ("inspected_on", "inspection_date", "survey_date", "date"),
    "thickness_mm": ("thickness_mm", "thickness", "reading_mm", "measured_thickness"), "min_required_mm": ("min_required_mm", "t_min", "minimum_thickness", "min_thickness"),
    "inspector": ("inspector", "inspected_by", "technician"), "finding": ("finding", "observation", "result", "comment"),
    "incident_id": ("incident_id", "inc_id", "event_id"), "report_no": ("report_no", "report_number", "survey_no"),
    "occurred_on": ("occurred_on", "event_date", "incident_date", "date_of_event"), "severity": ("severity", "sev", "consequence"),
    "narrative": ("narrative", "what_happened", "description_of_event", "details"), "immediate_cause": ("immediate_cause", "direct_cause"),
    "root_cause": ("root_cause", "basic_cause", "underlying_cause"),
}

# Document types by phrase, in order, with weight.
KEYWORD_RULES = [
    ("pid", 0.95, ("piping and instrumentation diagram", "piping & instrumentation diagram", "process flow diagram")), ("pid", 0.6, ("p&id", "p & id")),
    ("work_order", 0.92, ("work order", "maintenance notification", "job card", "wo number", "work order no")),
    ("sop", 0.92, ("standard operating procedure", "operating instruction", "start-up procedure", "startup procedure", "shutdown procedure")),
    ("inspection_report", 0.92, ("ultrasonic thickness", "thickness survey", "inspection report", "radiographic test report", "condition monitoring location", "magnetic particle")),
    ("incident_report", 0.92, ("incident report", "near miss report", "near-miss report", "incident investigation", "root cause analysis")),
    ("moc", 0.9, ("management of change", "moc no", "change request", "modification proposal")), ("hazop", 0.9, ("hazop", "hazard and operability")),
    ("permit", 0.9, ("permit to work", "hot work permit", "job safety analysis")), ("ncr_capa", 0.88, ("non-conformance", "nonconformance", "corrective action report")),
    ("datasheet", 0.85, ("equipment datasheet", "pump data sheet", "technical data sheet", "api 610")),
    ("regulation", 0.85, ("oisd-std", "factories act", "gazette of india", "peso", "central pollution control")),
    ("manual", 0.8, ("installation, operation and maintenance", "o&m manual", "iom manual")),
]
TITLE_WINDOW, REFERENCE_PENALTY = 600, 0.55

# Patterns of references, clauses, places, quantities and dates in text.
REFERENCE = r"(?<![A-Za-z0-9])(?:OISD(?:-STD)?|SOP|WO|MOC|CAPA|NCR|INC|API|ISO|IEC|PTW|JSA|HAZOP)[\s\-]?\d{2,6}(?:[-/]\d{1,4})?(?![A-Za-z])"
CLAUSE = r"(?i)(?:clause|section|para(?:graph)?|§)\s*(\d+(?:\.\d+){0,3}(?:\([a-z]\))?)"
FUNCTIONAL_LOCATION = r"(?i)(?:functional\s+location|floc|fl\s*tag)\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-‐-―_/ ]{2,30})"
QUANTITY = (
    r"(?i)(?<![A-Za-z0-9.])(\d+(?:\.\d+)?)\s*(barg?|kPa|MPa|psi[ga]?|mm|cm|m|km|kg|t|degC|°C|K|rpm|Hz|kW|MW|A|V|m3/h|m³/h|LPM|GPM|hrs?|hours?|mm/yr|micron|µm)(?![A-Za-z])"
)
DATE_FORMS = [
    (r"\b(\d{4}-\d{2}-\d{2})\b", "yyyy-MM-dd"), (r"\b(\d{2}/\d{2}/\d{4})\b", "dd/MM/yyyy"), (r"\b(\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4})\b", "d MMM yyyy"), (r"\b(\d{1,2}-[A-Z][a-z]{2}-\d{4})\b", "d-MMM-yyyy"),
]

# Questions for a present measurement, and what a question wants summed up, in order.
LIVE_MARKER = r"(?i)\b(current|currently|right now|at the moment|as of now|today'?s?|latest|present|real[- ]?time|live)\b"
MEASUREMENT = r"(?i)\b(reading|readings|value|values|measurement|temperature|pressure|vibration|flow|level|speed|rpm|amps?|current draw|position|status|state|setpoint|trend|alarm)\b"
DOCUMENTARY = r"(?i)\b(revision|version|procedure|document|drawing|sop|standard|requirement|policy|status of the (?:capa|action|incident))\b"
QUESTION_KINDS = [
    ("count", r"\b(how many|count|number of)\b"), ("sum", r"\b(total|sum)\b"), ("rank", r"\b(top|rank|worst|bad actor|most)\b"), ("trend", r"\b(trend|over time|per (year|month))\b"),
    ("average", r"\b(average|mean|median)\b"),
]
WORTH_KINDS, EXTRACTABLE_TYPES = ["record", "incident_section", "prose", "precondition"], ["incident_report", "moc"]

# A piece that is a reference as a whole.
WHOLE_REFERENCE = r"(?i)^(?:OISD(?:-STD)?|SOP|WO|MOC|CAPA|NCR|INC|API|ISO|IEC|PTW|JSA|HAZOP)[-\s]?\d{2,6}(?:[-/]\d{1,4})?$"
