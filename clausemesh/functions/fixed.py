"""Word lists, lookup tables, patterns and constants.

Every entry below is data that decides results and therefore has to be exactly this.
"""

# --- token budget -------------------------------------------------------------
CHARS_PER_TOKEN = 4
MAX_CHUNK_TOKENS = 768
LOOKBACK_SHARE = 0.2
LOOKBACK_MIN = 8

# --- ranks --------------------------------------------------------------------
PRIORITY_LEVEL = {"national": 100, "industry": 80, "enterprise": 60, "project": 40, "reference": 20}
DEFAULT_LEVEL = 40
HARD_LEVEL = 40
DOC_TYPE_LEVEL = {
    "national_standard": 100,
    "industry_standard": 80,
    "enterprise_spec": 60,
    "lot_checklist": 60,
    "project_spec": 40,
    "unknown": 40,
}
FORM_FIELD_WEIGHT = 0.9
COLUMN_HEADER_WEIGHT = 0.7
RRF_K = 60
TOP_K = 40
BM25_K1 = 1.2
BM25_B = 0.75
BM25_FLOOR = 0.01
BM25_MIN_IDF = 1e-6

# --- file name classes (first match wins, case ignored) -------------------------
DOC_TYPE_RULES = [
    (r"^GB[/_T-]?\d", "national_standard", 100),
    (r"^HG[/_T-]?\d", "industry_standard", 80),
    (r"^Q[/_-]?\d", "enterprise_spec", 60),
    (r"Lot\s*\d+|NCR|DCN|Check[- ]?list|Exception\s*List", "lot_checklist", 60),
    (r"^SA[-_]", "project_spec", 40),
]
DOC_TYPE_DEFAULT = ("unknown", 40)

# --- units: category -> (base unit, {unit: factor}) -----------------------------
UNIT_TABLE = {
    "length": ("m", {"m": 1.0, "mm": 0.001, "cm": 0.01, "km": 1000.0, "in": 0.0254, "ft": 0.3048,
                     "米": 1.0, "毫米": 0.001}),
    "area": ("m2", {"m2": 1.0, "mm2": 1e-6, "cm2": 1e-4, "km2": 1e6, "hectare": 10000.0,
                    "acre": 4046.86, "平方米": 1.0, "公顷": 10000.0, "亩": 666.67}),
    "time_duration": ("d", {"d": 1.0, "h": 1 / 24, "min": 1 / 1440, "s": 1 / 86400, "week": 7.0,
                            "month": 30.0, "year": 365.0, "天": 1.0, "日": 1.0, "小时": 1 / 24,
                            "个月": 30.0, "年": 365.0}),
    "pressure": ("pa", {"pa": 1.0, "mpa": 1e6, "kpa": 1e3, "bar": 1e5, "psi": 6894.76}),
    "percentage": ("%", {"%": 1.0}),
}

PARAMETER_SYNONYMS = {
    "温度": "temperature", "气温": "temperature", "temp": "temperature",
    "压力": "pressure", "压强": "pressure", "湿度": "humidity", "强度": "strength",
    "抗压强度": "compressive_strength", "抗拉强度": "tensile_strength", "厚度": "thickness",
    "直径": "diameter", "长度": "length", "宽度": "width", "高度": "height", "龄期": "age",
    "标号": "grade", "等级": "grade",
}

# --- numbers with a unit, in the order that owns characters first ---------------
NUMBER = r"(\p{Nd}+\.?\p{Nd}*)"
HINT_UNITS = [
    ("temperature", r"(°?[CKF])"),
    ("pressure", r"(MPa|Mpa|kPa|kpa|bar|psi|Pa)"),
    ("length", r"(mm|cm|m|km|英寸|寸)"),
    ("percentage", r"(%)"),
]
CONTEXT_WORDS = [
    ("temperature", r"(?:温度|气温|水温|室温|环境温度|油温|水温)[\s:：]*\p{Nd}"),
    ("pressure", r"(?:压力|压强|气压|油压|水压)[\s:：]*\p{Nd}"),
    ("diameter", r"(?:直径|外径|内径|公称直径)[\s:：]*\p{Nd}"),
    ("length", r"(?:长度|宽度|高度|厚度|半径)[\s:：]*\p{Nd}"),
    ("strength", r"(?:强度|抗压强度|抗拉强度|屈服强度)[\s:：]*\p{Nd}"),
    ("percentage", r"(?:比例|水灰比|含水率|孔隙率|掺量)[\s:：]*\p{Nd}"),
]
CONTEXT_LOOKBACK = 20
OPERATOR_RADIUS = 50
SIGNED_NUMBER = r"[+-]?\p{Nd}+\.?\p{Nd}*"
RANGE_WORDS = r"(?i)至|到|\bto\b"
OPERATOR_WORDS = [
    ("<=", r"不得超过"), ("<=", r"不超过"), ("<=", r"(?i)no more than"), ("<=", r"(?i)at most"),
    (">=", r"不低于"), (">=", r"不少于"), (">=", r"(?i)not less than"), (">=", r"(?i)at least"),
    ("==", r"等于"), ("==", r"为"), ("==", r"(?i)\bis\b"), ("==", r"(?i)equals"),
    (">", r"大于"), (">", r"高于"), (">", r">(?![=])"),
    ("<", r"小于"), ("<", r"低于"), ("<", r"<(?![=])"),
]
MEASURING_VERBS = ["测量", "检测", "记录", "观测", "显示", "表明", "发现"]

# --- applicability and life cycle ------------------------------------------------
CONDITION_PATTERNS = [
    ("environment", r"在([^。，,，\\s]+)环境下"),
    ("condition", r"在([^。，,，\\s]+)条件下"),
]
LIFECYCLE_WORDS = [
    ("draft", ["draft", "征求意见稿", "draft document"]),
    ("review", ["review", "建议", "审阅", "review document", "征求意见"]),
    ("transitional", ["过渡期", "transition period", "transitional"]),
]
NOT_BINDING = ["draft", "review", "deprecated"]
PROVISION = r"(\p{Nd}+\.\p{Nd}+(?:\.\p{Nd}+)?)"
DEADLINE = r"(.*?)(?:后|起)\s*(\p{Nd}+)\s*(天|日|个月|周|工作日)"
LOT = r"(?i)\blot\s*0*(\p{Nd}+)"
RUN_SUFFIX = r"_r\d{8}T\d{6}Z$"
ROUTE_TEMPLATE = r"^(/([a-zA-Z][a-zA-Z0-9_]*|\{[a-zA-Z_][a-zA-Z0-9_]*\}))+$"

# --- characters ---------------------------------------------------------------
SPACE = r"[\p{Z}\t-\r\x1c-\x1f\x85]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
ASCII_CUT_MARKS = ".,;:!?()[]{}\"'-/\\|<>=+*&%@#$^_~`"
CJK_CUT_RANGES = [(0x3000, 0x303F), (0xFF00, 0xFFEF), (0x4E00, 0x9FFF), (0x3400, 0x4DBF)]
UNSAFE_JOIN = r"^(\p{Nd}[A-Za-z.]|[A-Za-z]\p{Nd}|\.\p{Nd}|[A-Za-z][A-Za-z])$"

# --- audit ---------------------------------------------------------------------
EVENT_FIELDS = {
    "constraint_solve_started": ["trace_id", "query"],
    "constraint_solved": ["trace_id", "branches_count"],
    "constraint_solve_failed": ["trace_id", "error_type"],
    "endpoint_started": ["trace_id", "endpoint", "method"],
    "endpoint_completed": ["trace_id", "status_code", "duration_ms"],
    "ingestion_received": ["request_id", "doc_id"],
    "ingestion_completed": ["request_id", "doc_id"],
    "query_replay_executed": ["replayed_trace_id", "deterministic_match"],
    "ingestion_failed": ["request_id", "doc_id"],
    "ingestion_replay_started": ["request_id"],
    "ingestion_replay_completed": ["request_id"],
    "ingestion_replay_sha256_mismatch": ["request_id"],
    "compensation_retry": ["request_id", "reingest_outcome", "reingest_duration_ms"],
    "qdrant_write_failed": ["collection"],
    "lock_acquire_failed": ["lock_key"],
    "document_metadata_failed": ["request_id", "doc_id", "error"],
    "callback_url_blocked": ["doc_hash", "version", "reason"],
    "callback_auth_missing": ["doc_hash", "version"],
    "callback_best_effort_failed": ["doc_hash", "version", "rag_status", "error"],
    "fts_consistency_drift": ["drift_count"],
    "fts_synced": ["doc_hash", "version", "chunks_written"],
    "fts_searched": ["vector_hits", "fts_hits", "both_hits"],
}
REPLAY_EVENTS = ["constraint_solve_started", "constraint_solved"]
STORE_FAILURE_EVENT = "qdrant_write_failed"
HTTP_EDGES = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
SOLVE_EDGES = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
INGEST_EDGES = [0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0]
BRANCH_EDGES = [1, 2, 3, 5, 10]

# --- runs and tasks --------------------------------------------------------------
DONE_STATUSES = ["completed", "success"]
FAILED_STATUSES = ["rejected", "failed", "pending", "rate_limited", "notified_failed"]
TERMINAL_STATUSES = ["success", "completed", "failed"]
RETRY_STATUSES = ["PENDING", "FAILED"]
RETRY_OUTCOMES = ["success", "failed", "duplicate", "skipped"]
UNWIRED_ERROR = "handler not implemented (Phase 4.5)"
RETRY_FALSE_ERROR = "compensation handler returned False (re-ingest failed)"
MAX_ATTEMPTS = 3
RETRY_AGE_SECONDS = 60.0
ERROR_TEXT_LIMIT = 1024
SNAPSHOT_LIMIT = 4096
SNAPSHOT_MARK = "...[truncated]"
STATUS_TIMEOUT_S = 600.0
CHARS_PER_ESTIMATED_CHUNK = 500
SECONDS_PER_ESTIMATED_CHUNK = 0.8
ANCHOR_TYPES = ["form_field", "column_header", "heading"]
QUOTA_EVENTS = 60
QUOTA_SECONDS = 60
REPEAT_SECONDS = 5
ENCODING_TTL_SECONDS = 86400
UUID_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
