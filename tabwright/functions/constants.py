"""Fixed values.

These must equal the values the original scripts use, or the results
differ.  They are stated once, here, in their natural order.
"""

# --- fixed values: missing-cell tokens (compared after trim + lower-case) ---
MISSING_TOKENS = ["", "n/a", "na", "none", "null", "-", "—", "–", "unknown", "tbd"]

# --- fixed values: boolean tokens (compared lower-case) ---
BOOL_TRUE = ["true", "t", "yes", "y", "1"]
BOOL_FALSE = ["false", "f", "no", "n", "0"]

# --- fixed values: value-class patterns ---
INT_PATTERN = r"^[+-]?\d+$"
FLOAT_PATTERN = r"^[+-]?(?:\d+\.\d*|\d*\.\d+)(?:[eE][+-]?\d+)?$"
DATE_PATTERN = r"^\d{4}(-\d{2}(-\d{2})?)?$"
NUMBER_FULL_PATTERN = r"[+\-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+\-]?\d+)?"
DATE_FORMAT = "YYYY|YYYY-MM|YYYY-MM-DD"

# --- fixed values: key/value column names for structure detection ---
KV_KEY_NAMES = ["slot", "key", "field", "attribute", "name", "label", "column", "property"]
KV_VALUE_NAMES = ["value", "val", "text", "content", "data"]

# --- fixed values: header substrings that make a guessed field a string ---
STRING_HEADER_HINTS = ["name", "id", "team", "player", "city"]

# --- fixed values: cell tokens read as null when extracting tables ---
NULL_CELL_TOKENS = ["none", "null"]

# --- fixed values: field types a schema may use ---
SCHEMA_TYPES = ["string", "integer", "number", "boolean", "date"]

# --- fixed values: schema-id prefix and digest length ---
SCHEMA_ID_PREFIX = "auto."
SCHEMA_ID_HEX_LEN = 12

# --- fixed values: markers in model outputs ---
ATOMIC_MARKER = "### Atomic Statements:"
ATOMIC_STOP_PREFIXES = ["***", "<REASONING STEPS>"]
STATEMENTS_HEADER = "Statements:"
ROWS_HEADER = "Rows:"
FINAL_SCHEMA_MARKER = "### Final Schema:"
FINAL_TABLES_MARKER = "### Final Output Tables"
SCHEMA_JSON_LINE_PREFIX = '{"schema"'
METADATA_TURN_PREFIX = "[METADATA]\n"

# --- fixed values: length buckets and the step plan ---
CONTEXT_LENGTHS = [2048, 4096, 8192]          # stage 1, 2, 3 (tokens)
CHARS_PER_TOKEN = 4.0
BUCKET_MARGIN = 0.25
STAGE_HOURS = [4.0, 5.0, 5.0]
STAGE_MICRO_BATCH = [8, 4, 2]
STAGE_GRAD_ACCUM = [4, 8, 16]
EST_STEP_SECONDS = 22.0
TIME_SAFETY_SECONDS = 300
MIN_TARGET_STEPS = 50

# --- fixed values: split routing by input file name (first hit wins) ---
SPLIT_RULES = [("train", ["train"]), ("validation", ["validation", "dev"]), ("test", ["test"])]
SPLIT_DEFAULT = "data"

# --- fixed values: categories with a fixed display name ---
FIXED_CATEGORY_NAMES = {"team": "Team", "player": "Player"}

# --- fixed values: metadata keys kept by dropout ---
DROPOUT_KEEP_KEYS = ["language", "source_modality"]

# --- fixed values: failure ledger length in the sanity report ---
MAX_FAILURES = 50
