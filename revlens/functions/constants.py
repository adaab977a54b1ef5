"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the behaviour being
reproduced (directory / file / extension lists, known model context sizes,
severity order, retry statuses and words, key prefixes).  They are stated
plainly, in natural order, and are turned into small broadcast dimension
frames or literal arrays by the operators.  The language names in
``EXTENSION_LANGUAGE`` are our own labels for the breakdown report.
"""

from __future__ import annotations

# --- FIXED VALUES: corpus scan rules -------------------------------------
IGNORE_DIRS = (
    ".git", ".svn", ".hg",
    "node_modules", "vendor",
    "target", "build", "dist",
    ".idea", ".gradle",
    "__pycache__", ".pytest_cache",
    ".venv", "venv",
    "coverage", ".next", ".nuxt",
)

IGNORE_FILES = ("Thumbs.db", ".DS_Store")

TEXT_EXTENSIONS = (
    ".java", ".groovy", ".gradle", ".kt", ".kts",
    ".py", ".js", ".jsx", ".ts", ".tsx",
    ".php", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp",
    ".cs", ".go", ".rs", ".rb", ".swift",
    ".sql", ".sh", ".bash", ".zsh", ".ps1",
    ".html", ".htm", ".css", ".scss", ".sass", ".less",
    ".xml", ".json", ".yaml", ".yml", ".toml", ".ini",
    ".properties", ".conf", ".cfg",
    ".md", ".txt",
)

SPECIAL_FILE_NAMES = ("Dockerfile", "Makefile", "Jenkinsfile", "gradlew")

# --- FIXED VALUES: model context sizes (tokens) ---------------------------
MODEL_CONTEXTS = {
    "openrouter/free": 200_000,
    "qwen/qwen3-coder:free": 32_000,
    "deepseek/deepseek-r1:free": 32_000,
    "openai/gpt-oss-120b:free": 131_072,
    "openai/gpt-oss-20b:free": 131_072,
    "gpt-5.5": 400_000,
    "gpt-5": 400_000,
    "claude-opus-4.8": 1_000_000,
    "grok-4.5": 200_000,
    "deepseek-v4-pro": 1_000_000,
    "qwen3-coder": 256_000,
    "qwen3-coder:latest": 256_000,
    "deepseek-coder": 128_000,
    "llama3-8b-8192": 8_192,
    "llama-3.1-8b-instant": 131_072,
    "llama-3.3-70b-versatile": 131_072,
    "llama-4-scout": 131_072,
}
DEFAULT_CONTEXT = 8_192

# --- FIXED VALUES: budgets and pacing --------------------------------------
CONTEXT_SHARE = 0.5          # share of the context given to code
MIN_CHUNK_BUDGET = 1_500     # floor of the context budget
MAX_CHUNK_BUDGET = 100_000   # ceiling of the context budget
MIN_RATE_BUDGET = 1_200      # floor of the rate budget
RATE_OVERHEAD = 900          # tokens kept back per request from tpm/2
REQUEST_OVERHEAD = 1_500     # prompt + answer tokens added to each request
PACING_SAFETY = 1.08
MAX_DELAY = 65.0
MIN_MANUAL_TPM = 1_000
CHARS_PER_TOKEN = 3.5        # character-rule token estimate
MIN_SPLIT_CHARS = 1_000      # hard split width floor; width = max(1000, 3 * budget)
SPLIT_CHARS_PER_TOKEN = 3
RETRY_SPLIT_MIN_TOTAL = 1_500
RETRY_SPLIT_MIN_TARGET = 1_000

# --- FIXED VALUES: findings ------------------------------------------------
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")   # rank 0..4, other 99
UNKNOWN_SEVERITY_RANK = 99
ERROR_PREVIEW_CHARS = 800

# --- FIXED VALUES: attempts ------------------------------------------------
RETRYABLE_STATUSES = (408, 409, 429, 500, 502, 503, 504)
RETRYABLE_WORDS = (
    "timed out", "timeout", "temporarily", "connection reset",
    "connection aborted", "could not connect",
)
CONTEXT_ERROR_STATUSES = (400, 413)
CONTEXT_ERROR_MARKERS = (
    "context", "context_length", "context window",
    "maximum context", "max context", "too many tokens",
    "token limit", "prompt is too long", "input is too long",
    "request too large", "payload too large",
)
STATUS_HINTS = {
    400: "Bad request; this is not normally a rate-limit response.",
    401: "Authentication failed; verify the API key.",
    403: "Access forbidden by account/project permissions.",
    429: "Rate limit reached.",
}
MAX_ATTEMPTS = 5
RETRY_AFTER_MIN = 0.5
RETRY_AFTER_MAX = 120.0
BACKOFF_MAX = 120.0
JITTER_MAX = 0.75

# --- FIXED VALUES: model catalog -------------------------------------------
NON_CHAT_TERMS = ("embed", "embedding", "whisper", "tts", "speech", "audio", "moderation", "guard")
CONTEXT_PATHS = (
    "$.context_window",
    "$.context_length",
    "$.max_context_length",
    "$.max_input_tokens",
    "$.input_token_limit",
    "$.top_provider.context_length",
    "$.limits.context",
)
PAGE_SIZE = 25
SEARCH_LIMIT = 50

# --- FIXED VALUES: secrets -------------------------------------------------
KEY_PREFIXES = {
    "groq": ("gsk_",),
    "openrouter": ("sk-or-",),
    "openai": ("sk-",),
    "anthropic": ("sk-ant-",),
    "xai": ("xai-",),
    "deepseek": ("sk-",),
    "gemini": ("AIza",),
}
MIN_KEY_LENGTH = 20
MASK_SHORT_MAX = 8
FINGERPRINT_HEX = 10

# --- Our labels for the language breakdown (C3) ----------------------------
EXTENSION_LANGUAGE = {
    ".java": "Java", ".groovy": "Groovy", ".gradle": "Gradle", ".kt": "Kotlin", ".kts": "Kotlin",
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".php": "PHP", ".c": "C", ".h": "C", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".hpp": "C++",
    ".cs": "C#", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".swift": "Swift",
    ".sql": "SQL", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".ps1": "PowerShell",
    ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "Sass", ".less": "Less",
    ".xml": "XML", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".ini": "Config",
    ".properties": "Config", ".conf": "Config", ".cfg": "Config",
    ".md": "Markdown", ".txt": "Text",
}
OTHER_LANGUAGE = "Other"

# --- FIXED VALUES: the prompt of a chunk ------------------------------------
PROMPT_HEADER = ("Project: %s\nReview chunk: %d/%d\n\nPaths are relative to the project root.\n"
                 "Review the following source files:\n")
FILE_BLOCK = "\n===== FILE: {name} | LOC: {loc} =====\n{text}\n===== END FILE ====="

# --- FIXED VALUES: messages of the key check --------------------------------
KEY_EMPTY = "API key is empty."
KEY_SHORT = "API key is too short (%d characters). The key was probably pasted incorrectly."
KEY_LENGTH_OK = "Length check passed: %d characters."
KEY_PREFIX_ODD = "Prefix does not match the provider's common key format (%s). A live connection test will decide."

# --- FIXED VALUES: texts of the results ------------------------------------
REPLY_EMPTY = "AI provider returned an empty review response."
REPLY_NOT_JSON = "The AI response was not valid JSON. Response preview: '"
NO_TITLE = "Untitled finding"
NO_SUMMARY = "No summary returned."
NO_POSITIVES = "No specific positive points returned."
NO_RECOMMENDATIONS = "No additional recommendations returned."
