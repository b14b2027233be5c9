"""Fixed values that must equal the original service's for equal results.

They are stated here once, as plain values, and imported everywhere else.
"""

# --- fixed values (behaviour of the original service) ---------------------
DEFAULT_DATASET = "default"          # empty dataset name means this one
DEFAULT_TOP_K = 5                    # plain search: number of documents
DEFAULT_WORD_LIMIT = 512             # answering: word budget of the context
DEFAULT_MODEL = "text-davinci-003"   # model name when none is configured
UPLOAD_MAX_BYTES = 10 * 1024 * 1024  # 10 MiB upload cap (inclusive)
PDF_SUFFIXES = (".pdf", ".PDF")      # the only accepted file name endings
BEARER_PREFIX = "Bearer "            # authorization header scheme, case-sensitive
CITATION_PATTERN = r"\[citation\](\d+)\[/citation\]"
WORD_SPLIT_PATTERN = r"\s+"
PROMPT_HEADER = "Search results: \n"
PROMPT_NO_RESULTS = "No results \n\n"
PROMPT_DOC_OPEN = "```json\n"
PROMPT_DOC_CLOSE = "\n```\n\n"
SEARCH_WORDS_INSTRUCTION = "Please create a search query for this. ONLY give me the search string. Do not use quotes: \n\n"
SEARCH_WORDS_SEED = 1234
CHAT_MAX_TOKENS = -1
CHAT_TEMPERATURE = 0
TOKEN_LIFETIME = "INTERVAL '1' YEAR"  # default expiry = issue time + 1 year
# Characters Go's JSON encoder escapes that Spark's to_json writes verbatim.
GO_JSON_ESCAPES = (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"),
                   ("\u2028", "\\u2028"), ("\u2029", "\\u2029"))
# ---------------------------------------------------------------------------

# Error codes for rejected rows (side outputs).
ERR_BAD_REQUEST = "invalid request payload"
ERR_EMPTY_QUERY = "empty query"
ERR_EMPTY_VECTOR = "empty vector"
ERR_BAD_K = "k must be greater than zero"
ERR_BAD_BUDGET = "word limit must be greater than zero"
ERR_EMPTY_SESSION = "empty session id"
ERR_BAD_VECTOR = "vector holds a NULL, NaN or infinite element"
ERR_DIMENSION = "vector dimension differs from its dataset"
