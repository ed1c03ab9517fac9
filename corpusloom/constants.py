"""Fixed values that decide results. They are plain data, kept in one place."""

# Directory or file names that are always left out.
DEFAULT_IGNORED = [
    ".git", "node_modules", ".DS_Store", "dist", "build", "bin", "go.sum", ".gemini",
]

# Extensions treated as binary without looking at the content.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico",
    ".zip", ".tar", ".gz", ".7z", ".rar",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".out",
    ".woff", ".woff2", ".ttf", ".eot",
    ".mp3", ".mp4", ".avi", ".mkv", ".mov",
    ".db", ".sqlite",
]

# Extension to Markdown fence label.
LANGUAGE_LABELS = {
    ".go": "go",
    ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".py": "python",
    ".html": "html",
    ".css": "css",
    ".json": "json",
    ".yaml": "yaml", ".yml": "yaml",
    ".md": "markdown",
    ".sh": "bash",
    ".sql": "sql",
    ".rs": "rust",
}

# Comment syntax families.
C_EXTENSIONS = [".go", ".js", ".ts", ".tsx", ".jsx", ".java", ".c", ".cpp", ".h", ".css"]
HASH_EXTENSIONS = [".py", ".sh", ".rb", ".yaml", ".yml", ".dockerfile"]
MARKUP_EXTENSIONS = [".html", ".xml", ".svg"]

# A file is searched for secrets only if it holds one of these (case-sensitive).
SECRET_GATE = [
    "sk-", "AKIA", "hooks.slack", "aws_secret", "api_key", "secret_key",
    "password", "credential", "token",
]

# Names behind which an assigned value is a secret.
SECRET_WORDS = [
    "api_key", "apikey", "secret_key", "secretkey", "password", "passwd", "private_key",
    "db_pass", "db_password", "credential", "token",
]


def _folded(words: str) -> str:
    """(?i:...) folds ASCII letters only, which is much faster than Unicode folding,
    so the long s and the Kelvin sign are listed by hand."""
    return words.replace("s", "[s\u017f]").replace("k", "[k\u212a]")


# (label, Java regex) in priority order. White space is spelled out because \\s
# differs between engines. A run of the AWS word is only tried at its last one, so
# the search stays linear.
_BLANKS = r"[\t\n\f\r ]*"
_AWS = _folded("aws_secret")
SECRET_RULES = [
    ("OpenAI API Key", r"sk-(?:proj-)?[a-zA-Z0-9]{32,}"),
    (
        "Generic API Key/Secret",
        rf"(?i:(?:{_folded('|'.join(SECRET_WORDS))}){_BLANKS}[:=]{_BLANKS}"
        rf"[\"'][a-z0-9\-_.+=\u017f\u212a]{{8,}}[\"'])",
    ),
    (
        "Slack Webhook URL",
        r"https://hooks\.slack\.com/services/[a-zA-Z0-9_]{8,12}/[a-zA-Z0-9_]{8,12}/[a-zA-Z0-9_]{24}",
    ),
    ("AWS Access Key ID", r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|ASCA|ASIA)[A-Z0-9]{16}"),
    (
        "AWS Secret Access Key",
        rf"(?i:{_AWS}(?:(?!{_AWS})[a-z0-9_\u017f\u212a])*+{_BLANKS}[:=]{_BLANKS}"
        rf"[\"']?[a-z0-9/+=\u017f\u212a]{{40}}[\"']?)",
    ),
]
ENV_LABEL = "Environment file"

# Text put in front of every part.
PREAMBLE = "Below is the repository context of the code files packed for analysis.\n\n"
TREE_OPEN = "Repository Tree Structure:\n```\n"
TREE_CLOSE = "```\n\n"
DIR_ICON = "\U0001F4C1"
FILE_ICON = "\U0001F4C4"

CONTEXT_TOKENS = 200_000
