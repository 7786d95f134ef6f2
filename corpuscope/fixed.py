"""Word lists, lookup tables and defaults of the data model.

Fixed values: results depend on these exact entries, so they are stated once, as text,
and every operator and every check reads them from here.
"""

# Path patterns that are always skipped (unanchored search), directory-tree dialect.
TREE_IGNORE_PATTERNS = [
    r"node_modules", r"\.git/", r"\.DS_Store$", r"Thumbs\.db$", r"__pycache__",
    r"\.pyc$", r"\.pyo$", r"\.pyd$", r"\.pytest_cache", r"\.coverage", r"\.tox",
    r"\.env", r"\.venv", r"venv/", r"env/", r"build/", r"dist/", r"\.egg-info",
    r"\.mypy_cache",
]

# The same, open-document dialect.
DOCUMENT_IGNORE_PATTERNS = [r"node_modules", r"\.git/", r"\.DS_Store$", r"Thumbs\.db$"]

# Default exclusion globs of the open-document dialect.
DEFAULT_EXCLUDE_GLOBS = [
    "**/*.env", "**/*.lock", "**/node_modules/**", "**/out/**", "**/dist/**",
    "**/.vscode/**", "**/.git/**",
]

# Extensions that mark a file as binary, by dialect.
BINARY_EXTENSIONS = {
    "tree": [
        ".pdf", ".doc", ".docx", ".xls", ".xlsx",
        ".zip", ".tar", ".gz", ".7z", ".rar",
        ".exe", ".dll", ".so", ".dylib",
        ".jpg", ".jpeg", ".png", ".gif", ".bmp",
        ".mp3", ".mp4", ".avi", ".mov",
        ".ttf", ".otf", ".woff", ".woff2",
        ".pyc", ".pyo", ".pyd",
        ".o", ".obj",
        ".bin", ".dat",
        ".db", ".sqlite", ".sqlite3",
        ".jar", ".war", ".ear",
        ".class",
        ".pak", ".cache",
        ".ico", ".icns",
        ".tif", ".tiff", ".raw",
        ".wav", ".aac", ".m4a",
        ".mkv", ".wmv", ".flv",
        ".iso", ".img",
        ".svgz", ".eot",
        ".msi", ".app",
        ".pdb", ".ilk",
        ".vsix",
    ],
    "document": [
        ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
        ".zip", ".tar", ".gz", ".rar", ".7z",
        ".exe", ".dll", ".so", ".dylib",
        ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico",
        ".mp3", ".mp4", ".wav", ".avi", ".mov",
        ".db", ".sqlite", ".mdb",
    ],
    "utility": [
        ".pdf", ".doc", ".docx", ".xls", ".xlsx",
        ".zip", ".tar", ".gz", ".7z", ".rar",
        ".exe", ".dll", ".so", ".dylib",
        ".jpg", ".jpeg", ".png", ".gif", ".bmp",
        ".mp3", ".mp4", ".avi", ".mov",
        ".ttf", ".otf", ".woff", ".woff2",
    ],
}

# Extension -> language id, shared by both dialects.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascriptreact", ".ts": "typescript",
    ".tsx": "typescriptreact", ".py": "python", ".java": "java", ".c": "c",
    ".cpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".m": "objective-c", ".h": "c", ".json": "json", ".xml": "xml",
    ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".css": "css",
    ".scss": "scss", ".less": "less", ".html": "html", ".sql": "sql",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".ps1": "powershell",
}
# Where the open-document dialect differs.
DOCUMENT_LANGUAGES = {
    ".h": "objective-c", ".sh": "shellscript", ".bash": "shellscript", ".zsh": "shellscript",
}
DEFAULT_LANGUAGE = "plaintext"

# Language id -> label of a code fence.
FENCE_LABELS = {
    "typescriptreact": "tsx", "javascriptreact": "jsx", "typescript": "ts",
    "javascript": "js", "markdown": "md", "mdx": "mdx", "css": "css", "scss": "scss",
    "less": "less", "html": "html", "json": "json", "yaml": "yaml",
    "python": "python", "rust": "rust", "go": "go", "plaintext": "text",
}

# File name -> purpose.
SPECIAL_PURPOSES = {
    ".gitignore": "Git ignore patterns for version control",
    "LICENSE": "Project license information",
    "requirements.txt": "Python package dependencies",
    "package.json": "Node.js package configuration and dependencies",
}
VSCODEIGNORE_PURPOSE = "VSCode extension packaging ignore patterns"
SVG_PURPOSE = "Vector graphics image file"
BINARY_PURPOSE = "Binary file"
# Line starts that do not count as the first text of a file.
COMMENT_PREFIXES = ["#", "//", "/*", "*", "<!", "<?", "}"]

# Substring -> framework, in output order.
FRAMEWORK_MARKS = [
    ("React", "React"), ("angular", "Angular"), ("vue", "Vue"),
    ("express", "Express"), ("next", "Next.js"),
]

# Words and tokens of the complexity scores.
CYCLOMATIC_WORDS = ["if", "case", "default", "for", "while", "catch"]
COGNITIVE_WORDS = ["if", "else", "for", "while", "do", "switch", "case", "try", "catch", "finally"]

# Names left out of a directory listing (lower case).
UNLISTED_NAMES = [
    "readme.md", "license", "license.txt", "license.md", "requirements.txt",
    "setup.py", "setup.cfg", "pyproject.toml", "manifest.in", ".gitignore",
]

# Extensions tried, in order, when an import names no existing file.
IMPORT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ""]

# Separator lines of the plain-text report.
SECTION_SEPARATORS = {"double": "=" * 77, "single": "-" * 77, "minimal": "-" * 18}
CHUNK_SEPARATORS = {"double": "-" * 77, "single": "- " * 37 + "-", "minimal": "-" * 18}

# Summary depths, and how many key points each shows (None: all).
DEPTHS = ["minimal", "basic", "standard", "detailed", "comprehensive"]
KEY_POINT_LIMITS = {"minimal": 0, "basic": 2, "standard": 5, "detailed": 10, "comprehensive": None}

# Defaults.
MAX_FILE_BYTES = 1_000_000
MAX_SNAPSHOTS = 10
LINE_CHUNK_THRESHOLD = 100
LINE_CHUNK_SIZE = 50
CHAR_CHUNK_SIZE = 2000
