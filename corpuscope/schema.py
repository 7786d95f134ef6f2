"""Schemas of the tables that operators exchange, as Spark schema strings."""


def names(ddl: str) -> list[str]:
    """Column names of a flat schema string."""
    return [column.split()[0] for column in ddl.split(", ")]


FILES = (
    "relative_path string, file_name string, directory string, ext string, content string, "
    "size bigint, mtime timestamp, language string, content_hash string"
)
STATE = ("relative_path string, content_hash string")
CHANGES = ("relative_path string, change_type string, old_hash string, new_hash string")
SNAPSHOTS = ("snapshot_id string, ts timestamp, description string, tags array<string>")
NAMED_SNAPSHOTS = ("name string, content string, ts timestamp")
TAGS = (
    "tag_id string, name string, color string, description string, scope string, icon string"
)
APPLIED_TAGS = (
    "tag_id string, applied_to string, applied_at timestamp, applied_by string"
)
IGNORE_RULES = ("pattern string, regex string")
EDGES = (
    "source string, target string, type string, line int, character int, symbol string, "
    "context string"
)
EDITS = ("path string, ts timestamp, content_hash string")
INHERITANCE = "enabled boolean, override boolean"
