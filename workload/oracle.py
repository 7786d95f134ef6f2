"""SQL twins of the queries, over the same tables. Fixed lists come from ``corpuscope.fixed``
and parameters from ``workload.queries``; the logic is written again in SQL."""

from __future__ import annotations

from corpuscope import fixed
from corpuscope.functions import globs
from workload import queries as q
from workload import views as v

ORACLES: dict[str, str] = {}

NL = "chr(10)"
SPACES = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(text(x) for x in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def lines(x: str) -> str:
    return f"string_split({x}, {NL})"


def whole_lines(x: str) -> str:
    return (f"(CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) WHEN {x} LIKE '%' || {NL} "
            f"THEN {lines(x)}[1:-2] ELSE {lines(x)} END)")


def name_of(p: str) -> str:
    return f"string_split({p}, '/')[-1]"


def dir_of(p: str) -> str:
    return (f"(CASE WHEN contains({p}, '/') THEN array_to_string(string_split({p}, '/')[1:-2], '/') "
            f"ELSE '.' END)")


def suffix(n: str) -> str:
    return f"lower(regexp_extract({n}, '^.+(\\.[^.]+)$', 1))"


def language(ext: str, extra: dict | None = None) -> str:
    table = {**fixed.LANGUAGES, **(extra or {})}
    cases = " ".join(f"WHEN {text(k)} THEN {text(x)}" for k, x in table.items())
    return f"(CASE {ext} {cases} ELSE 'plaintext' END)"


def pick(values: list[str], number: str) -> str:
    return f"{listing(values)}[{number} % {len(values)} + 1]"


def cte(name: str, columns: str, source: str) -> str:
    """A table in the file schema from (…, relative_path, content)."""
    return f"""{name} AS (
  SELECT *, {name_of('relative_path')} AS file_name, {dir_of('relative_path')} AS directory,
    {suffix(name_of('relative_path'))} AS ext, CAST(strlen(content) AS BIGINT) AS size,
    {language(suffix(name_of('relative_path')))} AS language, sha256(content) AS content_hash
  FROM (SELECT {columns} FROM {source}) raw_{name})"""


DOC_PATH = (f"source || '/' || lang || {pick(v.SUBDIRECTORIES, 'doc_id')} || '/doc_' || doc_id || "
            f"{pick(v.EXTENSIONS, 'doc_id')}")
HEADER = f"""(CASE {pick(v.EXTENSIONS, 'doc_id')}
  WHEN '.py' THEN '\"\"\"Module ' || doc_id || ' of ' || source || '.' || {NL} || 'More.\"\"\"' || {NL}
  WHEN '.ts' THEN '/**' || {NL} || ' * Script ' || doc_id || {NL} || ' */' || {NL}
  WHEN '.js' THEN '//' || {NL} || '// script ' || doc_id || {NL}
  WHEN '.css' THEN '/* style ' || doc_id || ' */' || {NL}
  WHEN '.md' THEN '# Note ' || doc_id || {NL}
  WHEN '.html' THEN '<!-- page ' || doc_id || ' -->' || {NL}
  ELSE {NL} || {NL} END)"""
MTIME = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT))"


def docs(name: str = "files", source: str = "documents", body: str = "text") -> str:
    return cte(name, f"doc_id, source, lang, {DOC_PATH} AS relative_path, {HEADER} || {body} AS content, "
                     f"{MTIME} AS mtime", source)


FILES = docs()
PREV = docs("prev", "(SELECT * FROM documents WHERE source <> 'src3')")
CURR = docs("curr", "(SELECT * FROM documents WHERE source <> 'src7')",
            f"(CASE lang WHEN 'de' THEN text || {NL} || 'new last line' WHEN 'fr' THEN replace(text, ' ', '  ') ELSE text END)")

CODE_PATH = f"'m' || (doc_id % 20) || '/doc_' || doc_id || {pick(v.CODE_EXTENSIONS, 'doc_id')}"
CODE_HEADER = f"""concat_ws({NL},
  '// component ' || doc_id || ' ' || source,
  'import {{ a' || doc_id || ', b as c' || doc_id || ' }} from ''../m' || ((doc_id // 2) % 20) || '/doc_' || (doc_id // 2) || ''';',
  'import type {{ T' || doc_id || ' }} from ''./doc_' || (doc_id + 20) || '.css'';',
  'import React from ''react'';',
  'export {{ a' || doc_id || ' }} from ''./part''; // if (a&&b) x = c?d:e',
  'const shared = require(''../m0/doc_0'');',
  '  # TODO: check ' || lang || ' file ' || doc_id,
  '## FIXME: later',
  'const api_key = "k' || doc_id || '-' || source || '";',
  'password: ''pw' || doc_id || '''',
  'email = "user' || doc_id || '@' || source || '.example.com"',
  '-----BEGIN RSA PRIVATE KEY-----', 'AB' || doc_id, '-----END RSA PRIVATE KEY-----', '')"""
CODE = cte("code", f"doc_id, source, lang, {CODE_PATH} AS relative_path, {CODE_HEADER} || text AS content, "
                   f"{MTIME} AS mtime", "documents")

PAGES = cte("pagefiles", "page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '-' || "
                         "page_id || '.html' AS relative_path, html AS content", "pages")

PROJECT = f"""{FILES}, readmes AS (
  SELECT {dir_of('p')} AS dir, arg_min(text, doc_id) AS text, arg_min(lang, doc_id) AS lang
  FROM (SELECT *, {DOC_PATH} AS p FROM documents) GROUP BY 1), project AS (
  SELECT relative_path, file_name, directory, ext, content, size FROM files UNION ALL
  SELECT dir || '/README.md', 'README.md', dir, '.md', c, strlen(c) FROM (
    SELECT dir, '# ' || dir || (CASE WHEN lang = 'en' THEN {NL} ELSE {NL} || {NL} END) || text AS c FROM readmes))"""


def sql(name: str, ctes: str | list[str], body: str) -> None:
    ctes = ctes if isinstance(ctes, str) else ", ".join(c for c in ctes if c)
    ORACLES[name] = (f"WITH {ctes} " if ctes else "") + body


# --- sources and stores ------------------------------------------------------------------

sql("scan_text", "", f"""
SELECT 'source=' || source || '/lang=' || lang AS directory,
  CAST(SUM(strlen(text) + 1) AS BIGINT) AS n_bytes,
  CAST(SUM(length(text) - length(replace(text, {NL}, '')) + 1) AS BIGINT) AS n_lines
FROM documents GROUP BY 1""")

sql("open_documents", FILES, """
SELECT relative_path, 'file' AS scheme FROM files
WHERE lang <> 'es' AND ext <> '.json' AND source <> 'src5'""")

_RX = ("replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '([\\\\.^$|+(){{}}])', '\\\\\\1', 'g'), "
       "'\\[([^\\[\\]]+\\])', chr(1) || '\\1', 'g'), '\\[', '\\\\[', 'g'), chr(1), '['), '[!', '[^')")
sql("ignore_rules", FILES, f"""
SELECT relative_path, line_no, pattern,
  '^' || replace(regexp_replace({_RX.format('pattern')}, '\\*+', '[\\\\s\\\\S]*', 'g'), '?', '[\\s\\S]') || '$' AS regex
FROM (SELECT relative_path, line_no, unnest(CASE
    WHEN plain LIKE '*%' THEN [plain] WHEN NOT contains(plain, '/') THEN [plain || '/**', plain]
    WHEN plain LIKE '/%' THEN [plain] ELSE ['**/' || plain] END) AS pattern
  FROM (SELECT relative_path, line_no, CASE WHEN cut LIKE '/%' THEN substr(cut, 2) ELSE cut END AS plain
    FROM (SELECT relative_path, line_no, rtrim(line, '/') AS cut FROM (
      SELECT relative_path, line_no, {strip('t')} AS line FROM (
        SELECT relative_path, unnest({lines('content')}) AS t, CAST(generate_subscripts({lines('content')}, 1) AS INT) AS line_no FROM files
        UNION ALL SELECT relative_path, '/' || relative_path || '/', 0 FROM files
        UNION ALL SELECT relative_path, '*' || ext, -1 FROM files)
    ) WHERE line <> '' AND line NOT LIKE '#%')))""")

sql("user_summaries", FILES, """
SELECT relative_path, CASE lang WHEN 'en' THEN 'beside ' || doc_id ELSE 'inside ' || doc_id END AS user_summary
FROM files WHERE lang IN ('en', 'de', 'fr')""")

sql("state_roundtrip", CURR, "SELECT relative_path, content_hash FROM curr")

HEADS = """heads AS (SELECT strftime(ts, '%Y%m%d') AS snapshot_id, max(ts) AS ts,
  'day of ' || count(*) || ' edits' AS description,
  array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tags FROM events GROUP BY 1)"""
sql("snapshot_retention", HEADS, f"""
SELECT snapshot_id, ts, description FROM heads ORDER BY ts DESC, snapshot_id DESC LIMIT {fixed.MAX_SNAPSHOTS}""")
sql("snapshot_list", "", """
SELECT DISTINCT source || '-' || lang AS name FROM documents WHERE lang <> 'es'
UNION SELECT DISTINCT source || '-all' FROM documents WHERE lang = 'en'""")
sql("snapshot_metadata", HEADS, """
SELECT snapshot_id, CASE WHEN month(ts) = 1 THEN 'january ' || snapshot_id ELSE description END AS description, tags
FROM heads WHERE day(ts) <> 2""")
sql("snapshot_stats", FILES, """
SELECT source AS snapshot_id, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size FROM files GROUP BY 1""")

sql("snapshot_store", FILES, f"""
SELECT lang AS snapshot_id, 'described anew' AS description, lang AS tags, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size
FROM files WHERE lang = {text(q.SNAPSHOT_LANGS[-1])} GROUP BY lang
UNION ALL SELECT 'all', 'all files', 'all', count(*), CAST(sum(size) AS BIGINT) FROM files""")
sql("scan_rejects", FILES, f"""
SELECT outcome, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_bytes,
  CAST(sum(CASE outcome WHEN 'kept' THEN length(content) ELSE 0 END) AS BIGINT) AS n_chars, count(*) AS n_observed,
  (SELECT count(*) FROM files) AS n_listed
FROM (SELECT *, size + (CASE lang WHEN 'de' THEN 1 ELSE 0 END) AS n, CASE WHEN size + (CASE lang WHEN 'de' THEN 1 ELSE 0 END) > {q.REJECT_ABOVE}
  THEN 'too large' WHEN lang = 'de' THEN 'not UTF-8' ELSE 'kept' END AS outcome FROM files) GROUP BY outcome""")

# --- filters -------------------------------------------------------------------------------


def any_of(patterns: list[str]) -> str:
    return text("|".join(f"(?:{p})" for p in patterns))


def one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(text(x) for x in values)})"


IGNORED = f"regexp_matches(relative_path, {any_of(fixed.TREE_IGNORE_PATTERNS)})"
sql("filter_builtin_ignore", FILES, f"SELECT relative_path FROM files WHERE NOT {IGNORED}")

_RULES = text("^(?:" + "|".join(globs.shell_regex(p) for p in globs.ignore_patterns(q.IGNORE_LINES)) + ")$")
sql("filter_ignore_rules", FILES, f"""
SELECT relative_path FROM files WHERE len(list_filter(list_concat([relative_path],
  list_transform(range(1, len(string_split(relative_path, '/'))), lambda i: array_to_string(string_split(relative_path, '/')[1:i], '/')),
  list_transform(range(1, len(string_split(relative_path, '/'))), lambda i: array_to_string(string_split(relative_path, '/')[1:i], '/') || '/')),
  lambda p: regexp_matches(p, {_RULES}))) = 0""")
sql("filter_rule_table", FILES, f"""
SELECT relative_path FROM files WHERE relative_path NOT IN (
  SELECT relative_path FROM (
    SELECT relative_path, relative_path AS part FROM files
    UNION ALL SELECT relative_path, array_to_string(string_split(relative_path, '/')[1:depth], '/') || slash
    FROM (SELECT relative_path, unnest(range(1, len(string_split(relative_path, '/')))) AS depth FROM files), (VALUES (''), ('/')) AS slashes(slash)
  ) AS parts, (
    SELECT CASE doc_id % 5 WHEN 0 THEN relative_path WHEN 1 THEN directory || '/*_' || doc_id || '[.-]*' WHEN 2 THEN '*/doc_' || doc_id || ext
      WHEN 3 THEN 'src?/*_' || doc_id || '.*' ELSE '*_' || doc_id || ext END AS pattern
    FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT unnest({listing(globs.ignore_patterns(q.IGNORE_LINES))})
  ) AS patterns WHERE part GLOB pattern)""")
sql("filter_globs", FILES, f"""
SELECT relative_path FROM files WHERE contains('/' || directory || '/', '/.venv/') OR (
  file_name NOT LIKE '%.env' AND file_name NOT LIKE '%.lock'
  AND len(list_intersect(string_split(directory, '/'), {listing(['node_modules', 'out', 'dist', '.vscode', '.git'])})) = 0)""")
sql("filter_types", FILES, """
SELECT relative_path FROM files WHERE string_split(file_name, '.')[-1] IN ('py', 'ts', 'md')""")
sql("filter_text_files", FILES, f"SELECT relative_path FROM files WHERE NOT {one_of('ext', fixed.BINARY_EXTENSIONS['tree'])}")
sql("filter_dirs", FILES, f"""
SELECT relative_path FROM files WHERE len(list_filter(string_split(relative_path, '/'),
  lambda p: {' OR '.join(f"starts_with(p, {text(x)})" for x in q.EXCLUDE_DIRS)})) = 0""")
sql("filter_size", FILES, "SELECT relative_path, size FROM files WHERE size <= 2500")
sql("filter_selected", FILES, "SELECT relative_path FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")

LINES = f"""numbered AS (SELECT relative_path, unnest({lines('content')}) AS text,
  CAST(generate_subscripts({lines('content')}, 1) AS INT) AS line_no FROM files)"""
sql("search_regex", [FILES, LINES], f"SELECT * FROM numbered WHERE regexp_matches(text, {text('(?i)' + q.SEARCH)})")
sql("search_substring", [FILES, LINES], f"""
SELECT relative_path, line_no, {strip('text')} AS text FROM numbered WHERE contains(lower(text), {text(q.WORD.lower())})""")
sql("incremental_files", [PREV, CURR], """
SELECT relative_path FROM curr WHERE NOT EXISTS (SELECT 1 FROM prev
  WHERE prev.relative_path = curr.relative_path AND prev.content_hash = curr.content_hash)""")

EDGES = """edges AS (
  SELECT relative_path AS source, '../m' || ((doc_id // 2) % 20) || '/doc_' || (doc_id // 2) AS import_path, 1 AS line,
    0 AS "character", 'a' || doc_id || ', b as c' || doc_id AS symbol,
    'import { a' || doc_id || ', b as c' || doc_id || ' } from ''../m' || ((doc_id // 2) % 20) || '/doc_' || (doc_id // 2) || '''' AS context FROM code
  UNION ALL SELECT relative_path, './doc_' || (doc_id + 20) || '.css', 2, 0, 'T' || doc_id,
    'import type { T' || doc_id || ' } from ''./doc_' || (doc_id + 20) || '.css''' FROM code
  UNION ALL SELECT relative_path, '../m0/doc_0', 5, 15, NULL, 'require(''../m0/doc_0''' FROM code)"""
sql("import_edges", [CODE, EDGES], 'SELECT source, import_path, line, "character", symbol, context FROM edges')
sql("valid_edges", [CODE, EDGES], """
SELECT source, import_path AS target, 'import' AS type FROM edges WHERE NOT contains(import_path, '_1') AND symbol IS NOT NULL""")

_TOKEN_RX = text("(?i)" + q.TOKEN.before + q.TOKEN.value + q.TOKEN.after)


def masked(content: str, before: str, value: str, after: str) -> str:
    """Mask the value of every match, left to right."""
    rx, v_rx = text(f"(?i){before}{value}{after}"), text(f"(?i)({before})({value})({after})")
    return (f"array_to_string(list_transform(range(1, len(string_split_regex({content}, {rx})) + 1), lambda i: "
            f"string_split_regex({content}, {rx})[i] || coalesce("
            f"regexp_extract_all({content}, {v_rx}, 1)[i] || repeat('*', length(regexp_extract_all({content}, {v_rx}, 2)[i])) || "
            f"regexp_extract_all({content}, {v_rx}, 3)[i], '')), '')")


sql("sensitive_policy", "", f"""
SELECT doc_id, (lang = 'fr' AND regexp_matches(text, {_TOKEN_RX})) AS is_flagged,
  sha256(CASE WHEN lang = 'en' AND regexp_matches(text, {_TOKEN_RX}) THEN {masked('text', q.TOKEN.before, q.TOKEN.value, q.TOKEN.after)} ELSE text END) AS content_hash
FROM documents WHERE NOT (lang = 'de' AND regexp_matches(text, {_TOKEN_RX}))""")

# --- scalars -------------------------------------------------------------------------------

sql("path_parts", FILES, f"""
SELECT relative_path, file_name, directory, {name_of('directory')} AS directory_name, ext FROM files""")
sql("language_of", FILES, f"""
SELECT relative_path, language AS tree, {language('ext', fixed.DOCUMENT_LANGUAGES)} AS document FROM files""")


def fence(column: str, extra: dict | None = None) -> str:
    table = {**fixed.FENCE_LABELS, **(extra or {})}
    return f"(CASE {column} " + " ".join(f"WHEN {text(k)} THEN {text(x)}" for k, x in table.items()) + f" ELSE {column} END)"


sql("fence_label", FILES, f"""
SELECT relative_path, {fence('language')} AS label, {fence('language', {'python': 'py'})} AS custom FROM files""")


def sized(units: list[str], shape: str) -> str:
    cases = " ".join(f"WHEN n < {1024 ** (i + 1)} THEN {shape.format(x=f'(n / {float(1024 ** i)})')} || ' {u}'"
                     for i, u in enumerate(units[:-1]))
    last = len(units) - 1
    return f"(CASE {cases} ELSE {shape.format(x=f'(n / {float(1024 ** last)})')} || ' {units[-1]}' END)"


SIZE_TREE = sized(["B", "KB", "MB", "GB", "TB", "PB"], "format('{{:.1f}}', {x})")
SIZE_DOC = sized(["B", "KB", "MB", "GB"], "format('{{:.1f}}', floor({x} * 10 + 0.5) / 10)")
SIZE_COMPACT = ("(CASE WHEN n < 1024 THEN n || ' B' ELSE regexp_replace(" +
                sized(["B", "KB", "MB", "GB"], "format('{{:.2f}}', floor({x} * 100 + 0.5) / 100)") + ", '\\.?0+ ', ' ') END)")
sql("size_label", FILES, f"""
SELECT relative_path, n, {SIZE_TREE} AS tree, {SIZE_DOC} AS document, {SIZE_COMPACT} AS compact
FROM (SELECT relative_path, unnest([size, size * doc_id * 977]) AS n FROM files)""")


def slugged(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


def escaped(x: str, apostrophe: str = "&#39;") -> str:
    for raw, out in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)]:
        x = f"replace({x}, {text(raw)}, {text(out)})"
    return x


sql("slug", "", f"SELECT doc_id, {slugged('text')} AS slug FROM documents")
sql("html_escape", PAGES, f"""
SELECT relative_path, {escaped('content')} AS tree, {escaped('content', '&#039;')} AS document FROM pagefiles""")
sql("content_hash", "", "SELECT doc_id, sha256(text) AS content_hash FROM documents")

_HEAD = f"list_transform({lines('content')}[1:10], lambda p: {strip('p')})"
_PLAIN = " AND ".join(["p <> ''"] + [f"NOT starts_with(p, {text(x)})" for x in fixed.COMMENT_PREFIXES])
FIRST_TEXT = f"'Text file starting with: ' || substr(list_filter({_HEAD}, lambda p: {_PLAIN})[1], 1, 50) || '...'"
PURPOSE = f"""(CASE ext
  WHEN '.py' THEN 'Module ' || doc_id || ' of ' || source || '.'
  WHEN '.ts' THEN 'Script ' || doc_id WHEN '.js' THEN 'script ' || doc_id WHEN '.css' THEN 'style ' || doc_id
  WHEN '.md' THEN 'Note ' || doc_id WHEN '.html' THEN 'page ' || doc_id
  ELSE coalesce({FIRST_TEXT}, upper(substr(ext, 2)) || ' file') END)"""
sql("file_purpose", FILES, f"SELECT relative_path, {PURPOSE} AS purpose FROM files")

KEYWORD = """(CASE WHEN contains(content, 'test') OR contains(content, 'spec') THEN 'Test file'
  WHEN contains(content, 'interface') OR contains(content, 'type ') THEN 'Type definitions'
  WHEN contains(content, 'component') OR contains(content, 'React') THEN 'React component' ELSE 'Source file' END)"""
sql("purpose_keyword", [FILES, CODE], f"""
SELECT relative_path, {KEYWORD} AS purpose FROM code UNION ALL SELECT relative_path, {KEYWORD} FROM files""")


def framework_list(x: str) -> str:
    found = ", ".join(f"CASE WHEN contains({x}, {text(m)}) THEN {text(n)} END" for m, n in fixed.FRAMEWORK_MARKS)
    return f"list_filter([{found}], lambda f: f IS NOT NULL)"


sql("frameworks", CODE, f"SELECT relative_path, array_to_string({framework_list('content')}, ',') AS frameworks FROM code")
_ALLDEPS = ("list_concat(regexp_extract_all(content, 'import [^\\n\\r]* from [''\"]([^''\"]+)[''\"]', 1), "
            "regexp_extract_all(content, 'require\\([''\"]([^''\"]+)[''\"]\\)', 1))")
PACKAGES = f"list_filter({_ALLDEPS}, lambda d, i: list_position({_ALLDEPS}, d) = i)"
sql("js_dependencies", CODE, f"SELECT relative_path, array_to_string({PACKAGES}, ',') AS dependencies FROM code")


def references(word: str, link: str, kind: str) -> str:
    rx = text(f"""{word} [^\\n\\r]* {link} ['"]([^'"]+)['"]""")
    return (f"SELECT relative_path, unnest(regexp_extract_all(content, {rx}, 1)) AS file, '{kind}' AS type, "
            f"unnest(regexp_extract_all(content, {rx}, 0)) AS context FROM code")


sql("js_references", CODE, " UNION ALL ".join([
    references("import", "from", "import"), references("export", "to", "export"), references("export", "from", "export")]))
sql("line_count", "", f"SELECT doc_id, CAST(len({lines('text')}) AS BIGINT) AS n_lines FROM documents")


def hits(x: str, rx: str) -> str:
    return f"len(regexp_extract_all({x}, {text(rx)}))"


CYCLOMATIC = "(1 + " + " + ".join(
    [hits("content", rf"\b{w}\b") for w in [*fixed.CYCLOMATIC_WORDS, "else if"]]
    + [hits("content", rf"\b{w}\b") for w in ["&&", r"\|\|", r"\?"]]) + ")"
COGNITIVE = "(" + " + ".join(
    [hits("content", rf"\b{w}\b") for w in fixed.COGNITIVE_WORDS]
    + [f"(length(content) - length(replace(content, '{t}', ''))) // {len(t)}" for t in ["?", "&&", "||"]]) + ")"
sql("cyclomatic", CODE, f"SELECT relative_path, {CYCLOMATIC} AS score FROM code")
sql("cognitive", CODE, f"SELECT relative_path, {COGNITIVE} AS score FROM code")
COMMENTS = f"({hits('content', '//[^' + chr(92) + 'n' + chr(92) + 'r]*')} + {hits('content', r'/\*[\s\S]*?\*/')})"
DOC_COMMENTS = hits("content", r"/\*\*[\s\S]*?\*/")
sql("doc_counts", FILES, f"""
SELECT relative_path, {COMMENTS} AS comments, {DOC_COMMENTS} AS doc_comments, {hits('content', r'```[\s\S]*?```')} AS fenced FROM files""")


def flags(pairs) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(content, {text(rx)}) THEN {text(n)} END" for rx, n in pairs)
    return f"array_to_string(list_filter([{found}], lambda f: f IS NOT NULL), ',')"


sql("sensitive_flags", FILES, "SELECT relative_path, " + flags([
    ("(?i)password|secret|key|token|credential", "potential credentials"), ("(?i)api[_-]?key", "API key")]) + " AS flags FROM files")
sql("data_access_flags", FILES, "SELECT relative_path, " + flags([
    (r"(?i)database|db\.|sql|query", "database access"), ("(?i)fetch|axios|http|request", "network requests")]) + " AS flags FROM files")


def readme_purpose(x: str) -> str:
    """Purpose of a README text held in column ``x``."""
    first = (f"list_filter(list_transform(string_split({x}, {NL} || {NL}), lambda p: {strip('p')}), "
             f"lambda p: p <> '' AND NOT starts_with(p, '#') AND NOT starts_with(p, '```'))[1]")
    for rx in (r"\[([^\]]+)\]\([^)]+\)", r"[*_]{1,2}([^*_]+)[*_]{1,2}", r"`([^`]+)`"):
        first = f"regexp_replace({first}, {text(rx)}, '\\1', 'g')"
    described = f"nullif({strip(f'replace({first}, {NL}, chr(32))')}, '')"
    title = strip(f"regexp_extract({x}, '(?m)^#\\s+([^\\n]+)$', 1)")
    title_line = f"coalesce(list_filter({lines(x)}, lambda p: starts_with(p, '# '))[1], '')"
    same = f"nullif({strip(f'string_split({title_line}, chr(35) || chr(32) || {title})[-1]')}, '')"
    at = f"list_position(list_transform({lines(x)}, lambda p: starts_with(p, '# ' || {title})), true)"
    following = f"(CASE WHEN {at} > 0 THEN {lines(x)}[{at} + 1] END)"
    after = f"(CASE WHEN NOT starts_with({following}, '#') THEN nullif({strip(following)}, '') END)"
    from_title = (f"(CASE WHEN regexp_matches({x}, '(?m)^#\\s+([^\\n]+)$') THEN coalesce({title} || ' - ' || {same}, "
                  f"{title} || ' - ' || {after}, {title}) END)")
    return f"coalesce({described}, {from_title})"


sql("readme_purpose", "", f"""
SELECT doc_id, {readme_purpose('t')} AS purpose FROM (SELECT doc_id, CASE lang
  WHEN 'en' THEN '# Title ' || doc_id || {NL} || {NL} || text
  WHEN 'fr' THEN '# Title ' || doc_id || {NL} || replace(text, {NL} || {NL}, {NL})
  WHEN 'es' THEN '# Title ' || doc_id || {NL} || '## more' || {NL} || replace(text, {NL} || {NL}, {NL})
  ELSE 'A [link](http://x/y) to **bold** `code`' || {NL} || text END AS t FROM documents)""")
sql("language_info", CODE, f"""
SELECT relative_path, concat_ws(' | ',
  CASE WHEN language IN ('typescript', 'typescriptreact') THEN CASE WHEN contains(m, 'use client') THEN 'Client Component' ELSE 'Server Component' END END,
  CASE WHEN len({framework_list('m')}) > 0 THEN 'Frameworks: ' || array_to_string({framework_list('m')}, ', ') END) AS info
FROM (SELECT *, CASE WHEN lang = 'en' THEN '''use client'';' || {NL} || content ELSE content END AS m FROM code)""")
sql("token_splits", "", """
SELECT doc_id, CASE WHEN lang = 'es' THEN source ELSE lang END AS scope, CASE WHEN lang = 'es' THEN '' ELSE source END AS tag,
  source AS package, CASE WHEN lang <> 'fr' THEN '1.' || doc_id END AS version, doc_id + 1 AS shown FROM documents""")
_BLANK = f"list_transform({whole_lines('content')}, lambda p: {strip('p')} = '')"
sql("blank_lines", FILES, f"""
SELECT relative_path, CAST(coalesce(list_position({_BLANK}, false) - 1, len({_BLANK})) AS INT) AS leading,
  CAST(len(list_filter({_BLANK}[2:8], lambda b: b)) AS INT) AS between FROM files""")
sql("todo_items", CODE, """
SELECT relative_path, 7 AS line_no, 'TODO' AS kind, 'check ' || lang || ' file ' || doc_id AS note FROM code
UNION ALL SELECT relative_path, 8, 'FIXME', 'later' FROM code""")
sql("normalized_text", "", f"""
SELECT doc_id, regexp_replace({strip('text')}, '\\s+', ' ', 'g') AS plain,
  lower(regexp_replace({strip('text')}, '\\s+', ' ', 'g')) AS lowered FROM documents""")
sql("snippet", FILES, f"""
SELECT relative_path, array_to_string(list_filter({lines('content')}, lambda p: {strip('p')} <> '')[1:3], {NL})
  || CASE WHEN len({lines('content')}) > 3 THEN {NL} || '...' ELSE '' END AS snippet FROM files""")
sql("tag_ids", "", """
SELECT name, created_order, CASE WHEN n = 0 THEN base ELSE base || '-' || n END AS tag_id FROM (
  SELECT lang || ' ' || upper(source) AS name, doc_id AS created_order,
    regexp_replace(lower(lang || ' ' || source), '[^a-z0-9]+', '-', 'g') AS base,
    row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS n FROM documents)""")
sql("mtime_iso", "", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")

# --- generators ------------------------------------------------------------------------------

sql("lines", [FILES, LINES], "SELECT * FROM numbered")
sql("lines_tree", CODE, f"""
SELECT relative_path, unnest({whole_lines('content')}) AS text,
  CAST(generate_subscripts({whole_lines('content')}, 1) AS INT) AS line_no FROM code""")


def line_chunks(pieces: str, size: int, source: str, where: str = "true", keep: str = "") -> str:
    return f"""SELECT relative_path, {keep} CAST(i + 1 AS INT) AS chunk_no, CAST(ceil(len(ls) / {size}.0) AS INT) AS chunk_count,
  CAST(i * {size} + 1 AS INT) AS start_line, CAST(least((i + 1) * {size}, len(ls)) AS INT) AS end_line,
  array_to_string(ls[i * {size} + 1:(i + 1) * {size}], {NL}) AS content
FROM (SELECT *, unnest(range(0, CAST(ceil(len(ls) / {size}.0) AS BIGINT))) AS i
  FROM (SELECT * EXCLUDE (content), length(content) AS width, {pieces} AS ls FROM {source}) WHERE {where})"""


def char_chunks(budget: int, source: str, where: str = "true", keep: str = "") -> str:
    """Greedy chunks by a fold over line widths."""
    widths = "list_transform(ls, lambda p: {'used': length(p) + 1, 'line': CAST(1 AS BIGINT), 'cuts': [CAST(1 AS BIGINT)]})"
    fold = (f"list_reduce({widths}, lambda a, b: {{'used': CASE WHEN a.used + b.used > {budget} THEN b.used ELSE a.used + b.used END, "
            f"'line': a.line + 1, 'cuts': CASE WHEN a.used + b.used > {budget} THEN list_append(a.cuts, a.line + 1) ELSE a.cuts END}}).cuts")
    return f"""SELECT relative_path, {keep} CAST(i AS INT) AS chunk_no, CAST(len(cuts) AS INT) AS chunk_count,
  CAST(cuts[i] AS INT) AS start_line, CAST(coalesce(cuts[i + 1], len(ls) + 1) - 1 AS INT) AS end_line,
  array_to_string(ls[cuts[i]:coalesce(cuts[i + 1], len(ls) + 1) - 1], {NL}) AS content
FROM (SELECT *, unnest(range(1, len(cuts) + 1)) AS i FROM (SELECT *, {fold} AS cuts FROM (
  SELECT * EXCLUDE (content), {whole_lines('content')} AS ls FROM {source}) WHERE len(ls) > 0 AND {where}))"""


sql("chunk_lines", FILES, line_chunks(whole_lines("content"), 10, "files", "len(ls) > 20"))
sql("chunk_chars", FILES, char_chunks(1000, "files"))


def report_chunks(size: int, source: str, keep: str = "") -> str:
    """Chunks of ``size`` lines, blank ones dropped; shorter texts stay whole."""
    cut = line_chunks(lines("content"), size, source, f"width >= {size}", keep)
    return f"""SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY relative_path ORDER BY start_line) AS INT) AS chunk_no,
    CAST(count(*) OVER (PARTITION BY relative_path) AS INT) AS chunk_count)
  FROM ({cut}) WHERE {strip('content')} <> ''
  UNION ALL SELECT relative_path, {keep} 1, 1, 1, CAST(len({lines('content')}) AS INT), content FROM {source} WHERE length(content) < {size}"""


sql("report_chunks", FILES, report_chunks(6, "files"))
sql("chunk_counts", FILES, f"""
SELECT relative_path, CAST(n AS INT) AS n_chunks, CASE WHEN n > 0 THEN 'File split into ' || n || ' chunks' END AS chunk_info
FROM (SELECT relative_path, CASE WHEN len({whole_lines('content')}) > 100 THEN CAST(ceil(len({whole_lines('content')}) / 50.0) AS INT) ELSE 0 END AS n FROM files)""")


def pattern_matches(name: str, before: str, value: str, after: str, flags: str = "(?i)") -> str:
    whole = text(f"{flags}(?:{before}{value}{after})")
    parts = text(f"{flags}({before})({value})({after})")
    return f"""SELECT relative_path, {text(name)} AS pattern_name, ms[i] AS matched, vs[i] AS value,
  CAST(len(array_to_string(gaps[1:i], '')) + len(array_to_string(ms[1:i - 1], '')) AS INT) AS "start",
  CAST(len(array_to_string(gaps[1:i], '')) + len(array_to_string(ms[1:i], '')) AS INT) AS "end",
  CAST(len(array_to_string(gaps[1:i], '')) + len(array_to_string(ms[1:i - 1], '')) + length(bs[i]) AS INT) AS value_start
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT relative_path, regexp_extract_all(content, {whole}) AS ms,
  string_split_regex(content, {whole}) AS gaps, regexp_extract_all(content, {parts}, 1) AS bs,
  regexp_extract_all(content, {parts}, 2) AS vs FROM code))"""


MATCHES = "matches AS (" + " UNION ALL ".join(
    pattern_matches(p.name, p.before, p.value, p.after, p.flags) for p in q.ALL_PATTERNS) + ")"
sql("sensitive_matches", [CODE, MATCHES], "SELECT * FROM matches")
sql("sensitive_summary", [CODE, MATCHES], "SELECT relative_path, pattern_name, count(*) AS n FROM matches GROUP BY ALL")

_from = "SELECT relative_path, content AS c FROM code"
for _p in q.ALL_PATTERNS:
    _from = (f"SELECT relative_path, CASE WHEN regexp_matches(c, {text(_p.flags + _p.before + _p.value + _p.after)}) "
             f"THEN {masked('c', _p.before, _p.value, _p.after)} ELSE c END AS c FROM ({_from})")
sql("redact", CODE, f"SELECT relative_path, c AS content FROM ({_from})")

# Facts about the generated modules: lines 1..12 are fixed, then the decorated class with three
# lines per text line, two blank lines, and the function.
PY = f"""py AS (SELECT doc_id, source, lang, source || '/' || lang || '/mod_' || doc_id || '.py' AS relative_path,
  CAST(len({lines('text')}) AS INT) AS n, text FROM documents)"""
SYMBOLS = f"""symbols AS (
  SELECT relative_path, 'class' AS kind, 'Doc' || doc_id AS name, NULL AS parent, 14 AS start_line, 14 + 3 * n AS end_line FROM py
  UNION ALL SELECT relative_path, 'nested', 'part_' || i, 'Doc' || doc_id, 12 + 3 * i, 14 + 3 * i
    FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM py)
  UNION ALL SELECT relative_path, 'function', 'main' || doc_id, NULL, 17 + 3 * n, 22 + 3 * n FROM py
  UNION ALL SELECT relative_path, 'nested', 'inner', 'main' || doc_id, 19 + 3 * n, 21 + 3 * n FROM py)"""
ADJUSTED = """adjusted AS (
  SELECT relative_path, kind, name, parent,
    CASE WHEN kind = 'function' THEN start_line - 2 ELSE start_line - 1 END AS start_line,
    CASE WHEN kind = 'function' THEN start_line - 1 ELSE end_line - 1 END AS end_line FROM symbols)"""
_INTS = "CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line"
sql("code_symbols", [PY, SYMBOLS], f"SELECT relative_path, kind, name, parent, {_INTS} FROM symbols")
sql("adjusted_lines", [PY, SYMBOLS, ADJUSTED], f"SELECT relative_path, kind, name, parent, {_INTS} FROM adjusted")
sql("code_annotations", PY, """
SELECT relative_path, 'decorator' AS category, '@register(' || lang || ')' AS label FROM py
UNION ALL SELECT relative_path, 'annotation', unnest(['argv: Optional[List[str]]', 'n: int', 'return -> Dict[str, int]',
  'return -> None', 'rows: List[str]']) FROM py""")
PYDEPS = "list_sort(['config.settings', 'doc_' || (doc_id // 2), 'os', 'pkg', 'sys'])"
sql("py_dependencies", PY, f"SELECT relative_path, unnest({PYDEPS}) AS dependency FROM py")
sql("dependency_lists", [PY, CODE], f"""
SELECT relative_path, array_to_string({PYDEPS}, ',') AS dependencies FROM py UNION ALL
SELECT relative_path, array_to_string(list_sort({PACKAGES}), ',') FROM code""")
sql("file_analysis_summary", [PY, SYMBOLS, ADJUSTED], f"""
SELECT py.relative_path, '### Quick Analysis' || {NL} || '- **Classes Defined:** ' || c || {NL} || '- **Primary Functions:** ' || f
  || {NL} || '- **Nested Functions:** ' || x || {NL} || '- **Decorators Used:** @register(' || lang || ')' || {NL}
  || '- **Type Annotations:** argv: Optional[List[str]], n: int, return -> Dict[str, int], return -> None, rows: List[str]' || {NL}
  || '- **Code Patterns:** ' || concat_ws(', ', marks, 'TODO (Line ' || (20 + 3 * n) || '): finish ' || doc_id) || {NL}
  || '- **Key Dependencies:** ' || array_to_string({PYDEPS}, ', ') AS summary
FROM py JOIN (SELECT relative_path,
    string_agg(label, ', ') FILTER (kind = 'class') AS c, string_agg(label, ', ') FILTER (kind = 'function') AS f,
    array_to_string(list_transform(list_sort(list({{'k': kk, 's': start_line, 'l': label}}) FILTER (kind = 'nested')), lambda r: r.l), ', ') AS x
  FROM (SELECT *, concat_ws(' -> ', parent, name) AS kk,
      concat_ws(' -> ', parent, name) || ' (Lines ' || start_line || '-' || end_line || ')' AS label FROM adjusted) GROUP BY 1) s
  USING (relative_path)
LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN contains(line, 'TODO:') THEN 'TODO' ELSE 'FIXME' END || ' (Line ' || (13 + 3 * i) || '): ' ||
    {strip("substr(line, strpos(line, CASE WHEN contains(line, 'TODO:') THEN 'TODO:' ELSE 'FIXME:' END) + CASE WHEN contains(line, 'TODO:') THEN 5 ELSE 6 END)")}, ', ' ORDER BY i) AS marks
  FROM (SELECT doc_id, unnest({lines('text')}) AS line, generate_subscripts({lines('text')}, 1) AS i FROM documents)
  WHERE contains(line, 'TODO:') OR contains(line, 'FIXME:') GROUP BY 1) t USING (doc_id)""")

TOC = f"""toc AS (
  SELECT relative_path, 0 AS ord, file_name AS title, 1 AS level, {slugged('relative_path')} AS anchor, {PURPOSE} AS summary FROM files
  UNION ALL SELECT relative_path, chunk_no, {name_of('relative_path')} || ' (Part ' || chunk_no || ')', 2,
    {slugged("relative_path || '-part-' || chunk_no")}, 'Lines ' || start_line || '-' || end_line
  FROM ({line_chunks(whole_lines('content'), 50, 'files', 'len(ls) > 100')}))"""
sql("toc_entries", [FILES, TOC], "SELECT relative_path, CAST(ord AS INT) AS ord, title, level, anchor, summary FROM toc")
sql("toc_symbols", [PY, SYMBOLS], f"""
SELECT relative_path, CAST(row_number() OVER (PARTITION BY relative_path ORDER BY part, t, k) - 1 AS INT) AS ord, title, level, anchor FROM (
  SELECT relative_path, 0 AS part, '' AS t, 0 AS k, 'mod_' || doc_id || '.py' AS title, 1 AS level, {slugged('relative_path')} AS anchor FROM py
  UNION ALL SELECT relative_path, 1, name, 0, 'Class: ' || name, 2, {slugged("relative_path || '-class-' || name")} FROM symbols WHERE kind = 'class'
  UNION ALL SELECT relative_path, 2, name, 0, 'Function: ' || name, 2, {slugged("relative_path || '-function-' || name")} FROM symbols WHERE kind <> 'class'
  UNION ALL SELECT relative_path, 3, '', i, {name_of('relative_path')} || ' (Part ' || i || ')', 2, {slugged("relative_path || '-part-' || i")}
    FROM (SELECT relative_path, unnest(range(1, CAST(ceil((22 + 3 * n) / 50.0) AS BIGINT) + 1)) AS i FROM py WHERE 22 + 3 * n > 100))""")
sql("ancestors", FILES, """
SELECT relative_path, CAST(n - 1 - i AS INT) AS up, array_to_string(parts[1:i], '/') AS ancestor FROM (
  SELECT relative_path, string_split(relative_path, '/') AS parts, len(string_split(relative_path, '/')) AS n,
    unnest(range(1, len(string_split(relative_path, '/')))) AS i FROM files)""")

# --- joins ------------------------------------------------------------------------------------

CLASSES = """classes AS (SELECT coalesce(p.relative_path, c.relative_path) AS relative_path,
  CASE WHEN p.relative_path IS NULL THEN 'added' WHEN c.relative_path IS NULL THEN 'removed'
    WHEN p.content_hash <> c.content_hash THEN 'modified' ELSE 'unchanged' END AS change_type,
  p.content_hash AS old_hash, c.content_hash AS new_hash
  FROM prev p FULL JOIN curr c ON p.relative_path = c.relative_path)"""
sql("track_changes", [PREV, CURR, CLASSES], "SELECT * FROM classes WHERE change_type <> 'unchanged'")
sql("change_stats", [PREV, CURR, CLASSES], """
SELECT t.change_type, count(c.relative_path) AS n FROM (SELECT unnest(['added', 'modified', 'removed', 'unchanged']) AS change_type) t
LEFT JOIN classes c USING (change_type) GROUP BY 1""")
_NORM = "regexp_replace(trim({0}, " + SPACES + "), '\\s+', ' ', 'g')"
sql("snapshot_diff", [PREV, CURR], f"""
SELECT coalesce(p.relative_path, c.relative_path) AS relative_path,
  CASE WHEN p.relative_path IS NULL THEN 'added' WHEN c.relative_path IS NULL THEN 'removed'
    WHEN p.t <> c.t OR p.f <> c.f THEN 'modified' ELSE 'unchanged' END AS change_type,
  coalesce(p.t <> c.t, false) AS content_changed, coalesce(p.f <> c.f, false) AS analysis_changed
FROM (SELECT relative_path, {_NORM.format('content')} AS t, {framework_list('content')} AS f FROM prev) p
FULL JOIN (SELECT relative_path, {_NORM.format('content')} AS t, CASE WHEN lang = 'es' THEN ['React'] ELSE {framework_list('content')} END AS f FROM curr) c
  ON p.relative_path = c.relative_path""")
sql("line_diff", [PREV, CURR], f"""
SELECT relative_path, string_agg(piece, {NL} ORDER BY i) AS diff FROM (
  SELECT relative_path, i, CASE WHEN o IS NULL THEN '+ ' || w WHEN w IS NULL THEN '- ' || o
    WHEN {_NORM.format('o')} <> {_NORM.format('w')} THEN '- ' || o || {NL} || '+ ' || w END AS piece
  FROM (SELECT relative_path, i, a[i] AS o, b[i] AS w FROM (
    SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM (
      SELECT p.relative_path, {lines('p.content')} AS a, {lines('c.content')} AS b FROM prev p JOIN curr c
        ON p.relative_path = c.relative_path WHERE {_NORM.format('p.content')} <> {_NORM.format('c.content')}))))
WHERE piece IS NOT NULL GROUP BY 1""")

RESOLVED = f"""bases AS (SELECT *, CASE WHEN import_path LIKE '../%' THEN substr(import_path, 4)
    ELSE {dir_of('source')} || '/' || substr(import_path, 3) END AS base FROM edges),
resolved AS (SELECT source, target, 'import' AS type, line, "character", symbol, context FROM (
  SELECT b.*, f.relative_path AS target, row_number() OVER (PARTITION BY b.source, b.line ORDER BY x.rank) AS rn
  FROM bases b, (SELECT unnest({listing(fixed.IMPORT_EXTENSIONS)}) AS e, unnest(range(0, {len(fixed.IMPORT_EXTENSIONS)})) AS rank) x, code f
  WHERE f.relative_path = b.base || x.e) WHERE rn = 1),
crossrefs AS (SELECT source AS relative_path, 'references' AS direction, target AS other, line, "character", symbol, context FROM resolved
  UNION ALL SELECT target, 'referencedBy', source, line, "character", symbol, context FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY line DESC) AS rn FROM resolved) WHERE rn = 1)"""
sql("resolve_imports", [CODE, EDGES, RESOLVED], "SELECT * FROM resolved")
sql("cross_references", [CODE, EDGES, RESOLVED], "SELECT * FROM crossrefs")
sql("xref_report", [CODE, EDGES, RESOLVED], f"""
SELECT relative_path, direction, other, line, "character", '  ' || CASE direction WHEN 'references' THEN '→' ELSE '←' END || ' ' || other
  || coalesce(' (' || symbol || ')', '') || ' - Line ' || (line + 1) || {NL} || '    Context: ' || context AS report_line FROM crossrefs""")

APPLIED = f"""{FILES}, known AS (
  SELECT DISTINCT 's-' || source AS tag_id, 'file' AS scope FROM documents UNION SELECT DISTINCT 'l-' || lang, 'directory' FROM documents
  UNION SELECT DISTINCT 'p-' || source || '-' || lang, 'both' FROM documents),
requests AS (
  SELECT relative_path AS applied_to, 'file' AS kind, unnest(['s-' || source, 'l-' || lang, 'p-' || source || '-' || lang, 'unknown']) AS tag_id FROM files
  UNION ALL SELECT DISTINCT source || '/' || lang, 'directory', unnest(['l-' || lang, 'p-' || source || '-' || lang]) FROM files
  UNION ALL SELECT DISTINCT source, 'directory', unnest(['s-' || source, 'p-' || source || '-' || lang]) FROM files),
applied AS (SELECT DISTINCT r.tag_id, r.applied_to FROM requests r JOIN known k ON k.tag_id = r.tag_id AND k.scope IN ('both', r.kind)),
direct AS (SELECT f.relative_path, a.tag_id, a.applied_to, 0 AS distance FROM files f JOIN applied a ON a.applied_to = f.relative_path),
inherited AS (SELECT f.relative_path, a.tag_id, a.applied_to, CAST(len(string_split(f.relative_path, '/')) - len(string_split(a.applied_to, '/')) AS INT) AS distance
  FROM files f JOIN applied a ON starts_with(f.relative_path, a.applied_to || '/'))"""
sql("apply_tags", APPLIED, "SELECT tag_id, applied_to FROM applied")
sql("remove_tags", APPLIED, """
SELECT tag_id, applied_to FROM applied WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.lang = 'fr'
  AND f.relative_path = applied_to AND 's-' || f.source = tag_id)""")
sql("tag_store", APPLIED, """
SELECT 'tag' AS kind, tag_id, scope || '/' || upper(tag_id) || '/#336699' AS value FROM known
UNION ALL SELECT 'applied', tag_id, applied_to FROM applied WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.lang = 'fr'
  AND f.relative_path = applied_to AND 's-' || f.source = tag_id)
UNION ALL VALUES ('setting', 'enabled', 'true'), ('setting', 'override', 'true')""")
sql("inherited_tags", APPLIED, "SELECT * FROM direct UNION ALL SELECT * FROM inherited")
sql("inherited_tags_override", APPLIED, """
SELECT * FROM direct UNION ALL SELECT * FROM inherited i WHERE NOT EXISTS (
  SELECT 1 FROM direct d WHERE d.relative_path = i.relative_path AND d.tag_id = i.tag_id)""")
sql("reuse_analysis", CURR, f"SELECT content_hash, relative_path, {CYCLOMATIC} AS cyclomatic FROM curr")

# --- aggregates ---------------------------------------------------------------------------------

ENTRIES = f"""alldirs AS (SELECT DISTINCT directory FROM (
    SELECT array_to_string(parts[1:i], '/') AS directory FROM (SELECT string_split(directory, '/') AS parts,
      unnest(range(1, len(string_split(directory, '/')) + 1)) AS i FROM project WHERE directory <> '.')
    UNION ALL SELECT '.' UNION ALL SELECT directory FROM project)),
entries AS (SELECT directory, 'file' AS kind, file_name AS name, size FROM project
    WHERE NOT starts_with(file_name, '.') AND NOT {one_of('lower(file_name)', fixed.UNLISTED_NAMES)} AND NOT {one_of('ext', fixed.BINARY_EXTENSIONS['tree'])}
  UNION ALL SELECT {dir_of('directory')}, 'directory', {name_of('directory')}, NULL FROM alldirs
    WHERE directory <> '.' AND NOT starts_with({name_of('directory')}, '.') AND NOT {one_of(f"lower({name_of('directory')})", fixed.UNLISTED_NAMES)}),
kinds AS (SELECT directory, {suffix('name')} AS e, count(*) AS n FROM entries WHERE kind = 'file' GROUP BY ALL),
mains AS (SELECT directory, substr(arg_min(e, (-n, e)), 2) AS main FROM kinds WHERE e <> '' GROUP BY 1),
totals AS (SELECT directory, coalesce(nf, 0) AS num_files, coalesce(nd, 0) AS num_dirs, CAST(coalesce(sz, 0) AS BIGINT) AS size, main,
    CASE WHEN coalesce(nf, 0) = 0 THEN 'Empty directory' ELSE 'Directory containing ' || nf || coalesce(' ' || main, '') || ' files'
      || CASE WHEN nd > 0 THEN ' and ' || nd || ' subdirectories' ELSE '' END END AS made
  FROM alldirs LEFT JOIN (SELECT directory, count(*) FILTER (kind = 'file') AS nf, count(*) FILTER (kind = 'directory') AS nd, sum(size) AS sz
    FROM entries GROUP BY 1) USING (directory) LEFT JOIN mains USING (directory))"""
sql("directory_listing", [PROJECT, ENTRIES], "SELECT directory, kind, name, size FROM entries")
sql("directory_purpose", [PROJECT, ENTRIES], "SELECT directory, '.' || main AS main_ext, made AS purpose FROM totals")
sql("directory_summary", [PROJECT, ENTRIES], f"""
SELECT t.directory, {name_of('t.directory')} AS name, {name_of(dir_of('t.directory'))} AS parent,
  coalesce({readme_purpose('r.content')}, made) AS purpose, num_files, num_dirs, t.size
FROM totals t LEFT JOIN (SELECT directory, content FROM project WHERE file_name = 'README.md') r ON r.directory = t.directory""")
sql("language_stats", FILES, """
SELECT coalesce(language, '(all)') AS language, count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_bytes
FROM files GROUP BY ROLLUP (language)""")
sql("stream_language_stats", FILES, """
SELECT coalesce(language, '(all)') AS language, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM files GROUP BY ROLLUP (language)""")
sql("word_counts", "", """
SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY 1""")
_USES = f"'Uses: ' || array_to_string({framework_list('content')}, ', ')"
_INFO = f"""nullif(concat_ws(' | ', CASE WHEN language IN ('typescript', 'typescriptreact') THEN
  CASE WHEN contains(content, 'use client') THEN 'Client Component' ELSE 'Server Component' END END,
  CASE WHEN len({framework_list('content')}) > 0 THEN 'Frameworks: ' || array_to_string({framework_list('content')}, ', ') END), '')"""
sql("toc_by_directory", FILES, f"""
SELECT DISTINCT directory, '' AS file_name, {NL} || '[' || directory || ']' AS line FROM files
UNION ALL SELECT directory, file_name, '  ' || file_name || coalesce(' (' || {_INFO} || ')', '') || {NL} || '    '
  || concat_ws(' | ', 'Purpose: ' || {KEYWORD}, CASE WHEN len({framework_list('content')}) > 0 THEN {_USES} END) FROM files""")
sql("toc_by_directory_markdown", FILES, f"""
SELECT DISTINCT directory, '' AS file_name, '<details open><summary>📁 ' || directory || '/</summary>' || {NL} AS line FROM files
UNION ALL SELECT directory, file_name, '  - [' || file_name || '](#' || {slugged('relative_path')} || ') *('
  || concat_ws(' | ', {KEYWORD}, CASE WHEN len({framework_list('content')}) > 0 THEN {_USES} END) || ')* ' FROM files""")

# --- order, sets ------------------------------------------------------------------------------------

sql("ordered_files", FILES, "SELECT relative_path, size FROM files ORDER BY relative_path")
sql("custom_order", FILES, """
SELECT relative_path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN doc_id END AS rank FROM files ORDER BY rank NULLS LAST, relative_path""")
_POINTS = f"list_filter({lines('text')}, lambda p: {strip('p')} <> '')"
sql("key_points_limit", "", "SELECT doc_id, " + ", ".join(
    f"array_to_string({_POINTS}{'' if n is None else f'[1:{n}]'}, {NL}) AS {d}" for d, n in fixed.KEY_POINT_LIMITS.items()) + " FROM documents")
sql("added_paths", [PREV, CURR], "SELECT relative_path FROM curr EXCEPT SELECT relative_path FROM prev")
sql("removed_paths", [PREV, CURR], "SELECT relative_path FROM prev EXCEPT SELECT relative_path FROM curr")
sql("unchanged_paths", [PREV, CURR], "SELECT relative_path FROM prev INTERSECT SELECT relative_path FROM curr")

# --- rendering ------------------------------------------------------------------------------------------

ISO = "strftime(mtime, '%Y-%m-%dT%H:%M:%SZ')"
ANALYSIS = "(CASE language WHEN 'python' THEN '### Quick Analysis' ELSE 'Unable to analyze file content' END)"
_KEEP = "file_name, directory, language, size, mtime, lang, doc_id, purpose, by_lines,"
PARTS = f"""described AS (SELECT *, {PURPOSE} AS purpose, len({whole_lines('content')}) > 100 AS by_lines FROM files),
parts AS ({line_chunks(whole_lines('content'), 50, 'described', 'by_lines', _KEEP)} UNION ALL
  {char_chunks(fixed.CHAR_CHUNK_SIZE, 'described', 'NOT by_lines', _KEEP)})"""
_MANY = "chunk_count > 1"
sql("render_markdown", [FILES, PARTS], f"""
SELECT relative_path, chunk_no AS part_no, concat_ws({NL},
  {NL} || '## ' || file_name || CASE WHEN {_MANY} THEN ' (Part ' || chunk_no || '/' || chunk_count || ')' ELSE '' END
    || ' {{' || {slugged('relative_path')} || CASE WHEN {_MANY} THEN '-part-' || chunk_no ELSE '' END || '}}',
  '', '### File Purpose', purpose, '', '### Directory Context', {name_of('directory')}, '', {ANALYSIS}, '',
  '#### Directory Hierarchy', '`' || directory || '`', '', '### Metadata', '```yaml', 'path: ' || relative_path, 'language: ' || language,
  'size: ' || size || ' bytes', 'last_modified: ' || {ISO}, '```', '',
  CASE WHEN by_lines THEN '#### Chunking Information' || {NL} || 'File split into ' || chunk_count || ' chunks' || {NL} END,
  CASE WHEN lang <> 'es' THEN '### User-Provided Summary' || {NL} || CASE lang WHEN 'en' THEN 'beside ' ELSE 'inside ' END || doc_id || {NL} END,
  '### Source Code', CASE WHEN {_MANY} THEN '# Chunk ' || chunk_no || ' of ' || chunk_count ELSE '' END,
  CASE WHEN {_MANY} THEN '# Lines ' || start_line || '-' || end_line ELSE '' END,
  CASE WHEN {_MANY} THEN '# ' || repeat('-', 40) ELSE '' END,
  '```' || language || {NL} || {strip('content')} || {NL} || '```', '',
  CASE WHEN chunk_no < chunk_count THEN '---' || {NL} END) AS text FROM parts""")
_PRE = "'<pre><code class=\"' || language || '\">'"
sql("render_html", [FILES, PARTS], f"""
SELECT d.relative_path, 1 AS part_no, concat_ws({NL}, '<div class=''file-header'' id=''file_' || sha256(d.relative_path) || '''>',
  '<h2>' || d.relative_path || '</h2>', '<h3>File Purpose</h3>', '<p>' || purpose || '</p>', '<p><strong>Size:</strong> ' || size_text || '</p>',
  '<p><strong>Last Modified:</strong> ' || {ISO} || '</p>', '</div>', '<div class=''file-content''>',
  CASE WHEN by_lines THEN body ELSE {_PRE} || {NL} || {escaped('content')} || {NL} || '</code></pre>' END,
  '<div class=''file-metadata''>', {ANALYSIS}, '</div>', '</div>', '<hr>') AS text
FROM (SELECT *, size AS n, {SIZE_TREE} AS size_text FROM (SELECT * REPLACE (size AS size), size AS n FROM described)) d
LEFT JOIN (SELECT relative_path, string_agg('<h4>Chunk ' || chunk_no || '</h4>' || {NL} || {_PRE} || {NL} || {escaped('content')} || {NL}
  || '</code></pre>' || {NL} || '<br>', {NL} ORDER BY chunk_no) AS body FROM parts WHERE by_lines GROUP BY 1) b ON b.relative_path = d.relative_path""")

_DEPS = f"array_to_string({PACKAGES}, ', ')"
_IMPORTS = "array_to_string(regexp_extract_all(content, 'import [^\\n\\r]* from [''\"]([^''\"]+)[''\"]', 1), ', ')"
_EXPORTS = ("array_to_string(list_concat(regexp_extract_all(content, 'export [^\\n\\r]* to [''\"]([^''\"]+)[''\"]', 1), "
            "regexp_extract_all(content, 'export [^\\n\\r]* from [''\"]([^''\"]+)[''\"]', 1)), ', ')")
_COMPLEX = f"'Cognitive: ' || {COGNITIVE} || ', Cyclomatic: ' || {CYCLOMATIC} || ', Lines: ' || len({lines('content')})"
_DOCUMENTED = f"{COMMENTS} || ' comments, ' || {DOC_COMMENTS} || ' JSDoc blocks'"
_SECURE = ("array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(content, {text(rx)}) THEN {text(n)} END" for rx, n in [
        ("(?i)password|secret|key|token|credential", "potential credentials"), ("(?i)api[_-]?key", "API key"),
        (r"(?i)database|db\.|sql|query", "database access"), ("(?i)fetch|axios|http|request", "network requests")])
    + "], lambda f: f IS NOT NULL), ', ')")
_FRAMES = f"array_to_string({framework_list('content')}, ', ')"
ANALYSED = f"""analysed AS (SELECT *, {KEYWORD} AS purpose, nullif({_FRAMES}, '') AS frames, nullif({_DEPS}, '') AS deps,
  nullif({_IMPORTS}, '') AS imports, nullif({_EXPORTS}, '') AS exports, {_COMPLEX} AS complexity, {_DOCUMENTED} AS documentation,
  nullif({_SECURE}, '') AS security FROM code)"""
sql("summary_depth", [CODE, ANALYSED], """
SELECT relative_path, purpose, frames AS frameworks, deps AS dependencies, imports, exports, complexity, documentation FROM analysed""")
_CKEEP = "file_name, directory, language, size, mtime, purpose, frames, deps, imports, exports, complexity, documentation, security,"
CPARTS = f"cparts AS ({report_chunks(20, 'analysed', _CKEEP)})"
_FENCED = f"'```' || {fence('language')} || {NL} || content || {NL} || '```'"
sql("render_plaintext", [CODE, ANALYSED, CPARTS], f"""
SELECT relative_path, chunk_no AS part_no, concat_ws({NL}, 'File: ' || relative_path, 'Language: ' || language, '', 'Purpose: ' || purpose,
  'Frameworks: ' || frames, 'Dependencies: ' || deps, 'Imports: ' || imports, 'Exports: ' || exports, '',
  CASE WHEN {_MANY} THEN concat_ws({NL}, '//' || repeat('-', 77), '// Chunk ' || chunk_no || ': Lines ' || start_line || '-' || end_line, '//' || repeat('-', 77), '') END,
  {_FENCED}, '', '//' || repeat('=', 77), '', '') AS text FROM cparts""")
_MARK = f"CASE WHEN {_MANY} THEN ' (Chunk ' || chunk_no || '/' || chunk_count || ')' ELSE '' END"
sql("render_document_markdown", [CODE, ANALYSED, CPARTS], f"""
SELECT relative_path, chunk_no AS part_no, concat_ws({NL}, '## ' || file_name || {_MARK} || ' {{' || directory || '}}', '', '<details>',
  '<summary>File Metadata</summary>', '', '| Property | Value |', '|----------|--------|', '| Path | `' || relative_path || '` |',
  '| Language | ' || language || ' |', '| Size | ' || size || ' bytes |', '| Last Modified | ' || {ISO} || ' |',
  '| Purpose | ' || purpose || ' |', '| Frameworks | ' || frames || ' |', '| Dependencies | ' || deps || ' |', '| Imports | ' || imports || ' |',
  '| Exports | ' || exports || ' |', '| Complexity | ' || complexity || ' |', '| Documentation | ' || documentation || ' |',
  '| Security | ' || security || ' |', {NL} || '</details>', '',
  CASE WHEN {_MANY} THEN concat_ws({NL}, CASE WHEN chunk_no = 1 THEN '<details open>' ELSE '<details>' END || '<summary>Chunk ' || chunk_no || ': Lines '
    || start_line || '-' || end_line || '</summary>', '', {_FENCED}, '', '</details>') ELSE {_FENCED} END, '') AS text FROM cparts""")
sql("render_document_html", [CODE, ANALYSED], f"""
SELECT relative_path, 1 AS part_no, concat_ws({NL}, '<div class="file-section extra-spacing">',
  '<h2>' || file_name || ' <span class="file-path">' || directory || '</span></h2>', '<div class="file-metadata">', '<details>',
  '<summary>File Metadata</summary>', '<table>', '<tr><th>Property</th><th>Value</th></tr>',
  '<tr><td>Path</td><td><code>' || relative_path || '</code></td></tr>', '<tr><td>Language</td><td>' || language || '</td></tr>',
  '<tr><td>Size</td><td>' || size || ' bytes</td></tr>', '<tr><td>Last Modified</td><td>' || {ISO} || '</td></tr>',
  '<tr><td>Purpose</td><td>' || purpose || '</td></tr>', '<tr><td>Frameworks</td><td>' || frames || '</td></tr>',
  '<tr><td>Dependencies</td><td>' || deps || '</td></tr>', '</table>', '</details>', '</div>',
  '<div class="code-block extra-spacing"><pre><code class="language-' || language || '">' || {escaped('content', '&#039;')} || '</code></pre></div>',
  '</div>', '<hr>', '') AS text FROM analysed""")
sql("formatter_choice", "", " UNION ALL ".join(
    f"SELECT '{style}' AS style, relative_path, part_no, text FROM ({ORACLES[name]})" for style, name in [
        ("Markdown", "render_document_markdown"), ("HTML", "render_document_html"), ("other", "render_plaintext")]))
sql("render_overview", [CODE, ANALYSED], f"""
SELECT relative_path, chunk_no AS part_no, concat_ws({NL}, CASE WHEN chunk_no = 1 THEN concat_ws({NL}, {NL} || '## ' || relative_path,
    '```yaml', 'language: ' || language, 'size: ' || size_text, 'frameworks: ' || frames, '```') END,
  '```' || language || CASE WHEN chunk_count > 1 THEN ' (Chunk ' || chunk_no || '/' || chunk_count || ')' ELSE '' END || {NL} || content || {NL} || '```' || {NL}) AS text
FROM (SELECT c.*, {SIZE_DOC} AS size_text FROM (SELECT *, size AS n FROM (
  {line_chunks(lines('content'), 20, 'analysed', 'width > 20', 'language, size, frames,')}
  UNION ALL SELECT relative_path, language, size, frames, 1, 1, 1, 1, content FROM analysed WHERE length(content) <= 20)) c)""")
sql("change_report", [PREV, CURR, CLASSES], """
SELECT * FROM (SELECT CASE change_type WHEN 'added' THEN 1 WHEN 'modified' THEN 2 ELSE 3 END AS section_no, 3 AS row_no, relative_path,
    '- ' || relative_path || ' (' || change_type || ')' AS line FROM classes WHERE change_type <> 'unchanged'
  UNION ALL SELECT DISTINCT s.section_no, s.row_no, '', s.line FROM classes c JOIN (VALUES
    ('added', 1, 0, '### Added Files'), ('added', 1, 1, ''), ('added', 1, 4, ''),
    ('modified', 2, 0, '### Modified Files'), ('modified', 2, 1, ''), ('modified', 2, 4, ''),
    ('removed', 3, 0, '### Removed Files'), ('removed', 3, 1, ''), ('removed', 3, 4, '')) s(change_type, section_no, row_no, line) USING (change_type))""")
sql("report_sink", FILES, f"""
SELECT line, count(*) AS n FROM (SELECT unnest({lines('t')}) AS line FROM (SELECT concat_ws({NL}, 'File: ' || relative_path, 'Language: ' || language, '',
  'Purpose: ' || {KEYWORD}, '', {_FENCED}, '', '//' || repeat('=', 77), '', '') AS t FROM files)) GROUP BY 1""")

# --- streams --------------------------------------------------------------------------------------------

sql("stream_incremental", [PREV, docs("nowfiles")], """
SELECT c.relative_path, c.size, c.content_hash, CASE WHEN p.relative_path IS NULL THEN 'added' ELSE 'modified' END AS change_type
FROM nowfiles c LEFT JOIN prev p USING (relative_path) WHERE p.relative_path IS NULL OR p.content_hash <> c.content_hash""")
EDITS = "edits AS (SELECT 'u' || user_id AS path, ts, sha256(event_type || '/' || event_id) AS content_hash FROM events)"
sql("latest_version", EDITS, """
SELECT path, ts, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, content_hash DESC) AS rn FROM edits) WHERE rn = 1""")
sql("stream_changes", EDITS, """
SELECT path, 'added' AS first_change, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC) AS rn FROM edits) WHERE rn = 1""")
