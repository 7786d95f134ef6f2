"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from corpuscope import fixed, session
from corpuscope.functions import code, globs, paths, sensitive
from corpuscope.functions import text as tx
from corpuscope.operators import changes, filters, lines, order, reuse, rollup, rules, snapshots, symbols, tags, xref
from corpuscope.options import ReportOptions
from corpuscope.plans import sections, toc
from corpuscope.sources import files as fl
from corpuscope.sources import ignore, state, versions
from corpuscope.streaming import edits as st
from workload import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters shared with the SQL twins.
IGNORE_LINES = ["# rules", "", "*.json", "/src0/en/", "docs/*.md", "src1", "src[2-3]/de/tests/doc_?*.t?t",
                "doc_1.txt", "*/fr/build/"]
EXCLUDE_DIRS = ["src1", "node", ".venv"]
TOKEN = sensitive.SensitivePattern("Token", r"token\s*=\s*\"", r"[^\"]+", r"\"")
ALL_PATTERNS = [*sensitive.BUILT_IN_PATTERNS, TOKEN]
SEARCH = "tion[ae]n?d"
SNAPSHOT_LANGS = ["en", "de", "fr", "es"]
REJECT_ABOVE = 2500     # bytes
WORD = "Tion the"


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(session.configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build




def C() -> Column:
    return F.col("content")


def PATH() -> Column:
    return F.col("relative_path")


def listed(values: Column) -> Column:
    return F.array_join(values, ",")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return v.document_files(spark, d)


def _code(spark: SparkSession, d: str) -> DataFrame:
    return v.code_files(spark, d)


def _python(spark: SparkSession, d: str) -> DataFrame:
    return v.python_files(spark, d)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").withColumnRenamed("text", "content")


# --- sources and stores ------------------------------------------------------------------


@query
def scan_files(spark, d):
    return fl.scan_tree(spark, d).select("relative_path", paths.suffix(paths.file_name(PATH())).alias("ext"), "size")


@query
def scan_text(spark, d):
    """The documents written as a tree of text files and scanned back, totalled per directory
    (how many files Spark writes is its own choice)."""
    folder = session.new_folder(spark, "tree")
    rows = v.table(spark, d, "documents").select("source", "lang", "text")
    rows.write.partitionBy("source", "lang").option("maxRecordsPerFile", 1000).text(folder)
    texts, _ = fl.decoded(fl.scan_tree(spark, folder, name_glob="*.txt"))
    line_feeds = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return texts.groupBy(paths.directory(PATH()).alias("directory")).agg(
        F.sum("size").alias("n_bytes"), F.sum(line_feeds).cast("long").alias("n_lines"))


@query
def scan_rejects(spark, d):
    """Documents as scanned files: texts in German end in a byte that UTF-8 does not have, large ones are not
    kept. Files and bytes per reason beside the counts that the one pass over them observed."""
    bytes_ = F.encode("content", "UTF-8")
    broken = F.when(F.col("lang") == "de", F.concat(bytes_, F.lit(b"\xff"))).otherwise(bytes_)
    scanned = _docs(spark, d).select("relative_path", "mtime", broken.alias("bytes")).withColumn(
        "size", F.octet_length("bytes").cast("bigint"))
    counts = Observation("scan")
    rows = session.written(fl.scan_counts(fl.tagged(scanned, REJECT_ABOVE), counts).drop("bytes"), "scan")
    seen = counts.get
    of_reason = F.create_map(*[F.lit(x) for pair in (
        ("kept", seen["kept"]), (fl.TOO_LARGE, seen["too_large"]), (fl.UNDECODABLE, seen["undecodable"])) for x in pair])
    return rows.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(
        F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("bigint").alias("n_chars")).withColumns({
            "n_observed": F.element_at(of_reason, F.col("outcome")), "n_listed": F.lit(seen["listed"])})


@query
def open_documents(spark, d):
    rows = _docs(spark, d).withColumn("scheme", F.when(F.col("lang") == "es", "untitled").when(
        F.col("ext") == ".json", "output").otherwise("file")).withColumn(
        "is_untitled", (F.col("lang") == "es") | (F.col("source") == "src5"))
    return filters.saved_documents(rows).select("relative_path", "scheme")


@query
def ignore_rules(spark, d):
    """Every line of every document read as a line of an ignore file, and every path as a rule."""
    rows = _docs(spark, d)
    texts = lines.lines(rows).select(F.concat(F.lit(" "), "text").alias("text"), "relative_path", "line_no")
    own = rows.select(F.concat(F.lit("/"), "relative_path", F.lit("/")).alias("text"), "relative_path", F.lit(0).alias("line_no"))
    names = rows.select(F.concat(F.lit("*"), "ext").alias("text"), "relative_path", F.lit(-1).alias("line_no"))
    return ignore.rules_from_lines(texts.unionByName(own).unionByName(names))


@query
def user_summaries(spark, d):
    return rollup.summaries_from_notes(v.noted_files(spark, d))


@query
def state_roundtrip(spark, d):
    base = session.new_folder(spark, "state")
    state.save_state(v.previous(spark, d), base)
    state.save_state(v.current(spark, d), base)
    return state.load_state(spark, base)


def _headers(spark, d):
    """One snapshot per day of edits."""
    day = F.date_format("ts", "yyyyMMdd")
    return v.table(spark, d, "events").groupBy(day.alias("snapshot_id")).agg(
        F.max("ts").alias("ts"), F.concat(F.lit("day of "), F.count("*").cast("string"), F.lit(" edits")).alias("description"),
        F.array_sort(F.collect_set("event_type")).alias("tags"))


@query
def snapshot_retention(spark, d):
    return snapshots.newest(_headers(spark, d), fixed.MAX_SNAPSHOTS).select("snapshot_id", "ts", "description")


@query
def snapshot_list(spark, d):
    """Named snapshots after an upsert and a delete."""
    rows = v.table(spark, d, "documents")
    stored = rows.groupBy(F.concat("source", F.lit("-"), "lang").alias("name")).agg(
        F.max("doc_id").cast("string").alias("content"), F.lit(v.FIRST_DAY).cast("timestamp").alias("ts"))
    saves = rows.filter("lang = 'en'").groupBy(F.concat("source", F.lit("-all")).alias("name")).agg(
        F.max("doc_id").cast("string").alias("content"), F.lit(v.FIRST_DAY).cast("timestamp").alias("ts"))
    gone = rows.select(F.concat("source", F.lit("-es")).alias("name")).distinct()
    return snapshots.list_named(snapshots.delete_named(snapshots.save_named(stored, saves), gone))


@query
def snapshot_metadata(spark, d):
    heads = _headers(spark, d)
    new = heads.filter(F.month("ts") == 1).select(
        "snapshot_id", F.concat(F.lit("january "), "snapshot_id").alias("description"),
        F.lit(None).cast("array<string>").alias("tags"))
    gone = heads.filter(F.dayofmonth("ts") == 2).select("snapshot_id")
    return snapshots.updated(snapshots.deleted(heads, gone), new).select(
        "snapshot_id", "description", listed(F.col("tags")).alias("tags"))


@query
def snapshot_stats(spark, d):
    rows = _docs(spark, d).withColumn("snapshot_id", F.col("source"))
    return snapshots.snapshot_stats(rows)


@query
def snapshot_store(spark, d):
    """One snapshot per language and one of all files, through a store whose second opening keeps fewer; one
    is described anew, one deleted, and the files of a run without a header are swept. What the folders
    hold afterwards, beside the headers: a folder too many or too few would show."""
    base = session.new_folder(spark, "snapshots")
    rows = _docs(spark, d).select("relative_path", "language", "size", "content_hash", "content", "lang")
    store = snapshots.SnapshotStore(spark, base)
    for day, lang in enumerate(SNAPSHOT_LANGS, 1):
        store.create(rows.filter(F.col("lang") == lang), lang, datetime(2025, 1, day), f"{lang} files", [lang])
    smaller = snapshots.SnapshotStore(spark, base, keep=3)
    smaller.create(rows, "all", datetime(2025, 2, 1), "all files", ["all"])
    smaller.update(SNAPSHOT_LANGS[-1], description="described anew")
    smaller.delete(SNAPSHOT_LANGS[-2])
    rows.drop("content").write.parquet(f"{base}/files/snapshot_id=unnamed")
    smaller.sweep(grace_seconds=0)
    held = snapshots.snapshot_stats(spark.read.parquet(f"{base}/files"))
    heads = smaller.headers().select(F.col("snapshot_id").alias("named"), "description", listed(F.col("tags")).alias("tags"))
    return heads.join(held, F.col("named") == F.col("snapshot_id"), "full").drop("named")


# --- filters -------------------------------------------------------------------------------


@query
def filter_builtin_ignore(spark, d):
    return filters.not_ignored(_docs(spark, d)).select("relative_path")


@query
def filter_ignore_rules(spark, d):
    return filters.outside_rules(_docs(spark, d), globs.ignore_patterns(IGNORE_LINES)).select("relative_path")


@query
def filter_rule_table(spark, d):
    """Rules of every shape for the documents labelled toxic, and the fixed ones."""
    rows = _docs(spark, d).join(v.table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id")
    number = F.col("doc_id").cast("string")
    shape = F.element_at(F.array(
        PATH(), F.concat(F.col("directory"), F.lit("/*_"), number, F.lit("[.-]*")), F.concat(F.lit("*/doc_"), number, F.col("ext")),
        F.concat(F.lit("src?/*_"), number, F.lit(".*")), F.concat(F.lit("*_"), number, F.col("ext"))),
        (F.col("doc_id") % 5 + 1).cast("int"))
    fixed_rules = spark.createDataFrame([(rule,) for rule in globs.ignore_patterns(IGNORE_LINES)], "pattern string")
    table = rows.select(shape.alias("pattern")).unionByName(fixed_rules)
    return rules.outside_rule_table(_docs(spark, d), table).select("relative_path")


@query
def filter_globs(spark, d):
    return filters.outside_globs(_docs(spark, d)).select("relative_path")


@query
def filter_types(spark, d):
    return filters.of_types(_docs(spark, d), ["py", "ts", "js", "env", "md"], ["js", "env"]).select("relative_path")


@query
def filter_text_files(spark, d):
    return filters.text_only(_docs(spark, d)).select("relative_path")


@query
def filter_dirs(spark, d):
    return filters.outside_directories(_docs(spark, d), EXCLUDE_DIRS).select("relative_path")


@query
def filter_size(spark, d):
    return filters.within_size(_docs(spark, d), 2500).select("relative_path", "size")


@query
def filter_selected(spark, d):
    chosen = v.table(spark, d, "labels").filter("quality = 1").select("doc_id")
    picked = v.table(spark, d, "documents").join(chosen, "doc_id", "left_semi").select(
        v.document_path().alias("relative_path"))
    return filters.selected(_docs(spark, d), picked).select("relative_path")


@query
def search_regex(spark, d):
    return lines.search_regex(_docs(spark, d), SEARCH)


@query
def search_substring(spark, d):
    return lines.search_substring(_docs(spark, d), WORD)


def _state(files):
    return files.select("relative_path", "content_hash")


@query
def incremental_files(spark, d):
    return filters.changed_since(v.current(spark, d), _state(v.previous(spark, d))).select("relative_path")


@query
def valid_edges(spark, d):
    edges = xref.import_edges(_code(spark, d)).select(
        F.col("source"), F.when(F.col("import_path").contains("_1"), "").otherwise(F.col("import_path")).alias("target"),
        F.when(F.col("symbol").isNull(), F.lit(None)).otherwise("import").alias("type"))
    return filters.valid_edges(edges)


@query
def sensitive_policy(spark, d):
    policy = F.when(F.col("lang") == "en", "redact").when(F.col("lang") == "de", "skip").when(
        F.col("lang") == "fr", "warn").otherwise("ignore")
    out = filters.apply_sensitive_policy(_raw(spark, d), policy, [TOKEN])
    return out.select("doc_id", "is_flagged", tx.content_hash(C()).alias("content_hash"))


# --- scalars -------------------------------------------------------------------------------


@query
def path_parts(spark, d):
    return _docs(spark, d).select("relative_path", paths.parts(PATH()).alias("p")).select("relative_path", "p.*")


@query
def language_of(spark, d):
    return _docs(spark, d).select(
        "relative_path", paths.language(PATH()).alias("tree"), paths.language(PATH(), "document").alias("document"))


@query
def fence_label(spark, d):
    return _docs(spark, d).select("relative_path", paths.fence_label(F.col("language")).alias("label"),
                                  paths.fence_label(F.col("language"), {"python": "py"}).alias("custom"))


@query
def size_label(spark, d):
    big = F.col("size") * F.col("doc_id") * F.lit(977)
    rows = _docs(spark, d).select("relative_path", F.explode(F.array("size", big)).alias("n"))
    return rows.select("relative_path", "n", *[tx.size_label(F.col("n"), s).alias(s) for s in ("tree", "document", "compact")])


@query
def slug(spark, d):
    return _raw(spark, d).select("doc_id", tx.slug(C()).alias("slug"))


@query
def html_escape(spark, d):
    return v.page_files(spark, d).select(
        "relative_path", tx.html_escape(C()).alias("tree"), tx.html_escape(C(), "document").alias("document"))


@query
def content_hash(spark, d):
    return _raw(spark, d).select("doc_id", tx.content_hash(C()).alias("content_hash"))


@query
def file_purpose(spark, d):
    return _docs(spark, d).select("relative_path", code.file_purpose(F.col("file_name"), F.col("ext"), C()).alias("purpose"))


@query
def purpose_keyword(spark, d):
    return _code(spark, d).select("relative_path", code.keyword_purpose(C()).alias("purpose")).unionByName(
        _docs(spark, d).select("relative_path", code.keyword_purpose(C()).alias("purpose")))


@query
def frameworks(spark, d):
    return _code(spark, d).select("relative_path", listed(code.frameworks(C())).alias("frameworks"))


@query
def js_dependencies(spark, d):
    return xref.package_dependencies(_code(spark, d)).select("relative_path", listed(F.col("dependencies")).alias("dependencies"))


@query
def js_references(spark, d):
    return _code(spark, d).select("relative_path", F.inline(code.raw_references(C())))


@query
def line_count(spark, d):
    return _raw(spark, d).select("doc_id", tx.line_count(C()).cast("long").alias("n_lines"))


@query
def cyclomatic(spark, d):
    return _code(spark, d).select("relative_path", code.cyclomatic(C()).cast("long").alias("score"))


@query
def cognitive(spark, d):
    return _code(spark, d).select("relative_path", code.cognitive(C()).cast("long").alias("score"))


@query
def doc_counts(spark, d):
    return _docs(spark, d).select(
        "relative_path", code.comment_count(C()).cast("long").alias("comments"),
        code.doc_comment_count(C()).cast("long").alias("doc_comments"),
        code.fenced_block_count(C()).cast("long").alias("fenced"))


@query
def sensitive_flags(spark, d):
    return _docs(spark, d).select("relative_path", listed(code.sensitive_flags(C())).alias("flags"))


@query
def data_access_flags(spark, d):
    return _docs(spark, d).select("relative_path", listed(code.data_access_flags(C())).alias("flags"))


@query
def readme_purpose(spark, d):
    """Every document read as a README: English ones below a title, French ones on a titled
    paragraph alone, others as they are."""
    title = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"))
    text = F.when(F.col("lang") == "en", F.concat(title, F.lit("\n\n"), C())).when(
        F.col("lang") == "fr", F.concat(title, F.lit("\n"), F.replace(C(), F.lit("\n\n"), F.lit("\n")))).when(
        F.col("lang") == "es", F.concat(title, F.lit("\n## more\n"), F.replace(C(), F.lit("\n\n"), F.lit("\n")))).otherwise(
        F.concat(F.lit("A [link](http://x/y) to **bold** `code`\n"), C()))
    return _raw(spark, d).select("doc_id", code.readme_purpose(text).alias("purpose"))


@query
def language_info(spark, d):
    marked = F.when(F.col("lang") == "en", F.concat(F.lit("'use client';\n"), C())).otherwise(C())
    return _code(spark, d).select(
        "relative_path", code.language_info(F.col("language"), marked, code.frameworks(marked)).alias("info"))


@query
def token_splits(spark, d):
    tag = F.when(F.col("lang") == "es", F.col("source")).otherwise(F.concat("lang", F.lit("/"), "source"))
    dep = F.when(F.col("lang") == "fr", F.col("source")).otherwise(F.concat("source", F.lit("@1."), F.col("doc_id").cast("string")))
    rows = _raw(spark, d).select("doc_id", tx.tag_parts(tag).alias("t"), tx.dependency_parts(dep).alias("p"),
                                 tx.shown_line(F.col("doc_id")).alias("shown"))
    return rows.select("doc_id", "t.scope", F.col("t.name").alias("tag"), F.col("p.name").alias("package"), "p.version", "shown")


@query
def blank_lines(spark, d):
    return _docs(spark, d).select("relative_path", tx.leading_blank_lines(C()).alias("leading"),
                                  tx.blank_lines_between(C(), F.lit(2), F.lit(8)).alias("between"))


@query
def adjusted_lines(spark, d):
    return symbols.adjusted_symbols(_python(spark, d))


@query
def todo_items(spark, d):
    return lines.todo_items(_code(spark, d))


@query
def normalized_text(spark, d):
    return _raw(spark, d).select("doc_id", tx.normalized(C()).alias("plain"), tx.normalized(C(), True, True).alias("lowered"))


@query
def snippet(spark, d):
    return _docs(spark, d).select("relative_path", tx.snippet(C()).alias("snippet"))


@query
def tag_ids(spark, d):
    names = v.table(spark, d, "documents").select(
        F.concat("lang", F.lit(" "), F.upper("source")).alias("name"), F.col("doc_id").alias("created_order"))
    return tags.new_tag_ids(names)


@query
def mtime_iso(spark, d):
    return v.table(spark, d, "events").select("event_id", tx.iso_time(F.col("ts")).alias("iso"))


# --- generators ------------------------------------------------------------------------------


@query
def lines_tree(spark, d):
    return lines.lines(_code(spark, d), "tree")


@query
def lines_document(spark, d):
    return lines.lines(_docs(spark, d))


QUERIES["lines"] = QUERIES.pop("lines_document")


@query
def chunk_lines(spark, d):
    return lines.line_chunks(_docs(spark, d), 10, 20)


@query
def report_chunks(spark, d):
    return lines.exploded(_docs(spark, d), lines.report_chunk_array(C(), 6))


@query
def chunk_chars(spark, d):
    return lines.char_chunks(_docs(spark, d), 1000)


@query
def sensitive_matches(spark, d):
    return rollup.sensitive_matches(_code(spark, d), ALL_PATTERNS)


@query
def code_symbols(spark, d):
    return symbols.symbols(_python(spark, d))


@query
def code_annotations(spark, d):
    return symbols.annotations(_python(spark, d))


@query
def toc_entries(spark, d):
    return toc.toc_entries(_docs(spark, d))


@query
def toc_symbols(spark, d):
    return toc.toc_entries(_python(spark, d), with_symbols=True).select("relative_path", "ord", "title", "level", "anchor")


@query
def ancestors(spark, d):
    return _docs(spark, d).select("relative_path", F.posexplode(paths.ancestors(PATH())).alias("up", "ancestor"))


@query
def import_edges(spark, d):
    return xref.import_edges(_code(spark, d))


@query
def py_dependencies(spark, d):
    return symbols.dependencies(_python(spark, d))


# --- joins ------------------------------------------------------------------------------------


@query
def track_changes(spark, d):
    return changes.track_changes(_state(v.previous(spark, d)), _state(v.current(spark, d)))


def _analysed(files):
    """Snapshot files; the analysis of Spanish ones names their languages, which change."""
    return files.withColumn("frameworks", code.frameworks(C())).withColumn(
        "dependencies", code.package_dependencies(C()))


@query
def snapshot_diff(spark, d):
    old = _analysed(v.previous(spark, d))
    new = _analysed(v.current(spark, d)).withColumn(
        "frameworks", F.when(F.col("lang") == "es", F.array(F.lit("React"))).otherwise(F.col("frameworks")))
    return changes.compare_snapshots(old, new)


@query
def line_diff(spark, d):
    return changes.line_diff(v.previous(spark, d), v.current(spark, d))


def _edges(spark, d):
    files = _code(spark, d)
    return xref.resolve_imports(xref.import_edges(files), files.select("relative_path"))


@query
def resolve_imports(spark, d):
    return _edges(spark, d)


@query
def cross_references(spark, d):
    return xref.cross_references(_edges(spark, d))


def _applied(spark, d):
    return tags.apply_tags(v.tags(spark, d), v.tag_requests(spark, d))


@query
def apply_tags(spark, d):
    return _applied(spark, d)


def _gone(spark, d):
    return _docs(spark, d).filter("lang = 'fr'").select(
        F.concat(F.lit("s-"), "source").alias("tag_id"), F.col("relative_path").alias("applied_to"))


@query
def remove_tags(spark, d):
    return tags.remove_tags(_applied(spark, d), _gone(spark, d))


@query
def tag_store(spark, d):
    """Tags and applied tags saved and loaded, some taken away, saved as the next version and loaded again."""
    base = session.new_folder(spark, "tags")
    known = v.tags(spark, d).select(
        "tag_id", F.upper("tag_id").alias("name"), F.lit("#336699").alias("color"),
        F.lit(None).cast("string").alias("description"), "scope", F.lit(None).cast("string").alias("icon"))
    applied = _applied(spark, d).withColumn("applied_at", F.lit("2025-01-16").cast("timestamp")).withColumn(
        "applied_by", F.lit("rule"))
    state.save_tags(known, applied, base)
    loaded, held, _ = state.load_tags(spark, base)
    state.save_tags(loaded, tags.remove_tags(held, _gone(spark, d)), base, override=True)
    loaded, held, settings = state.load_tags(spark, base)
    rows = loaded.select(F.lit("tag").alias("kind"), "tag_id", F.concat_ws("/", "scope", "name", "color").alias("value"))
    rows = rows.unionByName(held.select(F.lit("applied").alias("kind"), "tag_id", F.col("applied_to").alias("value")))
    return rows.unionByName(settings.select(F.inline(F.array(*[
        F.struct(F.lit("setting").alias("kind"), F.lit(name).alias("tag_id"), F.col(name).cast("string").alias("value"))
        for name in ("enabled", "override")]))))


@query
def inherited_tags(spark, d):
    return tags.effective_tags(_docs(spark, d), _applied(spark, d))


@query
def inherited_tags_override(spark, d):
    return tags.effective_tags(_docs(spark, d), _applied(spark, d), override=True)


@query
def reuse_analysis(spark, d):
    """The analysis of the current corpus, with that of the previous one stored."""

    def analyse(files):
        return files.select("content_hash", code.cyclomatic(C()).cast("long").alias("cyclomatic")).distinct()

    stored = analyse(v.previous(spark, d).select("content_hash", "content"))
    return reuse.reuse_analysis(v.current(spark, d).select("relative_path", "content_hash", "content"), stored, analyse)[0]


# --- aggregates ---------------------------------------------------------------------------------


@query
def directory_summary(spark, d):
    return rollup.directory_summary(v.project_files(spark, d))


@query
def directory_listing(spark, d):
    return rollup.directory_entries(v.project_files(spark, d))


@query
def directory_purpose(spark, d):
    return rollup.directory_purposes(v.project_files(spark, d))


@query
def language_stats(spark, d):
    return rollup.language_stats(_docs(spark, d))


@query
def word_counts(spark, d):
    return lines.word_counts(_raw(spark, d))


@query
def change_stats(spark, d):
    return changes.change_counts(changes.classify(_state(v.previous(spark, d)), _state(v.current(spark, d))))


@query
def dependency_lists(spark, d):
    both = _python(spark, d).unionByName(_code(spark, d))
    return fl.dependency_lists(both).select("relative_path", listed(F.col("dependencies")).alias("dependencies"))


@query
def file_analysis_summary(spark, d):
    return symbols.analysis_summary(_python(spark, d))


@query
def chunk_counts(spark, d):
    chunks = lines.line_chunk_array(C(), 50, 100)
    return _docs(spark, d).select("relative_path", F.size(chunks).alias("n_chunks"), F.when(
        F.size(chunks) > 0, F.format_string("File split into %d chunks", F.size(chunks))).alias("chunk_info"))


@query
def toc_by_directory(spark, d):
    return toc.toc_by_directory(_docs(spark, d))


@query
def toc_by_directory_markdown(spark, d):
    return toc.toc_by_directory(_docs(spark, d), "markdown")


@query
def sensitive_summary(spark, d):
    return rollup.sensitive_summary(_code(spark, d), ALL_PATTERNS)


# --- order, sets ------------------------------------------------------------------------------------


@query
def ordered_files(spark, d):
    return order.by_path(_docs(spark, d).select("relative_path", "size"))


@query
def custom_order(spark, d):
    """Labelled files first, by id; the others by path."""
    ranked = v.table(spark, d, "documents").join(v.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(
        v.document_path().alias("relative_path"), F.col("doc_id").alias("rank"))
    return order.by_user_order(_docs(spark, d).select("relative_path"), ranked)


@query
def key_points_limit(spark, d):
    """Non-blank lines as key points, at every depth."""
    points = F.filter(tx.lines(C()), lambda p: tx.strip(p) != "")
    rows = _raw(spark, d).select("doc_id", points.alias("points"))
    return rows.select("doc_id", *[F.array_join(sections.limited_key_points(F.col("points"), depth), "\n").alias(depth)
                                   for depth in fixed.DEPTHS])


@query
def added_paths(spark, d):
    return changes.added_paths(v.previous(spark, d), v.current(spark, d))


@query
def removed_paths(spark, d):
    return changes.removed_paths(v.previous(spark, d), v.current(spark, d))


@query
def unchanged_paths(spark, d):
    return changes.kept_paths(v.previous(spark, d), v.current(spark, d))


# --- masking and rendering ---------------------------------------------------------------------------


@query
def redact(spark, d):
    return _code(spark, d).select("relative_path", sensitive.redacted(C(), ALL_PATTERNS).alias("content"))


@query
def render_markdown(spark, d):
    notes = rollup.summaries_from_notes(v.noted_files(spark, d))
    return sections.tree_markdown(rollup.with_user_summaries(_docs(spark, d), notes))


@query
def render_html(spark, d):
    return sections.tree_html(_docs(spark, d))


@query
def render_plaintext(spark, d):
    return sections.document_plaintext(_code(spark, d), ReportOptions(depth="detailed", chunk_size=20))


@query
def render_document_markdown(spark, d):
    return sections.document_markdown(_code(spark, d), ReportOptions(depth="comprehensive", chunk_size=20))


@query
def render_document_html(spark, d):
    return sections.document_html(_code(spark, d), ReportOptions(depth="standard", chunk_size=0))


@query
def formatter_choice(spark, d):
    """The document sections by the name of a style; a name that is no style gives plain text."""
    chosen = {"Markdown": ReportOptions(depth="comprehensive", chunk_size=20), "HTML": ReportOptions(chunk_size=0),
              "other": ReportOptions(depth="detailed", chunk_size=20)}
    rows = [sections.document_sections(_code(spark, d), name, options).withColumn("style", F.lit(name))
            for name, options in chosen.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def render_overview(spark, d):
    return sections.overview_sections(_code(spark, d), ReportOptions(chunk_size=20), enable_chunking=True)


@query
def change_report(spark, d):
    changed = changes.track_changes(_state(v.previous(spark, d)), _state(v.current(spark, d)))
    return changes.change_report(changed)


@query
def summary_depth(spark, d):
    return sections.summary_rows(_code(spark, d), ReportOptions(depth="detailed"))


@query
def xref_report(spark, d):
    return xref.reference_report(xref.cross_references(_edges(spark, d)), "comprehensive")


@query
def report_sink(spark, d):
    """The plain-text report written as ordered text files and read back, counted per line."""
    folder = session.new_folder(spark, "report")
    parts = sections.document_plaintext(_docs(spark, d), ReportOptions(depth="minimal", chunk_size=0))
    state.write_report(parts, folder, ["relative_path", "part_no"])
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


# --- streams --------------------------------------------------------------------------------------------


def _file_edits(spark, d):
    rows = v.files(v.stream_of(spark, d, "documents"))
    return rows.select(F.col("relative_path").alias("path"), F.col("mtime").alias("ts"), "content_hash", "language", "size")


@query
def stream_language_stats(spark, d):
    return st.refresh_language_stats(_file_edits(spark, d), session.new_folder(spark, "stats"))


@query
def stream_incremental(spark, d):
    base = session.new_folder(spark, "incremental")
    rows = v.files(v.stream_of(spark, d, "documents")).withColumnRenamed("mtime", "ts")
    st.start_incremental(_state(v.previous(spark, d)), base)

    def process(files):
        return files.select("relative_path", "size", "content_hash")

    st.incremental_run(rows, base, process)
    columns = "relative_path string, size bigint, content_hash string, change_type string"
    return st.incremental_results(spark, base, columns)


@query
def stream_changes(spark, d):
    feed = st.write_change_feed(v.edits(v.stream_of(spark, d, "events")), session.new_folder(spark, "feed"))
    return feed.groupBy("path").agg(
        F.min_by("change_type", "ts").alias("first_change"), F.max_by("new_hash", "ts").alias("content_hash"))


@query
def latest_version(spark, d):
    return reuse.latest_versions(v.edits(v.table(spark, d, "events")))
