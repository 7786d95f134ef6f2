from collections import Counter

from corpuscope.operators import rollup


def test_readme_gives_the_purpose_and_is_not_listed(make_files):
    files = make_files({"src/README.md": "# Source Directory\nContains core application logic.", "src/main.py": "print('hello')",
                        "config/settings.py": "K = 1", "test_dir/file1.py": "import m", "test_dir/file2.txt": "t"})
    rows = {r.directory: r for r in rollup.directory_summary(files).collect()}
    assert "core application logic" in rows["src"].purpose and rows["src"].num_files == 1
    assert rows["config"].purpose == "Directory containing 1 py files" and rows["test_dir"].num_files == 2
    assert rows["."].purpose == "Empty directory" and rows["."].num_dirs == 3
    names = {(r.directory, r.kind, r.name) for r in rollup.directory_entries(files).collect()}
    assert ("src", "file", "main.py") in names and ("src", "file", "README.md") not in names and (".", "directory", "src") in names


def test_totals_of_nested_hidden_and_binary(make_files):
    files = make_files({"a/b/c/x.py": "1", "a/b/y.js": "22", "a/b/z.js": "333", "a/b/w.py": "1", "a/b/.hidden/q.py": "1",
                        "a/b/i.png": "1", "a/b/noext": "1", "a/b/setup.py": "1", "top": "12345"})
    rows = {r.directory: (r.num_files, r.num_dirs, r.size, r.main_ext) for r in rollup.directory_totals(files).collect()}
    assert rows == {".": (1, 1, 5, None), "a": (0, 1, 0, None), "a/b": (4, 1, 7, ".js"), "a/b/c": (1, 0, 1, ".py"),
                    "a/b/.hidden": (1, 0, 1, ".py")}
    purposes = {r.directory: r.purpose for r in rollup.directory_purposes(files).collect()}
    assert purposes["a/b"] == "Directory containing 4 js files and 1 subdirectories"
    assert purposes["."] == "Directory containing 1 files and 1 subdirectories"


def test_language_stats(make_files):
    files = make_files({"a.ts": "x" * 20, "b.ts": "é", "c.py": "1"})
    assert {tuple(r) for r in rollup.language_stats(files).collect()} == {
        ("typescript", 2, 22), ("python", 1, 1), (rollup.ALL_LANGUAGES, 3, 23)}


def test_notes_beside_come_first(make_files):
    files = make_files({
        "test_file.py": "content", "test_file.py.notes": "This is a user-provided summary.\n",
        "alt_file.py": "content", ".notes/alt_file.py": "Alternative summary location",
        "d/both.py": "c", "d/both.py.notes": " ", "d/.notes/both.py": "inside", "d/none.py": "c", "d/.notes/gone.py": "orphan"})
    got = {r.relative_path: r.user_summary for r in rollup.summaries_from_notes(files).collect()}
    assert got == {"test_file.py": "This is a user-provided summary.", "alt_file.py": "Alternative summary location", "d/both.py": "inside"}
    assert rollup.with_user_summaries(files).count() == files.count()


def test_one_directory_may_hold_most_files(make_files):
    contents = {f"hot/f{i}.{'py' if i % 3 else 'md'}": "x" for i in range(900)}
    contents.update({f"d{i}/f.md": "x" for i in range(50)})
    rows = {r.directory: r for r in rollup.directory_totals(make_files(contents)).collect()}
    kinds = Counter(p.rsplit(".", 1)[1] for p in contents if p.startswith("hot/"))
    assert rows["hot"].num_files == 900 and rows["hot"].main_ext == "." + kinds.most_common(1)[0][0] and rows["."].num_dirs == 51
