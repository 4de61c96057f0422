"""Source files as tables: walking a folder, ignore rules, selection, languages, document kinds, diffs."""

from __future__ import annotations

import fnmatch
import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType

#: Files above this size are not read.
LARGE_BYTES = 512 * 1024

# Languages by extension, and names of Ruby files without one.
LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "python": (".py",),
    "java": (".java",),
    "c": (".c",),
    "cpp": (".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx", ".hh"),
    "csharp": (".cs",),
    "go": (".go",),
    "ruby": (".rb", ".rake", ".gemspec"),
    "rust": (".rs",),
    "php": (".php", ".phtml", ".php3", ".php4", ".php5", ".php8"),
    "kotlin": (".kt", ".kts"),
    "swift": (".swift",),
    "dart": (".dart",),
    "vue": (".vue",),
    "svelte": (".svelte",),
    "astro": (".astro",),
    "cobol": (".cbl", ".cob", ".cpy", ".cobol", ".copybook", ".jcl", ".job", ".proc"),
    "markdown": (".md", ".mdx"),
    "pdf": (".pdf",),
    "word": (".doc", ".docx", ".odt", ".rtf"),
    "spreadsheet": (".xls", ".xlsx", ".xlsm", ".xlsb", ".xlt", ".xltx", ".xltm", ".xlam", ".ods", ".csv", ".tsv"),
}
RUBY_NAMES = ("Rakefile", "Gemfile", "Guardfile", "Vagrantfile", "Brewfile")
# Folders and endings that are never read.
IGNORED_DIRS = (
    ".git", ".svn", ".hg", ".bzr", ".idea", ".vscode", ".vs", ".eclipse", ".settings", "node_modules",
    "bower_components", "jspm_packages", "vendor", "venv", ".venv", "env", ".env", "__pycache__", ".pytest_cache",
    ".mypy_cache", "site-packages", ".tox", "eggs", ".eggs", "lib64", "parts", "sdist", "wheels", "dist", "build",
    "out", "output", "bin", "obj", "target", ".next", ".nuxt", ".output", ".vercel", ".netlify", ".serverless",
    "_build", "public/build", ".parcel-cache", ".turbo", ".svelte-kit", "coverage", ".nyc_output", "htmlcov",
    ".coverage", "__mocks__", ".jest", "logs", "log", "tmp", "temp", "cache", ".cache", ".tmp", ".temp",
    ".generated", "generated", "auto-generated", ".terraform", ".husky", ".github", ".circleci", ".gitlab",
    "fixtures", "snapshots", "__snapshots__",
)
IGNORED_ENDINGS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".bmp", ".tiff", ".tif", ".psd", ".ai", ".sketch",
    ".fig", ".xd", ".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz", ".tgz", ".exe", ".dll", ".so", ".dylib",
    ".a", ".lib", ".o", ".obj", ".class", ".jar", ".war", ".ear", ".pyc", ".pyo", ".pyd", ".beam", ".wasm", ".node",
    ".ppt", ".pptx", ".odp", ".mp4", ".mp3", ".wav", ".mov", ".avi", ".mkv", ".flv", ".wmv", ".ogg", ".webm",
    ".flac", ".aac", ".m4a", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".db", ".sqlite", ".sqlite3", ".mdb",
    ".accdb", ".min.js",
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.translate(path, "\\", "/"), r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    """The language of a path, or null."""
    pairs = [(e, name) for name, all_ in LANGUAGES.items() for e in all_]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(table[extension(path)], F.when(F.substring_index(path, "/", -1).isin(*RUBY_NAMES), "ruby"))


def document_kind(path: Column) -> Column:
    """Kind of a document, and null for code; only Markdown is read as text."""
    kind = language(path)
    return F.when(kind.isin("markdown", "pdf", "word", "spreadsheet"), kind)


def _normal(pattern: str) -> str:
    return posixpath.normpath(pattern.strip().replace("\\", "/")).strip("/") if pattern.strip() else ""


def matches(path: str, pattern: str) -> bool:
    """Whether a relative path is selected: `dir/**`, a name or glob of a segment, a glob of the path, or a folder above it."""
    p = _normal(pattern)
    if not p:
        return False
    if p.endswith("/**"):
        return path == p[:-3] or path.startswith(p[:-2])
    glob = re.compile(fnmatch.translate(p).replace(".*", "[^/]*"))
    if "/" not in p:
        return any(s == p or glob.match(s) for s in path.split("/"))
    return bool(glob.match(path)) or path == p or path.startswith(p + "/")


class IgnoreRules:
    """Lines of ignore files: the last that matches decides, `!` takes a path back; built-in folders and endings come first."""

    def __init__(self, lines: list[str] = ()):
        kept = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
        self.rules = [(x.lstrip("!").strip(), x.startswith("!")) for x in kept]

    def ignored(self, path: str) -> bool:
        path = _normal(path)
        parts = path.split("/")
        if any(x in IGNORED_DIRS for x in parts[:-1]) or any(f"/{d}/" in f"/{path}/" for d in IGNORED_DIRS if "/" in d) or path.lower().endswith(IGNORED_ENDINGS):
            return True
        out = False
        for pattern, back in self.rules:
            if matches(path, pattern):
                out = not back
        return out


def walk(spark: SparkSession, root: str, ignore: IgnoreRules | None = None, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(filePath, size, hash, language, content) of a folder's text files, without ignored, unselected and large ones."""
    rules = ignore or IgnoreRules()
    base = root.rstrip("/")

    def kept(paths: pd.Series) -> pd.Series:
        return pd.Series([not rules.ignored(p) and (not include or any(matches(p, x) for x in include)) and not any(matches(p, x) for x in exclude) for p in paths])

    keep = F.pandas_udf(kept, BooleanType())
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    # The reader gives absolute locations; what follows the root is the path in the repository.
    at = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base.removeprefix("file://").rstrip("/")) + "/", "")
    rows = raw.filter(F.col("length") <= LARGE_BYTES).select(at.alias("filePath"), F.col("length").alias("size"), F.col("content").alias("raw"))
    rows = rows.filter(keep("filePath"))
    return rows.select("filePath", "size", F.sha2("raw", 256).alias("hash"), language(F.col("filePath")).alias("language"), F.decode(F.col("raw"), "UTF-8").alias("content"))


def contents(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(filePath, content) of the wanted paths that exist."""
    return files.join(paths.select("filePath").distinct(), "filePath", "left_semi").select("filePath", "content")


def graph_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, relationships) of a JSON snapshot."""
    one = spark.read.json(path, multiLine=True)
    return one.select(F.explode("nodes").alias("n")).select("n.*"), one.select(F.explode("relationships").alias("r")).select("r.*")


def relationship_csv(spark: SparkSession, path: str) -> DataFrame:
    """Relationships with all nine fields; shorter rows are dropped."""
    schema = "sourceId string, targetId string, type string, confidence double, reason string, step int, resolutionSource string, evidence string, fileHash string"
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)


_BLOCK = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
_FRONT = re.compile(r"\A---\r?\n(.*?)\r?\n---", re.S)


def script_blocks(path: str, text: str) -> list[tuple[int, str, str]]:
    """(lines before, language, code) of the script blocks of a single-file component."""
    out = []
    if path.endswith(".astro") and (m := _FRONT.match(text)):
        out.append((text[: m.start(1)].count("\n"), "typescript", m[1]))
    for m in _BLOCK.finditer(text):
        kind = "typescript" if re.search(r"""lang=["']tsx?["']""", m[1]) else "javascript"
        out.append((text[: m.start(2)].count("\n"), kind, m[2]))
    return out
