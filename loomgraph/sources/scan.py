"""Directory scans: which files count, ignore rules, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import CODE, file_class, is_secret, looks_like_paper

# Folders of dependencies, builds and caches, and lock files, which no scan reads.
NOISE_DIRS = (
    "venv", ".venv", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "site-packages", "lib64",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", ".eggs", "coverage", "lcov-report", "visual-tests", "visual-test",
    "__snapshots__", "storybook-static", "dist-protected", ".next", ".nuxt", ".turbo", ".angular", ".idea", ".cache", ".parcel-cache",
    ".svelte-kit", ".terraform", ".serverless", ".worktrees",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "go.work.sum")
# Interpreters in the first line of a script that make it code.
INTERPRETERS = ("python", "node", "ruby", "perl", "bash", "sh", "zsh", "php", "lua")


def in_noise_dir(path: Column) -> Column:
    """Whether one of the folders of a relative path is noise."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda p: p.isin(*NOISE_DIRS) | F.endswith(p, F.lit("_venv")) | F.endswith(p, F.lit(".egg-info"))) | path.rlike(r"(^|/)\.[^/]*/worktrees/")


def is_lock_file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(*LOCK_FILES)


def rule_of(line: str) -> str:
    """A line of an ignore file without comments and outer blanks; empty if it holds no rule."""
    line = line.rstrip("\r\n").lstrip()
    if not line or line.startswith("#"):
        return ""
    line = re.sub(r"\s+#+[^\\].*$", "", line).replace("\\#", "#")
    return re.sub(r"(?<!\\) +$", "", line)


def _glob(pattern: str, star: str) -> str:
    """A regular expression for a glob; star: what * may stand for."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out += star + "*"
        elif c == "?":
            out += star
        elif c == "[" and (end := pattern.find("]", k + 1)) > 0:
            inner = pattern[k:end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            k = end + 1
        else:
            out += re.escape(c)
    return out


def rule_pattern(rule: str) -> tuple[str, bool, bool]:
    """(regular expression for a path below the rule's folder, whether it takes back, whether it is for folders only)."""
    negated = rule.startswith("!")
    raw = rule[1:] if negated else rule
    p = raw.strip("/")
    if "/" in raw.rstrip("/"):
        parts, out = p.split("/"), ""
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            out += ".+" if part == "**" and last else "(?:[^/]+/)*" if part == "**" else _glob(part, "[^/]") + ("" if last else "/")
        return f"^{out}$", negated, raw.endswith("/")
    return f"(?:^|/){_glob(p, '[^/]')}(?:/|$)|^{_glob(p, '.')}(?:/|$)", negated, raw.endswith("/")


def is_ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether rules (folder, line), outer ones first, ignore a file: the last rule that matches decides; a file in an ignored
    folder can't be taken back. Rules are lines of a few files, so they are compiled on the driver into one expression."""
    compiled = []
    for folder, line in rules:
        if rule := rule_of(line):
            if rule.lstrip("!").strip("/"):
                compiled.append((folder.strip("/"), *rule_pattern(rule)))

    def verdict(target: Column, is_dir: bool) -> Column:
        out = F.lit(False)
        for folder, pattern, negated, dirs_only in compiled:  # the last one ends up outermost
            if dirs_only and not is_dir:
                continue
            below = target if not folder else F.when(F.startswith(target, F.lit(folder + "/")), F.substring(target, len(folder) + 2, 1 << 30))
            out = F.when(F.coalesce(F.rlike(below, F.lit(pattern)), F.lit(False)), not negated).otherwise(out)
        return out

    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.exists(F.filter(folders, lambda x: x != ""), lambda x: verdict(x, True)) | verdict(path, False)


def shebang_class(text: Column) -> Column:
    """`code` if the first line names an interpreter."""
    first = F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)
    return F.when(first.rlike(r"^#!.*[/ ](?:" + "|".join(INTERPRETERS) + r")[0-9.]*(?:\s|$)"), "code")


def classify(path: Column, text: Column) -> Column:
    """The class of a file by its ending, else its first line; prose that looks like a paper is one."""
    kind = F.coalesce(file_class(path), shebang_class(text))
    return F.when((kind == "document") & looks_like_paper(F.coalesce(text, F.lit(""))), "paper").otherwise(kind)


def counted(files: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, kind, words, secret) of the files (path, text) that a scan takes; secret ones are listed without being read."""
    keep = files.filter(~in_noise_dir(F.col("path")) & ~is_lock_file(F.col("path")))
    if rules:
        keep = keep.filter(~is_ignored(F.col("path"), rules))
    secret = is_secret(F.col("path"))
    out = keep.select("path", classify(F.col("path"), F.col("text")).alias("kind"), F.when(~secret, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))).otherwise(0).cast("long").alias("words"), secret.alias("secret"))
    return out.filter("kind IS NOT NULL")


def scan_verdict(files: DataFrame) -> DataFrame:
    """One row: files, words, and whether they fit into a context, or are too many to read at once."""
    t = files.filter("NOT secret").agg(F.count("*").alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return t.select("files", "words", F.when((F.col("words") >= 500_000) | (F.col("files") >= 500), "large").when(F.col("words") < 50_000, "fits").otherwise("medium").alias("verdict"))


def code_files(files: DataFrame) -> DataFrame:
    """Files with an ending that an extractor reads."""
    return files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*CODE) & ~in_noise_dir(F.col("path")))


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, mtime, text) of all files below root, but for those whose name begins with a dot or _, which
    Spark's readers leave out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(re.sub(r"^file:/*", "/", root).rstrip("/") + "/")
    plain = F.regexp_replace("path", "^file:/*", "/")
    return f.select(F.replace(plain, base, F.lit("")).alias("path"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def ignore_rules(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore",)) -> list[tuple[str, str]]:
    """(folder, line) of the ignore files below root, outer folders first, in the order of `names` in one folder. They are
    looked for level by level, and read on the driver: a few lines each."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, level, out = at(root).toUri().getPath().rstrip("/"), root.rstrip("/"), []
    while fs.globStatus(at(f"{level}/*")):
        found = [(s.getPath().getParent().toUri().getPath()[len(top) + 1 :], k, s.getPath()) for k, name in enumerate(names) for s in fs.globStatus(at(f"{level}/{name}")) or []]
        for folder, _, path in sorted(found, key=lambda x: x[:2]):
            stream = fs.open(path)
            text = bytes(stream.readAllBytes()).decode("utf-8-sig", "ignore")
            stream.close()
            out += [(folder, line) for line in text.splitlines()]
        level += "/*"
    return out


def save_manifest(files: DataFrame, path: str, previous: DataFrame | None = None) -> None:
    """Write (path, mtime, hash); what a previous manifest has of files not scanned now stays. Paths are relative, so a
    manifest holds on another machine."""
    now = files.select("path", "mtime", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    if previous is not None:
        now = now.union(previous.join(now.select("path"), "path", "left_anti").select("path", "mtime", "hash"))
    now.write.mode("errorifexists").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, mtime timestamp, hash string").parquet(path)
