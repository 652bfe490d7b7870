"""Expressions over paths, texts and queries. All are built-in column functions that stay in generated code."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions and names of each document type.
EXTENSIONS = {
    "PLAIN_TEXT": ["txt", "rst", "adoc"],
    "MARKDOWN": ["md", "markdown"],
    "SOURCE_CODE": ["java", "kt", "kts", "py", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx", "cs", "go", "rs", "rb", "php", "swift", "sh", "bash", "zsh", "ps1", "psm1", "bat", "cmd", "sql", "css", "scss", "sass", "less"],
    "STRUCTURED_TEXT": ["json", "jsonc", "yaml", "yml", "toml", "ini", "cfg", "properties", "xml"],
}
BASENAMES = {
    "PLAIN_TEXT": ["README", "LICENSE", "LICENCE", "NOTICE", "CHANGELOG", "AUTHORS", "CONTRIBUTING"],
    "SOURCE_CODE": ["Dockerfile", "Containerfile", "Makefile", "Jenkinsfile"],
}
# What is not indexed by default.
EXCLUDED_DIRS = ["target", "build", "dist", "out", "node_modules", ".gradle", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".next"]
EXCLUDED_NAMES = ["*.min.js", "*.min.css", "*.map", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "composer.lock", "Cargo.lock", "poetry.lock", "uv.lock", "Pipfile.lock", "Gemfile.lock", "gradle.lockfile", ".env", ".env.*"]
INCLUDES = [f"**/*.{e}" for es in EXTENSIONS.values() for e in es] + [f"**/{b}" for bs in BASENAMES.values() for b in bs]
EXCLUDES = [f"**/{d}/**" for d in EXCLUDED_DIRS] + [f"**/{n}" for n in EXCLUDED_NAMES]
# What code in a query looks like; a query of at most three parts with one such part is an identifier.
CODE_LIKE = [r"\p{Ll}[\p{Ll}\p{Nd}]*\p{Lu}", r"[\p{L}\p{Nd}]_[\p{L}\p{Nd}]", r"\p{L}\p{Nd}|\p{Nd}\p{L}", r"[\p{L}\p{Nd}](\.|/|::|#|->)[\p{L}\p{Nd}]"]
IDENTIFIER_PARTS, MAX_PARTS, MAX_QUERY = 3, 64, 4096
# Bytes a chunk holds on average, by type.
BYTES_PER_CHUNK = {"MARKDOWN": 387, "PLAIN_TEXT": 845, "SOURCE_CODE": 601, "STRUCTURED_TEXT": 457}
#: Tokens that the context line before a chunk may take when it is embedded.
CONTEXT_TOKENS = 32
QUERY_SPACE = r"[\s\x1c-\x1f\x0b\p{Z}\u0085]+"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _folds() -> dict[str, str]:
    """Latin letters with marks and their plain letters, by canonical decomposition. Letters without one (ß, œ, ø, ı, ligatures) stay."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            out[c] = parts[0]
    return out


FOLD_FROM, FOLD_TO = "".join(_folds()), "".join(_folds().values())


def fold(text: Column) -> Column:
    """Lower case without the marks on Latin letters and without combining marks; folded before lowered, so İ becomes i."""
    return F.lower(F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """The index terms of a text in order: runs of letters, numbers and private-use characters, folded. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def query_parts(text: Column) -> Column:
    """The parts of a query that hold a searchable character, in order and with repetitions."""
    return F.filter(F.split(text, QUERY_SPACE), lambda p: p.rlike(r"[\p{L}\p{N}\p{Co}]"))


def part_count(text: Column) -> Column:
    """All parts of a query, searchable or not."""
    return F.size(F.filter(F.split(text, QUERY_SPACE), lambda p: p != ""))


def phrases(text: Column) -> Column:
    """The phrase (array of terms) of each searchable part of a query."""
    return F.transform(query_parts(text), tokens)


def match_expression(text: Column) -> Column:
    """The query as quoted phrases joined by AND; null if nothing in it can be searched."""
    quoted = F.transform(query_parts(text), lambda p: F.concat(F.lit('"'), F.replace(p, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, " AND "))


def query_problem(text: Column, limit: Column) -> Column:
    """Why a query can't be run (BLANK, NUL, TOO_LONG, LIMIT), or null."""
    return (
        F.when(text.isNull() | (F.regexp_replace(text, QUERY_SPACE, "") == ""), "BLANK")
        .when(F.instr(text, "\0") > 0, "NUL")
        .when(F.length(text) > MAX_QUERY, "TOO_LONG")
        .when(limit.isNull() | (limit < 1) | (limit > 100), "LIMIT")
    )


def query_shape(text: Column) -> Column:
    """IDENTIFIER for up to three parts of which one looks like code, else NATURAL_LANGUAGE."""
    code = F.exists(F.split(text, QUERY_SPACE), lambda p: p.rlike("|".join(f"(?:{x})" for x in CODE_LIKE)))
    return F.when(part_count(text).between(1, IDENTIFIER_PARTS) & code, "IDENTIFIER").otherwise("NATURAL_LANGUAGE")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def document_type(path: Column) -> Column:
    """The type of a path: by its whole name, then by its last extension, else PLAIN_TEXT. Names that begin or end with their only dot have no extension."""
    name = F.lower(file_name(path))
    ext = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    out = F.when(path.isNull(), F.lit(None).cast("string"))
    for kind, names in BASENAMES.items():
        out = out.when(name.isin([n.lower() for n in names]), kind)
    for kind, exts in EXTENSIONS.items():
        out = out.when(ext.isin(exts), kind)
    return out.otherwise("PLAIN_TEXT")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over lower-case paths: * and ? stay within a name, ** spans directories, a leading **/ also matches at the root, {a,b} are alternatives."""
    out, i, depth, g = "", 0, 0, glob.lower()
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if g.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = g[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return out


def globs_regex(globs: list[str]) -> str:
    return "^(?:" + "|".join(map(glob_regex, globs)) + ")$"


def admitted(path: Column, include: list[str] = INCLUDES, exclude: list[str] = EXCLUDES) -> Column:
    """Whether a path matches some include (or there are none) and no exclude, ignoring case."""
    low = F.lower(path)
    wanted = low.rlike(globs_regex(include)) if include else F.lit(True)
    return wanted & ~(low.rlike(globs_regex(exclude)) if exclude else F.lit(False))


def pruned_directory(directory: Column, exclude: list[str] = EXCLUDES) -> Column:
    """Whether a whole directory is excluded by a pattern that ends in /**."""
    whole = [g[:-3] for g in exclude if g.endswith("/**")]
    return F.lower(directory).rlike(globs_regex(whole)) if whole else F.lit(False)


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def looks_binary(text: Column) -> Column:
    """A NUL, or four or more control characters (other than LF, CR, tab, form feed) that make up over 1 % of the text."""
    controls = F.regexp_count(text, F.lit(r"[\x01-\x08\x0B\x0E-\x1F\x7F-\x9F]"))
    return (F.instr(text, "\0") > 0) | ((controls >= 4) & (controls * 100 > F.length(text)))


def valid_path(path: Column) -> Column:
    """Relative, normalised and without steps upwards."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"^/|\\|(^|/)\.{0,2}(/|$)|^[A-Za-z]:|\x00")


def portable_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def only_markup(content: Column) -> Column:
    """Nothing but HTML comments and tags, > and white space outside of code."""
    bare = F.regexp_replace(F.regexp_replace(content, r"(?s)<!--.*?-->", ""), r"</?[A-Za-z][^<>]*>", "")
    return ~content.rlike(r"(?m)^ {0,3}(```|~~~)|`") & bare.rlike(r"^[\s>]*$")


def bounded(text: Column, most: int = 400) -> Column:
    """At most ``most`` characters; a longer text is cut one short and ends in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def _framed(text: Column) -> Column:
    """The UTF-8 bytes of a text after their number as a big-endian 32-bit integer."""
    raw = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 8, "0")), raw)


def stable_id(path: Column, index: Column, fingerprint: Column, family: str = "index") -> Column:
    """A chunk's id from path, index and chunking fingerprint alone: SHA-256 over length-prefixed fields. ``family`` is the prefix of the format's name."""
    number = F.unhex(F.lpad(F.hex(index.cast("long")), 8, "0"))
    return F.sha2(F.concat(_framed(F.lit(f"{family}-chunk-id-v1")), _framed(path), number, _framed(fingerprint)), 256)


def _digest(texts: list[str], numbers: list[int]) -> str:
    h = hashlib.sha256()
    for t in texts:
        h.update(len(t.encode()).to_bytes(4, "big") + t.encode())
    for n in numbers:
        h.update(n.to_bytes(4, "big"))
    return h.hexdigest()


@dataclass(frozen=True)
class ChunkingIdentity:
    """Everything that decides how a text is cut; its fingerprint changes when any of it does."""

    algorithm: str
    vocabulary_sha256: str
    vocabulary_size: int
    max_input_tokens: int
    special_tokens: int
    max_tokens: int
    overlap_tokens: int
    extraction_version: str = "index-utf8-extraction-v1"
    chunking_version: str = "index-built-in-chunking-v3"
    family: str = "index"

    def __post_init__(self):
        if not self.special_tokens < self.max_tokens <= self.max_input_tokens:
            raise ValueError("max_tokens must be above the special tokens and within the model's input")
        if not 0 <= self.overlap_tokens < self.max_tokens - self.special_tokens:
            raise ValueError("overlap_tokens must be below the content budget")

    @property
    def budget(self) -> int:
        """Content tokens of a chunk; room for the context line is kept, which is no part of the fingerprint."""
        return min(self.max_tokens, self.max_input_tokens - CONTEXT_TOKENS) - self.special_tokens

    def fingerprint(self) -> str:
        return _digest(
            [f"{self.family}-chunking-identity-v1", self.extraction_version, self.chunking_version, self.algorithm, self.vocabulary_sha256],
            [self.vocabulary_size, self.max_input_tokens, self.special_tokens, self.max_tokens, self.overlap_tokens],
        )


@dataclass(frozen=True)
class EmbeddingProfile:
    """What vectors were made with; only vectors of one fingerprint compare."""

    model_id: str
    model_revision: str
    model_sha256: str
    dimensions: int
    tokenizer_algorithm: str
    vocabulary_sha256: str
    max_input_tokens: int
    pooling: str = "mean"
    normalization: str = "l2"
    input: str = "path-headings-content"
    family: str = "index"

    def fingerprint(self) -> str:
        return _digest(
            [f"{self.family}-embedding-profile-v1", self.model_id, self.model_revision, self.model_sha256, self.tokenizer_algorithm, self.vocabulary_sha256, self.pooling, self.normalization, self.input],
            [self.dimensions, self.max_input_tokens],
        )


def chunk_estimate(kind: Column, size: Column, max_tokens: int = 256, overlap: int = 32, model_input: int = 256, special: int = 2) -> Column:
    """Estimated chunks of a file by type and bytes: none for an empty file, else at least one."""

    def stride(most: int, over: int) -> int:
        content = min(most, model_input - CONTEXT_TOKENS) - special
        return max(1, content - min(over, content - 1))

    scale = stride(max_tokens, overlap) / stride(256, 32)
    each = F.create_map(*[F.lit(x) for k, v in BYTES_PER_CHUNK.items() for x in (k, v * scale)])
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / F.element_at(each, kind) + 0.5))).cast("long")


def closest(word: str, known: list[str]) -> str | None:
    """The known word within two edits (swaps of neighbours count one) of a mistyped one, if twice the distance is below the longer length."""

    def distance(a: str, b: str) -> int:
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, rows[-2][j - 2] + 1)
                row.append(best)
            rows.append(row)
        return rows[-1][-1]

    near = sorted((d, k) for k in known if (d := distance(word, k)) <= 2 and 2 * d < max(len(word), len(k)))
    return near[0][1] if near else None
