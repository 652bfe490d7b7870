"""Telling hand-written source files from generated, minified and vendored ones and from data saved as code.

Attribute files of repositories mark paths as generated or vendored; their patterns are resolved as version control does (the deepest directory wins, in a file the last matching line) and decide on the files they match. For undeclared repositories equivalent patterns are mined: directory names and name endings of which most files are declared elsewhere, show evidence in their texts, or lie in a directory named after a package that headers of copies name. Patterns that are usual elsewhere stand in only where a corpus holds too few such files to mine. Evidence in a file's own text counts by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.session import materialise, ship

#: Files a mined pattern needs, and the share of them that must show evidence: most for a directory, nearly all for a name ending, of which there are so many that chance finds some.
MIN_FILES, DIR_SHARE, ENDING_SHARE = 5, 0.5, 0.9

# Fixed values, used for patterns too rare to mine: directories that by convention hold what others or tools wrote.
VENDORED_DIRS = "node_modules bower_components jspm_packages vendor vendors _vendor _vendored vendored third_party third-party thirdparty 3rdparty 3rd_party external externals extern ext deps _deps dependencies Godeps Pods Carthage site-packages dist-packages".split()
GENERATED_DIRS = "gen gen-src gensrc src-gen generated generated-sources generated-src generated_src auto-generated autogen autogenerated __generated__ _generated".split()
# Fixed values, as before: endings of names before their extension, and whole names.
ENDINGS = r"^(?:\.(?:min|prod|bundle|g|gen|generated|designer|pb|autogen|freezed|pb\.gw)|_(?:gen|generated|autogen|pb2|pb2_grpc|pb|grpc)|[._]grpc[._]pb|[._]pb[._]grpc)$"
NAMES = r"(?:^|/)(?:package-lock\.json|moc_\w+\.cpp|ui_\w+\.h|qrc_\w+\.cpp)$"

# What headers of generated files say, matched in comment lines.
_GENERATED = re.compile(
    r"(?:code|file|source|module|content)s? (?:is |was |has been )?(?:auto(?:matically)?[- ]?)?(?:generated|produced|created) (?:by|from|using|with)\b"
    r"|^auto-?generated\s*(?::|by\b|from\b|file\b|code\b|/?>|$)|^<auto-?generated|^@generated\b"
    r"|^generated on build from\b|^machine-(?:written|generated|made)\b|\bautomatically (?:produced|generated|created) (?:from|by)\b|^created by the [\w-]+ .*(?:compiler|generator)\b"
    r"|^(?:this (?:file|code) (?:is|was) )?(?:auto-?)?generated\b.*\bdo not (?:edit|modify|change)\b|^auto-?generated file\b"
    r"|otomatik olarak üretil|otomatik oluşturul|自動生成され|自动生成|自動產生|maschinell erzeugt|automatisch (?:erzeugt|generiert|erstellt)|generado automáticamente|generad[oa] por|archivo generado|généré automatiquement|تم إنشاء هذا الملف|مولد تلقائي|स्वचालित रूप से|स्वतः|สร้างโดยอัตโนมัติ|สร้างขึ้นโดยอัตโนมัติ|автоматически|gerado automaticamente|自動的に生成",
    re.I,
)
# The same in two parts, the second anywhere behind the first; in one pattern they would take quadratic time on a long line.
_GENERATED_PARTS = [
    (re.compile(r"\bgenerated (?:by|from|on build from|with|using) [\w./-]", re.I), re.compile(r"do not|don't|instead|overwritten|edits? (?:are|will)|version", re.I)),
    (re.compile("أُنشئ "), re.compile("تلقائي")),
]
# What says the opposite; it outweighs a mined or usual pattern.
_DENIED = re.compile(r"\bnot (?:auto-?)?generated\b|\bhand-?written\b", re.I)
# What headers of third-party copies say; the group is the package.
_VENDORED = re.compile(
    r"^(?:bundled|vendored|unmodified|verbatim|local|modified) copy of (?P<a>[\w.@-]+)|^upstream: (?P<b>[\w.@/-]+)|^copyright (?:\(c\)|©)? ?[\d, -]* (?:by )?the (?P<c>[\w.-]+)(?: project)? (?:contributors|authors|developers|team)\b(?!.*\bour\b)"
    r"|^(?P<d>[\w.-]+) v?\d[\w.]* - released under|^!? ?(?P<e>[\w.-]+) v\d[\w.]*(?: \|| -|$)|^@license (?P<f>[\w.-]+)|^(?:copied|taken|imported|vendored) (?:verbatim )?from (?P<g>[\w./:@-]+)",
    re.I,
)
_COMMENT = re.compile(r"\s*(?://+|#+|/\*+!?|\*+|--+|;+|<!--+|%+|'|\"\"\")\s*")
_BLOCK = re.compile(r"(?:\A|(?<=[\r\n]))[^\S\r\n]*/\*")
_REMARK = re.compile(r"\s*(?://|#|/\*|\*|--|;|<!--|%|'|\"\"\")")
_LEADING = re.compile(r"^\s*/\*.*?\*/\s*")
_LINES = re.compile(r"\r\n|\r|\n")
_SHAPE = re.compile(r"\b[^\W\d]*\d\w*")
_LITERAL = re.compile(r"0x[0-9a-fA-F]+|-?\d[\d_.]*(?:[eE][+-]?\d+)?|\"[^\"\n]*\"|'[^'\n]*'|[A-Za-z0-9+/]{40,}={0,2}")
_PUNCTUATION = re.compile(r"[\s\[\](){},;]+")
_WORDS = re.compile(r"\b[a-z]\b")
_WORD = re.compile(r"[^\W\d_]{2,}")
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{60,}|(?:\\x[0-9a-fA-F]{2}){15,}")


def _comment(line: str) -> str | None:
    """What a comment line says, without its marks; None for other lines."""
    if not (m := _COMMENT.match(line)):
        return None
    said = line[m.end() :].rstrip()
    if said.endswith("*/"):
        return said[:-1].rstrip("*").rstrip()
    return said[:-3].rstrip() if said.endswith("-->") else said


def _block_lines(text: str) -> Iterator[str]:
    """What the lines of the closed block comments say that begin a line."""
    at = 0
    while (m := _BLOCK.search(text, at)) and (end := text.find("*/", m.end())) >= 0:
        yield from (said for x in _LINES.split(text[m.end() : end]) if (said := x.strip().strip("*! \t")))
        at = end + 2


def _says_generated(said: str) -> bool:
    return bool(_GENERATED.search(said)) or any((m := first.search(said)) and then.search(said, m.end()) for first, then in _GENERATED_PARTS)


def evidence(text: str | None) -> tuple[bool, bool, bool, bool, bool, list[str]]:
    """(generated, vendored, minified, data, denied, packages named) by the text alone; nothing for null and blank texts.

    Headers count wherever they stand as a comment of their own, as tools also write below a licence or a first section.
    """
    if not text or text.isspace():
        return False, False, False, False, False, []
    lines = [x for x in _LINES.split(text) if x.strip()]
    generated = vendored = denied = False
    packages: set[str] = set()
    said = [s for x in lines if (s := _comment(x))]
    said.extend(_block_lines(text.lstrip()))
    for s in dict.fromkeys(said):
        if _DENIED.search(s):
            denied = True
        elif _says_generated(s):
            generated = True
        elif m := _VENDORED.search(s):
            vendored = True
            packages.update(p for p in m.groups() if p)
    bare = [_LEADING.sub("", x) if x.lstrip()[:2] == "/*" else x for x in lines]
    code = [x for x in bare if x and not _REMARK.match(x)]
    body = sum(map(len, code))
    long = [x for x in code if len(x) >= 200]
    dense = [x for x in long if sum(map(x.count, " \t")) < 0.085 * len(x) and sum(map(x.count, "{}();=,:")) > 0.08 * len(x)]
    minified = body > 0 and sum(map(len, dense)) >= 0.5 * body
    shapes = Counter(_SHAPE.sub("0", x.strip()) for x in code if len(x.strip()) > 12)
    common, most = shapes.most_common(1)[0] if shapes else ("", 0)
    same = most >= 8 and most >= 0.7 * len(code)
    blobs = sum(len(m[0]) for m in _BLOB.finditer(text))
    rest = [_WORDS.sub("", _SHAPE.sub("", _LITERAL.sub("", x))) for x in code]
    literal = body - sum(len(_PUNCTUATION.sub("", _LITERAL.sub("", x))) for x in code)
    rows = sum(len(r) <= 0.45 * len(x) and not _WORD.search(r) for r, x in zip(rest, code))
    data = body >= 300 and (blobs >= 0.5 * body or literal >= 0.65 * body or rows >= 12 and rows >= 0.85 * len(code))
    return generated or (same and not data), vendored, minified and not data, data or (same and most >= 25), denied, sorted(packages)


def text_evidence(documents: DataFrame) -> DataFrame:
    """file_id and the evidence of each document that is not of another type than source code; a narrow stage."""
    names = ["file_id", "generated", "vendored", "minified", "data", "denied", "packages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(evidence, b.column(1).to_pylist()))) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.bool_()) for x in found[:5]], pa.array(found[5], pa.list_(pa.string()))], names=names)

    source = documents.filter("file_id is not null and (document_type is null or document_type = 'SOURCE_CODE')").select("file_id", "text")
    return source.mapInArrow(run, "file_id long, generated boolean, vendored boolean, minified boolean, data boolean, denied boolean, packages array<string>")


@lru_cache(maxsize=4096)
def glob_regex(pattern: str) -> re.Pattern:
    """The pattern of an attribute line as a regular expression over the path of a file below its directory: without a slash it matches names at any depth, with one it is anchored; ``**`` as a whole step spans directories; a backslash takes the next character as it is. A pattern that ends in a slash names directories only, so it matches no file, nor does a directory's name match what lies below."""
    anchored = "/" in pattern.rstrip("/")
    body, out, i = pattern.removeprefix("/"), "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + r"(?:.*/)?", i + 3
        elif body.startswith("**", i) and i + 2 == len(body) and (i == 0 or body[i - 1] == "/"):
            out, i = out + r".+", i + 2
        elif c == "*":
            out, i = out + r"[^/]*", i + 1
        elif c == "?":
            out, i = out + r"[^/]", i + 1
        elif c == "[" and (j := _class_end(body, i)):
            inner = body[i + 1 : j]
            negated = inner[:1] in ("!", "^")
            out, i = out + "(?!/)[" + ("^" if negated else "") + re.sub(r"\\(.)|([\[\]&~|^])", lambda m: re.escape(m[1] or m[2]), inner[negated:]) + "]", j + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    try:
        return re.compile(("" if anchored else r"(?:.*/)?") + out + r"\Z")
    except re.error:  # a class with its ends the wrong way round matches nothing
        return re.compile(r"(?!)")


def _class_end(body: str, at: int) -> int | None:
    """Where the class that opens at a place closes; a bracket right behind the opening one is a member."""
    j = at + 1 + (body[at + 1 : at + 2] in ("!", "^"))
    j += body[j : j + 1] == "]"
    while j < len(body) and body[j] != "]":
        j += 2 if body[j] == "\\" else 1
    return j if j < len(body) else None


_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"\s+(.*)')
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _unquoted(body: str) -> str:
    """A pattern between quotes, as C writes them; octal escapes are bytes of UTF-8."""

    def one(m: re.Match) -> bytes:
        said = m[1].decode("latin-1")
        return bytes([int(said, 8) & 255]) if said[0] in "01234567" else _ESCAPES.get(said, said).encode("latin-1")

    return re.sub(rb"\\([0-7]{1,3}|.)", one, body.encode()).decode("utf-8", "replace")


def parse_attributes(text: str | None) -> Iterator[tuple[str | None, str | None, dict[str, str]]]:
    """(pattern, macro, states) of each line of an attribute file: a line has a pattern or defines a macro. A state is set, unset, unspecified, or =value; of a name that comes twice the last counts. Comments, blank lines and negated patterns, which the format forbids, say nothing."""
    for line in _LINES.split(text or ""):
        line = line.lstrip(" \t")
        if not line or line[0] in "#!":
            continue
        if m := _QUOTED.match(line):
            pattern, rest = _unquoted(m[1]), m[2]
        else:
            pattern, _, rest = (line.replace("\t", " ")).partition(" ")
        states = {}
        for word in rest.split():
            if word[0] in "-!":
                states[word[1:]] = "unset" if word[0] == "-" else "unspecified"
            else:
                name, _, value = word.partition("=")
                states[name] = f"={value}" if value else "set"
        if pattern.startswith("[attr]"):
            if pattern[6:]:
                yield None, pattern[6:], states
        else:
            yield pattern, None, states


def _said(states: dict[str, str], name: str) -> str | None:
    """set, unset, unspecified or None of an attribute that is true, false or not said to be either."""
    state = states.get(name)
    return {"=true": "set", "=set": "set", "=false": "unset", "=unset": "unset"}.get(state, state if state in ("set", "unset", "unspecified") else None)


_MARKS = ("linguist-generated", "linguist-vendored")


def attribute_rules(documents: DataFrame, files: DataFrame) -> DataFrame:
    """directory, rules (position, pattern, generated, vendored) of each attribute file that speaks of generated or vendored paths.

    A repository is the first step of a path. Macros may be defined in attribute files at the top, of a repository or of all; where one is set, it says what its definition says, unless the line itself says otherwise. One row holds one attribute file.
    """
    at = files.filter(r"source_path rlike '(^|/)\\.gitattributes$'").select(F.col("id").alias("file_id"), F.regexp_replace("source_path", r"/?\.gitattributes$", "").alias("directory")).distinct()
    texts = documents.select("file_id", "text").join(at, "file_id").select("directory", "text").distinct()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                macros: dict[str, dict[str, str]] = {}
                for n, (pattern, macro, states) in enumerate(parse_attributes(r.text)):
                    for name in [k for k, v in states.items() if v == "set" and k in macros]:
                        states = macros[name] | states
                    if macro and "/" not in r.directory:
                        macros[macro] = states
                        rows.append((r.directory, -1, None, macro, *[_said(states, m) for m in _MARKS], []))
                    elif pattern:
                        rows.append((r.directory, n, pattern, None, *[_said(states, m) for m in _MARKS], [k for k, v in states.items() if v == "set"]))
            yield pd.DataFrame(rows, columns=["directory", "position", "pattern", "macro", "generated", "vendored", "names"])

    lines = texts.mapInPandas(parse, "directory string, position int, pattern string, macro string, generated string, vendored string, names array<string>")
    lines = materialise(lines.filter("macro is not null or size(names) > 0 or generated is not null or vendored is not null"), "attributes")
    macros = lines.filter("macro is not null").select(F.col("directory").alias("_home"), "macro", F.col("generated").alias("_g"), F.col("vendored").alias("_v"))
    named = lines.filter("macro is null").drop("macro").withColumn("macro", F.explode_outer("names"))
    home = F.explode(F.array_distinct(F.array(F.lit(""), F.split("directory", "/")[0]))).alias("_home")
    met = named.select("*", home).join(macros, ["_home", "macro"], "left")
    rules = met.groupBy("directory", "position", "pattern").agg(*[F.coalesce(F.max(c), F.max(m)).alias(c) for c, m in (("generated", "_g"), ("vendored", "_v"))]).filter("generated is not null or vendored is not null")
    return rules.groupBy("directory").agg(F.array_sort(F.collect_list(F.struct("position", "pattern", "generated", "vendored"))).alias("rules"))


#: Copies of a directory's rules, among which its files are divided, so that no directory's files meet in one task.
SPREAD = 32


def declared(files: DataFrame, rules: DataFrame) -> DataFrame:
    """id, declared of the files on which attribute lines decide: true if they are generated or vendored, false if it is said that they are neither.

    A file meets the rules of the directories above it, each in a row of its own. In one file the last matching line that speaks of an attribute decides on it, and the deepest directory that does; what is unspecified there is undecided.
    """
    parts = F.split("source_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    salted = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = files.select("id", "source_path", F.pmod(F.xxhash64("source_path"), F.lit(SPREAD)).cast("int").alias("_salt"), F.explode(above).alias("directory")).join(salted, ["directory", "_salt"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                said: dict[str, str] = {}
                below = r.source_path[len(r.directory) :].lstrip("/")
                for x in r.rules:
                    if glob_regex(x["pattern"]).match(below):
                        said |= {k: x[k] for k in ("generated", "vendored") if x[k] is not None}
                if said:
                    rows.append((r.id, len(r.directory), said.get("generated"), said.get("vendored")))
            yield pd.DataFrame(rows, columns=["id", "depth", "generated", "vendored"])

    found = met.select("id", "source_path", "directory", "rules").mapInPandas(run, "id long, depth int, generated string, vendored string")
    last = found.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c) for c in ("generated", "vendored")])
    true = (F.col("generated").eqNullSafe("set")) | (F.col("vendored").eqNullSafe("set"))
    return last.filter("generated in ('set', 'unset') or vendored in ('set', 'unset')").select("id", true.alias("declared"))


def path_features(path: str = "source_path") -> Column:
    """Patterns a path offers to mining: ``name/`` for each directory below the first, and the ending of the name before its extension, of one part (``.min``, ``_gen``) and of two (``_pb2_grpc``)."""
    parts = F.split(path, "/")
    dirs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.concat(F.regexp_replace(x, r"[@-]v?\d[\w.]*$", ""), F.lit("/")))
    name = F.element_at(parts, -1)
    endings = [F.regexp_extract(name, rf"((?:[._-][A-Za-z][A-Za-z0-9]*){{{n}}})\.\w+$", 1) for n in (1, 2)]
    return F.array_distinct(F.concat(dirs, F.filter(F.array(*endings), lambda x: x != "")))


def usual(feature: Column) -> Column:
    """Whether a pattern is usual for what others or tools wrote."""
    return feature.isin([f"{d}/" for d in VENDORED_DIRS + GENERATED_DIRS]) | feature.rlike(ENDINGS)


def unwritten_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """file_id, declared, by_text, by_path, by_mining of each SOURCE_CODE file with a document that nobody on the project wrote by hand.

    An attribute line decides on the files it matches, for others any of the rest does. Null paths leave only the text, null and blank texts only the path; repeated rows change nothing. A text that says it was not generated outweighs patterns. Texts are read once and stay where they are read; what is written and shuffled is a few flags a document and the parts of paths.
    """
    ship(files.sparkSession)
    source = files.filter("document_type = 'SOURCE_CODE' and id is not null").select("id", "source_path").distinct()
    flags = text_evidence(documents).groupBy("file_id").agg(*[F.max(c).alias(c) for c in ("generated", "vendored", "minified", "data", "denied")], F.array_distinct(F.flatten(F.collect_set("packages"))).alias("packages"))
    shown = F.col("generated") | F.col("vendored") | F.col("minified") | F.col("data")
    read = source.join(flags, source["id"] == flags["file_id"]).select("id", "source_path", shown.alias("by_text"), "denied", "packages")
    known = materialise(read.join(declared(source, attribute_rules(documents, files)), "id", "left"), "evidence")

    packages = known.select(F.explode("packages").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2 and length(p) > 2").select(F.concat("p", F.lit("/")).alias("feature"))
    offered = known.select("id", "declared", "by_text", F.explode(path_features()).alias("feature"))
    copies = offered.join(packages, "feature", "left_semi").select("id").distinct().withColumn("copied", F.lit(True))
    # A declaration outweighs the text, as it does for the file itself.
    counts = offered.join(copies, "id", "left").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("declared", F.col("by_text") | F.coalesce("copied", F.lit(False)))).alias("shown"))
    share = F.when(F.col("feature").endswith("/"), DIR_SHARE).otherwise(ENDING_SHARE)
    counts = materialise(counts.filter((F.col("n") >= MIN_FILES) & (F.col("shown") >= share * F.col("n")) | (F.col("n") < MIN_FILES) & usual(F.col("feature"))), "patterns")
    patterns = counts.filter(F.col("n") >= MIN_FILES).select("feature").union(packages).distinct()
    by_mining = offered.join(patterns, "feature", "left_semi").select("id").distinct().withColumn("by_mining", F.lit(True))
    rare = counts.filter(F.col("n") < MIN_FILES).select("feature")
    by_path = offered.filter(usual(F.col("feature"))).join(rare, "feature", "left_semi").select("id").distinct().withColumn("by_path", F.lit(True))

    decided = known.join(by_path, "id", "left").join(by_mining, "id", "left")
    named = F.coalesce("by_path", F.lit(False)) | F.coalesce(F.col("source_path").rlike(NAMES), F.lit(False))
    judged = decided.select(F.col("id").alias("file_id"), "declared", "by_text", (named & ~F.col("denied")).alias("by_path"), (F.coalesce("by_mining", F.lit(False)) & ~F.col("denied")).alias("by_mining"))
    return judged.groupBy("file_id").agg(*[F.max(c).alias(c) for c in ("declared", "by_text", "by_path", "by_mining")]).filter("coalesce(declared, by_text or by_path or by_mining)")
