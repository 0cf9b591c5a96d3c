"""Generated, minified and vendored source files, so that only hand-written source remains.

Three kinds of evidence decide on a file, in this order:

1. Repository attribute files (``.gitattributes``). Rules hold within their own
   project; those of deeper directories go before those above, later lines
   before earlier ones, per attribute.
2. What its chunks show: a header that says who wrote the file, the shape of
   minified code, or of data saved as code. One chunk speaks for the file.
3. Path patterns for repositories that declare nothing, mined from this
   collection: directories and file name parts under which declared files and
   such headers are far more usual than elsewhere. Names that are known
   conventions start with a few pretended files; what the collection's own
   files show under them outweighs these.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map, read
from lodestrata.runtime import cut_lineage

GENERATED, VENDORED, MINIFIED, DATA = 1, 2, 4, 8


@dataclass(frozen=True)
class MiningParams:
    """A pattern is mined from ``least_files`` files on, pretended ones included, if

    - the 95 % lower bound of the share that is of the kind is at least
      ``least_share``, or
    - the lower bound at ``sure`` standard errors is at least ``lift`` times the
      share among all other files, and ``least_sure``.

    Shapes (minified code) need ``least_shape`` instead, since tools write
    beside people in output folders. prior: of the pretended files of a known
    convention, how many are of the kind, and how many there are. mine: False
    leaves only what files show and declare.
    """

    least_files: int = 6
    least_share: float = 0.15
    sure: float = 4.0
    lift: float = 2.0
    least_sure: float = 0.06
    least_shape: float = 0.8
    prior: tuple[int, int] = (6, 10)
    mine: bool = True


# --- what a chunk shows ----------------------------------------------------------------------

COMMENT_LINE = re.compile(r"\s*(?://[/!]?|#(?![\[!])|/\*+|\*(?!/)|--|;|<!--)\s?(.*?)\s*(?:\*/|-->)?\s*$")
GENERATED_HEADER = re.compile(
    r"""(?ix)
    ^code\ generated\b.*\bdo\ not\ edit\b
  | ^@generated\b
  | ^<auto-?generated\b
  | ^auto-?generated\ file\b
  | ^(?:this|the)\ (?:file|code|module)\ (?:is|was|has\ been)\ (?:automatically|auto|machine)[-\ ]?(?:generated|produced|created|made|written|built)\b
  | ^(?:automatically|machine)[-\ ](?:generated|produced|created|made|written)\ (?:by|from|with)\b
  | ^(?:this\ file\ (?:is|was)\ )?generated\ (?:by|from|with)\b.*\b(?:do\ not|don't|never)\ (?:edit|modify|change|touch)\b
  | ^do\ not\ (?:edit|modify)\b.*\b(?:generated|produced)\ (?:by|from)\b
    """
)
VENDORED_HEADER = re.compile(
    r"""(?ix)
    ^(?:copyright\b|\(c\)|spdx-).*\b(?:imported|copied|taken)\ from\b
  | ^(?:vendored|bundled|third[-\ ]party)\ (?:copy|version|snapshot)\ of\b
  | ^(?:imported|copied|vendored|taken)\ (?:over\ )?(?:verbatim\ )?from\ (?:the\ )?\S+.*\b(?:upstream|license|licence|project|v?\d+\.\d+)\b
  | ^from\ \S+\.(?:tar\.\w+|tgz|zip|crate|whl)\b
  | ^\S+\ v?\d+(?:\.\d+)+\S*\s.*\b(?:bundled|vendored|upstream)\b
  | \btaken\ over\ from\ upstream\b
    """
)
LINE = re.compile(r"[^\n]+")


def header_of(text: str) -> list[str]:
    """The comment lines a chunk begins with, to the first line of code, without their markers."""
    out, block = [], ""
    for found in LINE.finditer(text):
        line = found.group()
        if not line.strip():
            continue
        m = COMMENT_LINE.match(line)
        if not m and not block:
            break
        out.append((m.group(1) if m else line.split(block)[0]).strip())
        # lines within a block comment need no marker of their own
        if not block:
            block = {"/*": "*/", "<!--": "-->"}.get(next((x for x in ("/*", "<!--") if line.lstrip().startswith(x)), ""), "")
        if block and block in line:
            block = ""
    return out


LITERAL = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|-?\b0[xX][0-9a-fA-F]+\b|-?\b\d[\d_.]*(?:[eE][+-]?\d+)?\b""")
STRING = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`""")


def looks_minified(text: str) -> bool:
    """Long lines of dense code: hardly any blanks outside strings, many statements a line, short names."""
    if len(text) < 300:
        return False
    longest = max(text.split("\n"), key=len)
    if len(longest) < 250:
        return False
    code = STRING.sub('""', longest)
    if len(code) < 200:
        return False
    names = re.findall(r"[A-Za-z_$][\w$]*", code)
    short = sum(len(n) <= 2 for n in names)
    return code.count(" ") + code.count("\t") < 0.08 * len(code) and code.count(";") + code.count(",") + code.count("{") >= len(code) / 60 and short >= 0.35 * max(len(names), 1)


def looks_like_data(text: str) -> bool:
    """Nearly all of it literals: tables of numbers, strings or encoded bytes."""
    if len(text) < 400:
        return False
    body = text.split("\n")
    listed = sum(1 for x in body if x.lstrip()[:1] in tuple("\"'`-0123456789[{("))
    if len(body) > 3 and listed < 0.7 * len(body):
        return False
    found = LITERAL.findall(text)
    covered = sum(map(len, found))
    rest = re.sub(r"[\s,\[\]{}();|:]", "", LITERAL.sub("", text))
    return len(found) >= 8 and covered >= 0.5 * len(text) and len(rest) <= 0.12 * len(text)


def evidence_of(text: str | None) -> int:
    if not text:
        return 0
    found = 0
    head = header_of(text)
    if any(GENERATED_HEADER.search(x) for x in head):
        found |= GENERATED
    if any(VENDORED_HEADER.search(x) for x in head):
        found |= VENDORED
    if looks_minified(text):
        found |= MINIFIED
    elif looks_like_data(text):
        found |= DATA
    return found


# --- attribute files ---------------------------------------------------------------------------


def glob_to_regex(glob: str) -> str:
    """A gitattributes pattern, relative to its file's directory, as an anchored regular expression."""
    anchored = "/" in glob.rstrip("/")
    glob = glob.lstrip("/")
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$"


ATTRIBUTES = {"linguist-generated": GENERATED, "linguist-vendored": VENDORED}


def attribute_rules(path: str, content: str) -> list[tuple[str, int, str, int, bool]]:
    """(directory, line, regex, kind, set) of the rules in one attribute file."""
    folder = path.rpartition("/")[0]
    rules = []
    for number, line in enumerate(content.splitlines()):
        line = line.strip()
        if not line or line.startswith(("#", "!")):
            continue
        m = re.match(r'"((?:[^"\\]|\\.)*)"\s+(.*)|(\S+)\s+(.*)', line)
        if not m:
            continue
        glob, words = (m.group(1), m.group(2)) if m.group(1) is not None else (m.group(3), m.group(4))
        for word in words.split():
            name, _, value = word.lstrip("-!").partition("=")
            if name in ATTRIBUTES:
                rules.append((folder, number, glob_to_regex(glob), ATTRIBUTES[name], not (word[0] in "-!" or value.lower() in ("false", "0", "no"))))
    return rules


#: rules of one directory meet the files below it in so many tasks
RULE_SALTS = 16


def declared(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """(project, path, yes, no): kinds that attribute files give each file or deny it, as bit sets, by precedence.

    ``files``: (project, path); ``attributes``: (project, path, content).
    """

    def parse(batch: pa.RecordBatch):
        rows = [(project, *r) for project, p, c in zip(*(batch.column(n).to_pylist() for n in ("project", "path", "content"))) if p is not None for r in attribute_rules(p, c or "")]
        names, types = ("project", "folder", "line", "regex", "kind", "on"), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))

    rules = arrow_map(attributes.select("project", "path", "content"), parse, "project string, folder string, line int, regex string, kind int, on boolean").distinct()
    rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(RULE_SALTS - 1))))
    parts = F.split("path", "/")
    depth = F.size(parts)
    above = files.select("project", "path", F.pmod(F.hash("path"), F.lit(RULE_SALTS)).alias("salt"), F.posexplode(F.transform(F.sequence(F.lit(0), depth - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "folder"))
    within = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    hit = above.join(rules, ["project", "folder", "salt"]).withColumn("within", within).where(F.expr("within rlike regex"))
    last = hit.groupBy("project", "path", "kind").agg(F.max_by("on", F.struct("depth", "line")).alias("on"))
    said = lambda on: F.bit_or(F.when(F.col("on") == on, F.col("kind")).otherwise(0))
    return last.groupBy("project", "path").agg(said(True).alias("yes"), said(False).alias("no"))


# --- path patterns -----------------------------------------------------------------------------

#: fixed values: known conventions; "dir/" for a directory anywhere below the root, else the tail of a name before its last extension
CONVENTIONS = {
    VENDORED: ["vendor/", "node_modules/", "bower_components/", "third_party/", "third-party/", "thirdparty/", "Godeps/", "external/", "externals/", "extern/deps/", "contrib/upstream/", "jspm_packages/", "Pods/"],
    GENERATED: ["generated/", "gen/", "autogen/", "__generated__/", "bindings/", "target/out/", ".pb", "_pb2", "_pb2_grpc", ".g", ".gen", "_generated", "_autogen", ".generated", ".designer"],
}
NAME_TAIL = r"(?:[._-][A-Za-z0-9]+)$"


def normal_path(path):
    """Forward slashes, none doubled, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/"), r"^(?:\./)+", "")


def patterns_of(path):
    """All patterns a path matches: directories, neighbouring pairs of them, and the tail of its name."""
    parts = F.split(path, "/")
    inner = F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 2))
    one = F.transform(inner, lambda x: F.concat(x, F.lit("/")))
    two = F.transform(F.arrays_zip(inner.alias("a"), F.slice(inner, 2, F.greatest(F.lit(0), F.size(inner) - 1)).alias("b")), lambda x: F.concat(x["a"], F.lit("/"), x["b"], F.lit("/")))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    tail = F.regexp_extract(stem, NAME_TAIL, 0)
    return F.filter(F.array_distinct(F.concat(one, two, F.array(tail))), lambda x: x.isNotNull() & (x != ""))


def mined_patterns(files: DataFrame, p: MiningParams) -> DataFrame:
    """(pattern, kind): patterns under which files of ``files(path, evidence)`` are often of the kind; see :class:`MiningParams`."""
    kinds = (GENERATED, VENDORED, MINIFIED)
    of = {k: (F.col("evidence").bitwiseAND(k) > 0).cast("long") for k in kinds}
    total = files.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(of[k]), F.lit(0)).alias(f"k{k}") for k in kinds]).first()
    each = files.select(F.explode(patterns_of(F.col("path"))).alias("pattern"), *[of[k].alias(f"k{k}") for k in kinds])
    counts = each.groupBy("pattern").agg(F.count("*").alias("n"), *[F.sum(f"k{k}").alias(f"k{k}") for k in kinds])

    def lower(hits: Column, n: Column, z: float) -> Column:  # Wilson's bound
        share, z2 = hits / n, z * z
        return (share + z2 / (2 * n) - z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)

    def mined(k: int) -> Column:
        known = F.col("pattern").isin(CONVENTIONS[k]) if k in CONVENTIONS else F.lit(False)
        hits, n = F.col(f"k{k}") + F.when(known, p.prior[0]).otherwise(0), F.col("n") + F.when(known, p.prior[1]).otherwise(0)
        enough = (n >= p.least_files) & (hits > 1)
        if k == MINIFIED:
            return enough & (lower(hits, n, 1.96) >= p.least_shape)
        elsewhere = (F.lit(total[f"k{k}"]) - F.col(f"k{k}")) / F.greatest(F.lit(1), F.lit(total["n"]) - F.col("n"))
        return enough & ((lower(hits, n, 1.96) >= p.least_share) | (lower(hits, n, p.sure) >= F.greatest(F.lit(p.least_sure), p.lift * elsewhere)))

    found = F.array(*[F.when(mined(k), F.lit(k)) for k in kinds])
    return counts.select("pattern", F.explode(found).alias("kind")).where("kind is not null")


def not_handwritten(chunks: DataFrame, path_col: str, text_col: str, attributes: DataFrame | None = None, params: MiningParams | None = None, project_col: str | None = None) -> DataFrame:
    """(file_path, kinds): files, as spelled, that nobody wrote by hand here; kinds is a bit set.

    ``attributes``: (path, content) of attribute files, if there are any, with
    (project, path, content) where ``project_col`` names the chunks' project;
    a rule holds for files of its own project only. A null or empty path takes
    no part; a null or empty text shows nothing; a null project is one project;
    repeated rows change nothing.
    """
    p = params or MiningParams()
    project = F.coalesce(F.col(f"`{project_col}`").cast("string"), F.lit("")) if project_col else F.lit("")
    src = chunks.where(F.length(F.col(path_col)) > 0).select(F.col(path_col).alias("file_path"), project.alias("project"), F.col(text_col).alias("text"))

    def show(batch: pa.RecordBatch):
        found = pa.array([evidence_of(t) for t in batch.column("text").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("file_path"), batch.column("project"), found], names=["file_path", "project", "evidence"])

    shown = arrow_map(src, show, "file_path string, project string, evidence int")
    # one row for each file; what follows reads it several times
    spelled = cut_lineage(shown.groupBy("project", "file_path").agg(F.bit_or("evidence").alias("evidence")).withColumn("path", normal_path(F.col("file_path"))))
    files = spelled.groupBy("project", "path").agg(F.bit_or("evidence").alias("evidence"))
    if attributes is not None:
        own = F.coalesce(F.col("project"), F.lit("")) if "project" in attributes.columns else F.lit("")
        said = declared(files, attributes.select(own.alias("project"), normal_path(F.col("path")).alias("path"), "content"))
        files = files.join(said, ["project", "path"], "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("yes", "no")})
        files = files.select("project", "path", F.col("evidence").bitwiseAND(F.bitwise_not("no")).bitwiseOR(F.col("yes")).alias("evidence"), "no")
        files = cut_lineage(files)
    else:
        files = files.withColumn("no", F.lit(0))
    judged = files.withColumn("kinds", F.col("evidence"))
    if p.mine:
        mined = mined_patterns(files, p)
        has = files.select("project", "path", F.explode(patterns_of(F.col("path"))).alias("pattern"))
        by_mining = has.join(mined, "pattern").groupBy("project", "path").agg(F.bit_or("kind").alias("mined"))
        judged = files.join(by_mining, ["project", "path"], "left").withColumn("kinds", F.col("evidence").bitwiseOR(F.coalesce("mined", F.lit(0)).bitwiseAND(F.bitwise_not("no"))))
    flagged = judged.where("kinds <> 0").select("project", "path", "kinds")
    return spelled.select("file_path", "project", "path").join(flagged, ["project", "path"]).groupBy("file_path").agg(F.bit_or("kinds").alias("kinds"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of code_chunks that nobody wrote by hand in their project."""
    chunks = read(spark, sf_dir, "code_chunks")
    attributes = chunks.where(F.col("file_path").rlike(r"(?:^|[/\\])\.gitattributes$")).select(F.col("project_name").alias("project"), F.col("file_path").alias("path"), F.col("code_content").alias("content"))
    return not_handwritten(chunks, "file_path", "code_content", attributes, project_col="project_name").select("file_path")


QUERIES = {"p4_found": p4_found}
