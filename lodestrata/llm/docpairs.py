"""Functions paired with their documentation.

One recursive pattern for each language takes a documentation comment, the
signature under it and the balanced body together; strings, comments and
character literals are matched as wholes, so a brace or a keyword inside them
counts for nothing. A run of comments that no function follows is passed over
whole, not once for each of its lines. What follows decides whether the description is real.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map, one_row_per_key, read


@dataclass(frozen=True)
class DocParams:
    """least_words: words that a description needs."""

    least_words: int = 5


# --- extraction ------------------------------------------------------------------------------

CURLY = r"""
(?(DEFINE)
  (?P<str>"(?:[^"\\]++|\\.)*+"|r(?P<h>\#*)".*?"(?P=h))
  (?P<chr>'(?:\\[^\n]{1,9}?|[^'\\\n])')
  (?P<note>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)
  (?P<body>\{(?:[^{}"'`/]++|(?&str)|(?&tpl)|(?&chr)|(?&note)|(?&body)|['/`"])*+(?:\}|\Z))
  (?P<par>\((?:[^()"'`/]++|(?&str)|(?&tpl)|(?&chr)|(?&note)|(?&par)|['/`"])*+\))
  %s
)
"""
RUST = CURLY % r"""
  (?P<tpl>(?!))
  (?P<attr>\#!?\[(?:[^\[\]"]++|(?&str)|(?&attrin))*+\])
  (?P<attrin>\[(?:[^\[\]"]++|(?&str)|(?&attrin))*+\])
""" + r"""
(?P<fn>
  (?P<doc>(?:(?:///(?!/)[^\n]*+|/\*\*(?![*/])(?:[^*]++|\*(?!/))*+\*/|(?&attr))\s*+)*+)
  (?:pub(?:\s*(?&par))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+"[^"]*")?)\s+)*+
  fn\s+(?P<name>\w++)(?:[^{};()"]++|(?&par)|(?&str))*+(?P<block>(?&body))
)
| (?:(?:///(?!/)[^\n]*+|/\*\*(?![*/])(?:[^*]++|\*(?!/))*+\*/)\s*+)++
| (?&str) | (?&chr) | (?&note)
"""
SCRIPT = CURLY % r"""
  (?P<tpl>`(?:[^`\\]++|\\.)*+`)
  (?P<gen><(?:[^<>]++|(?&gen))*+>)
""" + r"""
(?P<fn>
  (?P<doc>(?:/\*\*(?![*/])(?:[^*]++|\*(?!/))*+\*/\s*+)*+)
  (?:@[\w.]++(?:(?&par))?\s*+)*+
  (?:
    (?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<name>[\w$]++)\s*(?:<[^<>(){}]*+>)?\s*(?&par)[^{};]*+(?P<block>(?&body))
  | (?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]++)\s*(?::[^=;{}]++(?==))?=\s*(?:async\s*)?(?:
        function\b\s*\*?\s*[\w$]*\s*(?&par)[^{};]*+(?P<block>(?&body))
      | (?:<[^<>(){}]*+>)?\s*(?:(?&par)\s*(?::[^={};]++)?|[\w$]++\s*)=>\s*(?:(?P<block>(?&body))|(?!\{)[^;\n]++)
    )
  | (?<![\w$.])(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*+\*?\s*(?!(?:if|for|while|switch|catch|function|return|with|do|else|new|typeof|await|super|throw|import)\b)\#?(?<![\w$.])(?P<name>[\w$]++)\s*(?:<[^<>(){}]*+>)?\s*(?&par)\s*(?::(?:[^{};=<]++|(?&gen))++)?(?P<block>(?&body))
  )
)
| (?:/\*\*(?![*/])(?:[^*]++|\*(?!/))*+\*/\s*+)++
| (?&str) | (?&tpl) | (?&note) | [\w$]++(?:\.[\w$]++)*+\s*(?&par)(?!\s*[:{])
"""
GO = CURLY % r"""
  (?P<tpl>`[^`]*+`)
""" + r"""
(?P<fn>
  (?P<doc>(?:(?:[ \t]*//[^\n]*+\n|[ \t]*/\*(?:[^*]++|\*(?!/))*+\*/[ \t]*\n)++)?+)
  [ \t]*func\s+(?:(?&par)\s*)?(?P<name>\w++)\s*(?:\[[^\[\]]*+\])?\s*(?&par)[^{}\n]*+(?:(?&par)\s*)?(?P<block>(?&body))
)
| (?:[ \t]*//[^\n]*+\n|[ \t]*/\*(?:[^*]++|\*(?!/))*+\*/[ \t]*\n)++
| (?&str) | (?&tpl) | (?&note) | (?&chr)
"""
PYTHON = r"""
(?(DEFINE)
  (?P<long>(?i:[rbuf]{0,2})(?:\"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''))
  (?P<short>(?i:[rbuf]{0,2})(?:"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'))
  (?P<par>\((?:[^()"'\#]++|(?&long)|(?&short)|\#[^\n]*+|(?&par)|["'])*+\))
  (?P<sub>\[(?:[^\[\]"'\#]++|(?&long)|(?&short)|\#[^\n]*+|(?&sub)|["'])*+\])
)
(?P<fn>
  ^(?P<indent>[ \t]*+)(?:async\s+)?def\s+(?P<name>\w++)\s*(?:\[[^\[\]]*+\])?\s*(?&par)\s*(?:->(?:[^:\n\["']++|(?&sub)|(?&short))*+)?:[ \t]*+(?:\#[^\n]*+)?
  (?:(?:\s*\n[ \t]*\#[^\n]*+)*+\s*(?P<doc>(?&long)|(?&short))[ \t]*+(?=\n|\Z|;|\#))?
  (?P<block>[^\n]*+(?:\n(?:[ \t]*+(?:\n|\Z)|(?P=indent)[ \t]++[^\n]*+|[ \t]*+\#[^\n]*+))*+)
)
| (?&long) | (?&short) | \#[^\n]*+
"""

FLAGS = regex.X | regex.S | regex.V0


@lru_cache(maxsize=None)
def pattern(language: str) -> regex.Pattern | None:
    if language == "python":
        return regex.compile(PYTHON, FLAGS | regex.M)
    text = {"rust": RUST, "typescript": SCRIPT, "javascript": SCRIPT, "go": GO}.get(language)
    return regex.compile(text, FLAGS) if text else None


def functions_of(code: str | None, language: str) -> list[tuple[str, str, str]]:
    """(name, raw documentation, code) of the functions and methods written out in ``code``, read to its end without a time limit."""
    found = pattern(language or "")
    if not code or found is None:
        return []
    return [(m.group("name"), m.group("doc") or "", m.group("fn")) for m in found.finditer(code) if m.group("fn") is not None]


def text_of_comment(raw: str, language: str) -> str:
    """The words of a documentation comment, without its markers."""
    if language == "python":
        raw = re.sub(r"^[rRbBuUfF]*", "", raw.strip())
        quote = 3 if raw[:3] in ('"""', "'''") else 1
        return raw[quote:-quote].replace("\\n", "\n") if len(raw) >= 2 * quote else ""
    out = []
    for m in re.finditer(r'//[/!]?([^\n]*)|/\*+(.*?)\*/|#!?\[doc\s*=\s*"((?:[^"\\]|\\.)*)"\s*\]|#!?\[', raw, re.S):
        if m.group(1) is not None:
            if not m.group().startswith("//go:"):
                out.append(m.group(1))
        elif m.group(2) is not None:
            out += [re.sub(r"^\s*\*+ ?", "", x) for x in m.group(2).split("\n")]
        elif m.group(3) is not None:
            out += m.group(3).replace('\\"', '"').split("\\n")
    return "\n".join(out)


# --- real descriptions ------------------------------------------------------------------------

TAG = re.compile(r"\s*(?:[@\\][A-Za-z]\w*|:[A-Za-z]\w*(?:\s+[^:]*)?:|(?:\*\*)?(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|notes?|see also|errors|panics|safety|attributes|todo)(?:\*\*)?\s*:\s*$)", re.I)
TITLE = re.compile(r"\s*(?:#{1,6}\s+\S.*|[=~^*_.\-#+\s]+)$")
#: what stands for a description that nobody has written yet
STUB = re.compile(
    r"""(?ix)^\s*[\[(<{*_-]*\s*(?:
      (?:todo|fixme|xxx|hack|wip|tbd|tbc)\b
    | n\s*/\s*a\b | none\b[\s.!]*$ | undocumented\b | deprecated\b[\s.!]*$
    | (?:auto(?:matically)?[-\ ]?generated|generated)\s+(?:method|function|code|by|stub|doc|constructor|getter|setter)
    | (?:method|function|class|constructor)\s+stub\b
    | placeholder\b | lorem\ ipsum
    | (?:insert|add|write|put|enter|fill\ in|provide|describe|document)\s+(?:a\s+|the\s+|your\s+|some\s+)?(?:description|docs?|documentation|docstring|text|summary|comment|this|here)\b
    | (?:description|documentation|docs?|docstring|comment)\s+(?:goes|to\ come|to\ be|missing|pending|here|needed)\b
    | (?:no|missing)\s+(?:description|documentation|docs?|docstring)\b
    | (?:same|see)\s+(?:as\s+)?(?:above|below)\b[\s.]*$
    | self[-\ ]explanatory\b
    )"""
)
#: words that say nothing beside a name
FILLER = set("a an the this that it is are of for to and method function func fn procedure routine member helper implementation implements impl does summary docstring doc docs documentation description describes comment class struct type object".split())
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+")
UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-鿿가-힯]")


def name_words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)} | {name.lower()}


def description_of(text: str | None, name: str, p: DocParams) -> str | None:
    """The prose of a documentation text, or None if it isn't a real description of ``name``."""
    if not text or not text.strip():
        return None
    prose, fenced = [], False
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.strip().startswith(("```", "~~~")) and not TITLE.match(line):
            fenced = not fenced
            continue
        if fenced:
            continue
        if TAG.match(line):
            break  # tags and their sections come last
        if TITLE.match(line):
            if prose:
                break
            continue
        if line.strip():
            prose.append(line.strip())
        elif prose:
            prose.append("")
    plain = re.sub(r"<[^<>]*>", " ", "\n".join(prose)).strip()
    if not plain or STUB.match(plain):
        return None
    words = WORD.findall(re.sub(r"\{@\w+\s+([^}]*)\}|`", r"\1", plain))
    count = len(words) + sum(1 for _ in UNSPACED.finditer(plain)) // 2
    if count < p.least_words:
        return None
    known = name_words(name) | FILLER
    said = [w for w in words if w.lower() not in known and not {x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", w)} <= known]
    if not said and not UNSPACED.search(plain):
        return None
    return re.sub(r"\s+", " ", plain)


FUNCTION_NODES = {"function_item", "function_definition", "function_declaration", "method_declaration", "method_definition", "arrow_function", "function_expression", "generator_function_declaration"}


#: without one of these a text has no documentation comment, and the pattern needn't run
MARKS = {"rust": ("///", "/**", "#[doc"), "typescript": ("/**",), "javascript": ("/**",), "go": ("//", "/*"), "python": ('"""', "'''", '"', "'")}


def documented_functions(code: str | None, language: str | None, node_type: str | None, identifier: str | None, docstring: str | None, p: DocParams) -> list[tuple[str, str, str]]:
    """(name, description, code) of each documented function of a chunk, in order.

    Its own comment goes before the docstring column, which describes the
    function of the chunk's name, if the pattern finds that written out. For
    languages without a pattern the column alone counts.
    """
    language = (language or "").lower()
    column = description_of(docstring, identifier, p) if node_type in FUNCTION_NODES and identifier else None
    marked = bool(code) and (column is not None or any(x in code for x in MARKS.get(language, ())))
    written = functions_of(code, language) if marked else []
    out = []
    for name, raw, body in written:
        said = description_of(text_of_comment(raw, language), name, p) if raw.strip() else None
        if said:
            out.append((name, said, body))
    if column and all(n != identifier for n, _, _ in out):
        if pattern(language) is None:
            out.append((identifier, column, code or ""))
        else:
            out += [(name, column, body) for name, _, body in written if name == identifier][:1]
    return out


PAIR_SCHEMA = "chunk_id string, function_name string, description string, code string"


def function_pairs(chunks: DataFrame, params: DocParams | None = None, with_code: bool = True) -> DataFrame:
    """(chunk_id, function_name, description, code) of the functions with a real description.

    Reads chunk_id, language, node_type, identifier, docstring and
    code_content. Null ids have no rows, nor have null or empty texts of a
    language with a pattern; functions of one name in a chunk each have a row;
    a chunk that stands twice comes out twice.
    """
    p = params or DocParams()
    columns = ["chunk_id", "language", "node_type", "identifier", "docstring", "code_content"]
    src = chunks.where(F.col("chunk_id").isNotNull()).select(*columns)

    def extract(batch: pa.RecordBatch):
        rows = [(r["chunk_id"], n, d, b if with_code else None) for r in batch.to_pylist() for n, d, b in documented_functions(r["code_content"], r["language"], r["node_type"], r["identifier"], r["docstring"], p)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["chunk_id", "function_name", "description", "code"])

    return arrow_map(src, extract, PAIR_SCHEMA)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with a real description, by chunk."""
    return function_pairs(read(spark, sf_dir, "code_chunks"), with_code=False).select("chunk_id", "function_name").distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of each such function, each chunk once."""
    columns = ["chunk_id", "language", "node_type", "identifier", "docstring", "code_content"]
    return function_pairs(one_row_per_key(read(spark, sf_dir, "code_chunks"), "chunk_id", columns))


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs}
