"""Definitions in source files: chunks, calls, imports and module documentation.

Python is read with ``ast``. The brace languages are read with a scanner that
knows strings, characters and comments; it is tolerant, not a full parser.
"""

from __future__ import annotations

import ast
import re
import textwrap
from dataclasses import dataclass, field


@dataclass
class Chunk:
    identifier: str
    node_type: str
    code_content: str
    start_line: int
    docstring: str | None = None
    signature: str | None = None
    calls: list[str] = field(default_factory=list)


#: fixed values: how definitions begin, by language, with the node type each makes
DEFINITIONS = {
    "rust": [
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(?P<n>\w+)", "function_item"),
        (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)", "struct_item"),
        (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)", "enum_item"),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)", "trait_item"),
        (r"(?:unsafe\s+)?impl(?:\s*<[^{;]*?>)?\s+(?:[\w:<>,\s&']+?\s+for\s+)?(?P<n>\w+)", "impl_item"),
        (r"(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>\w+)", "type_item"),
        (r"macro_rules!\s*(?P<n>\w+)", "macro_definition"),
    ],
    "typescript": [
        (r"(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)", "function_declaration"),
        (r"(?:abstract\s+)?class\s+(?P<n>[\w$]+)", "class_declaration"),
        (r"interface\s+(?P<n>[\w$]+)", "interface_declaration"),
        (r"enum\s+(?P<n>[\w$]+)", "enum_declaration"),
        (r"type\s+(?P<n>[\w$]+)(?:<[^=]*>)?\s*=", "type_alias_declaration"),
        (r"(?:const|let|var)\s+(?P<n>[\w$]+)(?:\s*:[^=]+)?\s*=\s*(?:async\s+)?(?:\([^()]*\)|[\w$]+)(?:\s*:[^=]+?)?\s*=>", "arrow_function"),
        (r"(?:(?:public|private|protected|static|async|override|readonly)\s+)*(?!(?:if|for|while|switch|catch|return|function|constructor)\b)(?P<n>[\w$]+)\s*\([^()]*\)(?:\s*:\s*[^{};=]+)?\s*(?=\{)", "method_definition"),
    ],
    "go": [
        (r"func\s+\([^)]*\)\s*(?P<n>\w+)", "method_declaration"),
        (r"func\s+(?P<n>\w+)", "function_declaration"),
        (r"type\s+(?P<n>\w+)", "type_declaration"),
    ],
}
SKIPPED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)'", re.S)
CALL = re.compile(r"(?:\.|::)?\b([A-Za-z_$][\w$]*)\s*(?:::<[^()]*>)?\(")
KEYWORDS = set("if for while match switch return fn func function catch loop in let mut move unsafe impl new await async sizeof typeof super".split())


def blanked(text: str) -> str:
    """The text with strings and comments as blanks, offsets and lines kept."""
    return SKIPPED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def body_end(bare: str, at: int) -> tuple[int, int]:
    """Start and end of the braced body of a definition whose head ends at ``at``; without one, the statement's end."""
    depth = 0
    for i in range(at, len(bare)):
        ch = bare[i]
        if ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == ";" and depth <= 0:
            return i, i + 1
        elif ch == "{" and depth <= 0:
            level = 0
            for j in range(i, len(bare)):
                level += (bare[j] == "{") - (bare[j] == "}")
                if not level:
                    return i, j + 1
            return i, len(bare)
        elif ch == "\n" and depth <= 0 and not bare[i + 1 : i + 120].lstrip().startswith(("{", "where", ".", "|", "&")):
            if bare[at:i].strip():
                return i, i
    return len(bare), len(bare)


def doc_above(lines: list[str], line: int, language: str) -> str | None:
    """Documentation right above a definition in its language's own form."""
    out: list[str] = []
    i = line - 1
    if language == "typescript":
        while i >= 0 and not lines[i].strip():
            i -= 1
        if i < 0 or not lines[i].strip().endswith("*/"):
            return None
        end = i
        while i >= 0 and "/**" not in lines[i]:
            i -= 1
        if i < 0:
            return None
        text = [re.sub(r"^\s*(?:/\*\*|\*/|\*)\s?|\s*\*/\s*$", "", x).rstrip() for x in lines[i : end + 1]]
        return "\n".join(x for x in text if not x.lstrip().startswith("@")).strip() or None
    while i >= 0:
        x = lines[i].strip()
        if language == "rust":
            quoted = re.fullmatch(r'#\[doc\s*=\s*"(.*)"\]', x)
            if x.startswith("///"):
                out.append(x[3:].removeprefix(" "))
            elif quoted:
                out.append(quoted.group(1))
            elif x and not x.startswith("#["):
                break
        else:
            if not x.startswith("//"):
                break
            if not x.startswith("//go:"):
                out.append(x[2:].removeprefix(" "))
        i -= 1
    return "\n".join(reversed(out)).strip() or None


def test_modules(bare: str) -> list[tuple[int, int]]:
    """Spans of Rust modules that only tests compile."""
    return [body_end(bare, m.end()) for m in re.finditer(r"#\[cfg\(test\)\]\s*(?:#\[[^\]]*\]\s*)*(?:pub\s+)?mod\s+\w+", bare)]


def scan(text: str, language: str) -> list[Chunk]:
    bare, lines, out = blanked(text), text.split("\n"), []
    spans = test_modules(bare) if language == "rust" else []
    for pattern, kind in DEFINITIONS[language]:
        for m in re.finditer(r"^[ \t]*(?:export\s+(?:default\s+)?)?(" + pattern + ")", bare, re.M):
            start = m.start(1)
            if any(a <= start < b for a, b in spans):
                continue
            at, end = body_end(bare, m.end())
            if kind == "method_definition" and (at >= len(bare) or bare[at] != "{"):
                continue
            line = text.count("\n", 0, start)
            head = re.sub(r"\s+", " ", text[start : at if kind != "type_alias_declaration" else m.end()]).strip()
            called = sorted({c for c in CALL.findall(bare[at:end]) if c not in KEYWORDS})
            out.append(Chunk(m.group("n"), kind, text[start:end], line + 1, doc_above(lines, line, language), None if kind == "macro_definition" else head, called))
    return out


def scan_python(text: str) -> list[Chunk]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    lines, out = text.split("\n"), []
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        body = lines[node.lineno - 1 : node.body[0].lineno - 1] or [lines[node.lineno - 1]]
        head = re.sub(r"\s+", " ", " ".join(body)).strip()
        head = re.sub(r":\s*(?:#.*)?$", "", head) if len(body) > 1 or node.body[0].lineno > node.lineno else head.split(":")[0]
        called = {n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))}
        doc = ast.get_docstring(node)
        code = textwrap.dedent("\n".join([" " * node.col_offset + lines[node.lineno - 1].lstrip(), *lines[node.lineno : node.end_lineno]]))
        out.append(Chunk(node.name, "class_definition" if isinstance(node, ast.ClassDef) else "function_definition", code, node.lineno, doc or None, head, sorted(called)))
    return out


def chunks_of(text: str, language: str) -> list[Chunk]:
    """Chunks by identifier and line, each pair once; unknown languages have none."""
    found = scan_python(text) if language == "python" else scan(text, language) if language in DEFINITIONS else []
    seen = {}
    for c in sorted(found, key=lambda c: (c.identifier, c.start_line)):
        seen.setdefault((c.identifier, c.start_line), c)
    return list(seen.values())


def imports_of(text: str, language: str) -> list[tuple[str, str]]:
    """(imported name, source) of the imports of a file; aliases give the original name."""
    out: list[tuple[str, str]] = []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        return [(a.name, "." * n.level + (n.module or "")) for n in tree.body if isinstance(n, ast.ImportFrom) for a in n.names if not a.asname]
    if language == "rust":
        for m in re.finditer(r"^(?:pub\s+)?use\s+([^;]+);", blanked(text), re.M):
            path = re.sub(r"\s+", "", m.group(1).replace(" as ", "@"))
            base, brace, inner = path.partition("{")
            for item in inner.rstrip("}").split(",") if brace else [path.rpartition("::")[2]]:
                name = item.split("@")[0].rpartition("::")[2]
                if name and name != "*":
                    out.append((name, base.rstrip(":") if brace else path.rpartition("::")[0] or path))
    elif language == "typescript":
        for m in re.finditer(r"^import\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\s*['\"]([^'\"]+)['\"]", text, re.M):
            names = [m.group(1)] if m.group(1) else []
            names += [x.split(" as ")[-1].strip() for x in (m.group(2) or "").split(",") if x.strip()]
            out += [(x, m.group(3)) for x in names]
    elif language == "go":
        for block in re.findall(r"^import\s+(\([^)]*\)|[^\n]+)", text, re.M):
            for alias, path in re.findall(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", block):
                if alias not in ("_", "."):
                    out.append((alias or path.rpartition("/")[2], path))
    return out


def module_doc(text: str) -> str | None:
    """The leading ``//!`` lines of a Rust crate root."""
    out = []
    for line in text.split("\n"):
        if line.startswith("//!"):
            out.append(line[3:].removeprefix(" "))
        elif line.strip() or out:
            break
    return "\n".join(out).strip() or None


def manifest(text: str) -> tuple[str, str | None, list[str]] | None:
    """(name, description, local dependencies) of a Cargo manifest; None without a package name."""
    import tomllib

    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return None
    package = data.get("package", {})
    if not isinstance(package.get("name"), str):
        return None
    local = [k for k, v in data.get("dependencies", {}).items() if isinstance(v, dict) and "path" in v]
    description = package.get("description")
    return package["name"], description if isinstance(description, str) else None, sorted(local)
