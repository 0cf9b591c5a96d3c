"""Credentials embedded in source code and texts, found and redacted in place.

Context rules propose the exact span of a value: private key blocks, passwords
in connection strings and URLs, authorization headers, command-line flags,
assignments to telling names, arguments of calls, remarks. A value that is
neither a reference nor a placeholder is then judged by how natural it is, that
is by its characters for each subword of a public tokenizer's vocabulary: words
of a language or of code take few subwords, keys and passwords many. Redaction
keeps every offset and line break.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map, read
from lodestrata.llm.tokens import BYTE_BPE, TOKENIZER_DIR, tokenizer, vocabulary_path


@dataclass(frozen=True)
class CredentialParams:
    """natural: characters per subword from which on a value counts as ordinary words.
    plain: the same for values of letters and joints only, as names and words are.
    bare: the same for the argument of a call that no other sign marks.
    least: characters of the shortest value whose context is in doubt."""

    natural: float = 3.3
    plain: float = 1.8
    bare: float = 2.4
    least: int = 8
    vocabulary: str = BYTE_BPE
    folder: str = TOKENIZER_DIR


PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>.*?)-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
URL = re.compile(r"\b[a-zA-Z][\w+.-]*://[^\s:/@\"'`<>]*:(?P<v>[^\s@\"'`<>/]+)@[\w.\[-]")
PAIRED = re.compile(r"(?i)(?:^|[;\"'`&?\s])(?:password|pwd|passwd)\s?=\s?(?P<v>[^;\"'`&\s<>]+)(?=;|[\"'`&\s<]|$)")
HEADER = re.compile(r"(?i)authorization[\"'`]?\s*[:,=]\s*[\"'`]?(?:bearer|basic|token|apikey|digest)\s+(?P<v>[^\s\"'`<>,;)]+)")
FLAG = re.compile(r"(?i)(?<![\w-])--?(?:password|passwd|pass|pwd|token|secret|auth[-_]token|access[-_]token|api[-_]?key|access[-_]key|secret[-_]key|private[-_]token|client[-_]secret|credential)(?:=|\s+)(?P<q>[\"']?)(?P<v>[^\s\"'`<>,;)]+)")
LOGIN = re.compile(r"(?i)\b\w*(?:login|log_in|sign_?in|authenticate|set_?credentials|basic_?auth)\s*\(\s*([\"'`])[^\"'`\n]*\1\s*,\s*(?P<q>[\"'`])(?P<v>[^\"'`\n]+)(?P=q)")
CALL = re.compile(r"(?i)\b[\w.:]*(?:password|passwd|passphrase|secret|token|credentials?|api_?key|auth|bearer)\w*\s*\(\s*(?:(?:[^()\"'`,\n]++|\"[^\"\n]*+\"|'[^'\n]*+')*+,\s*+)*([\"'`])(?P<v>[^\"'`\s]{12,})\1\s*[,)]")
CORE = re.compile(r"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|credential|bearer|key|login")
VALUE = re.compile(r"[\"']?(?:\s*:\s*[&'\w<>\[\]. ]{1,30}?(?=\s*=))?\s*(?::=|=>|=(?!=)|:(?!:))\s*(?:\w{0,2}(?P<q>\"\"\"|'''|[\"'`])(?P<v>.*?)(?P=q)|(?P<bare>[^\s\"'`<>,;(){}\[\]]+(?=[\s<,;]|$)))")
REMARK = re.compile(r"(?i)\b(?:login|password|passwd|pwd|passphrase|secret|token|credentials?|(?:(?:api|access|signing|secret|private) ?)?key)\b(?:\s+\w+){0,10}\s*[:=]\s*[\"'`]?(?P<v>[^\s\"'`<>,;]{6,})")
KNOWN = re.compile(r"\b(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{20,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{20,}|glpat-[0-9A-Za-z_-]{20,}|eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,})")

#: fixed values: last words of names that hold a secret, and last words that make a name of something else
TELLING = {"password", "passwd", "passphrase", "pwd", "pass", "secret", "token", "credential", "credentials", "bearer"}
KEYS = {"api", "access", "secret", "private", "signing", "auth", "encryption", "master", "account", "shared", "service", "webhook", "client", "hmac", "aes", "license"}
STRONG = {"password", "passwd", "passphrase", "pwd", "pass", "secret", "credential", "credentials"}

REFERENCE = re.compile(r"""(?ix)
    ^(?:\$|%\w+%|\{\{?|<|@|&|\#\{|%\(|\[)           # ${NAME}, $NAME, %NAME%, {{ x }}, <value>
  | ^(?:env|vault|ssm|sops|keyring|file|ref|arn|secret)s?[:/]
  | ^(?:process|os)\.(?:env|environ|getenv)\b
  | \$\{?[A-Za-z_]\w*\}?$
  | \{\w*\}
""")
PLACEHOLDER = re.compile(r"""(?ix)
    ^(.)\1*$                                         # one character again and again
  | ^(?:x|\*|\.|-|_|\#|•|0|\?)+$
  | [*•]{3,} | x{5,} | \.{3}
  | ^(?:your|my|the|some|insert|enter|put|add|any)[-_ .]
  | (?:change|replace|fill)[-_ ]?(?:me|this|it|in)\b
  | ^(?:todo|tbd|fixme|none|null|nil|undefined|true|false|n/?a|redacted|removed|hidden|masked|placeholder|example|sample|dummy|fake|test|testing|demo|secret|password|passwd|passw0rd|pass|token|key|api[-_]?key|string|value|default|empty|unset|changeit|letmein|hunter2)\d*[!.]?$
  | (?:^|[-_. ])(?:example|sample|dummy|placeholder|fake|redacted|your|notreal|not[-_]a[-_]?real)(?:[-_. ]|$)
  | (?:here|goes[-_]here)$
  | ^(?:abc(?:def)?|qwerty|123456?7?8?9?0?|1234|abcd1234|foo|bar|baz|foobar)\w{0,3}$
""")
COMMENT = re.compile(r"\s*(?://|#|/?\*|--|;|<!--|%)")


def words_of(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def subword_length(value: str, p: CredentialParams) -> float:
    """Characters per subword."""
    ids = tokenizer(vocabulary_path(p.vocabulary, p.folder)).encode(value, add_special_tokens=False).ids
    return len(value) / max(1, len(ids))


def is_literal(value: str) -> bool:
    return bool(value) and not REFERENCE.search(value) and not PLACEHOLDER.search(value)


NAME_LIKE = re.compile(r"[^\W\d]+(?:[.-][^\W\d]+)*|[a-z_]+-?\d+")


def plausible(value: str, p: CredentialParams, doubtful: bool) -> bool:
    """Whether a value in such a context is a secret: a literal, and not made of ordinary words."""
    if len(value) < 4 or not is_literal(value) or any(c.isspace() for c in value):
        return False
    if re.fullmatch(r"[\d.:-]+", value) and (doubtful or len(value) < 12):
        return False
    if doubtful and (len(value) < p.least or re.search(r"[()]|\[\]|::|->|^[./~]|^\w+://", value)):
        return False
    return subword_length(value, p) < (p.plain if NAME_LIKE.fullmatch(value) else p.natural)


def bare_secret(value: str, p: CredentialParams) -> bool:
    """Whether a literal that no name or form marks is a secret: of three kinds of characters, no digest, and very unnatural."""
    kinds = sum(bool(re.search(x, value)) for x in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"))
    return kinds >= 3 and plausible(value, p, True) and not re.fullmatch(r"[0-9a-fA-F-]+|sha\d+[-:].*", value) and subword_length(value, p) < p.bare


def naming(text: str, at: int, end: int) -> tuple[str | None, int]:
    """The last word of the name around a telling word, None if it names no secret, and where the name ends.

    The name is read back over three joints; what stands before can't change the last two words.
    """
    a, joints = at, 0
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_-"):
        joints += not text[a - 1].isalnum()
        if joints > 3:
            break
        a -= 1
    b = end
    while b < len(text) and (text[b].isalnum() or text[b] == "_"):
        b += 1
    words = words_of(text[a:b])
    while words and words[-1].isdigit():
        words.pop()
    if words and (words[-1] in TELLING or (words[-1] in ("key", "keys") and len(words) > 1 and words[-2] in KEYS) or words[-1] in ("apikey", "accesskey", "secretkey")):
        return words[-1], b
    return None, b


def find_credentials(text: str | None, p: CredentialParams) -> list[tuple[int, int]]:
    """Spans of all credentials, in order, none within another."""
    if not text:
        return []
    spans: list[tuple[int, int]] = []
    low = text.lower()
    if "private key" in low:
        for m in PRIVATE_KEY.finditer(text):
            body = re.sub(r"\\[nr]|\s", "", m.group("v"))
            if re.search(r"[A-Za-z0-9+/]{24}", body) and not re.search(r"x{12,}|\.{3}|<|your", body, re.I):
                spans.append(m.span())
    inside = lambda a: any(s <= a < e for s, e in spans)

    def take(m: re.Match, doubtful: bool, group: str = "v") -> None:
        a, b = m.span(group)
        while b > a and text[b - 1] in ".,:)" and group != "v":
            b -= 1
        if not inside(a) and plausible(text[a:b], p, doubtful):
            spans.append((a, b))

    if "://" in text and "@" in text:
        for m in URL.finditer(text):
            take(m, False)
    if "authorization" in low:
        for m in HEADER.finditer(text):
            take(m, False)
    if "=" in text and ";" in text and ("password" in low or "pwd" in low or "passwd" in low):
        for m in PAIRED.finditer(text):
            line = text[text.rfind("\n", 0, m.start()) + 1 :].split("\n", 1)[0]
            if re.search(r"(?i)(?:server|host|data source|user(?: id)?|uid|database)\s?=", line):
                take(m, False)
    if "-" in text:
        for m in FLAG.finditer(text):
            take(m, False)
    if "log" in low or "auth" in low or "sign" in low or "cred" in low:
        for m in LOGIN.finditer(text):
            take(m, True)
    if "(" in text:
        for m in CALL.finditer(text):
            if not inside(m.start("v")) and bare_secret(m.group("v"), p):
                spans.append(m.span("v"))
    if "_" in text or "-" in text or "AKIA" in text or "AIza" in text or "eyJ" in text or "ASIA" in text:
        for m in KNOWN.finditer(text):
            take(m, False)
    skip = 0
    for m in CORE.finditer(text):
        if m.start() < skip:
            continue
        word, end = naming(text, *m.span())
        skip = end
        if word is None:
            continue
        v = VALUE.match(text, end)
        if not v:
            continue
        if v.group("v") is not None:
            a, b = v.span("v")
            if not inside(a) and plausible(text[a:b], p, word not in STRONG or not re.search(r"\d", text[a:b])):
                spans.append((a, b))
        else:
            start = text.rfind("\n", 0, m.start()) + 1
            lead = text[start : m.start()]
            lead = re.sub(r"<[^<>]*>|&\w+;", "", lead)
            if re.fullmatch(r"\s*(?:(?://+|#+|/?\*+|--|;|>|-|\$)\s*)*(?:(?:export|set|ENV|env|-e)\s+)?[\"']?[\w.-]*", lead):
                a, b = v.span("bare")
                if not inside(a) and plausible(text[a:b], p, True):
                    spans.append((a, b))
    for m in REMARK.finditer(text):
        start = text.rfind("\n", 0, m.start()) + 1
        if COMMENT.match(text, start) or re.search(r"(?://|#|/\*)\s", text[start : m.start()]):
            take(m, True)
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def redact(text: str | None, p: CredentialParams, mask: str = "*") -> str | None:
    """The text with each credential masked character by character; line breaks, escaped ones too, stay."""
    if not text:
        return text
    out, at = [], 0
    for a, b in find_credentials(text, p):
        out += [text[at:a], re.sub(r"\\[nrt]|[\r\n]|(.)", lambda m: mask if m.group(1) else m.group(), text[a:b])]
        at = b
    return "".join([*out, text[at:]])


#: one of these must stand in a text that holds a credential
HINT = r"(?i)pass|pwd|secret|token|key|auth|bearer|credential|log_?in|sign_?in|://|akia|asia|aiza|gh[pousr]_|xox|eyj|glpat|sk_live"


def credentials(df: DataFrame, id_col: str, text_col: str, params: CredentialParams | None = None) -> DataFrame:
    """(id, start, secret), one row for each credential in each row's text; offsets in characters.

    Null ids, null and empty texts have none. A repeated row repeats its rows.
    """
    p = params or CredentialParams()
    src = df.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(HINT)).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def find(batch: pa.RecordBatch):
        rows = [(i, a, t[a:b]) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) for a, b in find_credentials(t, p)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))], names=["id", "start", "secret"])

    return arrow_map(src, find, "id string, start int, secret string")


def redacted(df: DataFrame, id_col: str, text_col: str, params: CredentialParams | None = None) -> DataFrame:
    """(id, text) of each row, the text redacted; null and empty texts as they are."""
    p = params or CredentialParams()
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def mask(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([redact(t, p) for t in batch.column("text").to_pylist()], pa.string())], names=["id", "text"])

    return arrow_map(src, mask, f"id {dict(src.dtypes)['id']}, text string")


SOURCES = {"code_chunks": "code_content", "readme_chunks": "content"}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials of both tables, each text once."""
    parts = [credentials(read(spark, sf_dir, t), "chunk_id", c).select(F.lit(t).alias("source_table"), F.col("id").alias("chunk_id"), "secret") for t, c in SOURCES.items()]
    return parts[0].unionByName(parts[1]).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' texts without their credentials."""
    parts = [redacted(read(spark, sf_dir, t), "chunk_id", c).select(F.lit(t).alias("source_table"), F.col("id").alias("chunk_id"), "text") for t, c in SOURCES.items()]
    return parts[0].unionByName(parts[1])


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}
