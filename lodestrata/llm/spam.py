"""Keyword-stuffed and link-list pages: bagged decision trees on weak labels, smoothed by host.

Each text is cut into tokens once; all features are counted from the token
numbers of a whole batch of texts at a time. The labels that the trees learn
from have other sources than the features: how far bytes compress against what
texts of that length and script usually do, and how densely characters of
addresses, hashtags, separators and sentence ends stand. These speak only for
clear pages of a bounded sample and leave the others open. Every text is then
scored by all trees, and the score is moved towards the spam rate of its host,
which is taken over all texts.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map, mix64, read
from lodestrata.runtime import cut_lineage


@dataclass(frozen=True)
class SpamParams:
    """train_rows: bound of the sample that the trees are grown on. host_pull: how many
    logits a host's rate may move a score, at most. host_rows: pages that a host's own
    rate needs to weigh as much as the rate of all. slice_chars: characters whose tokens
    are counted at a time (a longer text is counted alone)."""

    train_rows: int = 20_000
    trees: int = 25
    depth: int = 6
    least_leaf: int = 5
    bins: int = 32
    host_pull: float = 0.5
    host_rows: float = 50.0
    threshold: float = 0.5
    seed: int = 11
    slice_chars: int = 2_000_000


# --- features ----------------------------------------------------------------------------------

#: fixed values: frequent function words of the languages in the collection
STOP = frozenset(
    """the a an is are was were be been it its of to in and or for on that which this these those we you they he she i if each can not by from now with as at but so
    than then there here when while has have had do does did will would what how why who where no only even because although every both after
    up out into over under before about more most some any such same other our your their my his her must should could may might
    der die das den dem des ein eine einen ist sind war und oder nicht nur wenn auch sich noch von zu im in mit auf für als wie wird werden hat haben nach bei aus am es er sie man wir ihr ich jede jeder jedes ohne lässt kann ob sofern solange bitte dann dass waren wurde wer muss mehr gestern nur jetzt diese dieser
    le la les un une des du de et ou est sont que qui ne pas plus dans pour par sur avec si il elle se ce cette ces au aux ici nous vous ils elles avons ont été était étaient dont tant tout aussi seulement quand chaque sans même pourquoi après hier maintenant reste faut l' d' n' s' qu
    el los las una y o es son no se por para con en del al lo su más si como pero ya ahora está estuvo estaban esta este esto ha han fue hay muy sin cada solo cuando otro otros quien también tras aunque aún hace qué tan conviene ser""".split()
) | frozenset("はがのをにでともへやかなてただしすまいるりんせ")
CJK = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
REST = r"[^\s<>\"')\]]"
TOKEN = re.compile(
    rf"(?:https?://|www\.){REST}+"  # an address with its scheme
    r"|</?[a-zA-Z][^<>\n]{0,200}>"  # a tag
    r"|\#\w[\w-]*+"  # a hashtag
    rf"|[{CJK}]"
    rf"|[^\W_{CJK}]++(?:[-_.][^\W_{CJK}]++)*+(?:/{REST}*+)?"  # a word, a compound, or a bare address with its path
    r"|\n|[^\w\s]"
)
PARTS = re.compile(r"[^\W_]+")
#: fixed values: last labels of bare addresses
DOMAINS = frozenset("com net org info biz io co de fr es ru cn example test invalid localhost".split())
LINE_KIND = re.compile(
    r"""(?imx)^[ \t]*(?:
      (\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d:\d\d|(?:\[\s*)?(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\b|at\s+[\w.$<>]+\s*\(|File\ "|Traceback|Caused\ by|\d+:\s+0x|\#\d+\s+0x)
    | (\|.*\|[ \t]*$)
    | (-{1,2}[\w-]+[ ,=\t]|usage:|options:|\$\ )
    | ((?:[-*+]\s+)?(?:\#+\s*)?(?:\[?v?\d+\.\d+(?:\.\d+)*\]?|(?:fix(?:e[ds])?|add(?:ed|s)?|chang(?:e|ed|es)|remov(?:e|ed|es)|deprecat\w+|improv\w+|bump\w*|updat\w+|renam\w+|drop\w*|feat|chore|refactor|perf|docs?)\b[:(\s]))
    )"""
)
FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
ADDRESS, TAG, HASHTAG, LINE, END, SEPARATOR, WORD, OTHER = range(8)
FEATURES = ["words", "unique", "stops", "link_chars", "link_lines", "explained", "hashtags", "tags", "codes", "pair", "pairs", "word", "short_parts", "sentences", "shouts", "logged", "tables", "help", "changes", "fenced", "template", "any_pair", "starts"]
F_AT = {name: i for i, name in enumerate(FEATURES)}


class Lexicon(dict):
    """Token to number; what is known of each number stands in lists."""

    def __init__(self):
        super().__init__()
        self.kind, self.weight, self.size = [], [], []
        self.stop, self.mixed, self.plain, self.shout = [], [], [], []

    def __missing__(self, token: str) -> int:
        low = token.lower()
        kind, weight = OTHER, 0
        if token == "\n":
            kind = LINE
        elif token in ".!?\u3002\uff01\uff1f":
            kind = END
        elif token in "|;,\u2022\u00b7\u00bb>/":
            kind = SEPARATOR
        elif low[0] == "<" and len(low) > 1:
            kind = SEPARATOR if low[:3] in ("<br", "<li") else TAG
        elif token[0] == "#" and len(token) > 1:
            kind = HASHTAG
        elif "://" in token or low[:4] == "www.":
            kind = ADDRESS
        elif token[0].isalnum():
            host = low.partition("/")[0]
            kind = ADDRESS if "." in host and host.rpartition(".")[2] in DOMAINS else WORD
            weight = len(PARTS.findall(low)) if kind == WORD else 0
        if kind == WORD and low != token:
            self[token] = number = self[low]
            return number
        self[token] = number = len(self.kind)
        word = kind == WORD
        for known, value in (
            (self.kind, kind), (self.weight, weight), (self.size, len(token)), (self.stop, word and low in STOP), (self.mixed, word and weight == 1 and not low.isalpha() and not low.isdigit()),
            (self.plain, word and low not in STOP and not low.isdigit()), (self.shout, token in "!?"),
        ):
            known.append(value)
        return number


def counted(text: np.ndarray, key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, count or sum of weights) of each distinct key within its text."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        whole = mix64(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (text.astype(np.uint64) + np.uint64(1)))
    _, first, back, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    return text[first], count if weight is None else np.bincount(back, weights=weight)


def two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def features_of(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text; null and blank texts have zeros only."""
    n, lexicon = len(texts), Lexicon()
    texts = [(t or "").replace("\r", "\n") for t in texts]
    tokens = [TOKEN.findall(t) for t in texts]
    length = np.array([len(t) for t in tokens], np.int64)
    code = np.fromiter((lexicon[t] for each in tokens for t in each), np.int64, int(length.sum()))
    out = np.zeros((n, len(FEATURES)))
    if not len(code):
        return out
    del tokens
    text = np.repeat(np.arange(n), length)
    known = lambda values, kind: np.array(values, kind)[code]
    kind, weight, size = known(lexicon.kind, np.int8), known(lexicon.weight, np.int32), known(lexicon.size, np.int32)
    stop, mixed, plain, shout = (known(x, bool) for x in (lexicon.stop, lexicon.mixed, lexicon.plain, lexicon.shout))
    per = lambda mask, w=None: np.bincount(text[mask], weights=None if w is None else w[mask], minlength=n)
    put = lambda name, values: out.__setitem__((slice(None), F_AT[name]), values)

    def most(of: np.ndarray, count: np.ndarray) -> np.ndarray:
        top = np.zeros(n)
        np.maximum.at(top, of, count)
        return top

    word = kind == WORD
    words, chars = per(word, weight), np.array([max(1, len(t.strip())) for t in texts], float)
    some = np.maximum(words, 1)
    put("words", np.log1p(words))
    put("unique", np.bincount(counted(text[word], code[word])[0], minlength=n) / some)
    for name, mask in (("stops", stop), ("codes", mixed), ("shouts", shout)):
        put(name, per(mask) / some)
    for name, which in (("link_chars", ADDRESS), ("hashtags", HASHTAG), ("tags", TAG)):
        put(name, per(kind == which, size) / chars)
    # repeated words and neighbours
    at = np.flatnonzero(plain)
    of, what = text[at], code[at]
    content = np.maximum(np.bincount(of, minlength=n), 1)
    put("word", most(*counted(of, what)) / some)
    side = (of[1:] == of[:-1]) & (what[1:] != what[:-1])
    pair_of, pair_count = counted(of[1:][side], two(what[:-1], what[1:])[side])
    top = most(pair_of, pair_count)
    put("pair", 2 * np.where(top > 2, top, 0) / content)
    often = pair_count >= np.maximum(3, content // 40)[pair_of]
    put("pairs", np.minimum(1, 2 * np.bincount(pair_of[often], weights=pair_count[often], minlength=n) / content))
    at = np.flatnonzero(word)
    of, what = text[at], code[at]
    side = of[1:] == of[:-1]
    put("any_pair", np.where(words > 9, 2 * most(*counted(of[1:][side], two(what[:-1], what[1:])[side])) / some, 0))
    # parts, sentences, lines
    begins = np.append(True, text[1:] != text[:-1])

    def cut(*kinds: int) -> tuple[np.ndarray, np.ndarray]:
        new = begins.copy()
        for k in kinds:
            new |= kind == k
        return np.cumsum(new) - 1, text[new]

    sums = lambda part, n_parts, w: np.bincount(part, weights=w, minlength=n_parts)
    part, part_of = cut(LINE, END, SEPARATOR)
    w = sums(part, len(part_of), weight)
    put("short_parts", np.bincount(part_of, weights=np.where(w <= 4, w, 0), minlength=n) / some)
    part, part_of = cut(LINE, END)
    w, s = sums(part, len(part_of), weight), sums(part, len(part_of), stop)
    spoken = (w >= 5) & (s >= np.maximum(1, 0.15 * w))
    put("sentences", np.bincount(part_of, weights=np.where(spoken, w, 0), minlength=n) / some)
    at = np.flatnonzero(stop)
    nth = np.arange(len(at)) - np.searchsorted(part[at], part[at])
    order = np.zeros(len(part_of), np.uint64)  # a sentence's stop words in their order
    with np.errstate(over="ignore"):
        np.add.at(order, part[at], mix64(code[at].astype(np.uint64) * np.uint64(0x100000001B3) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    put("template", most(*counted(part_of[spoken], order[spoken], w[spoken])) / some)
    part, part_of = cut(LINE)
    w, s, links, filled = (sums(part, len(part_of), x) for x in (weight, stop, kind == ADDRESS, kind != LINE))
    lines = np.maximum(np.bincount(part_of[filled > 0], minlength=n), 1)
    linked = np.bincount(part_of[links > 0], minlength=n)
    put("link_lines", linked / lines)
    put("explained", np.bincount(part_of[(links > 0) & (w >= 5) & (s >= 2) & (w >= 4 * links)], minlength=n) / np.maximum(1, linked))
    at = np.flatnonzero(word)
    first = np.searchsorted(part[at], np.arange(len(part_of)))
    whole = np.flatnonzero(first + 1 < len(at))
    whole = whole[(part[at[first[whole]]] == whole) & (part[at[first[whole] + 1]] == whole)]
    put("starts", np.where(lines > 5, most(*counted(part_of[whole], two(code[at[first[whole]]], code[at[first[whole] + 1]]))) / lines, 0))
    shapes = np.zeros((n, 4))
    for i, t in enumerate(texts):
        for groups in LINE_KIND.findall(t):
            shapes[i] += [bool(g) for g in groups]
        if "```" in t or "~~~" in t:
            out[i, F_AT["fenced"]] = sum(len(m.group()) for m in FENCE.finditer(t)) / chars[i]
    for j, name in enumerate(("logged", "tables", "help", "changes")):
        put(name, shapes[:, j] / lines)
    return out


def measured(texts: list[str | None], p: SpamParams) -> np.ndarray:
    """:func:`features_of` of any number of texts, so many at a time."""
    parts, some, size = [], [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= p.slice_chars:
            parts.append(features_of(some))
            some, size = [], 0
    return np.vstack([*parts, features_of(some)]) if parts or some else np.zeros((0, len(FEATURES)))


# --- weak labels ---------------------------------------------------------------------------------

SIGNS = ["bytes", "chars", "packed", "separators", "ends", "addresses", "hashes", "shaped", "listed"]
ENDS = re.compile(r"[.!?](?:\s|$)|[\u3002\uff01\uff1f]")
MARKED = re.compile(r"://|\bwww\.|\w\.(?:com|net|org|info|example|test|invalid)\b")
HASHED = re.compile(r"(?<!\w)#\w")
LISTED = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,4}[.)])[ \t]", re.M)
SHAPED = re.compile(r"^[ \t]*(?:\|.*\|[ \t\r]*$|\[?\d{4}-\d\d-\d\d|[-+*]?[ \t]*-{1,2}\w|```|~~~)", re.M)


def signs_of(text: str | None) -> list[float]:
    """What the labels are read from: sizes, compressed size, and densities of characters for 100 of the text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    per = 100 / max(1, len(raw))
    marks = sum(text.count(c) for c in "|,;/#>[]()<\u2022\u00b7\u00bb")
    lines = max(1, sum(1 for x in text.splitlines() if x.strip()))
    inside = text.count("```") + text.count("~~~")
    return [len(raw), len(text), len(zlib.compress(raw, 6)) / max(1, len(raw)), 100 * marks / max(1, len(text)), len(ENDS.findall(text)) * per, len(MARKED.findall(text)) * per, len(HASHED.findall(text)) * per, len(SHAPED.findall(text)) / lines + (inside > 1) * 0.3, len(LISTED.findall(text)) / lines]


def weak_labels(signs: np.ndarray) -> np.ndarray:
    """1: surely spam, 0: surely not, -1: open, by rows of SIGNS; a text is set against texts of its length and script."""
    g = {name: signs[:, i] for i, name in enumerate(SIGNS)}
    size = np.floor(2 * np.log2(np.maximum(g["bytes"], 1)))
    wide = np.floor(2 * g["bytes"] / np.maximum(g["chars"], 1))
    usual = np.zeros(len(signs))
    for each in np.unique(np.stack([size, wide], 1), axis=0):
        rows = (size == each[0]) & (wide == each[1])
        usual[rows] = np.median(g["packed"][rows])
    apart = g["packed"] - usual
    shaped = g["shaped"] > 0.4
    spam = ~shaped & (g["bytes"] > 150) & (((apart < -0.2) & (g["bytes"] > 500) & (g["bytes"] < 6000)) | (g["addresses"] > 2.5) | (g["separators"] > 9) | (g["hashes"] > 2) | ((g["separators"] > 4) & (g["ends"] < 0.1) & (g["listed"] < 0.3) & (g["bytes"] > 400)))
    plain = (apart > 0.02) & (g["separators"] < 2) & (g["addresses"] < 0.05) & (g["ends"] > 1.2)
    short = (g["bytes"] < 120) & (g["separators"] < 3) & (g["addresses"] == 0) & (g["hashes"] == 0)
    return np.where(spam, 1, np.where(plain | short | shaped & (g["addresses"] < 1), 0, -1))


# --- trees ---------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Arrays by node; a leaf has feature -1 and a probability."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            rows = np.flatnonzero(inner)
            go = x[rows, f[rows]] <= self.cut[at[rows]]
            at[rows] = np.where(go, self.left[at[rows]], self.right[at[rows]])


def grow(x: np.ndarray, y: np.ndarray, p: SpamParams, rng: np.random.Generator) -> Tree:
    """A tree by Gini gain over quantile cuts, a random subset of features at each node."""
    nodes: list[list] = []
    tries = max(1, int(np.ceil(np.sqrt(x.shape[1]))) + 2)

    def split(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        mean = y[rows].mean() if len(rows) else 0.0
        nodes.append([-1, 0.0, 0, 0, mean])
        if depth == 0 or len(rows) < 2 * p.least_leaf or mean in (0.0, 1.0):
            return me
        best = (1e-9, None, None)
        for f in rng.choice(x.shape[1], min(tries, x.shape[1]), replace=False):
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, p.bins + 1)[1:-1])):
                low = v <= cut
                a, b = int(low.sum()), int((~low).sum())
                if min(a, b) < p.least_leaf:
                    continue
                ma, mb = y[rows[low]].mean(), y[rows[~low]].mean()
                gain = mean * (1 - mean) - (a * ma * (1 - ma) + b * mb * (1 - mb)) / len(rows)
                if gain > best[0]:
                    best = (gain, f, cut)
        if best[1] is not None:
            low = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = split(rows[low], depth - 1)
            nodes[me][3] = split(rows[~low], depth - 1)
        return me

    split(np.arange(len(x)), p.depth)
    return Tree(*(np.array([n[i] for n in nodes], t) for i, t in enumerate((np.int64, float, np.int64, np.int64, float))))


def bag(x: np.ndarray, y: np.ndarray, p: SpamParams) -> list[Tree]:
    """Trees on bootstrap samples; both classes weigh the same. Without both classes there are none."""
    rng = np.random.default_rng(p.seed)
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(ones) or not len(zeros):
        return []
    each = max(10, min(len(y) // 2, 4000))
    out = []
    for _ in range(p.trees):
        rows = np.concatenate([rng.choice(ones, each), rng.choice(zeros, each)])
        out.append(grow(x[rows], y[rows].astype(float), p, rng))
    return out


def scores(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """The share of votes for spam; without trees, where nothing could be learnt, 0."""
    return np.mean([t.predict(x) for t in trees], axis=0) if trees and len(x) else np.zeros(len(x))


def train(src: DataFrame, p: SpamParams) -> list[Tree]:
    """Trees grown on the labelled rows of a sample of ``src(id, text)``, the same however the rows are split over files."""
    share = min(1.0, p.train_rows / max(1, src.count()))
    sample = src.select(F.xxhash64("id", "text").alias("h"), "text").where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20) + 1))

    def measure(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        rows = np.hstack([measured(texts, p), np.array([signs_of(t) for t in texts]).reshape(-1, len(SIGNS))])
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(list(rows), pa.list_(pa.float64()))], names=["h", "x"])

    found = arrow_map(sample, measure, "h long, x array<double>").orderBy("h").limit(p.train_rows).toArrow().column("x")
    rows = np.array(found.to_pylist()).reshape(-1, len(FEATURES) + len(SIGNS))
    x, y = rows[:, : len(FEATURES)], weak_labels(rows[:, len(FEATURES) :])
    return bag(x[y >= 0], y[y >= 0], p)


def spam_scores(df: DataFrame, id_col: str, text_col: str, host_col: str, params: SpamParams | None = None) -> DataFrame:
    """(id, score, spam) of each row.

    Null, empty and blank texts score 0; a null host has the rate of all.
    Rows come out as often as they stand; an empty table gives none, and where
    the sample has no clear page of either kind nothing is called spam.
    """
    p = params or SpamParams()
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{host_col}`").cast("string").alias("host"))
    trees = train(src.select("id", "text"), p)

    def score(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        blank = np.array([not (t and t.strip()) for t in texts], bool)
        s = np.where(blank, 0.0, scores(measured(texts, p), trees))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), pa.array(s.astype(float))], names=["id", "host", "raw"])

    scored = cut_lineage(arrow_map(src, score, f"id {dict(src.dtypes)['id']}, host string, raw double"))
    overall = scored.agg(F.avg((F.col("raw") > p.threshold).cast("double"))).first()[0] or 0.0
    rate = scored.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("raw") > p.threshold).cast("long")).alias("bad"))
    own = (F.col("bad") + F.lit(overall * p.host_rows)) / (F.col("n") + F.lit(p.host_rows))
    logit = lambda c: F.log(F.greatest(F.lit(0.001), F.least(F.lit(0.999), c)) / (1 - F.greatest(F.lit(0.001), F.least(F.lit(0.999), c))))
    base = math.log(min(max(overall, 0.001), 0.999) / (1 - min(max(overall, 0.001), 0.999)))
    pull = F.greatest(F.lit(-p.host_pull), F.least(F.lit(p.host_pull), logit(own) - F.lit(base)))
    wide = scored.join(rate.select("host", pull.alias("pull")), "host", "left")
    moved = 1 / (1 + F.exp(-(logit(F.col("raw")) + F.coalesce("pull", F.lit(0.0)))))
    final = F.when(F.col("raw") == 0, F.lit(0.0)).otherwise(moved)
    return wide.select("id", final.alias("score"), (final > p.threshold).alias("spam"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that consist of repeated keywords, links or tags."""
    return spam_scores(read(spark, sf_dir, "documents"), "doc_id", "text", "source").where("spam").select(F.col("id").alias("doc_id"))


QUERIES = {"p10_found": p10_found}
