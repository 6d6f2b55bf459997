"""Languages of documents and of their parts: a linear-chain conditional random field over words.

Every blank-separated token of a line gets one of the languages or ``NONE`` (code, paths, logs, names). Emission scores
are sums of feature weights (word, affixes, character n-grams, lexicon membership, shape); transition weights are
learned with them; confidences are marginals from forward-backward. Scores depend on the form of a token only, so each
worker keeps them for forms it has met and the sweep over all lines is plain array work.

The model is fitted on the driver from a bounded sample of labelled documents (``Fit``). Labels are taken to be mostly
right, not always: lines that read as sentences are relabelled by what their words say, starting from the document
labels, before the field is trained. Lines that read as code are examples of ``NONE``.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Languages and how labels name them (fixed values): codes of ISO 639, English and own names.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "it": ("it", "ita", "italian", "italiano"),
    "ru": ("ru", "rus", "russian", "русский"),
}
LANGUAGES = tuple(NAMES)
NONE = len(LANGUAGES)
LABELS = NONE + 1
#: Words of one language, expected under the marginals, that make a line a sentence; and their least share of its words.
SENTENCE_WORDS, SENTENCE_SHARE = 2.5, 0.5


@dataclass(frozen=True)
class Fit:
    """Bounds of the fit: labelled documents a language, characters of a document (longer ones are passed over), lines a
    label that train the field, feature buckets, one in how many training lines has another one behind it, one in how many
    has words of another language put in (0: none; for ``tag_words``, as it makes switches cheap, which costs a little
    where only whole lines are told apart), and the training: passes, lines a step, step size, weight decay."""

    documents: int = 300
    characters: int = 20_000
    lines: int = 1000
    buckets: int = 1 << 16
    joined: int = 8
    spliced: int = 0
    epochs: int = 8
    batch: int = 300
    rate: float = 0.15
    decay: float = 1e-5


def label_language(label: Column) -> Column:
    """The language a label names, in any of its spellings and with or without a region; null if it names none."""
    plain = F.regexp_extract(F.lower(F.trim(label)), r"^[^-_]*", 0)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(plain.isin(*names), code).otherwise(out)
    return out


EDGE = re.compile(r"^([^\w`]*)(.*?)([^\w`]*)$", re.S)
INNER = re.compile(r"[^\w'’\-]|[\d_]")
CASES = re.compile(r"[^\W\d_][\w]*?[a-zа-яё][A-ZА-ЯЁ]")
SHAPES = ((re.compile(r"[A-ZÀ-ÞА-ЯЁ]+"), "A"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1"))


def form(token: str) -> tuple[str, bool]:
    """(form, is it a word): words in lower case with marks of what stands around them, anything else by its shape."""
    left, core, right = EDGE.match(token).groups()
    if core and "`" not in core and len(core) < 40 and not CASES.match(core):
        letters = sum(c.isalpha() for c in core)
        odd = len(INNER.findall(core)) + core.count("-")
        if letters >= 0.7 * len(core) and (not odd or (odd == core.count("-") and not set(left + right) & set("\"'=(){}[]<>"))):
            marks = ("q" if set(left) - set("¿¡-*>#/ ") else "") + "|" + ("s" if right and not set(right) - set(".,?!:…") else "q" if right else "")
            return f"{marks}|{core.lower()}", True
    shape = token[:60]
    for pattern, by in SHAPES[:3]:
        shape = pattern.sub(by, shape)
    shape = re.sub(r"(a[./_-])(?:a[./_-])+", r"\1", shape)
    return "§" + SHAPES[3][0].sub(SHAPES[3][1], shape)[:16], False


def features(kind: str, word: bool, lexicon: dict[str, int], buckets: int) -> list[int]:
    """Hashed features of a form."""
    if not word:
        names = ["s=" + kind, "t=" + kind[:3], "nonword"]
    else:
        left, right, w = kind.split("|", 2)
        names = ["w=" + w, "l=" + left, "r=" + right, "b"]
        names += [f"p{n}=" + w[:n] for n in (1, 2, 3) if len(w) > n] + [f"x{n}=" + w[-n:] for n in (1, 2, 3) if len(w) > n]
        framed = f"^{w}$"
        names += ["g=" + framed[i : i + 3] for i in range(len(framed) - 2)]
        if w in lexicon:
            names.append(f"lex={lexicon[w]}")
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % buckets for n in names]


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]
    buckets: int = field(default=1 << 16)


class Layout:
    """Lines of tokens back to back, arranged for sweeps over positions: longer lines first."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.at = (np.cumsum(sizes) - sizes)[self.order]
        longest = int(self.sizes[0]) if len(sizes) else 0
        self.live = np.searchsorted(-self.sizes, -np.arange(longest), side="left")  # lines longer than t

    def sweep(self, x: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alpha, beta): forward and backward messages of every token, each scaled to sum 1. x: emission factors."""
        alpha, beta = np.empty_like(x), np.empty_like(x)
        last = None
        for t, n in enumerate(self.live):
            at = self.at[:n] + t
            now = x[at] * (start if t == 0 else last[:n] @ move)
            now /= now.sum(axis=1, keepdims=True)
            alpha[at] = last = now
        nxt = np.empty((0, x.shape[1]), x.dtype)
        back = np.ascontiguousarray(move.T)
        for t in range(len(self.live) - 1, -1, -1):
            n = self.live[t]
            now = np.full((n, x.shape[1]), 1 / x.shape[1], x.dtype)
            if len(nxt):
                m = (x[self.at[: len(nxt)] + t + 1] * nxt) @ back
                now[: len(nxt)] = m / m.sum(axis=1, keepdims=True)
            beta[self.at[:n] + t] = nxt = now
        return alpha, beta


def factors(scores: np.ndarray) -> np.ndarray:
    """exp of scores, scaled so that none under- or overflows."""
    return np.exp(np.maximum(scores - scores.max(axis=-1, keepdims=True), -30)).astype(np.float32)


MARKER = re.compile(r"^\s*(?:(?://+|#+|/\*+|\*+|>+|-+|\d+[.)]|\"\"\"|[A-Za-zÀ-ÿ]+-?\d*:)\s+)*")
CODE = re.compile(r"[{}=;()\[\]<>_\\]|\w/\w|\w\.\w|\"[\w-]|^```|:\d+:\d+")


def looks(line: str) -> int:
    """1: reads as a sentence, -1: as code or the like, 0: unsure. Only chooses training lines."""
    body = re.sub(r"`[^`]*`", " ", MARKER.sub("", line)).strip()
    if CODE.search(body):
        return -1
    words = re.findall(r"[^\W\d_]{2,}", body)
    if len(words) >= 4 and re.search(r"[.?!…]$", body):
        return 1
    return -1 if len(body.split()) <= 2 and not re.search(r"[.?!…,]$", body) else 0


def train(rows: list[tuple[str, str]], fit: Fit) -> Model:
    """Fit the field on (text, language label) rows. Without rows everything is ``NONE``."""
    rng, inner = np.random.default_rng(5), np.random.default_rng(6)
    sentences, code = [], []
    for text, label in rows:
        for line in text.split("\n"):
            kind = looks(line)
            tokens = line.split()
            if kind == 1:
                sentences.append((tokens, LANGUAGES.index(label)))
            elif kind == -1 and tokens:
                code.append(tokens)
    forms: dict[str, tuple[str, bool]] = {}
    see = lambda t: forms.get(t) or forms.setdefault(t, form(t))
    words = [[w.split("|", 2)[2] for w, ok in map(see, tokens) if ok] for tokens, _ in sentences]
    label = [l for _, l in sentences]
    for _ in range(4):  # naive Bayes over words, from the document labels to the lines' own
        count: dict[str, np.ndarray] = defaultdict(lambda: np.full(NONE, 0.1))
        for ws, l in zip(words, label, strict=True):
            for w in ws:
                count[w][l] += 1
        sums = sum(count.values()) if count else np.ones(NONE)
        share = {w: np.log(c / sums) for w, c in count.items()}
        label = [int(sum(share[w] for w in ws).argmax()) if ws else l for ws, l in zip(words, label, strict=True)]
    lexicon = {w: int(c.argmax()) for w, c in count.items() if c.sum() >= 5 and c.max() >= 0.9 * c.sum()} if sentences else {}
    chosen: list[tuple[list[str], int]] = []
    for l in range(NONE):
        own = [i for i, x in enumerate(label) if x == l]
        chosen += [(sentences[i][0], l) for i in rng.permutation(own)[: fit.lines]]
    chosen += [(code[i], NONE) for i in rng.permutation(len(code))[: 2 * fit.lines]]
    if not chosen:
        return Model(np.zeros((fit.buckets, LABELS), np.float32), np.zeros((LABELS, LABELS)), np.eye(LABELS)[NONE] * 20, {}, fit.buckets)

    types: dict[str, int] = {}
    kinds: list[tuple[str, bool]] = []
    ids, target, sizes = [], [], []
    for i, line in enumerate(chosen):
        # Some lines switch, so that transitions between languages, and to and from NONE, are learned.
        parts = [line]
        if i % fit.joined == 0:
            parts = [line, chosen[rng.integers(len(chosen))]]
        elif fit.spliced and i % fit.spliced == fit.spliced // 2:
            parts = _spliced(line, chosen[inner.integers(len(chosen))], inner)
        for tokens, l in parts:
            for t in tokens:
                k, ok = see(t)
                if k not in types:
                    types[k] = len(kinds)
                    kinds.append((k, ok))
                ids.append(types[k])
                target.append(l)
        sizes.append(sum(len(tokens) for tokens, _ in parts))
    ids, target, sizes = np.array(ids), np.array(target), np.array(sizes)
    lists = [features(k, ok, lexicon, fit.buckets) for k, ok in kinds]
    used, flat = np.unique(np.concatenate(lists), return_inverse=True)
    count = np.array([len(x) for x in lists])
    begin = np.cumsum(count) - count
    at = np.cumsum(sizes) - sizes
    p = [np.zeros((len(used), LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)]
    m, v, mean = ([np.zeros_like(x) for x in p] for _ in range(3))
    batches = [c for _ in range(fit.epochs) for c in np.array_split(rng.permutation(len(sizes)), max(1, len(sizes) // fit.batch))]
    for step, lines in enumerate(batches, 1):
        token = np.repeat(at[lines] - (np.cumsum(sizes[lines]) - sizes[lines]), sizes[lines]) + np.arange(sizes[lines].sum())
        grads = _gradient(p, ids[token], target[token], sizes[lines], flat, begin, count, len(used))
        for i, g in enumerate(grads):
            g = g / len(token) - fit.decay * p[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] + fit.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)
            if step > len(batches) // 2:  # the mean of the second half is steadier than any one step
                mean[i] += p[i] / (len(batches) - len(batches) // 2)
    weights = np.zeros((fit.buckets, LABELS), np.float32)
    weights[used] = mean[0]
    return Model(weights, mean[1], mean[2], lexicon, fit.buckets)


def _spliced(line: tuple[list[str], int], other: tuple[list[str], int], rng: np.random.Generator) -> list[tuple[list[str], int]]:
    """A sentence with some words of another language put between two of its own; the line as it is where either is code:
    code has no sentences inside, and what code stands in sentences is learned from these themselves."""
    tokens, l = line
    if len(tokens) < 4 or NONE in (l, other[1]):
        return [line]
    at = int(rng.integers(2, len(tokens) - 1))
    first = int(rng.integers(0, max(1, len(other[0]) - 2)))
    return [(tokens[:at], l), (other[0][first : first + int(rng.integers(2, 8))], other[1]), (tokens[at:], l)]


def _gradient(p: list, ids: np.ndarray, target: np.ndarray, sizes: np.ndarray, flat: np.ndarray, begin: np.ndarray, count: np.ndarray, n: int) -> list:
    """Gradient of the log likelihood of some lines by weights, transitions and starts."""
    kinds, ids = np.unique(ids, return_inverse=True)
    owner = np.repeat(np.arange(len(kinds)), count[kinds])
    f = flat[np.repeat(begin[kinds] - (np.cumsum(count[kinds]) - count[kinds]), count[kinds]) + np.arange(len(owner))]
    x = factors(np.add.reduceat(p[0][f], np.cumsum(count[kinds]) - count[kinds]))[ids].astype(np.float64)
    move, start = factors(p[1].reshape(1, -1)).reshape(LABELS, LABELS).astype(np.float64), factors(p[2]).astype(np.float64)
    alpha, beta = Layout(sizes).sweep(x, move, start)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    first = np.cumsum(sizes) - sizes
    inner = np.ones(len(ids), bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    both = alpha[later - 1][:, :, None] * move[None] * (x[later] * beta[later])[:, None, :]
    both /= both.sum(axis=(1, 2), keepdims=True)
    gold_move = np.bincount(target[later - 1] * LABELS + target[later], minlength=LABELS * LABELS).reshape(LABELS, LABELS)
    d = np.eye(LABELS)[target] - marginal
    by_kind = np.stack([np.bincount(ids, d[:, l], len(kinds)) for l in range(LABELS)], axis=1)
    by_weight = np.stack([np.bincount(f, by_kind[owner, l], n) for l in range(LABELS)], axis=1)
    return [by_weight, gold_move - both.sum(axis=0), d[first].sum(axis=0)]


def fit_model(documents: DataFrame, key: str, text: str, label: str, fit: Fit | None = None) -> Model:
    """Train on at most ``documents`` rows a language, chosen by a hash of the key among those with a known label."""
    fit = fit or Fit()
    rows = documents.select(F.col(key).alias("k"), label_language(F.col(label)).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    # Counted by label alone, so that no text is read; rows without text make the sample a little smaller, which 1.3 allows for.
    have = {r["l"]: r["count"] for r in documents.select(label_language(F.col(label)).alias("l")).where("l is not null").groupBy("l").count().collect()}
    million = 1_000_000
    chance = F.lit(0)
    for l, n in have.items():
        chance = F.when(F.col("l") == l, int(million * min(1.0, 1.3 * fit.documents / n))).otherwise(chance)
    h = F.pmod(F.xxhash64(F.lit("fit"), "k"), F.lit(million))
    some = rows.where((h < chance) & (F.length("t") <= fit.characters)).select("l", "t", h.alias("h")).limit(4 * fit.documents * len(LANGUAGES))
    got: dict[str, list] = defaultdict(list)
    for r in some.collect():
        got[r["l"]].append((r["h"], r["t"]))
    return train([(t, l) for l in sorted(got) for _, t in sorted(got[l])[: fit.documents]], fit)


class Tagger:
    """Applies a model to texts; keeps what it has worked out about tokens, up to a bound."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.token: dict[str, int] = {}
        self.kind: dict[str, int] = {}
        self.x = np.empty((0, LABELS), np.float32)
        self.word = np.empty(0, np.float32)
        self.move = factors(model.move.reshape(1, -1)).reshape(LABELS, LABELS)
        self.start = factors(model.start)

    def _learn(self, tokens: set[str]) -> None:
        if len(self.token) > self.most:
            self.token.clear()
        rows, words = [], []
        for t in tokens:
            k, ok = form(t)
            i = self.kind.get(k)
            if i is None:
                i = self.kind[k] = len(self.kind)
                rows.append(self.model.weights[features(k, ok, self.model.lexicon, self.model.buckets)].sum(axis=0))
                words.append(ok)
            self.token[t] = i
        if rows:
            self.x = np.concatenate([self.x, factors(np.array(rows))])
            self.word = np.concatenate([self.word, np.array(words, np.float32)])

    def lines(self, lines: list[str], runs: bool = False) -> tuple[np.ndarray, ...]:
        """(language or NONE, confidence, expected words of the language) of each line.

        With runs, also (line, first word, last word, language, mean marginal) of every run of words whose most probable
        label is one language, other labels than languages between them passed over.
        """
        flat, sizes = [], []
        for line in lines:
            tokens = line.split()
            sizes.append(len(tokens))
            flat += tokens
        lang = np.full(len(lines), NONE)
        sure, count = np.ones(len(lines)), np.zeros(len(lines))
        if not flat:
            return (lang, sure, count, *[np.empty(0, np.int64)] * 5) if runs else (lang, sure, count)
        if len(self.kind) > 4 * self.most:
            self.kind, self.x, self.word = {}, self.x[:0], self.word[:0]
            self.token.clear()
        if len(self.token) > self.most:
            self.token.clear()
        new = set(flat).difference(self.token)
        if new:
            self._learn(new)
        ids = np.fromiter(map(self.token.__getitem__, flat), np.int64, len(flat))
        sizes = np.array(sizes)
        full = np.flatnonzero(sizes)
        alpha, beta = Layout(sizes[full]).sweep(self.x[ids], self.move, self.start)
        marginal = alpha * beta
        marginal /= marginal.sum(axis=1, keepdims=True)
        w = self.word[ids]
        at = (np.cumsum(sizes) - sizes)[full]
        expected = np.add.reduceat(marginal * w[:, None], at)
        words = np.add.reduceat(w, at)
        best = expected[:, :NONE].argmax(axis=1)
        most = expected[np.arange(len(full)), best]
        says = (most >= SENTENCE_WORDS) & (most >= SENTENCE_SHARE * words)
        lang[full] = np.where(says, best, NONE)
        share = most / np.maximum(words, 1)
        sure[full] = np.where(says, share, 1 - np.where(words > 0, share, 0))
        count[full] = np.where(says, most, 0)
        if not runs:
            return lang, sure, count
        label = marginal.argmax(axis=1)
        hit = np.flatnonzero(label != NONE)
        line, label = np.repeat(np.arange(len(lines)), sizes)[hit], label[hit]
        word = hit - (np.cumsum(sizes) - sizes)[line] + 1
        new = np.ones(len(hit), bool)
        new[1:] = (line[1:] != line[:-1]) | (label[1:] != label[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit)) - 1
        mean = np.add.reduceat(marginal[hit, label].astype(np.float64), first) / (last - first + 1) if len(hit) else np.empty(0)
        return lang, sure, count, line[first], word[first], word[last[: len(first)]], label[first], mean


RESULT = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("lines", T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
    ]
)


def tag_words(documents: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``(key, line_no, first_word, last_word, lang, confidence)``: the runs of words in one language of every line.

    Words are separated by blanks and counted from 1 in their line, lines from 1. A run is made of the words whose most
    probable label under the field is its language; code, paths and names between them are passed over. confidence: the
    mean marginal of its words. A line that switches language has a run for each part. Null, blank and code-only texts
    have none; whole texts are read; repeated and null keys are passed through; ties between labels go to the language
    that comes first in ``LANGUAGES``.
    """
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # buckets x labels numbers, whatever the data
    kinds = {"line_no": pa.int32(), "first_word": pa.int32(), "last_word": pa.int32(), "lang": pa.string(), "confidence": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for whole in batches:
            texts = whole.column("_text").to_pylist()
            for start, stop in _stretches(texts):
                lines, owner, number = [], [], []
                for i, t in enumerate(texts[start:stop], start):
                    own = t.split("\n") if t else []
                    lines += own
                    owner += [i] * len(own)
                    number += range(1, len(own) + 1)
                _, _, _, line, first, last, label, mean = tagger.lines(lines, True)
                take = pa.array(np.array(owner, np.int64)[line])
                cols = [np.array(number, np.int64)[line], first, last, np.array(LANGUAGES, object)[label], mean]
                yield pa.RecordBatch.from_arrays([whole.column("_key").take(take), *[pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)]], names=["_key", *kinds])

    schema = T.StructType([rows.schema["_key"]]).add("line_no", T.IntegerType()).add("first_word", T.IntegerType()).add("last_word", T.IntegerType()).add("lang", T.StringType()).add("confidence", T.DoubleType())
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)


def _stretches(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of some megabytes together."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (size < most or stop == start):
            size += len(texts[stop] or "")
            stop += 1
        yield start, stop
        start = stop


def _results(texts: list[str | None], tagger: Tagger) -> list[dict]:
    lines, owner = [], []
    for i, t in enumerate(texts):
        if t:
            own = t.split("\n")
            lines += own
            owner.append((i, len(own)))
    lang, sure, count = tagger.lines(lines)
    out: list[dict] = [{"lang": None, "confidence": 0.0, "lines": [], "segments": []} for _ in texts]
    at = 0
    for i, n in owner:
        hits = np.flatnonzero(lang[at : at + n] != NONE)
        if len(hits):
            ls, ss, cs = lang[at : at + n][hits], sure[at : at + n][hits], count[at : at + n][hits]
            total = np.bincount(ls, cs, NONE)
            r = out[i]
            r["lang"], r["confidence"] = LANGUAGES[total.argmax()], float(total.max() / np.maximum(total.sum(), 1e-9) * np.average(ss[ls == total.argmax()], weights=cs[ls == total.argmax()]))
            r["lines"] = [{"line_no": int(h) + 1, "lang": LANGUAGES[l], "confidence": float(s)} for h, l, s in zip(hits, ls, ss, strict=True)]
            cut = np.flatnonzero(np.append(True, ls[1:] != ls[:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(ls)), strict=True):
                r["segments"].append({"first_line": int(hits[a]) + 1, "last_line": int(hits[b - 1]) + 1, "lang": LANGUAGES[ls[a]], "confidence": float(np.average(ss[a:b], weights=cs[a:b]))})
        at += n
    return out


def tag_documents(documents: DataFrame, key: str, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``(key, keep..., lang, confidence, lines, segments)``, one row a document.

    lang: the language most of the text is in, null if no line holds a sentence (null, empty or code-only texts, and texts
    whose lines all have fewer than ``SENTENCE_WORDS`` expected words of one language);
    confidence: its share of the words in sentences times the mean marginal of its lines. lines: the lines (from 1,
    blank ones counted) that hold a sentence, with language and mean marginal. segments: runs of such lines in one
    language. Whole texts are read, however long; repeated and null keys are passed through; ties between languages go
    to the one that comes first in ``LANGUAGES``. ``keep`` must not name a column of the result.
    """
    keep = keep or []
    rows = documents.select(key, *keep, F.col(text).alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # buckets x labels numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for whole in batches:
            texts = whole.column("_text").to_pylist()
            for start, stop in _stretches(texts):
                b = whole.slice(start, stop - start)
                found = _results(texts[start:stop], tagger)
                cols = [pa.array([r[f.name] for r in found], to_arrow(f.dataType)) for f in RESULT]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in (key, *keep)] + cols, names=[key, *keep, *RESULT.names])

    return rows.mapInArrow(run, T.StructType(rows.drop("_text").schema.fields + RESULT.fields))


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind])
    return {"string": pa.string(), "double": pa.float64(), "integer": pa.int32()}[kind.typeName()]


__all__ = ["NAMES", "Layout", "form", "Fit", "LANGUAGES", "Model", "Tagger", "fit_model", "label_language", "tag_documents", "tag_words", "train"]
