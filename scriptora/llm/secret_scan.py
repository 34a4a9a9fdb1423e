"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import builtins
import hashlib
import keyword
import math
import random
import re
import string
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptora.llm.common import compact

#: The base patterns with the least lengths of what they find, in the order of their kinds (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")
#: Words of which one must occur for ASSIGN to match.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What ends a part of a candidate, a maximal run of ALPHABET.
ENDS = "/=_-"
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
OUTSIDE = re.compile(r"[^A-Za-z0-9+/_=-]")
#: The alphabets in which keys are written; each has a model of its own.
KEYS = (
    string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_letters + string.digits, string.ascii_letters,
    string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase, string.ascii_uppercase, "0123456789abcdef", "0123456789ABCDEF",
)
SEED, SAMPLES, THRESHOLD = 11, 12_000, 0.5
#: The share of an ordinary string's chance that its kinds of characters alone give.
FOREIGN = 0.2
#: Nats by which a window must be likelier under a model of random strings; its length follows from that. Shorter runs than LEAST cannot have them.
EVIDENCE, LEAST = 14.0, 6
#: Characters of a text that are scored at once.
BLOCK = 1 << 20
#: Ordinary words of German, French, Spanish and Italian, beside the English ones of Python's documentation.
WORDS = (
    "und oder nicht werden wurde zwischen gegen durch Verantwortung Entwicklung Gesellschaft Wissenschaft Unternehmen Zusammenarbeit Geschwindigkeit Versicherung Entscheidung Veranstaltung Bundesregierung Krankenhaus Freundschaft Eigenschaften schrecklich wahrscheinlich verschiedene eigentlich"
    " selbstverständlich Arbeitsplatz Staatsanwaltschaft Möglichkeiten Straßenbahn Rechtschreibung Aufmerksamkeit Bürgermeister Wirtschaft Jahrhundert Schwierigkeiten les des une dans pour avec sans sous chez leurs toujours aujourd beaucoup plusieurs gouvernement développement"
    " environnement connaissance anniversaire administration établissement responsabilité universitaire traditionnel naturellement appartement quelquefois bibliothèque chercheurs travailleurs heureusement international rassemblement los las una para porque desde hasta entonces siempre"
    " también universidad conocimiento desarrollo gobierno ayuntamiento responsabilidad investigación trabajadores acontecimiento extraordinario desgraciadamente construcciones pensamiento movimiento naturaleza establecimiento aproximadamente gli della nella perché quando sempre ancora"
    " università conoscenza sviluppo governo responsabilità amministrazione straordinario probabilmente costruzione avvenimento cittadinanza naturalmente movimento appartamento meravigliosamente"
).split()


@dataclass(frozen=True)
class MarkovModel:
    """For each alphabet of KEYS log P(next character | character) of random strings of it minus that of ordinary ones; the first row is for the start."""

    ratio: np.ndarray

    def bound(self, threshold: float) -> np.ndarray:
        """What a character adds at most to a window's sum over threshold, plus threshold: no window has more than the sum of these."""
        return np.maximum(self.ratio.max(axis=0), 0.0)

    def ratios(self, text: str) -> np.ndarray:
        """The log-likelihood ratios of each character in nats, a row for each alphabet."""
        at = np.array([_PLACE[c] for c in text], "i8")
        return self.ratio[:, np.concatenate([[0], at[:-1] + 1]), at]

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio a character in nats under the likeliest alphabet; above 0 the text is more like a random string."""
        return float(self.ratios(text).sum(axis=1).max()) / len(text) if text else 0.0


_PLACE = {c: k for k, c in enumerate(ALPHABET)}
_CODES = np.array([_PLACE.get(chr(k), -1) for k in range(129)], "i8")


def train(rows: Iterable[tuple[str, int]], smoothing: float = 0.1) -> MarkovModel:
    """Fits the models to labelled strings: 1 + k random of alphabet k, 0 ordinary. Characters outside the alphabet are skipped."""
    counts = np.full((1 + len(KEYS), len(ALPHABET) + 1, len(ALPHABET)), smoothing)
    for text, label in rows:
        at = 0
        for c in text:
            if (k := _PLACE.get(c)) is not None:
                counts[int(label), at, k] += 1
                at = k + 1
    chances = counts / counts.sum(axis=2, keepdims=True)
    # A bigram of ordinary strings that the sample lacks may still be of another language's words: it costs no more than its kinds of characters do.
    kinds = np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 + ENDS.find(c) for c in ALPHABET])
    same = (kinds[:, None] == kinds[None]) / (kinds[:, None] == kinds[None]).sum(axis=0)
    rows_of = np.concatenate([[True], np.zeros(len(ALPHABET), bool)])
    by_kind = np.empty_like(chances[0])
    for group in [rows_of, *(np.concatenate([[False], kinds == k]) for k in sorted(set(kinds)))]:
        own = counts[0][group].sum(axis=0)
        by_kind[group] = own / own.sum() @ same
    chances[0] = (1 - FOREIGN) * chances[0] + FOREIGN * by_kind
    logs = np.log(chances)
    return MarkovModel(logs[1:] - logs[:1])


def labelled_sample(n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, int]]:
    """Labelled strings: n drawn from the alphabets in which keys are written, n ordinary ones: words of Python's documentation and of WORDS, and identifiers, paths, versions, numbers and dates put together from them and from the names of Python's library, and rulers of each character."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        k = draw.randrange(len(KEYS))
        out.append(("".join(draw.choices(KEYS[k], k=draw.randint(12, 64))), 1 + k))
    sources = [*dir(builtins), *keyword.kwlist, *dir(str), *dir(math), *dir(random.Random), *(getattr(x, "__doc__", None) or "" for x in (*vars(builtins).values(), *vars(str).values(), *vars(random.Random).values(), *vars(re).values(), *vars(string).values(), *vars(hashlib).values(), *vars(math).values()))]
    prose = [w for text in [*sys.stdlib_module_names, *sources] for w in re.findall(r"[A-Za-z][a-z]+", text)] + WORDS * 4
    words = sorted({w.lower() for w in prose if len(w) > 2 and w.isascii()})
    joins = [lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: "".join(x.title() for x in w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "".join(w), lambda w: "_".join(w).upper(), lambda w: "".join(w).upper()]
    while len(out) < 2 * n:
        kind = draw.random()
        if kind < 0.4:
            text = draw.choice(prose)
        elif kind < 0.5:
            text = draw.choice([lambda: str(draw.randrange(10 ** draw.randint(1, 16))), lambda: "-".join(str(draw.randrange(10 ** draw.randint(2, 4))) for _ in range(draw.randint(2, 4))), lambda: f"{draw.randint(1900, 2100)}-{draw.randint(1, 12):02}-{draw.randint(1, 31):02}T{draw.randint(0, 23):02}"])()
        else:
            text = draw.choice(joins)([draw.choice(words) for _ in range(draw.randint(2, 6))])
            if draw.random() < 0.5:
                text += draw.choice(["_v", "-", "_", "/", ""]) + str(draw.randint(0, draw.choice([9, 99, 2100])))
            if draw.random() < 0.15:
                run = draw.choice(ALPHABET) * draw.randint(8, 40)
                text = run + text if draw.random() < 0.5 else text + run
        out.append((text, 0))
    return out + [(c * draw.randint(8, 40), 0) for c in ALPHABET for _ in range(8)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base patterns find."""
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if any(h in low for h in HINTS) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def _best(gains: np.ndarray) -> tuple[float, int, int]:
    """The window with the greatest sum of any row of gains."""
    upto = np.concatenate([np.zeros((len(gains), 1)), np.cumsum(gains, axis=1)], axis=1)
    rise = upto - np.minimum.accumulate(upto, axis=1)
    k, end = np.unravel_index(int(np.argmax(rise)), rise.shape)
    start = int(np.argmin(upto[k, : end + 1]))
    return float(rise[k, end]), start, int(end)


def _windows(found: str, ratios: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Random windows of a candidate, each widened to whole parts: the one with the greatest sum of ratios over threshold, then those beside it."""
    out, todo = [], [(0, len(found))]
    while todo:
        low, high = todo.pop()
        best, a, b = _best(ratios[:, low:high] - threshold)
        if best <= 0:
            continue
        a, b, left = a + low, b + low, a + low
        while a < b and found[a] in ENDS:
            a += 1
        if b > a and ratios[:, a:b].sum(axis=1).max() >= EVIDENCE:
            while a > low and found[a - 1] not in ENDS:
                a -= 1
            while b < high and found[b] not in ENDS:
                b += 1
            out.append((a, b))
        todo += [(x, y) for x, y in ((low, min(a, left)), (b, high)) if y - x >= LEAST]
    return out


def _candidates(text: str, model: MarkovModel, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ratios) of each maximal run of ALPHABET whose gains over threshold could come to EVIDENCE; a text is scored in blocks that end outside such runs."""
    begin = 0
    while begin < len(text):
        stop = OUTSIDE.search(text, min(len(text), begin + BLOCK))
        stop = stop.start() if stop else len(text)
        at = _CODES[np.minimum(np.frombuffer(text[begin:stop].encode("utf-32-le"), "<u4"), 128)]
        inside = np.concatenate([[False], at >= 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
        if len(starts):
            before = np.where(inside[:-2], np.concatenate([[0], at[:-1]]) + 1, 0)
            most = np.concatenate([[0.0], np.cumsum(np.where(at >= 0, model.bound(threshold)[before, at], 0.0))])
            likely = most[ends] - most[starts] >= EVIDENCE
            for a, b in zip(starts[likely].tolist(), ends[likely].tolist(), strict=True):
                yield begin + a, model.ratio[:, before[a:b], at[a:b]]
        begin = stop + 1


def model_spans(text: str, base: list[tuple[int, int, int]], model: MarkovModel, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Further spans, what the base ones leave of strings that the models call random: candidates, whole by their mean or else windows of them."""
    out = []
    for at, ratios in _candidates(text, model, threshold):
        n = ratios.shape[1]
        total = float(ratios.sum(axis=1).max())
        whole = total > threshold * n and total >= EVIDENCE
        for a, b in [(0, n)] if whole else _windows(text[at : at + n], ratios, threshold):
            a, b = at + a, at + b
            for x, _, y in base:
                if x < b and a < y:
                    if a < x:
                        out.append((a, 3, x))
                    a = max(a, y)
            if a < b:
                out.append((a, 3, b))
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(df: DataFrame, model: MarkovModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of df (doc_id, text), from the whole text.

    Offsets are code points, ends exclusive. Null and empty texts have no
    spans. Rows stay as they are, repeated ones too; nothing is shuffled.
    """
    model = model or train(labelled_sample())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                kinds = [k for _, k, _ in base]
                every = base + model_spans(text or "", base, model, threshold)
                out.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(_join(base).encode()).hexdigest(), _join(every)))
            columns = [pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return compact(df.select(F.col("doc_id").cast("long"), "text")).mapInArrow(task, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, model: MarkovModel | None = None, threshold: float = THRESHOLD, mark: str = "[secret]") -> DataFrame:
    """df with every found span of its text replaced by mark; overlapping spans become one. A column n_chars follows where the text has changed."""
    model, names = model or train(labelled_sample()), df.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, changed = b.column("text").to_pylist(), {}
            for row, text in enumerate(texts):
                base = base_spans(text or "")
                if spans := sorted(base + model_spans(text or "", base, model, threshold)):
                    parts, at = [], 0
                    for start, _, end in spans:
                        if start >= at:
                            parts += [text[at:start], mark]
                        at = max(at, end)
                    texts[row] = "".join(parts) + text[at:]
                    changed[row] = len(texts[row])
            columns = []
            for c in names:
                column = b.column(c)
                if c == "text" and changed:
                    column = pa.array(texts, column.type)
                elif c == "n_chars" and changed:
                    column = pa.array([changed.get(k, n) for k, n in enumerate(column.to_pylist())], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names)

    return compact(df).mapInArrow(task, df.schema)
