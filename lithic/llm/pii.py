"""Personal data: fixed patterns plus a linear-chain conditional random field over word shapes.

The base patterns are found by scans that stay linear on any text. The field reads windows of words around every word
that holds a digit or an at-sign (no other word can begin or carry personal data here), sees only shapes and checks
(digit counts, Luhn sum, octet range), is trained by full-batch gradient steps on a small labelled table, and is decoded by
Viterbi for many windows at once. It adds spans that no base span touches, such as telephone numbers without a plus.

Defined results: null and empty texts have no spans; one text may be of any length; repeated rows are handled one by
one; extra columns pass through `redacted` and are ignored elsewhere; empty tables give empty results.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import bounded_batches, strings, text_slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words on each side of a window's key words; cells of the feature table; gradient steps; words decoded at once.
MARGIN, CELLS, STEPS, BATCH = 2, 4096, 120, 1 << 15
#: Rows a labelled table may have.
LABELLED_ROWS = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+")
_GROUPED = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGNAL = re.compile(r"[0-9@]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octets(parts: Iterable[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """All spans of the fixed patterns, in order of start, then kind."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        runs = [(r.start(), r.end()) for r in _DIGITS.finditer(text, m.start(), m.end())]
        for k in range(0, len(runs) - 3, 4):
            if _octets(text[a:b] for a, b in runs[k : k + 4]):
                found.append((runs[k][0], 1, runs[k + 3][1]))
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- the field ---


@lru_cache(maxsize=1 << 16)
def shape(word: str) -> tuple[str, str]:
    """Run-collapsed shape of a word, and the checks its digits pass."""
    kinds = "".join("d" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isalpha() else c for c in word[:64]) + ("~" if len(word) > 64 else "")
    digits = _NOT_DIGIT.sub("", word[:64])
    parts = word[:64].strip(".,;:!?#$%&*()\"'").split(".")
    checks = f"{len(digits)}{'L' if 13 < len(digits) < 20 and luhn(digits) else ''}"
    checks += "Q" if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and _octets(parts) else ""
    checks += "@" if "@" in word[1:] and "." in word.partition("@")[2] else ""
    return re.sub(r"(.)\1+", r"\1\1", kinds), checks


def features(words: list[str]) -> np.ndarray:
    """(words, 6) cells of the weight table."""
    pad = [("^", "^"), *map(shape, words), ("$", "$")]
    cell = lambda slot, value: zlib.crc32(f"{slot} {value}".encode("utf-8", "surrogatepass")) % CELLS
    return np.array([[cell(0, b[0]), cell(1, b[1]), cell(2, (a[0], b[0])), cell(3, a[1]), cell(4, c[0]), cell(5, c[1])] for a, b, c in zip(pad, pad[1:], pad[2:], strict=False)], np.int32).reshape(-1, 6)


class Field:
    """Weights of a linear-chain conditional random field over LABELS."""

    def __init__(self) -> None:
        k = len(LABELS)
        self.emit, self.move, self.start = np.zeros((CELLS, k)), np.zeros((k, k)), np.zeros(k)
        for j, label in enumerate(LABELS):  # an inside label follows its own kind only
            if label[0] == "I":
                self.start[j] = -1e4
                self.move[[i for i in range(k) if LABELS[i][2:] != label[2:]], j] = -1e4

    def train(self, cells: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-3) -> None:
        """Maximise the log-likelihood of labelled windows by Adam steps over all of them."""
        n, t, k = len(cells), max(map(len, cells)), len(LABELS)
        x, y, live = np.zeros((n, t, 6), np.int32), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
        for i, (c, lab) in enumerate(zip(cells, labels, strict=True)):
            x[i, : len(c)], y[i, : len(c)], live[i, : len(c)] = c, lab, True
        truth = np.eye(k)[y] * live[..., None]
        both = live[:, 1:] & live[:, :-1]
        pairs = np.zeros((k, k))
        np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
        weights = [self.emit, self.move, self.start]
        memory = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
        for step in range(1, steps + 1):
            e = self.emit[x].sum(2)
            alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
            alpha[:, 0] = self.start + e[:, 0]
            for i in range(1, t):
                a = alpha[:, i - 1, :, None] + self.move
                top = a.max(1)
                alpha[:, i] = np.where(live[:, i, None], top + np.log(np.exp(a - top[:, None]).sum(1)) + e[:, i], alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                b = (beta[:, i + 1] + e[:, i + 1])[:, None, :] + self.move
                top = b.max(2)
                beta[:, i] = np.where(live[:, i + 1, None], top + np.log(np.exp(b - top[..., None]).sum(2)), 0)
            total = np.logaddexp.reduce(alpha[:, -1], axis=1)
            gap = truth - np.exp(alpha + beta - total[:, None, None]) * live[..., None]
            joint = np.exp(np.minimum(alpha[:, :-1, :, None] + self.move + (e + beta)[:, 1:, None, :] - total[:, None, None, None], 0)) * both[..., None, None]
            up = np.zeros_like(self.emit)
            np.add.at(up, x[live], gap[live][:, None, :])
            for w, m, g in zip(weights, memory, (up / n, (pairs - joint.sum((0, 1))) / n, gap[:, 0].sum(0) / n), strict=True):
                g = np.where(w < -1e3, 0, g - decay * w)
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                w += np.where(w < -1e3, 0, rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))

    def decode(self, cells: list[np.ndarray]) -> list[np.ndarray]:
        """Best label path of each window, many windows at a time."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(cells)
        order, at = sorted(range(len(cells)), key=lambda i: len(cells[i])), 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and (upto + 1 - at) * len(cells[order[upto]]) <= BATCH:
                upto += 1
            part, at = order[at:upto], upto
            t = len(cells[part[-1]])
            x, size = np.zeros((len(part), t, 6), np.int32), np.array([len(cells[i]) for i in part])
            for row, i in enumerate(part):
                x[row, : size[row]] = cells[i]
            e = self.emit[x].sum(2)
            best, back = self.start + e[:, 0], np.zeros((t, len(part), len(LABELS)), np.int8)
            for i in range(1, t):
                s = best[:, :, None] + self.move
                live = (i < size)[:, None]
                back[i] = np.where(live, s.argmax(1), np.arange(len(LABELS)))
                best = np.where(live, s.max(1) + e[:, i], best)
            path = np.zeros((t, len(part)), np.int64)
            path[-1] = best.argmax(1)
            for i in range(t - 1, 0, -1):
                path[i - 1] = back[i][np.arange(len(part)), path[i]]
            for row, i in enumerate(part):
                out[i] = path[: size[row], row]
        return out


Words = list[tuple[int, int]]


def windows(text: str) -> list[Words]:
    """Runs of words around words with a digit or an at-sign, as (start, end) places."""
    runs: list[Words] = []
    after = 0  # end of the last word taken
    for m in _SIGNAL.finditer(text):
        if m.start() < after:
            continue
        start, end = _left(text, m.start(), after), _WORD.match(text, m.start()).end()
        before: Words = []
        at = start
        while len(before) < MARGIN and (w := _word_before(text, at, after)):
            before.insert(0, w)
            at = w[0]
        first = before[0][0] if before else start
        joined = bool(runs) and not text[after:first].strip(" \t\n\v\f\r")
        if joined:
            runs[-1] += [*before, (start, end)]
        else:
            runs.append([*before, (start, end)])
        after = end
        for _ in range(MARGIN):
            w = _WORD.search(text, after)
            if not w or _SIGNAL.search(w[0]):
                break
            runs[-1].append(w.span())
            after = w.end()
    return runs


def _left(text: str, at: int, stop: int) -> int:
    while at > stop and not _is_space(text[at - 1]):
        at -= 1
    return at


def _is_space(c: str) -> bool:
    return c == " " or "\t" <= c <= "\r"


def _word_before(text: str, at: int, stop: int) -> tuple[int, int] | None:
    while at > stop and _is_space(text[at - 1]):
        at -= 1
    return (_left(text, at, stop), at) if at > stop else None


def _added(text: str, words: Words, path: np.ndarray, base: list[Span]) -> Iterator[Span]:
    """Spans of a label path that touch no base span, without marks around them."""
    i = 0
    while i < len(words):
        label = LABELS[path[i]]
        j = i + 1
        if label != "O":
            while j < len(words) and LABELS[path[j]] == f"I-{label[2:]}":
                j += 1
            start, end = words[i][0], words[j - 1][1]
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while end > start and not text[end - 1].isalnum():
                end -= 1
            if start < end and not any(a < end and start < b for a, _, b in base):
                yield start, KINDS.index(label[2:]), end
        i = j


# --- the labelled table ---

#: Sentences with one marked place each, or none. <w> is a word, the others are drawn anew for each row.
TEMPLATES = """<w> <w> <email> <w> <w>|<w> write <email> .|<email> <w>|mail: <email>, <w>|<w> <w> <ip> <w> <w>|from <ip> to <w>|host <ip> , <w>|<w> <card> <w>
<w> card <card> <w> <w>|<w> <card2> <w>|<w> <phone> <w>|call <phone> <w> <w>|<w> <w> <phone2> <w>|tel. <phone2>|<w> <phone3> <w>|phone <phone4> , <w>|<w> <phone5> <w>
<w> <n> <w>|in <year> the <w>|<w> <price> <w>|<w> <version> <w>|<w> <hex> <w>|<w> @<w> <w>|<w> <badcard> <w>|<w> <badip> <w>|<time> <w>|<w> <date> <w>|<w> <n> <n> <w>
<w> <w><n> <w>|<w> <n>. <w>|<w> <n>%, <w>|<w> <n>-<n> <w>|<w> <long> <w>|<w> <hex><hex> <w>|id <badcard> <w>|<w> <decimal> <w>|(<n>) <w>|#<n> <w>""".replace("\n", "|").split("|")


def labelled_rows(copies: int = 12, seed: int = 5) -> list[tuple[str, int, int, str]]:
    """(text, start, end, kind) rows drawn from TEMPLATES; kind is empty where nothing is marked."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["th", "er", "an", "ou", "é", "st", "ing"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."])

    def card(valid: bool) -> str:
        while luhn(d := rng.choice("3456") + num(15)) != valid:
            pass
        return d

    area = lambda: f"{rng.randint(200, 999)}"
    octet = lambda: str(rng.randint(0, 255))
    make = {
        "w": word, "n": lambda: num(rng.randint(1, 6)), "year": lambda: str(rng.randint(1900, 2030)), "price": lambda: f"${num(2)}.{num(2)}", "version": lambda: f"{num(1)}.{num(1)}.{num(2)}",
        "hex": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(20)), "badcard": lambda: card(False), "badip": lambda: f"{rng.randint(256, 999)}.{octet()}.{octet()}.{octet()}", "time": lambda: f"{num(2)}:{num(2)}",
        "date": lambda: f"{num(4)}-{num(2)}-{num(2)}", "long": lambda: num(rng.randint(7, 13)), "decimal": lambda: f"{num(1)}.{num(3)}", "email": lambda: f"{word().strip('.,')}.{num(2)}@mail{num(1)}.example.com",
        "ip": lambda: ".".join((octet(), octet(), octet(), octet())), "card": lambda: card(True), "card2": lambda: re.sub("(....)(?=.)", r"\1 ", card(True)), "phone": lambda: f"+1 ({area()}) 555-{num(4)}",
        "phone2": lambda: f"({area()}) 555-{num(4)}", "phone3": lambda: f"+{num(2).replace('0', '4')} {num(3)} {num(3)} {num(4)}", "phone4": lambda: f"({area()}) {area()}-{num(4)}", "phone5": lambda: f"+1-{area()}-555-{num(4)}",
    }
    rows = []
    for template in TEMPLATES * copies:
        text, mark = "", (0, 0, "")
        for part in re.split(r"(<\w+>)", template):
            name = part.strip("<>")
            piece = make[name]() if part[:1] == "<" else part
            if name.rstrip("2345") in KINDS and part[:1] == "<":
                mark = (len(text), len(text) + len(piece), name.rstrip("2345"))
            text += piece
        rows.append((text, *mark))
    return rows


def train(labelled: DataFrame | None = None) -> Field:
    """Fit the field on a labelled table (text, start, end, kind) of at most LABELLED_ROWS rows; by default `labelled_rows`."""
    rows = labelled_rows() if labelled is None else [tuple(r) for r in labelled.select("text", "start", "end", "kind").limit(LABELLED_ROWS + 1).collect()]
    if len(rows) > LABELLED_ROWS:
        raise ValueError(f"the labelled table has more than {LABELLED_ROWS} rows")
    cells, labels = [], []
    for text, start, end, kind in rows:
        words = [m.span() for m in _WORD.finditer(text or "")]
        hit = [k for k, (a, b) in enumerate(words) if kind and a < end and start < b]
        y = np.zeros(len(words), np.int64)
        for k in hit:
            y[k] = LABELS.index(f"{'B' if k == hit[0] else 'I'}-{kind}")
        if words:
            cells.append(features([text[a:b] for a, b in words]))
            labels.append(y)
    field = Field()
    if cells:
        field.train(cells, labels)
    return field


def spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Per text its base spans and the spans the field adds."""
    base = [base_spans(t) for t in texts]
    places = [(i, w) for i, t in enumerate(texts) for w in windows(t)]
    paths = field.decode([features([texts[i][a:b] for a, b in w]) for i, w in places])
    more: list[list[Span]] = [[] for _ in texts]
    for (i, w), path in zip(places, paths, strict=True):
        if path.any():
            more[i] += _added(texts[i], w, path, base[i])
    return list(zip(base, more, strict=True))


def shown(found: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def detect(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): counts and places of the base spans, and of all spans."""
    field = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = spans(strings(batch.column("text")), field)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([shown(b) for b, _ in found]), pa.array([shown([*b, *m]) for b, m in found])], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return bounded_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, columns)


def hidden(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in sorted(found):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of `docs`, all columns, with personal data in `text` replaced."""
    field = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            found = spans([t or "" for t in texts], field)
            clean = [t and hidden(t, [*b, *m]) for t, (b, m) in zip(texts, found, strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
